"""Schemas of the stage tables and a check for stage inputs."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def _schema(columns: str) -> T.StructType:
    # StructType.fromDDL would need a running session at import.
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CRAWL_INDEX = _schema(
    "url string, fetch_time string, warc_filename string, warc_record_offset bigint, "
    "warc_record_length bigint, content_mime_detected string, crawl string"
)
SEGMENTS = CRAWL_INDEX
RAW_RECORDS = T.StructType([
    *_schema("url string, crawl string, fetch_time string, warc_filename string, warc_offset bigint").fields,
    T.StructField("raw", T.BinaryType()),
    T.StructField("error", T.StringType()),
])
RAW_HTML = _schema(
    "url string, crawl string, fetch_time string, html string, warc_filename string, warc_offset bigint"
)
CLEAN_TEXT = _schema(
    "url string, domain string, crawl string, fetch_time string, text string, word_count int"
)
CORPUS = _schema(
    "url string, domain string, crawl string, fetch_time string, word_count int, text string, year_month string"
)
DOC_SENTIMENT = _schema(
    "url string, domain string, crawl string, fetch_time string, word_count int, year_month string, "
    "sentiment_compound double, sentiment_pos double, sentiment_neg double, sentiment_neu double, "
    "partisan_score double"
)
DOC_TOPICS = _schema(
    "doc_id bigint, crawl string, url string, domain string, year_month string, topic_dist_arr array<double>, "
    "dominant_topic int"
)
DOMAIN_IDEOLOGY = _schema(
    "domain string, year_month string, doc_count bigint, ideology_score double, ideology_std double, "
    "avg_sentiment double, avg_pos_sentiment double, avg_neg_sentiment double, avg_topic_ideology double, "
    "avg_partisan_score double, median_topic int, modal_topic int"
)
CRAWL_IDEOLOGY = T.StructType([*_schema("crawl string").fields, *DOMAIN_IDEOLOGY.fields])
POLARIZATION = _schema(
    "polarization_index double, between_cluster_var double, within_cluster_var double, "
    "n_clusters bigint, n_domains bigint"
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail when the plan is built, not after hours of work, if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df
