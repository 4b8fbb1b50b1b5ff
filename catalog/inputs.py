"""Stage inputs derived from the given tables.

The ``*_SQL`` constants run unchanged in Spark SQL and in DuckDB; only the table names
differ. No given table has a crawl or a fetch time, so both are computed from the ids.
"""

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.defaults import CRAWLS, DOMAINS, LEFT_PHRASES, RIGHT_PHRASES, URL_KEYWORDS
from corpuslens.functions.topics import dominant_topic
from corpuslens.functions.urls import crawl_month
from corpuslens.operators.clusters import domain_features
from corpuslens.operators.ideology import (
    build_panel,
    composite_ideology,
    ideology_panel,
    join_scores,
    score_topics,
)
from corpuslens.operators.sentiment import lexicon_table, score_documents
from corpuslens.plans.corpus import build_corpus
from corpuslens.schemas import CRAWL_INDEX
from corpuslens.sources.archive import open_store
from corpuslens.sources.stages import read_stage, shared_dir, write_stage


def crawl_of(n: str) -> str:
    return (
        f"CASE cast(floor({n}) AS int) % 6 WHEN 0 THEN 'CC-MAIN-2022-05' WHEN 1 THEN 'CC-MAIN-2022-27' "
        "WHEN 2 THEN 'CC-MAIN-2023-06' WHEN 3 THEN 'CC-MAIN-2023-40' WHEN 4 THEN 'CC-MAIN-2024-10' "
        "ELSE 'CC-MAIN-2024-38' END"
    )


# About one document in twenty repeats the address of an earlier one with another query string.
BASE_ID = "CASE WHEN doc_id % 40 >= 20 AND doc_id % 10 = 9 THEN doc_id - 20 ELSE doc_id END"

DOCS_COLUMNS = [
    "doc_id",
    f"""concat('https://www.', source, '.example.com',
        CASE WHEN ({BASE_ID}) % 3 = 0 THEN '/politics/' ELSE '/life/' END, cast({BASE_ID} AS string),
        CASE WHEN ({BASE_ID}) <> doc_id THEN '/?ref=x' ELSE '' END) AS url""",
    "concat(source, '.example.com') AS domain",
    f"{crawl_of('doc_id / 20')} AS crawl",
    "lpad(cast((doc_id * 7919) % 1000003 AS string), 7, '0') AS fetch_time",
    "text",
]

PAGE_COLUMNS = [
    "page_id",
    "url",
    f"{crawl_of('page_id')} AS crawl",
    "lpad(cast(page_id AS string), 7, '0') AS fetch_time",
    "html",
]

RAW_COLUMN = """concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10),
    'WARC-Target-URI: ', url, chr(13), chr(10), chr(13), chr(10),
    'HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), chr(13), chr(10),
    html) AS raw"""

DOCS_SQL = "SELECT " + ", ".join(DOCS_COLUMNS) + " FROM documents"
PAGES_SQL = "SELECT " + ", ".join(PAGE_COLUMNS) + " FROM pages"
RECORDS_SQL = f"SELECT page_id, crawl, fetch_time, {RAW_COLUMN} FROM ({PAGES_SQL}) p"
INDEX_SQL = f"""SELECT url, fetch_time, concat('part-', cast(page_id % 4 AS string), '.warc') AS warc_filename,
    CASE WHEN page_id % 10 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_mime_detected, crawl
    FROM ({PAGES_SQL}) p"""

def chosen(key: str, values: list[str]) -> str:
    """The value that an integer expression selects; an empty text for one number more than there are values."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE cast(floor({key}) AS bigint) % {len(values) + 1} {cases} ELSE '' END)"


# The default lists do not occur in the invented text, so entries of them are planted: phrases in two places of
# the documents, domains and keywords in addresses. Some hosts only end like a listed domain, or lie below one.
PHRASED_SQL = f"""SELECT doc_id, concat({chosen('doc_id', LEFT_PHRASES)}, ' ', text, ' Said ', upper({chosen('doc_id / 3', RIGHT_PHRASES)}),
    '. ', {chosen('doc_id / 7', LEFT_PHRASES + RIGHT_PHRASES)}) AS text FROM documents"""
LISTED_SQL = f"""SELECT page_id, concat('https://', CASE page_id % 5 WHEN 0 THEN 'www.' WHEN 1 THEN 'Edition.' WHEN 2 THEN 'not' ELSE '' END,
    {chosen('page_id', DOMAINS)}, '/x', {chosen('page_id / 5', URL_KEYWORDS)}, cast(page_id AS string)) AS url FROM pages"""

# The word lists below occur in the invented text.
LEFT = ["of the", "to be"]
RIGHT = ["and the", "in the"]
TERMS = {
    "the": 0.5, "was": -1.2, "for": 1.1, "that": -0.8, "la": 0.7, "que": -1.5, "der": 1.9, "und": -2.3,
    "with": 2.1, "is": -0.4,
}
NEGATORS = ["on", "en", "ist"]
BOOSTERS = {"by": 0.293, "in": 0.293, "de": -0.293, "to the": 0.293, "in of": -0.293, "and a to": 0.293}
IDIOMS = {"the of": 2.0, "for the": -1.8, "of and": 0.0, "in the to": 1.2, "to the a": -1.4, "the la": 1.0}
DOMAIN_LIST = ["src1.example.com", "src2.example.com", "example.org"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*DOCS_COLUMNS)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(*PAGE_COLUMNS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr("page_id", "crawl", "fetch_time", "url", RAW_COLUMN)


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with phrases of the default lists."""
    return spark.sql(PHRASED_SQL.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages at addresses of the default domains and keywords."""
    return spark.sql(LISTED_SQL.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted pages: documents with the word count taken at extraction."""
    d = docs(spark, sf_dir)
    return d.withColumn("word_count", F.size(F.split("text", r"\s+")))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl index without record locations."""
    columns = [
        "url", "fetch_time", "concat('part-', cast(page_id % 4 AS string), '.warc') AS warc_filename",
        "cast(NULL AS bigint) AS warc_record_offset", "cast(NULL AS bigint) AS warc_record_length",
        "CASE WHEN page_id % 10 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_mime_detected", "crawl",
    ]
    return pages(spark, sf_dir).selectExpr(*columns)


def archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Archive files made from ``pages`` in a shared folder: (index with record locations, folder).

    Every task writes one file of its own; every second record is a gzip member.
    """
    root = shared_dir(spark, "archive")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        name, at = f"part-{uuid.uuid4().hex}.warc", 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for rows in batches:
                raws = [
                    gzip.compress(r.raw.encode()) if r.page_id % 2 == 0 else r.raw.encode()
                    for r in rows.itertuples(index=False)
                ]
                sizes = pd.Series([len(r) for r in raws], dtype="int64")
                out.write(b"".join(raws))
                yield pd.DataFrame({
                    "url": rows["url"], "fetch_time": rows["fetch_time"], "warc_filename": name,
                    "warc_record_offset": at + sizes.cumsum() - sizes, "warc_record_length": sizes,
                    "content_mime_detected": rows["page_id"].mod(10).eq(0).map(
                        {True: "application/pdf", False: "text/html"}
                    ),
                    "crawl": rows["crawl"],
                })
                at += int(sizes.sum())

    # Stored, so that every file is written once whatever is done with the index.
    located = records(spark, sf_dir).mapInPandas(write, CRAWL_INDEX)
    path = shared_dir(spark, "index")
    write_stage(located, path)
    return read_stage(spark, path, CRAWL_INDEX), root


def warc_record(kind: str, url: str, date: str, block: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive_folder(spark: SparkSession, sf_dir: str) -> str:
    """Archive files made from ``pages``, in a shared folder by crawl.

    Each task writes two files of its own for a crawl, one of gzip members and one that is not
    compressed. Before each response stands the request for it.
    """
    root = shared_dir(spark, "crawl-data")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        own, files = uuid.uuid4().hex, {}
        for rows in batches:
            for r in rows.itertuples(index=False):
                zipped = r.page_id % 3 > 0
                key = (r.crawl, "warc.gz" if zipped else "warc")
                if key not in files:
                    store.create_dir(f"{base}/{r.crawl}", recursive=True)
                    files[key] = store.open_output_stream(f"{base}/{r.crawl}/part-{own}.{key[1]}", compression=None)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + r.html.encode()
                for data in (
                    warc_record("request", r.url, r.fetch_time, b"GET / HTTP/1.1\r\n\r\n"),
                    warc_record("response", r.url, r.fetch_time, http),
                ):
                    files[key].write(gzip.compress(data) if zipped else data)
        for f in files.values():
            f.close()
        yield pd.DataFrame({"files": [len(files)]})

    written = pages(spark, sf_dir).mapInPandas(write, "files bigint")
    written.write.parquet(shared_dir(spark, "files"))
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a stage table, as later stages get it, so that several readers compute it once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    write_stage(df, path)
    return spark.read.parquet(path)


def lexicon(spark: SparkSession) -> DataFrame:
    return lexicon_table(spark, TERMS)


def corpus(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    return build_corpus(clean_pages(spark, sf_dir), only=only)


def scored(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Scores of the whole corpus, or of the documents (crawl, url) that a join with other scores can keep."""
    return score_documents(corpus(spark, sf_dir, only), lexicon(spark), LEFT, RIGHT, NEGATORS, BOOSTERS, idioms=IDIOMS)


def doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic mixes from the embeddings: 64 unnormalised shares per document."""
    shares = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS doc_id", "transform(embedding, x -> cast(abs(x) AS double)) AS topic_dist_arr"
    )
    known = docs(spark, sf_dir).select("doc_id", "url", "domain", "crawl")
    joined = known.join(shares, "doc_id").withColumn("year_month", crawl_month(F.col("crawl")))
    return joined.withColumn("dominant_topic", dominant_topic(F.col("topic_dist_arr")))


LABELS = {i: -1 + 2 * i / 63 for i in range(64)}
PANEL_DOCS, DOMAIN_DOCS, VIEW_DOCS = 2, 10, 15


def topic_and_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = doc_topics(spark, sf_dir)
    return join_scores(score_topics(topics, LABELS), scored(spark, sf_dir, topics.select("crawl", "url")))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite_ideology(topic_and_sentiment(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideology_panel(joined(spark, sf_dir), PANEL_DOCS)


def panels_by_crawl(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    whole = stored(panel(spark, sf_dir), "panel")
    return {c: whole.filter(F.col("year_month") == crawl_month(F.lit(c))) for c in CRAWLS}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_features(panel(spark, sf_dir), DOMAIN_DOCS)


# Numbers of clusters whose centres are given, loadings of the six features, languages as topics.
GIVEN_K = [2, 3, 5]
LOADINGS = [[0.5, -0.25], [0.25, 0.5], [-0.125, 0.75], [0.0, 0.25], [0.375, -0.5], [-0.5, 0.125]]
LANGS = ["de", "en", "es", "fr"]
CLUSTER = "cast(substring(domain, 4, instr(domain, '.') - 4) AS int) % 5 AS cluster"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed assignment of the domains, so that results do not depend on K-means."""
    return features(spark, sf_dir).selectExpr("*", CLUSTER)


def crawl_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_crawl = domain_features(
        build_panel(panels_by_crawl(spark, sf_dir)), PANEL_DOCS, by=("crawl", "domain")
    )
    return by_crawl.selectExpr("*", CLUSTER)
