"""The whole study, stage by stage, with every stage stored and counted as it is written."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens import schemas
from corpuslens.defaults import (
    DOMAINS,
    LEFT_PHRASES,
    MAX_FAILED_SHARE,
    MIN_PAGE_WORDS,
    NEGATORS,
    NUM_TOPICS,
    RIGHT_PHRASES,
    TOPIC_ITERATIONS,
    URL_KEYWORDS,
    VOCAB_SIZE,
)
from corpuslens.functions.urls import has_url_keyword, in_domains
from corpuslens.operators.bootstrap import REPLICATES, index_changes, index_interval
from corpuslens.operators.clusters import (
    cluster_domains,
    cluster_summary,
    domain_features,
    label_clusters,
    label_domains,
    polarization_index,
    project_2d,
    select_k,
    standardize,
)
from corpuslens.operators.extract import extract_pages
from corpuslens.operators.ideology import composite_ideology, ideology_panel, join_scores, score_topics
from corpuslens.operators.index import filter_index
from corpuslens.operators.sentiment import BOOSTERS, score_documents, sentiment_panel
from corpuslens.operators.topics import (
    document_topics,
    fit_topics,
    save_topic_model,
    top_terms,
    topic_prevalence,
    topic_quality,
    topic_term_lists,
)
from corpuslens.operators.trends import METRICS as TREND_METRICS
from corpuslens.operators.trends import domain_trend, polarization_trend
from corpuslens.plans.corpus import build_corpus
from corpuslens.sources.archive import fetch_records, fetched, parse_records, rejected
from corpuslens.sources.stages import for_crawl, read_stage, write_csv, write_json, write_stage
from corpuslens.sources.warc import read_archive


PANEL_KEYS = ("crawl", "domain", "year_month")
METRICS = T.StructType([T.StructField("crawl", T.StringType()), *schemas.POLARIZATION.fields])


def collect_corpus(
    index: DataFrame,
    archive: str,
    out: str,
    crawl: str | None = None,
    domains: Iterable[str] = DOMAINS,
    keywords: Iterable[str] = URL_KEYWORDS,
    min_page_words: int = MIN_PAGE_WORDS,
    fraction: float = 1.0,
    max_html_chars: int | None = None,
    max_text_chars: int | None = None,
    key_chars: int | None = None,
    max_failed: float = MAX_FAILED_SHARE,
) -> dict[str, int]:
    """Crawl index to corpus under ``out``: segments, fetched, rejects, raw-html, clean-text, corpus. Returns rows per stage.

    Every stage holds its crawls apart. Texts are whole unless a length is given. Records that
    could not be read are listed in ``rejects``; more than a share of ``max_failed`` is an error.
    """
    spark = index.sparkSession
    rows = {"segments": write_stage(filter_index(index, crawl, domains, keywords, fraction=fraction), f"{out}/segments", ["crawl"])}
    manifest = read_stage(spark, f"{out}/segments", schemas.SEGMENTS)
    rows["fetched"] = write_stage(fetch_records(manifest, archive), f"{out}/fetched", ["crawl"])
    return _pages_to_corpus(spark, out, rows, min_page_words, max_html_chars, max_text_chars, key_chars, max_failed)


def collect_archive(
    spark: SparkSession,
    archive: str,
    out: str,
    crawls: Iterable[str] | None = None,
    domains: Iterable[str] = DOMAINS,
    keywords: Iterable[str] = URL_KEYWORDS,
    min_page_words: int = MIN_PAGE_WORDS,
    max_html_chars: int | None = None,
    max_text_chars: int | None = None,
    key_chars: int | None = None,
    max_failed: float = MAX_FAILED_SHARE,
    **options,
) -> dict[str, int]:
    """As ``collect_corpus``, from a folder of archive files without an index of them.

    All files of the ``crawls`` are read, of which the paths are to name each; ``options`` go to
    ``read_archive``. A part of a file that cannot be read is a reject whatever its address.
    """
    if crawls is not None:
        options["crawls"] = ",".join(crawls)
    wanted = F.col("error").isNotNull() | in_domains(F.col("url"), domains) | has_url_keyword(F.col("url"), keywords)
    records = read_archive(spark, archive, schemas.RAW_RECORDS.fieldNames(), **options).filter(wanted)
    rows = {"fetched": write_stage(records, f"{out}/fetched", ["crawl"])}
    return _pages_to_corpus(spark, out, rows, min_page_words, max_html_chars, max_text_chars, key_chars, max_failed)


def _pages_to_corpus(
    spark: SparkSession, out: str, rows: dict[str, int], min_page_words: int, max_html_chars: int | None, max_text_chars: int | None,
    key_chars: int | None, max_failed: float,
) -> dict[str, int]:
    """The stages after ``fetched``, which is stored."""
    by = ["crawl"]
    records = read_stage(spark, f"{out}/fetched", schemas.RAW_RECORDS)
    rows["rejects"] = write_stage(rejected(records), f"{out}/rejects", by)
    if rows["rejects"] > max_failed * rows["fetched"]:
        raise RuntimeError(f"{rows['rejects']} of {rows['fetched']} records could not be read, see {out}/rejects")
    rows["raw-html"] = write_stage(parse_records(fetched(records), max_html_chars=max_html_chars), f"{out}/raw-html", by)
    raw = read_stage(spark, f"{out}/raw-html", schemas.RAW_HTML)
    rows["clean-text"] = write_stage(extract_pages(raw, min_page_words, max_text_chars), f"{out}/clean-text", by)
    pages = read_stage(spark, f"{out}/clean-text", schemas.CLEAN_TEXT)
    rows["corpus"] = write_stage(build_corpus(pages, key_chars=key_chars), f"{out}/corpus", by)
    return rows


def score_corpus(
    spark: SparkSession,
    out: str,
    lexicon: DataFrame,
    left: Iterable[str] = LEFT_PHRASES,
    right: Iterable[str] = RIGHT_PHRASES,
    negators: Iterable[str] = NEGATORS,
    boosters: Mapping[str, float] = BOOSTERS,
    max_chars: int | None = None,
    min_docs: int = 10,
) -> dict[str, int]:
    """``out/corpus`` to sentiment by document and by crawl, domain and month."""
    corpus = read_stage(spark, f"{out}/corpus", schemas.CORPUS)
    scored = score_documents(corpus, lexicon, left, right, negators, boosters, max_chars)
    rows = {"sentiment/by_document": write_stage(scored, f"{out}/sentiment/by_document", ["crawl"])}
    stored = read_stage(spark, f"{out}/sentiment/by_document", schemas.DOC_SENTIMENT)
    panel = sentiment_panel(stored, min_docs, PANEL_KEYS)
    rows["sentiment/by_domain_month"] = write_stage(panel, f"{out}/sentiment/by_domain_month", ["crawl"])
    return rows


def model_topics(
    spark: SparkSession,
    out: str,
    k: int = NUM_TOPICS,
    max_iter: int = TOPIC_ITERATIONS,
    vocab_size: int = VOCAB_SIZE,
    min_df: int = 5,
) -> dict[str, int]:
    """``out/corpus`` to topic terms, fit quality, document topics and the stored model."""
    corpus = read_stage(spark, f"{out}/corpus", schemas.CORPUS)
    model = fit_topics(corpus, k, max_iter, vocab_size, min_df)
    write_json(topic_term_lists(top_terms(model)), f"{out}/topics/topic_terms")
    write_json(topic_quality(model, corpus), f"{out}/topics/quality")
    save_topic_model(model, f"{out}/topics/model")
    return {"topics/doc_topics": write_stage(document_topics(model, corpus), f"{out}/topics/doc_topics", ["crawl"])}


def score_ideology(
    spark: SparkSession, out: str, labels: DataFrame | Mapping[int, float], min_docs: int = 5, on: Iterable[str] = ("crawl", "url")
) -> dict[str, int]:
    """Document topics and sentiment to ideology by document and by domain and month."""
    topics = schemas.require_columns(
        spark.read.parquet(f"{out}/topics/doc_topics"), *schemas.DOC_TOPICS.fieldNames()
    )
    sentiment = read_stage(spark, f"{out}/sentiment/by_document", schemas.DOC_SENTIMENT)
    joined = composite_ideology(join_scores(score_topics(topics, labels), sentiment, list(on)))
    by_document = [
        "crawl", "url", "domain", "year_month", "dominant_topic", "composite_ideology", "sentiment_compound",
        "partisan_score", "topic_ideology_score",
    ]
    # The stored join feeds the panel, so it is computed once.
    write_stage(joined, f"{out}/ideology/scored")
    scored = spark.read.parquet(f"{out}/ideology/scored")
    rows = {"ideology/doc_ideology": write_stage(scored.select(*by_document), f"{out}/ideology/doc_ideology", ["crawl"])}
    rows["ideology/domain_ideology"] = write_stage(
        ideology_panel(scored, min_docs, PANEL_KEYS), f"{out}/ideology/domain_ideology", ["crawl"]
    )
    return rows


def cluster_panel(spark: SparkSession, out: str, k: int = 0, k_max: int = 8, min_docs: int = 20) -> dict[str, int]:
    """The ideology panel to labelled clusters of domains in crawls, their summary and the polarization of each crawl.

    ``k=0`` chooses k by silhouette.
    """
    panel = read_stage(spark, f"{out}/ideology/domain_ideology", schemas.CRAWL_IDEOLOGY)
    standardized = standardize(domain_features(panel, min_docs, by=("crawl", "domain")))
    if k <= 0:
        k, _ = select_k(standardized, k_max=k_max)
    placed = project_2d(cluster_domains(standardized, k)).drop("raw_features", "scaled_features")
    write_stage(placed, f"{out}/clusters/assigned")
    clusters = spark.read.parquet(f"{out}/clusters/assigned")
    labelled = label_clusters(cluster_summary(clusters), k)
    write_csv(labelled.coalesce(1).sortWithinPartitions("ideology_score_mean"), f"{out}/clusters/cluster_summary")
    write_json(
        polarization_index(clusters, by=["crawl"]).withColumn("k", F.lit(k)), f"{out}/clusters/polarization_metrics"
    )
    rows = write_stage(label_domains(clusters, labelled), f"{out}/clusters/domain_clusters")
    return {"clusters/domain_clusters": rows}


def trend_tables(
    spark: SparkSession, out: str, domains: Iterable[str] = DOMAINS, replicates: int = REPLICATES
) -> dict[str, int]:
    """The series over months and crawls under ``out/trends``: topics, chosen domains, and polarization with its intervals."""
    panel = read_stage(spark, f"{out}/ideology/domain_ideology", schemas.CRAWL_IDEOLOGY)
    clusters = spark.read.parquet(f"{out}/clusters/assigned")
    tables = {
        "topic_prevalence": topic_prevalence(spark.read.parquet(f"{out}/topics/doc_topics")),
        "polarization_trend": polarization_trend(spark.read.schema(METRICS).json(f"{out}/clusters/polarization_metrics")),
        "polarization_interval": index_interval(clusters, ["crawl"], replicates),
        "polarization_changes": index_changes(clusters, replicates=replicates),
    }
    tables |= {f"domain_{m}": domain_trend(panel, list(domains), m) for m in TREND_METRICS}
    return {f"trends/{name}": write_stage(df, f"{out}/trends/{name}") for name, df in tables.items()}


def publish_crawls(spark: SparkSession, out: str, base: str) -> list[str]:
    """Panel and metrics of each crawl under ``base/crawl``, as ``read_panel`` and ``read_metrics`` take them. Returns the crawls."""
    panel = read_stage(spark, f"{out}/ideology/domain_ideology", schemas.CRAWL_IDEOLOGY)
    metrics = spark.read.schema(METRICS).json(f"{out}/clusters/polarization_metrics")
    # One row per crawl snapshot.
    crawls = sorted(r["crawl"] for r in panel.select("crawl").distinct().collect())
    for crawl in crawls:
        write_stage(for_crawl(panel, crawl).drop("crawl"), f"{base}/{crawl}/domain_ideology")
        write_json(for_crawl(metrics, crawl).drop("crawl"), f"{base}/{crawl}/polarization_metrics")
    return crawls
