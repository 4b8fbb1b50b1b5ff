"""From extracted pages to the corpus."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.defaults import MAX_NON_ASCII_RATIO, MIN_CORPUS_WORDS, MIN_PAGE_WORDS
from corpuslens.functions.text import cleaned, non_ascii_ratio, text_fingerprint, word_count
from corpuslens.functions.urls import crawl_month, url_fingerprint
from corpuslens.operators.dedup import APART, ORDER, earliest, keep, with_row_id
from corpuslens.operators.ledger import BLOCKS, Ledger, ledger_key
from corpuslens.schemas import require_columns
from corpuslens.sources.stages import shared_dir, write_stage


def min_words(df: DataFrame, n: int = MIN_PAGE_WORDS, text_col: str = "text") -> DataFrame:
    return df.filter(word_count(F.col(text_col)) >= n)


def ascii_only(df: DataFrame, max_ratio: float = MAX_NON_ASCII_RATIO, text_col: str = "text") -> DataFrame:
    """Rough language filter: texts with few characters outside ASCII. Empty texts are dropped."""
    return df.filter(non_ascii_ratio(F.col(text_col)) <= max_ratio)


def build_corpus(
    pages: DataFrame,
    max_ratio: float = MAX_NON_ASCII_RATIO,
    words: int = MIN_CORPUS_WORDS,
    key_chars: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Deduplicated, cleaned documents with their month.

    Copies go within each crawl: by URL first, then by whole text, then texts by language and length. Which
    copies stay is decided on fingerprints alone. The language and length filters do not
    change that choice: the first runs before the texts are shuffled, which happens once, and only texts that
    stay are cleaned. With ``only`` (crawl, url) the documents that it names are given, the same as without it.
    ``pages`` is read twice: give it as a stored table.
    """
    require_columns(pages, "url", "crawl", "fetch_time", "text")
    survivors = earliest(
        pages, [url_fingerprint(F.col("url")), text_fingerprint(F.col("text"), key_chars)], only=only
    )
    return _documents(pages, survivors, max_ratio, words)


def _documents(pages: DataFrame, survivors: DataFrame, max_ratio: float, words: int) -> DataFrame:
    """The cleaned documents of the rows whose ids survive."""
    carried = [c for c in pages.columns if c != "text"]
    texts = ascii_only(with_row_id(pages), max_ratio)
    kept = keep(texts, survivors).select(*carried, F.explode(cleaned(F.col("text"), words)).alias("text"))
    return kept.withColumn("year_month", crawl_month(F.col("crawl")))


def extend_corpus(
    pages: DataFrame,
    ledger: str,
    name: str,
    before: Sequence[str],
    max_ratio: float = MAX_NON_ASCII_RATIO,
    words: int = MIN_CORPUS_WORDS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """The documents that this instalment adds to the corpus of the instalments ``before`` it.

    Together they are the corpus that ``build_corpus`` makes of all pages at once, if instalments
    come in the order of fetch time; otherwise the first instalment that has a key keeps it. Only
    keys of earlier pages are read, from the folder ``ledger``, and the keys of this instalment are added under
    its name; an instalment that is run again replaces its own. ``pages`` is read twice.
    """
    require_columns(pages, "url", "crawl", "fetch_time", "text")
    if name in before:
        raise ValueError(f"instalment {name} cannot come before itself")
    spark = pages.sparkSession
    apart = [F.col(c) for c in APART if c in pages.columns]
    by = [c for c in ORDER if c in pages.columns]
    now = with_row_id(pages).select(
        *by, "_id1", "_id2",
        ledger_key(*apart, url_fingerprint(F.col("url"))).alias("url_key"),
        ledger_key(*apart, text_fingerprint(F.col("text"))).alias("text_key"),
    )
    for kind in ("url_key", "text_key"):
        rest = [c for c in ("text_key",) if c != kind]
        first = now.groupBy(F.col(kind).alias("key")).agg(F.min(F.struct(*by, "_id1", "_id2", *rest)).alias("_first"))
        keys = Ledger(spark, f"{ledger.rstrip('/')}/{kind}", blocks)
        path = shared_dir(spark, kind)
        write_stage(keys.new(first.select("key", "_first.*"), before), path)
        now = spark.read.parquet(path)
        keys.add(now, name)
    return _documents(pages, now.select("_id1", "_id2"), max_ratio, words)
