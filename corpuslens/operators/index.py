"""Crawl-index selection."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.defaults import DOMAINS, SEED, URL_KEYWORDS
from corpuslens.functions.urls import has_url_keyword, in_domains
from corpuslens.schemas import SEGMENTS, require_columns
from corpuslens.sources.stages import for_crawl


def filter_domains(df: DataFrame, domains: Iterable[str] = DOMAINS, url_col: str = "url") -> DataFrame:
    return df.filter(in_domains(F.col(url_col), domains))


def filter_url_keywords(df: DataFrame, keywords: Iterable[str] = URL_KEYWORDS, url_col: str = "url") -> DataFrame:
    return df.filter(has_url_keyword(F.col(url_col), keywords))


def sample_index(df: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """Bernoulli sample; the whole table for a fraction of 1 or more."""
    return df if fraction >= 1.0 else df.sample(fraction=fraction, seed=seed)


def sample_index_by_url(df: DataFrame, fraction: float, seed: int = SEED, url_col: str = "url") -> DataFrame:
    """Sample by a hash of the URL: the same rows whatever the partitioning."""
    if fraction >= 1.0:
        return df
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(url_col)))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.filter(bucket < int(fraction * 2**32))


def filter_index(
    index: DataFrame,
    crawl: str | None = None,
    domains: Iterable[str] = DOMAINS,
    keywords: Iterable[str] = URL_KEYWORDS,
    mime: str = "text/html",
    fraction: float = 1.0,
) -> DataFrame:
    """Manifest of the HTML captures on a listed domain or under a listed URL keyword.

    ``crawl`` prunes partitions and ``mime`` is pushed to the scan. With ``crawl=None`` all crawls are kept.
    """
    require_columns(index, *SEGMENTS.fieldNames())
    rows = index if crawl is None else for_crawl(index, crawl)
    rows = sample_index(rows, fraction)
    url = F.col("url")
    wanted = in_domains(url, domains) | has_url_keyword(url, keywords)
    return rows.filter((F.col("content_mime_detected") == mime) & wanted).select(*SEGMENTS.fieldNames())
