"""Series over months and crawls."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("ideology_score", "avg_sentiment", "avg_partisan_score")


def domain_trend(panel: DataFrame, domains: Iterable[str], metric: str = "ideology_score") -> DataFrame:
    """Rows (domain, year_month, metric) of the chosen domains, by month."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    chosen = panel.filter(F.col("domain").isin(list(domains)))
    return chosen.select("domain", "year_month", metric).orderBy("year_month", "domain")


def polarization_trend(metrics: DataFrame) -> DataFrame:
    """One row: first and last crawl, their polarization index, and the change between them."""
    first = F.min_by("polarization_index", "crawl")
    last = F.max_by("polarization_index", "crawl")
    return metrics.agg(
        F.count(F.lit(1)).alias("n_crawls"),
        F.min("crawl").alias("earliest_crawl"),
        first.alias("earliest_index"),
        F.max("crawl").alias("latest_crawl"),
        last.alias("latest_index"),
        (last - first).alias("delta"),
        F.max_by("between_cluster_var", "crawl").alias("latest_between_var"),
        F.max_by("within_cluster_var", "crawl").alias("latest_within_var"),
    )
