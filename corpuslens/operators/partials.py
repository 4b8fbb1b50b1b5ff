"""Panels from stored partial aggregates: a new crawl adds its part, and no document is read again.

A part has one row per group: the number of documents, a counter per topic, and of each measure its
count, sum and sum of squared deviations from its own mean. Parts are merged by addition; the
deviations are moved to the common mean, which stays exact where sums of squares would cancel.
Merged parts are parts again, so many small ones can be merged into a stored one.
"""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.schemas import require_columns
from corpuslens.sources.stages import write_stage

#: Measures of the two panels, and the names of their means there.
SENTIMENT = {
    "sentiment_compound": "avg_sentiment", "partisan_score": "avg_partisan_score", "sentiment_pos": "avg_pos", "sentiment_neg": "avg_neg",
}
IDEOLOGY = {
    "composite_ideology": "ideology_score", "sentiment_compound": "avg_sentiment", "sentiment_pos": "avg_pos_sentiment",
    "sentiment_neg": "avg_neg_sentiment", "topic_ideology_score": "avg_topic_ideology", "partisan_score": "avg_partisan_score",
}
#: Scores with four decimals at most: their sums are exact in any order.
EXACT = ("sentiment_compound", "sentiment_pos", "sentiment_neg")
GROUP = ("domain", "year_month")


def _sum(c: str) -> Column:
    values = F.col(c).cast("decimal(20,4)") if c in EXACT else F.col(c).cast("double")
    total = F.sum(values)
    return total.cast("decimal(38,4)") if c in EXACT else total


def panel_parts(
    scored: DataFrame, measures: Sequence[str], by: Sequence[str] = GROUP, topic: str | None = None
) -> DataFrame:
    """The part of these documents: ``by``, ``doc_count``, a struct (n, sum, m2) per measure, and ``topics``.

    ``topic`` names a column whose values are counted; the counters of a group are as many as there are topics.
    """
    require_columns(scored, *by, *measures)
    keys = list(by)
    stats = [
        F.struct(F.count(c).alias("n"), _sum(c).alias("sum"), (F.var_pop(c) * F.count(c)).alias("m2")).alias(c) for c in measures
    ]
    parts = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *stats)
    if topic is None:
        return parts
    counters = scored.filter(F.col(topic).isNotNull()).groupBy(*keys, F.col(topic).cast("int").alias("topic"))
    counters = counters.agg(F.count(F.lit(1)).alias("n")).groupBy(*keys)
    counters = counters.agg(F.array_sort(F.collect_list(F.struct("topic", "n"))).alias("topics"))
    renamed = counters.select(*[F.col(k).alias(f"_{k}") for k in keys], "topics")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    none = F.array().cast("array<struct<topic:int,n:bigint>>")
    return parts.join(renamed, same, "left").select(*parts.columns, F.coalesce("topics", none).alias("topics"))


def _total(values: Column, field: str, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, p: (a + F.coalesce(p[field].cast(kind), F.lit(0).cast(kind))).cast(kind))


def _merged(parts: Column, kind: str) -> Column:
    """(n, sum, m2) of all parts: their squared deviations, and n times that of each part's mean from the common one."""
    n, total = _total(parts, "n", "bigint"), _total(parts, "sum", kind)
    # Bound in a struct first, so that no part looks through all others.
    both = F.transform(F.array(F.struct(n.alias("n"), total.alias("sum"))), lambda t: F.struct(
        t["n"].alias("n"), F.when(t["n"] > 0, t["sum"]).alias("sum"),
        F.when(t["n"] > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.when(
            p["n"] > 0, p["m2"] + p["n"] * F.pow(p["sum"].cast("double") / p["n"] - t["sum"].cast("double") / t["n"], F.lit(2.0))
        ).otherwise(0.0))).alias("m2"),
    ))
    return F.get(both, F.lit(0))


def merge_parts(parts: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """One row per group from the rows of several parts, of the same columns.

    What is gathered for a group are its rows, one for each part, not its documents.
    """
    keys = list(by)
    measures = [c for c in parts.columns if c not in (*keys, "doc_count", "topics")]
    gathered = parts.groupBy(*keys).agg(
        F.sum("doc_count").alias("doc_count"), *[F.collect_list(c).alias(c) for c in measures],
        *([F.flatten(F.collect_list("topics")).alias("topics")] if "topics" in parts.columns else []),
    )
    kind = {c: "decimal(38,4)" if c in EXACT else "double" for c in measures}
    merged = [_merged(F.col(c), kind[c]).alias(c) for c in measures]
    if "topics" not in parts.columns:
        return gathered.select(*keys, "doc_count", *merged)
    names = F.array_sort(F.array_distinct(F.transform("topics", lambda t: t["topic"])))
    counters = F.transform(names, lambda k: F.struct(
        k.alias("topic"), _total(F.filter("topics", lambda t: t["topic"] == k), "n", "bigint").alias("n")
    ))
    return gathered.select(*keys, "doc_count", *merged, counters.alias("topics"))


def _mean(c: str) -> Column:
    return F.col(c)["sum"].cast("double") / F.col(c)["n"]


def _deviation(c: str) -> Column:
    """Sample deviation: 0 for equal values, null for fewer than two."""
    return F.when(F.col(c)["n"] > 1, F.sqrt(F.greatest(F.col(c)["m2"], F.lit(0.0)) / (F.col(c)["n"] - 1)))


def _median_topic(topics: Column) -> Column:
    """The smallest topic that at least half of the documents with a topic do not exceed."""
    half = _total(topics, "n", "bigint") / 2
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("topic"))

    def step(s: Column, t: Column) -> Column:
        seen = s["seen"] + t["n"]
        return F.struct(seen.alias("seen"), F.when(s["topic"].isNull() & (seen >= half), t["topic"]).otherwise(s["topic"]).alias("topic"))

    return F.aggregate(F.array_sort(topics), start, step, lambda s: s["topic"])


def _modal_topic(topics: Column) -> Column:
    return (-F.array_max(F.transform(topics, lambda t: F.struct(t["n"].alias("n"), (-t["topic"]).alias("less"))))["less"]).cast("int")


def sentiment_panel_of(parts: DataFrame, min_docs: int = 10, by: Sequence[str] = GROUP) -> DataFrame:
    """``sentiment_panel`` of all documents, from merged parts with the measures ``SENTIMENT``."""
    return parts.filter(F.col("doc_count") >= min_docs).select(
        *by, "doc_count", _mean("sentiment_compound").alias("avg_sentiment"), _deviation("sentiment_compound").alias("std_sentiment"),
        _mean("partisan_score").alias("avg_partisan_score"), _deviation("partisan_score").alias("std_partisan_score"),
        _mean("sentiment_pos").alias("avg_pos"), _mean("sentiment_neg").alias("avg_neg"),
    )


def ideology_panel_of(parts: DataFrame, min_docs: int = 5, by: Sequence[str] = GROUP) -> DataFrame:
    """``ideology_panel`` of all documents, from merged parts with the measures ``IDEOLOGY`` and topic counters."""
    topics = F.col("topics")
    return parts.filter(F.col("doc_count") >= min_docs).select(
        *by, "doc_count", _mean("composite_ideology").alias("ideology_score"), _deviation("composite_ideology").alias("ideology_std"),
        *[_mean(c).alias(name) for c, name in IDEOLOGY.items() if c != "composite_ideology"],
        _median_topic(topics).alias("median_topic"),
        F.when(F.size(topics) > 0, _modal_topic(topics)).alias("modal_topic"),
    )


def add_part(
    scored: DataFrame, base: str, crawl: str, measures: Mapping[str, str] | Sequence[str], by: Sequence[str] = GROUP, topic: str | None = None
) -> int:
    """Stores the part of a crawl under ``base``, in place of an earlier one of the same crawl; returns its rows."""
    parts = panel_parts(scored, list(measures), by, topic)
    return write_stage(parts, f"{base.rstrip('/')}/{crawl}/panel_parts")


def read_parts(spark: SparkSession, base: str, crawls: Sequence[str], by: Sequence[str] = GROUP) -> DataFrame:
    """The merged parts of all ``crawls``; each must have been added."""
    paths = [f"{base.rstrip('/')}/{c}/panel_parts" for c in crawls]
    if not paths:
        raise ValueError("no crawls")
    try:
        parts = spark.read.parquet(*paths)
    except AnalysisException as e:
        raise ValueError(f"no part of some crawl under {base}: {e}") from e
    return merge_parts(parts, by)
