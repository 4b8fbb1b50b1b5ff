"""Expressions over topic-mix arrays."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dominant_topic(shares: Column) -> Column:
    """0-based index of the first largest share."""
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("int")


def labels_map(labels: DataFrame) -> Column:
    """Topic-label table, one row per topic of a model, as one map value.

    Put it in a column before passing that to :func:`topic_ideology`.
    """
    entries = F.collect_list(F.struct(F.col("topic").cast("int"), F.col("label").cast("double")))
    return labels.agg(F.map_from_entries(entries)).scalar()


def topic_ideology(shares: Column, labels: Mapping[int, float] | Column) -> Column:
    """Mean topic label weighted by share. Unlabelled topics count 0; a null or all-zero mix gives 0."""
    shares = shares.cast("array<double>")
    if isinstance(labels, Column):
        weighted = F.transform(
            shares, lambda p, i: p * F.coalesce(F.try_element_at(labels, i), F.lit(0.0))
        )
    else:
        size = max(labels, default=-1) + 1
        values = F.array(*[F.lit(float(labels.get(i, 0.0))) for i in range(size)]).cast("array<double>")
        weighted = F.zip_with(
            shares, values, lambda p, v: F.coalesce(p, F.lit(0.0)) * F.coalesce(v, F.lit(0.0))
        )
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    score = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return F.when(total != 0, score / total).otherwise(F.lit(0.0))
