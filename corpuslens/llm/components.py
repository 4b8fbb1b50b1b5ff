"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.scratch import stored


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(both: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its neighbours. Sums form before the shuffle, hot nodes are split by the join."""
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.join(least, "u")


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (u, v); the root is the smallest node of its component.

    Each round moves every link towards the smallest node; rounds grow with the logarithm of the
    longest path. Links are tables on shared storage between rounds.
    """
    now = stored(links.filter("u > v").select("u", "v").distinct(), "links")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u > v").distinct(), "large")
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        now = stored(small.filter("u > v").distinct(), "links")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select("v").distinct()
    return stored(
        now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
            roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
        ),
        "roots",
    )
