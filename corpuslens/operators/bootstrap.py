"""How sure the polarization index and its changes are: intervals by a Poisson bootstrap in one pass.

Every domain counts a number of times in each replicate, which is drawn from the digest of domain
and replicate: the same on every run and in every crawl. So no sample is drawn or kept, partial
sums of all replicates form in the map tasks, and changes between crawls compare like with like.
"""

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.defaults import SEED

REPLICATES, LEVEL = 200, 0.95
#: Of 2**32 equally likely digests, so many give at most 0, 1, 2, ... by the Poisson law of mean 1.
THRESHOLDS = [int(2**32 * p) for p in accumulate(exp(-1) / factorial(k) for k in range(12))]


def poisson_weight(key: Column, replicate: Column, seed: int = SEED) -> Column:
    """How often a key counts in a replicate."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), replicate.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.size(F.filter(F.lit(THRESHOLDS).cast("array<bigint>"), lambda t: t <= u))


def replicated_index(
    clusters: DataFrame, by: Sequence[str] = (), replicates: int = REPLICATES, key: str = "domain", seed: int = SEED
) -> DataFrame:
    """(by, replicate, polarization_index): replicate 0 counts every domain once.

    A domain without a score counts nowhere; a replicate that leaves no domain of a group has no row.
    """
    group = list(by)
    rows = clusters.filter(F.col("ideology_score").isNotNull()).select(
        *group, F.lit(0).alias("_all"), "cluster", F.col(key).alias("_key"), F.col("ideology_score").alias("_x")
    )
    # Scores less the mean of their group, so that sums of squares do not cancel.
    centre = rows.groupBy(*group, "_all").agg(F.avg("_x").alias("_centre"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_all"]]
    moved = rows.alias("a").join(centre.alias("b"), same).select("a.*", (F.col("_x") - F.col("_centre")).alias("_d"))
    each = moved.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    each = each.withColumn("_w", F.when(F.col("replicate") == 0, 1).otherwise(poisson_weight(F.col("_key"), F.col("replicate"), seed)))
    w, d = F.col("_w"), F.col("_d")
    stats = each.filter(w > 0).groupBy(*group, "replicate", "cluster").agg(
        F.sum(w).alias("_n"), F.sum(w * d).alias("_s"), F.sum(w * d * d).alias("_q")
    )
    n, mean = F.col("_n"), F.col("_s") / F.col("_n")
    var = F.when(n > 1, F.greatest((F.col("_q") - n * mean * mean) / (n - 1), F.lit(0.0))).otherwise(0.0)
    stats = stats.select(*group, "replicate", "_n", "_s", mean.alias("_mean"), var.alias("_var"))
    total, mean = F.sum(n), F.col("_mean")
    sums = stats.groupBy(*group, "replicate").agg(
        (F.sum(n * mean * mean) / total - F.pow(F.sum("_s") / total, 2)).alias("_between"), (F.sum(n * F.col("_var")) / total).alias("_within")
    )
    between, within = F.greatest(F.col("_between"), F.lit(0.0)), F.col("_within")
    index = F.when(between + within > 0, between / (between + within)).otherwise(0.0)
    return sums.select(*group, "replicate", index.alias("polarization_index"))


def _bounds(value: Column, level: float) -> list[Column]:
    drawn = F.when(F.col("replicate") > 0, value)
    tail = (1 - level) / 2
    return [F.percentile(drawn, F.lit(tail)), F.percentile(drawn, F.lit(1 - tail))]


def index_interval(
    clusters: DataFrame, by: Sequence[str] = (), replicates: int = REPLICATES, level: float = LEVEL, digits: int = 4, seed: int = SEED
) -> DataFrame:
    """The polarization index of each group with the interval that holds ``level`` of its replicates."""
    value = F.col("polarization_index")
    low, high = _bounds(value, level)
    found = replicated_index(clusters, by, replicates, seed=seed).groupBy(*by).agg(
        F.max(F.when(F.col("replicate") == 0, value)).alias("polarization_index"), low.alias("low"), high.alias("high")
    )
    return found.select(*by, *[F.round(c, digits).alias(c) for c in ("polarization_index", "low", "high")])


def index_changes(
    clusters: DataFrame, crawl: str = "crawl", replicates: int = REPLICATES, level: float = LEVEL, digits: int = 4, seed: int = SEED
) -> DataFrame:
    """(crawl, change, low, high): the change of the index from the crawl before, in order of name.

    Changes are taken within replicates, where a domain counts equally often in both crawls.
    An interval without 0 is a change that the choice of domains does not explain.
    """
    index = replicated_index(clusters, [crawl], replicates, seed=seed)
    before = F.lag("polarization_index").over(Window.partitionBy("replicate").orderBy(crawl))
    changes = index.withColumn("change", F.col("polarization_index") - before)
    low, high = _bounds(F.col("change"), level)
    found = changes.groupBy(crawl).agg(
        F.max(F.when(F.col("replicate") == 0, F.col("change"))).alias("change"), low.alias("low"), high.alias("high")
    )
    return found.filter("change IS NOT NULL").select(crawl, *[F.round(c, digits).alias(c) for c in ("change", "low", "high")])
