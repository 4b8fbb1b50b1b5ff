"""Mixing sources to target weights by Pareto order sampling.

A source of size S with target T is to be taken rho = T / S times. Every document is certain of
floor(rho) whole copies. The rest is sampled with inclusion probability p = rho - floor(rho):
documents are ranked by (u / (1 - u)) / (p / (1 - p)) for a uniform u that is a digest of the id,
and the first of this order that fill the rest of the target are taken once more. The sample has
a fixed size in words, up to one document.

Where the order is cut is found without sorting a source in one task: sizes are summed over ever
finer ranges of the rank, first in map tasks, and only documents in the range of the cut are put
in order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.scratch import stored

MOST_COPIES = 3
#: Ranges of a source's ranks that each of the rounds tells apart.
RANGES, ROUNDS = 4096, 2
DRAW_BITS = 48


def draw(seed: str, *ids: Column) -> Column:
    """A number of 48 bits from the digest of the ids: as good as random, and the same on every run."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in ids])
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: list[float], share: float = 1.0, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in the order of their code points, null last, weigh as ``weights``, repeating. Their
    targets share ``share`` of all sizes by weight; none exceeds ``most_copies`` times its source,
    and what it leaves is shared by the others in the same way. So a source is capped exactly if
    its bound is below the level that the sources from it on, in order of bound by weight, would
    share; the levels of all prefixes are running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), place.cast("int")))
    weighed = weighed.withColumn("bound", F.col("source_size") * most_copies)
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("bound").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_bound))
    free = F.col("bound") >= F.col("level") * F.col("weight")
    # The first source that is not capped sets the level of all from it on.
    first = F.min(F.when(free, F.struct("place", "level"))).over(every)
    capped = first.isNull() | (F.col("place") < first["place"])
    target = F.when(capped, F.col("bound").cast("double")).otherwise(first["level"] * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds, mapped from [0, inf] to [0, 1] in the same order."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(p <= 0, F.lit(1.0)).otherwise(q / (1 + q))


def _cut(sized: DataFrame) -> DataFrame:
    """(row, extra): whether the document is taken once more, from (row, doc_id, source, rank, size, rest).

    Taken are the first documents by (rank, doc_id, row) of each source, as long as at least half
    of the document fits into ``rest`` words.
    """
    left = sized.withColumn("base", F.lit(0)).withColumn("low", F.lit(0).cast("bigint"))
    left = left.withColumn("at", F.floor(F.col("rank") * (1 << DRAW_BITS)))
    width, done = 1 << DRAW_BITS, []
    for _ in range(ROUNDS):
        width //= RANGES
        ranged = left.withColumn("range", F.floor((F.col("at") - F.col("low")) / width))
        per = ranged.groupBy("source", "low", "base", "range").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source").orderBy("low", "range").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0))
        per = per.select(F.col("source").alias("_source"), F.col("low").alias("_low"), F.col("range").alias("_range"),
                         "words", ahead.alias("ahead"))
        per = stored(per, "ranges")
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("low") == F.col("_low")) & (F.col("range") == F.col("_range"))
        # Where all the range fits, or nothing of it, the order within does not matter.
        told = F.when(F.col("ahead") + F.col("words") <= F.col("rest"), True).when(F.col("ahead") >= F.col("rest"), False)
        joined = ranged.join(per, same).withColumn("extra", told).withColumn("base", F.col("ahead"))
        joined = joined.withColumn("low", F.col("low") + F.col("range") * width)
        now = stored(joined.select("row", "doc_id", "source", "rank", "at", "size", "rest", "base", "low", "extra"), "told")
        done.append(now.filter("extra IS NOT NULL").select("row", "extra"))
        left = now.filter("extra IS NULL").drop("extra")
    before = Window.partitionBy("source", "low").orderBy("rank", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0))
    last = left.select("row", (at + F.col("size") / 2 <= F.col("rest")).alias("extra"))
    for d in done:
        last = last.unionByName(d)
    return last


def mix_sources(
    docs: DataFrame,
    weights: list[float] = (1, 2, 3),
    share: float = 1.0,
    most_copies: int = MOST_COPIES,
    seed: str = "mix",
    value: Column | None = None,
    row: Column | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row of ``docs``.

    docs: (doc_id, text, source). A document's size is its number of words; null and blank texts
    have size 0 and only the certain copies. ``value``, positive, makes some documents of a source
    likelier than others; without it all are equal. A null source is a source of its own, and one
    without words has target 0. Equal ranks, as of rows that repeat an id, are told apart by id and
    place. With ``row``, a number of each row, ``row`` is in the result too. Other columns are not read.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    worth = F.lit(1.0) if value is None else value.cast("double")
    each = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), "doc_id", "source",
        words.alias("size"), worth.alias("value"),
    )
    each = stored(each, "sizes")
    per = stored(
        each.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("value")).alias("worth")), "sources"
    )
    aims = targets(per.select("source", "source_size"), list(weights), share, most_copies)
    aim = aims.join(per.select(F.col("source").alias("_s"), "worth"), F.col("source").eqNullSafe(F.col("_s")))
    aim = stored(aim.select(F.col("source").alias("_source"), "source_size", "target", "worth"), "targets")
    known = each.join(aim, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.when(F.col("worth") > 0, F.col("target") / F.col("worth") * F.col("value")).otherwise(F.lit(0.0))
    known = known.withColumn("copies", F.least(copies, F.lit(float(most_copies))))
    known = known.withColumn("sure", F.floor("copies").cast("int"))
    u = (draw(seed, F.col("doc_id")) + F.lit(0.5)) / float(1 << DRAW_BITS)
    known = known.withColumn("rank", pareto_rank(u, F.col("copies") - F.col("sure")))
    known = stored(known.select("row", "doc_id", "source", "size", "source_size", "target", "sure", "rank"), "known")
    certain = known.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("certain"))
    certain = stored(certain.withColumnRenamed("source", "_source"), "certain")
    open_ = known.filter((F.col("sure") < most_copies) & (F.col("size") > 0))
    open_ = open_.join(certain, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rest", F.col("target") - F.col("certain"))
    extra = _cut(open_.select("row", "doc_id", "source", "rank", "size", "rest"))
    taken = F.col("sure") + F.coalesce(F.col("extra"), F.lit(False)).cast("int")
    return known.join(extra, "row", "left").withColumn("copies", taken).select(
        *([] if row is None else ["row"]),
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )
