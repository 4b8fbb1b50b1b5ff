"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer
name, different blocks different ones; then adjacent names are paired and the pairs are named in
the same way, until one name is left for each document. Names come from sorting: blocks sort by
their 64-bit hash, and the few different blocks that share a hash by their content, whose rank is
the second part of the name. That hashes do not decide alone is checked on every level: the
contents of each hash are gathered, and equal contents collapse before the shuffle, so a block
that a third of all documents hold costs one row per map task. Contents are moved once;
afterwards only names are.

Everything here is native. A text of any length costs one pass, and the number of levels is the
logarithm of the longest text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.scratch import stored

BLOCK_BYTES = 4096
#: Stands for the missing right half of the last pair of a text.
NONE = -1


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def clashes(items: DataFrame) -> DataFrame:
    """(h, content, rank) of the different contents that share a hash; usually no row.

    items: (h, content). The rank of a content is its place in the sort order of its hash.
    """
    sets = items.groupBy("h").agg(F.collect_set("content").alias("contents")).filter(F.size("contents") > 1)
    return sets.select("h", F.posexplode(F.sort_array("contents")).alias("rank", "content"))


def name_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """items (.., h, content) with the name (h, rank) in place of the content."""
    other = found.select(F.col("h").alias("_h"), F.col("content").alias("_content"), F.col("rank").alias("_rank"))
    same = (F.col("h") == F.col("_h")) & (F.col("content") == F.col("_content"))
    return (
        items.join(other, same, "left")
        .withColumn("rank", F.coalesce("_rank", F.lit(0)))
        .drop("content", "_h", "_content", "_rank")
    )


def _blocks(docs: DataFrame, id_column: str, text_column: str, block_bytes: int) -> DataFrame:
    """One row per block: (row, id, sha, n, pos, h, content). The digest stands on block 0 only."""
    norm = docs.select(F.col(id_column).alias("id"), normalised(F.col(text_column)).alias("text"))
    rows = norm.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.sha2("text", 256).alias("sha"),
        F.col("text").cast("binary").alias("bytes"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int").alias("n"),
    )
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    items = rows.select("row", "id", "sha", "n", F.posexplode(cut).alias("pos", "content"))
    sha = F.when(F.col("pos") == 0, F.col("sha")).alias("sha")
    return items.select("row", "id", sha, "n", "pos", F.xxhash64("content").alias("h"), "content")


def identities(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, sha, n, h, rank) per row: texts are equal after normalisation where (n, h, rank) are equal."""
    items = _blocks(docs, id_column, text_column, block_bytes)
    found = stored(clashes(items.select("h", "content")), "clashes")
    level = stored(name_items(items, found), "names")
    first = level.filter("pos = 0").select("row", "id", "sha", "n", "h", "rank")
    done = first.filter("n = 1").select("id", "sha", "n", "h", "rank")
    names = level.filter("n > 1").select("row", "n", "pos", "h", "rank")
    left = names.agg(F.max("n")).first()[0] or 0
    if not left:
        return done
    while left > 1:
        half = F.col("pos") % 2

        def side(k: int, c: str) -> Column:
            return F.coalesce(F.max(F.when(half == k, F.col(c))), F.lit(NONE))

        pair = F.struct(side(0, "h").alias("a"), side(0, "rank").alias("b"), side(1, "h").alias("c"),
                        side(1, "rank").alias("d"))
        pairs = names.groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(pair.alias("content"))
        pairs = stored(pairs.withColumn("h", F.xxhash64("content")), "pairs")
        found = stored(clashes(pairs.select("h", "content")), "clashes")
        names = stored(name_items(pairs, found), "names")
        left = (left + 1) // 2
    last = names.select("row", "h", "rank")
    return done.unionByName(
        first.filter("n > 1").drop("h", "rank").join(last, "row").select("id", "sha", "n", "h", "rank")
    )


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of equal texts the row with the smallest id stays. Null and empty texts are equal to each
    other. Rows without an id stay only if no row of their group has one. Rows that repeat an
    id and its text are the same document: they count in ``group_size`` and share ``kept``.
    Other columns of ``docs`` are not read.
    """
    ids = stored(identities(docs, id_column, text_column, block_bytes), "identities")
    groups = stored(
        ids.groupBy("n", "h", "rank").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    return ids.join(groups, ["n", "h", "rank"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
