"""Importance resampling of documents towards a target distribution over hashed word n-grams.

Counts of n-gram buckets over all documents and over all target texts give every bucket a gain,
the logarithm of the ratio of its shares; a document weighs the mean gain of its n-grams, and the
draw is by weight plus Gumbel noise from a digest of its id, which samples without replacement.

Both passes over the texts intern the n-grams of a batch in an open-addressed table of numpy
arrays. A slot is found by the xxhash64 of the n-gram, and its bytes are compared, so that two
n-grams with one hash have two slots. Slots store the bucket and the count: a bucket is computed
once for each different n-gram, and the slot ids of all occurrences gather the gains.

The draw ranks narrow rows by a range shuffle: places within a range and the sizes of the ranges
before it make the rank, so no task sees more than one range.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.arrays import LETTERS_DIGITS, chunks
from corpuslens.llm.scratch import stored

ORDER, BUCKETS, SHARE_PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Bytes of text whose n-grams share a table.
BATCH = 4 << 20
#: Lower-cases A-Z; every byte that belongs to no word becomes a space.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if LETTERS_DIGITS[b] else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def ngrams(tokens: list[bytes], order: int) -> list[bytes]:
    """All runs of 1 to ``order`` consecutive words, each joined by one space, repeats included."""
    found = list(tokens)
    for n in range(2, order + 1):
        found += [b" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
    return found


class Interned:
    """The different n-grams of a batch in an open-addressed table with linear probing.

    ``slot`` is the slot id of every occurrence; ``bucket`` and ``count`` belong to slots, and
    ``used`` lists the slots that are taken. ``digest`` is the hash of the keys.
    """

    def __init__(self, grams: list[bytes], buckets: int, digest=xxhash.xxh64_intdigest):
        n = len(grams)
        size = 1 << max(4, (2 * n - 1).bit_length())
        mask = np.uint64(size - 1)
        gram = np.empty(n, dtype=object)
        gram[:] = grams
        key = np.fromiter(map(digest, grams), dtype=np.uint64, count=n)
        owner = np.full(size, -1, dtype=np.int64)
        self.slot = np.zeros(n, dtype=np.int64)
        at, open_ = (key & mask).astype(np.int64), np.arange(n)
        while len(open_):
            free = owner[at] < 0
            # Several may claim a slot at once: the last one written has it, the others compare with it.
            owner[at[free]] = open_[free]
            own = owner[at]
            same = key[own] == key[open_]
            sure = np.flatnonzero(same)
            same[sure] = gram[own[sure]] == gram[open_[sure]]
            self.slot[open_[same]] = at[same]
            open_, at = open_[~same], (at[~same] + 1) & int(mask)
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, dtype=np.int64)
        first = gram[owner[self.used]]
        self.bucket[self.used] = np.fromiter(map(zlib.crc32, first), dtype=np.int64, count=len(first)) % buckets


def _batches(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[tuple]:
    """(batch, first row, words per row, n-grams per row, table) of ranges of rows of about BATCH bytes."""
    for b in batches:
        texts = [t or b"" for t in b["text"].to_pylist()]
        for lo, hi in chunks(texts, BATCH):
            tokens = [words(t) for t in texts[lo:hi]]
            grams = [ngrams(t, order) for t in tokens] if order > 1 else tokens
            table = Interned([g for own in grams for g in own], buckets)
            yield b, lo, np.array([len(t) for t in tokens]), np.array([len(g) for g in grams]), table


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all ``texts`` (text) fall into each bucket: summed in tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for *_, table in _batches(batches, order, buckets):
            np.add.at(total, table.bucket[table.used], table.count[table.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = _text(texts).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, dtype=np.int64)
    # At most one row for each bucket.
    for r in found.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's share of the target to its share of the source, one added to each count."""
    s, t, n = float(source.sum()), float(target.sum()), float(len(source))
    both = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in both], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of the n-grams of each text, rounded down; 0 without any."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, n_words, n_grams, table in _batches(batches, order, len(sent.value)):
            ends = np.cumsum(n_grams)
            run_sums = np.concatenate(([0], np.cumsum(sent.value[table.bucket[table.slot]])))
            weight = (run_sums[ends] - run_sums[ends - n_grams]) // np.maximum(n_grams, 1)
            columns = [b["doc_id"].slice(lo, len(ends)), *map(pa.array, (n_words, n_grams, weight))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _text(docs, "doc_id").mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: int, id_column: Column) -> Column:
    """floor(-1000 ln(-ln u)) for a u from the digest of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def _ranked(rows: DataFrame, taken: int, *order: Column) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``taken`` in the order, null for the others."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row tells its partition and its place in it.
    placed = stored(sorted_.withColumn("place", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = placed.join(F.broadcast(stored(ahead, "ahead")), part == F.col("part"))
    rank = F.col("ahead") + within + 1
    return ranked.withColumn("rank", F.when(rank <= taken, rank)).select(*rows.columns, "rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    order: int = ORDER,
    buckets: int = BUCKETS,
    percent: int = SHARE_PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``.

    docs: (doc_id, text), target: (text). ``percent`` of the documents with at least ``min_words``
    words, rounded down, are drawn: those of the highest score, ties to the smaller id, a null id
    last, then to fewer features; their rank counts from 1, the others have none. Null and empty
    texts have no features and weight 0. Rows that repeat an id have the same noise and are ranked
    one by one. A null id is drawn by the digest of ``null``. Without target texts a rare bucket gains most. Other
    columns are not read.
    """
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    weighed = weigh(docs, gain, order).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    each = stored(weighed, "weighed")
    able = each.filter(F.col("n_words") >= min_words)
    taken = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    place = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.desc("weight")]
    drawn = _ranked(able.select(*columns), taken, *place)
    rest = each.filter(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)
