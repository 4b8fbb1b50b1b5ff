"""Benchmark decontamination with a broadcast hash set of the n-grams of all items.

The windows of the items are hashed once and broadcast in parts of a bounded number, whatever the
size of the benchmark; every part is one pass over the documents. A pass hashes the word windows
of whole texts in batches, looks them up in the set, and compares the words of each hit, so equal
hashes alone never count.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.arrays import LETTERS_DIGITS, Words, chunks
from corpuslens.llm.scratch import stored

WINDOW = 10
#: Item windows that are broadcast at a time: some 200 bytes each.
MOST_WINDOWS = 200_000


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, words, size, items): the different windows of all items, and the items that have each.

    An item of fewer than ``window`` words is one window; one without words has none. Items
    without an id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b["item_id"].to_pylist(), [t or b"" for t in b["text"].to_pylist()]
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi], LETTERS_DIGITS)
                for size in {min(window, int(n)) for n in w.counts if n}:
                    for i, h in zip(*w.windows(size)):
                        if min(window, w.counts[w.doc[i]]) == size:
                            for col, v in zip(rows, (ids[lo + w.doc[i]], int(h.view(np.int64)), w.text(i, size), size)):
                                col.append(v)
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(rows, kinds)], ["item", "hash", "words", "size"]
            )

    read = benchmark.filter("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    found = read.mapInArrow(run, "item string, hash bigint, words binary, size int")
    return found.groupBy("hash", "words", "size").agg(F.collect_set("item").alias("items"))


def _ranges(flags: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges.reshape(-1, 2).tolist()


def _scan(docs: DataFrame, windows: list, id_type: str) -> DataFrame:
    """(doc_id, n_words, hits, items): merged ranges of hit words, ids of the items found."""
    known = {bytes(r["words"]): r["items"] for r in windows}
    by_size: dict[int, np.ndarray] = {}
    for size in {r["size"] for r in windows}:
        by_size[size] = np.unique(np.array([r["hash"] for r in windows if r["size"] == size], dtype=np.int64).view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast((known, by_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_size = sent.value
        sieves = {}
        for size, hashes in by_size.items():
            sieves[size] = sieve = np.zeros(1 << 22, dtype=bool)
            sieve[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for b in batches:
            texts = [t or b"" for t in b["text"].to_pylist()]
            n_words, hits, items = [], [], []
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi], LETTERS_DIGITS)
                hit = np.zeros(len(w.hashes) + 1, dtype=np.int32)
                found: list[set[str]] = [set() for _ in range(lo, hi)]
                for size, hashes in by_size.items():
                    at, h = w.windows(size)
                    maybe = np.flatnonzero(sieves[size][(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    k = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                    for i in at[maybe[hashes[k] == h[maybe]]].tolist():
                        if got := known.get(w.text(i, size)):
                            found[w.doc[i]].update(got)
                            hit[i] += 1
                            hit[i + size] -= 1
                flags = np.cumsum(hit[:-1]) > 0
                n_words += w.counts.tolist()
                items += [sorted(x) for x in found]
                for d in range(hi - lo):
                    first, n = w.firsts[d], w.counts[d]
                    hits.append(_ranges(flags[first : first + n]) if found[d] else [])
            out = [b["doc_id"], pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))),
                   pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "hits", "items"])

    read = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, f"doc_id {id_type}, n_words bigint, hits array<array<bigint>>, items array<string>")


def _without(text: bytes, w: Words, d: int, own: list[list[int]]) -> str:
    """The text without the hit words and what stands between them."""
    base, first = w.text_starts[d], w.firsts[d]
    kept, at = [], 0
    for a, b in own:
        kept.append(text[at : w.starts[first + a] - base])
        at = w.ends[first + b - 1] - base
    return b"".join([*kept, text[at:]]).decode(errors="replace")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS
) -> DataFrame:
    """(doc_id, n_words, n_hit, items), one row per row of ``docs``.

    docs: (doc_id, text), benchmark: (item_id, text). Null and empty texts have no words and no
    hits. n_hit counts the words inside any occurrence of a window; items are the ids found,
    sorted as strings. An empty benchmark hits nothing. Other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    windows = stored(item_windows(benchmark, window), "windows")
    n = windows.count()
    parts = max(1, -(-n // most_windows))
    if parts == 1:
        one = _scan(docs, windows.collect(), id_type)
        length = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, r: s + r[1] - r[0])
        return one.select("doc_id", "n_words", length.alias("n_hit"), "items")
    # Row numbers tell repeated ids apart; they are stored once, so that every part sees the same.
    each = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "documents")
    scans = []
    for k in range(parts):
        part = windows.filter(F.pmod("hash", F.lit(parts)) == k).collect()
        by_row = _scan(each.select(F.col("row").alias("doc_id"), "text"), part, "bigint")
        scans.append(stored(by_row, "part"))
    every = reduce(DataFrame.unionByName, scans)
    cover = every.select("doc_id", F.explode("hits").alias("r")).select(
        "doc_id", F.explode(F.sequence(F.col("r")[0], F.col("r")[1] - 1)).alias("word")
    )
    n_hit = cover.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    whole = every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    both = whole.join(n_hit, "doc_id", "left").withColumnRenamed("doc_id", "row")
    return both.join(each.select("row", "doc_id"), "row").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items"
    )


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row, see ``find_leaks``."""
    return find_leaks(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(doc_id, text), one row per row of ``docs``, with each run of hit words cut out.

    The hits of all windows are found first and cut out once, so the result does not depend on
    the parts in which a large benchmark is sent. Texts without hits are unchanged, null becomes
    empty. Rows that repeat an id or have none are cut one by one.
    """
    each = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "documents")
    windows = stored(item_windows(benchmark, window), "windows")
    parts = max(1, -(-windows.count() // most_windows))
    scans = []
    for k in range(parts):
        part = windows.filter(F.pmod("hash", F.lit(parts)) == k).collect()
        found = _scan(each.select(F.col("row").alias("doc_id"), "text"), part, "bigint")
        scans.append(stored(found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("hit_row"), "hits"), "hits"))
    hits = reduce(DataFrame.unionByName, scans).groupBy("hit_row").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for t, own in zip(b["text"].to_pylist(), b["hits"].to_pylist()):
                text = t or b""
                if own:
                    w = Words([text], LETTERS_DIGITS)
                    flags = np.zeros(int(w.counts[0]) + 1, dtype=np.int64)
                    for first, end in own:
                        flags[first] += 1
                        flags[end] -= 1
                    text = _without(text, w, 0, _ranges(np.cumsum(flags[:-1]) > 0)).encode()
                cut.append(text.decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(cut, pa.string())], ["doc_id", "text"])

    joined = each.join(hits, F.col("row") == F.col("hit_row"), "left")
    read = joined.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), "hits")
    return read.mapInArrow(run, f"doc_id {id_type}, text string")
