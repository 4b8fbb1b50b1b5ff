"""Main text of pages by markup and by the difference to the page with the nearest URL.

Pages of a host are put in the order of their URL paths, and each is paired with the neighbour
whose path has more in common with its own. The lines of both are aligned by their longest common
subsequence, and what they share is taken for the template of the site and deleted. Lines that
the markup declares to be the article stay, since pages also share passages and whole articles;
declared furniture goes whether it is shared or not, since adverts and menus also differ from
page to page. So the difference decides about the pages and lines that the markup leaves open.

The order of a host with a third of all pages is not made in one task: pages are sorted by range,
and only the first and last page of each range meet on the driver. Texts are not shuffled for the
alignment, hashes of lines are; lines to be deleted come back as numbers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.markup import ARTICLE, OPEN, lines
from corpuslens.llm.scratch import stored


#: Bits of the table of an alignment that are held at a time.
TABLE_BITS = 1 << 28


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each line of ``a`` the row of the table: bit j is clear where the common subsequence with b[: j + 1] is longer than with b[:j]."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        both = row & masks.get(x, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with b[:0], b[:1], ..."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[int], b: list[int], first: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        # Half of a with the part of b that suits both halves best, then the other half.
        n = len(a) // 2
        j = int(np.argmax(_lengths(a[:n], b) + _lengths(a[n:][::-1], b[::-1])[::-1]))
        return _aligned(a[:n], b[:j], first) + _aligned(a[n:], b[j:], first + n)
    table, found = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or table[i - 1] >> (j - 1) & 1:
            found.append(first + i)
            j -= 1
    return found[::-1]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, repeated lines included.

    Equal ends are taken off first. The table of the rest is made by rows of bits, so a machine word
    stands for 64 pairs of lines; if it is large, it is made in halves.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return [*range(lo), *_aligned(a[lo : len(a) - hi], b[lo : len(b) - hi], lo), *range(len(a) - hi, len(a))]


def _parsed(pages: DataFrame) -> DataFrame:
    """(key, host, path, page_id, states, hashes): hashes of all lines of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lines(t or "") for t in b["html"].to_pylist()]
            states = pa.array([bytes(s for s, _ in x) for x in found], pa.binary())
            hashes = pa.array(
                [np.array([xxhash.xxh64_intdigest(t.encode(errors="replace")) for _, t in x], "<u8").tobytes() for x in found],
                pa.binary(),
            )
            cols = [b[c] for c in ("key", "host", "path", "page_id")]
            yield pa.RecordBatch.from_arrays([*cols, states, hashes], ["key", "host", "path", "page_id", "states", "hashes"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("key", "host", "path", "page_id", "html").mapInArrow(
        run, f"key bigint, host string, path string, page_id {id_type}, states binary, hashes binary"
    )


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def partners(parsed: DataFrame) -> DataFrame:
    """(key, partner): the neighbour in (host, path, key) order with the longer common path; ties go to the one before.

    Pages without a host, and those alone in it, have none.
    """
    ordered = parsed.filter("host IS NOT NULL").select("host", "path", "key").distinct()
    ordered = ordered.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        names = ["host", "path", "key", "before", "before_path", "part", "first"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
        for b in batches:
            out = []
            for host, path, key in zip(b["host"].to_pylist(), b["path"].to_pylist(), b["key"].to_pylist()):
                same = last is not None and last[0] == host
                out.append((host, path, key, last[2] if same else None, last[1] if same else None, part, last is None))
                last = (host, path, key)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else
                                             [pa.array([], t) for t in kinds], names)

    kind = "host string, path string, key bigint, before bigint, before_path string, part int, first boolean"
    rows = stored(ordered.mapInArrow(run, kind), "order")
    # Two rows for each range of the sort.
    last = rows.groupBy("part").agg(F.max(F.struct("host", "path", "key")).alias("last")).collect()
    first = {r["part"]: r for r in rows.filter("first").collect()}
    at, met = sorted(first), []
    ends = {r["part"]: r["last"] for r in last}
    for x, y in zip(at, at[1:]):
        if ends[x]["host"] == first[y]["host"]:
            met.append((first[y]["path"], first[y]["key"], ends[x]["key"], ends[x]["path"]))
    pairs = rows.filter("before IS NOT NULL").select("path", "key", "before", "before_path")
    pairs = pairs.unionByName(
        rows.sparkSession.createDataFrame(met, "path string, key bigint, before bigint, before_path string")
    )

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([_common(x, y) for x, y in zip(b["path"].to_pylist(), b["before_path"].to_pylist())], pa.int32())
            yield pa.RecordBatch.from_arrays([b["key"], b["before"], n], ["key", "before", "common"])

    each = pairs.mapInArrow(common, "key bigint, before bigint, common int")
    sides = each.select("key", F.struct("common", F.lit(1).alias("is_before"), F.col("before").alias("other")).alias("s")).unionByName(
        each.select(F.col("before").alias("key"), F.struct("common", F.lit(0).alias("is_before"), F.col("key").alias("other")).alias("s"))
    )
    return sides.groupBy("key").agg(F.max("s")["other"].alias("partner"))


def deletions(parsed: DataFrame) -> DataFrame:
    """(key, page_id, deleted): numbers of the open lines that a page shares with its partner."""
    mine = partners(parsed).join(parsed.select("key", "page_id", "states", "hashes").dropDuplicates(["key"]), "key")
    other = parsed.select(F.col("key").alias("partner"), F.col("hashes").alias("other")).dropDuplicates(["partner"])
    id_type = parsed.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for i, (s, x, y) in enumerate(zip(*[b[c].to_pylist() for c in ("states", "hashes", "other")])):
                kept = {n for n, k in enumerate(s) if k == (ARTICLE if ARTICLE in s else OPEN)}
                gone = [n for n in shared_lines(np.frombuffer(x, "<u8").tolist(), np.frombuffer(y, "<u8").tolist())
                        if n in kept and s[n] == OPEN]
                # A page of which nothing would be left is a copy of its neighbour.
                if gone and len(gone) < len(kept):
                    keys.append(i)
                    out.append(gone)
            at = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["key"].take(at), b["page_id"].take(at), pa.array(out, pa.list_(pa.int32()))], ["key", "page_id", "deleted"]
            )

    return mine.join(other, "partner").mapInArrow(run, f"key bigint, page_id {id_type}, deleted array<int>")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of (page_id, url, html).

    The text is that of the declared article, or else of the lines that are neither declared
    furniture nor shared with the nearest page of the host; blocks are joined by one space. Null
    and empty pages have an empty text. Pages without a URL have no neighbour. Rows that repeat a
    page have the same text. Other columns are not read.
    """
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    read = pages.select(
        "page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"),
        F.when(host != "", host).alias("host"), path.alias("path"),
    )
    parsed = stored(_parsed(read), "parsed")
    gone = stored(deletions(parsed), "deletions").select(F.col("key").alias("_key"), F.col("page_id").alias("_id"), "deleted")
    same = (F.col("key") == F.col("_key")) & F.col("page_id").eqNullSafe(F.col("_id"))
    both = read.join(gone, same, "left").select("page_id", "url", "html", "deleted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, deleted in zip(b["html"].to_pylist(), b["deleted"].to_pylist()):
                found = lines(page or "")
                want = ARTICLE if any(s == ARTICLE for s, _ in found) else OPEN
                without = set(deleted or ())
                out.append(" ".join(t for n, (s, t) in enumerate(found) if s == want and n not in without))
            text = pa.array(out, pa.string())
            n = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], text, n], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return both.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
