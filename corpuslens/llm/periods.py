"""Periodic runs of words, found by recursive frequency splitting.

A run that qualifies repeats its period at least ``TIMES`` times, so each of its words occurs at
least as often within it. A word that occurs less often in a segment belongs to no run there and
splits the segment. Splitting is repeated, in all segments of a batch of texts at once, until no
word is too rare or the segment too short. Ordinary prose falls apart in a few steps; what
survives is scanned for each lag: words at the multiples of the lag are compared with the next,
so a segment of n words costs n log n comparisons, and the stretches around equal ones are
measured. Words are split by their hashes, which can only keep a segment that should fall apart;
survivors are compared by their bytes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.arrays import NOT_SPACE, chunks, span_hashes, spans

#: A run has at least ``LEAST`` words and ``TIMES`` periods.
TIMES, LEAST = 4, 6
#: Bytes of text that are split together.
BATCH = 4 << 20
#: Words that are compared first when a stretch is measured, and pairs that are probed before.
STEP, PROBES = 256, 8


def split(keys: np.ndarray, segment: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """The positions that survive: ``keys`` of words, ``segment`` of each word in ascending order.

    Returned are the surviving segments' numbers, -1 elsewhere. Only segments that changed are
    counted again, so a text that is one run is looked at twice.
    """
    out = np.full(len(keys), -1, dtype=np.int64)
    at, seg = np.arange(len(keys)), segment
    named = 0
    while len(at):
        # Segments too short go; the others are numbered from 0.
        first = np.concatenate(([True], seg[1:] != seg[:-1]))
        number = np.cumsum(first) - 1
        size = np.bincount(number)
        keep = size[number] >= least
        at, number = at[keep], number[keep]
        if not len(at):
            break
        order = np.lexsort((keys[at], number))
        k, s = keys[at][order], number[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
        group = np.cumsum(new) - 1
        rare = np.empty(len(at), dtype=bool)
        rare[order] = np.bincount(group)[group] < times
        changed = np.bincount(number, rare) > 0
        done = ~changed[number]
        if done.any():
            own = number[done]
            out[at[done]] = named + np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
            named = int(out[at[done]][-1]) + 1
        left = ~done & ~rare
        at, number = at[left], number[left]
        # A gap in the positions is where a rare word stood.
        seg = np.cumsum(np.concatenate(([0], (number[1:] != number[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else number
    return out


def _grow(ids: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest stretch [a, b) with word i whose words q apart are equal."""
    end, width = i, STEP
    while end < len(ids) - q:
        stop = min(end + width, len(ids) - q)
        differ = np.flatnonzero(ids[end:stop] != ids[end + q : stop + q])
        if len(differ):
            end += int(differ[0])
            break
        end, width = stop, 2 * width
    start, width = i, STEP
    while start > 0:
        stop = max(start - width, 0)
        differ = np.flatnonzero(ids[stop:start] != ids[stop + q : start + q])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, width = stop, 2 * width
    return start, end + q


def runs_of(ids: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run in one segment of word numbers, by start and period.

    A run at lag q holds ``need`` multiples of q in a row whose words equal those q further on, and
    all words between these multiples do, too; some of them are probed before a stretch is
    measured. Where a run of a divisor of q covers them, q is not the smallest period there. ``times`` is 2 at least.
    """
    n, found = len(ids), []
    by_period: dict[int, tuple[list[int], list[int]]] = {}
    for q in range(1, n // times + 1):
        need = max(least, times * q) // q - 1
        marks = ids[::q]
        same = marks[1:] == marks[:-1]
        if len(same) < need:
            continue
        row = same[: len(same) - need + 1].copy()
        for j in range(1, need):
            row &= same[j : len(same) - need + 1 + j]
        at = np.flatnonzero(row) * q
        for probe in range(1, PROBES + 1):
            if not len(at):
                break
            off = at + probe * (need - 1) * q // (PROBES + 1)
            at = at[ids[off] == ids[off + q]]
        if len(at):
            for p, (starts, stops) in by_period.items():
                if q % p == 0:
                    k = np.searchsorted(starts, at, side="right") - 1
                    at = at[(k < 0) | (at + need * q >= np.array(stops)[k])]
        past = 0
        for i in at.tolist():
            if i < past:
                continue
            start, stop = _grow(ids, i, q)
            past = stop - q
            if stop - start >= max(least, times * q):
                found.append((start, stop - start, q))
                of_q = by_period.setdefault(q, ([], []))
                of_q[0].append(start)
                of_q[1].append(stop)
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_in(texts: list[bytes], times: int = TIMES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = spans(buffer, NOT_SPACE)
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(text_starts, starts, side="right") - 1
    firsts = np.searchsorted(doc, np.arange(len(texts)))
    out: list[list] = [[] for _ in texts]
    segment = split(span_hashes(buffer, starts, ends), doc, times, least)
    whole = buffer.tobytes()
    kept = np.flatnonzero(segment >= 0)
    cuts = np.flatnonzero(np.diff(segment[kept])) + 1
    for part in np.split(kept, cuts) if len(kept) else []:
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(whole[a:b], len(numbers)) for a, b in zip(starts[part].tolist(), ends[part].tolist())]
        d = int(doc[part[0]])
        shift = int(part[0] - firsts[d])
        out[d] += [(s + shift, length, q) for s, length, q in runs_of(np.array(ids), times, least)]
    return out


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of the text, joined by one space, without those of a run that follow its first period."""
    tokens = text.split()
    if not runs:
        return b" ".join(tokens)
    flags = np.zeros(len(tokens) + 1, dtype=np.int64)
    for start, length, q in runs:
        flags[start + q] += 1
        flags[start + length] -= 1
    dropped = np.cumsum(flags[:-1]) > 0
    return b" ".join([tokens[i] for i in np.flatnonzero(~dropped).tolist()])


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed), one row per row of ``docs`` (doc_id, text).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, numbered from 0. ``runs`` are all stretches of at least
    ``least`` words and ``times`` times their smallest period that no neighbouring word extends,
    as (start, length, period) by start, then period; ``collapsed`` has the words, joined by one
    space, without those that repeat a run's first period. Null, empty and blank texts have no
    runs and an empty text. Rows that repeat an id or have none are taken one by one. Other
    columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b["text"].to_pylist()]
            for lo, hi in chunks(texts, BATCH):
                found = runs_in(texts[lo:hi], times, least)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in found]
                collapsed = [collapse(t, own).decode(errors="replace") for t, own in zip(texts[lo:hi], found)]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(lo, hi - lo), pa.array(rows, run_type), pa.array(collapsed, pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    read = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return read.mapInArrow(run, f"doc_id {id_type}, runs {kind}, collapsed string")


def with_loops(docs: DataFrame, every: int = 10) -> DataFrame:
    """(doc_id, text): one document in ``every``, by the CRC-32 of its id, gets a stretch of words repeated to its end.

    With h the CRC-32 of the id as text and g its quotient by ``every``, each word from a = g mod n
    on becomes word a + (i - a) mod p, for p = 1 + floor((n - a) / (3 + g mod 8)). Texts without
    words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def loop(text: bytes, g: int) -> bytes:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(tokens[:a] + [tokens[a + k % p] for k in range(n - a)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                t if t is None or g is None else loop(t, g) for t, g in zip(b["text"].to_pylist(), b["g"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.binary())], ["doc_id", "text"])

    g = F.when(h % every == 0, F.floor(h / every)).alias("g")
    read = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), g)
    return read.mapInArrow(run, f"doc_id {id_type}, text binary")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def run_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of ``periodic_runs``.

    The run reported is the longest, of equal ones the first, then the one of the smallest period;
    without runs its columns are null.
    """
    found = periodic_runs(docs)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumns({"longest": F.array_min(order), "lines": F.array_join(line, "")})
    length = -F.col("longest.n")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        F.col("longest.period").alias("period"), F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"),
        _digest(F.col("lines")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
