"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within radius 3 have a common point that is within 1 of the one and within 2 of
the other. So every fingerprint emits its variants with up to half the radius of bits flipped,
variants are shuffled, and fingerprints that emit the same variant collide. Two remarks halve
the number of variants twice without losing a pair:

* An odd distance joins fingerprints of different parity, an even one those of the same parity.
  Distances 1 and 2 meet with one flip on each side. For distance 3 it is enough that those of
  even parity emit two flips.
* Of the three differing bits two lie in the same half of the 64. So the two flips of the even
  side are taken within one half only: 1 + 64 + 992 variants, and 1 + 64 on the odd side.

A variant is not shuffled as a row of its own: a fingerprint goes once to each bucket that its
variants reach, a bucket being the value of some bits of the variant, and the variants of the
bucket are made there. Buckets that would hold too many variants are cut by further bits inside
the task, so memory is bounded. Members of one colliding group are linked to one member that is
near enough to all others, verified, and reduced to a forest, so no group emits all its pairs.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.components import connected_components
from corpuslens.llm.scratch import stored

SEED = 42
RADIUS = 3
#: Variants that one task holds at a time; 561 on average for each fingerprint.
MOST_VARIANTS = 2_000_000
MEAN_VARIANTS = 561


def shingles(text: bytes, size: int) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; of all the words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(joined, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where they are in over half of the hashes; 0 for none."""
    n = len(hashes)
    if n <= 1:
        return int(hashes[0]) if n else 0
    # Columns are summed as bytes in runs of 255 rows, which cannot overflow.
    padded = np.zeros(-(-n // 255) * 255, dtype="<u8")
    padded[:n] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle_words: int) -> int:
    return majority(shingles(text, shingle_words))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; null and empty texts have 0."""
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle_words) for t in b["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


def _bits(k: int) -> list[int]:
    """The bits that name a bucket, taken from both halves in turn."""
    return [(i // 2) + 32 * (i % 2) for i in range(k)]


def reach(fps: DataFrame, k: int, radius: int = RADIUS) -> DataFrame:
    """(bucket, fp): each fingerprint once for each bucket of k bits that its variants reach."""
    bits = _bits(k)

    def shift(fp, b):
        return F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1))

    own = F.lit(0)
    for i, b in enumerate(bits):
        own = own + shift(F.col("fp"), b) * (1 << i)
    one = [1 << i for i in range(k)]
    two = [(1 << i) | (1 << j) for i in range(k) for j in range(i) if (i - j) % 2 == 0] if radius > 2 else []
    odd, even = F.lit([0, *one]), F.lit([0, *one, *two])
    flips = F.when(F.bit_count("fp") % 2 == 1, odd).otherwise(even)
    return fps.select("fp", own.cast("int").alias("own"), F.explode(flips).alias("flip")).select(
        F.col("own").bitwiseXOR(F.col("flip")).alias("bucket"), "fp"
    )


def _masks(bits: list[int]) -> np.ndarray:
    return np.array([1 << b for b in bits], dtype=np.uint64)


def _pairs(bits: list[int]) -> np.ndarray:
    return np.array([(1 << a) | (1 << b) for a in bits for b in bits if a < b and a // 32 == b // 32], dtype=np.uint64)


def parts_of(
    fps: np.ndarray, used: np.ndarray, half: np.ndarray, free: list[int], most: int, radius: int = RADIUS
) -> Iterator[tuple]:
    """The bucket, cut by further bits until each part has at most ``most`` variants.

    used: bits already flipped to reach it, half: of the flipped bit if there is one, free: bits not yet decided.
    """
    odd = (np.bitwise_count(fps) % 2 == 1) | (radius < 3)
    per = np.where(used == 0, 1 + len(free) + ~odd * (len(free) ** 2 // 4), 1 + ~odd * (used == 1) * (len(free) // 2))
    if per.sum() > most and len(free) > 2:
        b, rest = free[0], free[1:]
        bit = (fps >> np.uint64(b)) & np.uint64(1)
        may = (used == 0) | (~odd & (used == 1) & (half == b // 32))
        for value in (0, 1):
            flip = bit != value
            go = ~flip | may
            now = np.where(flip & (used == 0), b // 32, half)
            yield from parts_of(fps[go], (used + flip)[go], now[go], rest, most, radius)
        return
    yield fps, used, half, free


def collide(
    fps: np.ndarray, used: np.ndarray, half: np.ndarray, free: list[int], radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints with a common variant in this bucket, each verified."""
    own = np.arange(len(fps), dtype=np.int32)
    odd = (np.bitwise_count(fps) % 2 == 1) | (radius < 3)
    variants, owners, firm = [], [], []

    def emit(who: np.ndarray, masks: np.ndarray, is_firm) -> None:
        if len(who) and len(masks):
            variants.append((low[who][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(who, len(masks)))
            firm.append(np.repeat(is_firm, len(masks)))

    # All variants of the bucket agree on the decided bits, so only the free ones are compared.
    # Owners with at most one flip are firm: each of them is near enough to all that share the variant.
    low = fps & np.bitwise_or.reduce(_masks(free)) if free else np.zeros_like(fps)
    zero, one, two = own[used == 0], own[used == 1], own[used == 2]
    nothing = np.zeros(1, dtype=np.uint64)
    emit(zero, nothing, np.ones(len(zero), bool))
    emit(zero, _masks(free), np.ones(len(zero), bool))
    emit(zero[~odd[zero]], _pairs(free), np.zeros((~odd[zero]).sum(), bool))
    emit(one, nothing, np.ones(len(one), bool))
    for h in (0, 1):
        at = one[~odd[one] & (half[one] == h)]
        emit(at, _masks([b for b in free if b // 32 == h]), np.zeros(len(at), bool))
    emit(two, nothing, np.zeros(len(two), bool))
    if not variants:
        return own[:0], own[:0]
    v, o, f = np.concatenate(variants), np.concatenate(owners), np.concatenate(firm)
    order = np.argsort(v, kind="stable")
    v, o, f = v[order], o[order], f[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    group = np.cumsum(new) - 1
    first = np.full(group[-1] + 1, -1, dtype=np.int64)
    firm_at = np.flatnonzero(f)[::-1]
    first[group[firm_at]] = firm_at  # the last assignment is the first firm member
    size = np.bincount(group)
    near = (size[group] > 1) & (first[group] >= 0)
    a, b = o[first[group[near]]], o[near]
    a, b = a[a != b], b[a != b]
    ok = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return a[ok], b[ok]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def near_links(fps: DataFrame, most: int = MOST_VARIANTS, radius: int = RADIUS) -> DataFrame:
    """(u, v), u > v: links whose components are those of all fingerprints within the radius, 2 or 3.

    fps: distinct fingerprints in column ``fp``. The number of buckets follows their number.
    """
    n = fps.count()
    per = MEAN_VARIANTS if radius > 2 else 65
    k = min(20, max(6, int(np.ceil(np.log2(max(1, n * per / most)))) + 1))
    bits = _bits(k)
    rest = [b for b in range(64) if b not in bits]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        target = np.uint64(sum(((int(key[0]) >> i) & 1) << b for i, b in enumerate(bits)))
        within = np.bitwise_or.reduce(_masks(bits))
        found = np.unique(rows["fp"].to_numpy().astype(np.int64).view(np.uint64))
        diff = (found & within) ^ target
        used = np.bitwise_count(diff).astype(np.int64)
        half = (diff >= np.uint64(1 << 32)).astype(np.int64)
        us, vs = [], []
        for part, u, h, free in parts_of(found, used, half, rest, most, radius):
            a, b = collide(part, u, h, free, radius)
            if len(a):
                root = forest(a, b, len(part))
                linked = np.flatnonzero(root != np.arange(len(part)))
                us.append(part[linked])
                vs.append(part[root[linked]])
        if not us:
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        x, y = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        return pd.DataFrame({"u": np.maximum(x, y), "v": np.minimum(x, y)})

    found = reach(fps, k, radius).groupBy("bucket").applyInPandas(run, "u bigint, v bigint")
    return found.groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n")).select("u", "v")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Fingerprints link at three or fewer differing bits; component_id is the smallest id that is
    reachable, itself included. Null, empty and blank texts have fingerprint zero and link like
    any other. Rows without an id belong to components but do not name them. Other columns of
    ``docs`` are not read.
    """
    each = stored(fingerprints(docs, id_column, text_column, shingle_words), "fingerprints")
    fps = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = stored(near_links(fps.select("fp")), "links")
    roots = connected_components(links)
    member = stored(fps.join(roots, fps["fp"] == roots["node"]).select("fp", "least", "root"), "members")
    least = stored(member.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stored(member.join(least, "root").select("fp", "component_id"), "named")
    final = stored(
        fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components"
    )
    return each.join(final, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
