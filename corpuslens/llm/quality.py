"""Quality by logistic regression over hashed word n-grams.

The weights are trained with follow-the-regularised-leader updates, one document at a time, and
a document's score is a sparse dot product. Words are runs of letters and digits and runs of
other marks; features are words, pairs of adjacent words, and the pair of a word with itself,
whichever it is. They are weighted by the logarithm of their number and scaled to length one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.arrays import chunks, mix, span_hashes
from corpuslens.llm.folds import held_out, learned

HASH_BITS = 18
#: Labelled documents that the weights are fitted on, at most, and passes over them.
SAMPLE, EPOCHS = 20_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: 0 white space, 1 letters and digits, 2 other marks.
_CLASS = np.array(
    [0 if b in (9, 10, 11, 12, 13, 32) else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.int8
)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of each different feature, ordered by text.

    Bucket 0 is the constant, bucket 1 a repeated word.
    """
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    kind = _CLASS[buffer]
    edges = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(buffer)]))
    starts, ends = edges[:-1], edges[1:]
    if len(buffer):
        word = kind[starts] != 0
        starts, ends = starts[word], ends[word]
    else:
        starts = ends = np.zeros(0, dtype=np.int64)
    hashes = span_hashes(buffer, starts, ends)
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(text_starts, starts, side="right") - 1
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    with np.errstate(over="ignore"):
        two = mix(hashes[pair] * np.uint64(3) + hashes[pair + 1])
    size = np.uint64(1 << HASH_BITS)
    twice = pair[hashes[pair] == hashes[pair + 1]]
    bucket = np.concatenate((hashes, two)) % (size - np.uint64(2)) + np.uint64(2)
    bucket = np.concatenate((bucket.astype(np.int64), np.ones(len(twice), dtype=np.int64)))
    key, n = np.unique(np.concatenate((owner, owner[pair], owner[twice])) * (1 << HASH_BITS) + bucket, return_counts=True)
    text, value = key >> HASH_BITS, np.log1p(n)
    norm = np.sqrt(np.bincount(text, value**2, minlength=len(texts)))
    # The constant, of value 1 in every text, stands first.
    text = np.concatenate((np.arange(len(texts)), text))
    order = np.argsort(text, kind="stable")
    value = np.concatenate((np.ones(len(texts)), value / norm[key >> HASH_BITS]))
    return text[order], np.concatenate((np.zeros(len(texts), dtype=np.int64), key & ((1 << HASH_BITS) - 1)))[order], value[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """The weights of all buckets, from docs (doc_id, text) and labels (doc_id, quality).

    At most ``sample`` labelled documents are used, those whose id has the smallest hash; their
    features are made in parallel and visited in the order of the hash, by one task. Labels other
    than 0 and 1, and null texts, are left out. Without any the weights are 0.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select(
        F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"),
        F.xxhash64("doc_id", F.lit("sample")).alias("place"),
    )
    chosen = chosen.distinct().orderBy("place", "quality").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select(
        "place", "quality", F.col("text").cast("string").cast("binary").alias("bytes")
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["bytes"].to_pylist()
            ok = [i for i, t in enumerate(texts) if t is not None]
            at, value = [], []
            for lo, hi in chunks([texts[i] for i in ok]):
                t, k, v = features([texts[i] for i in ok[lo:hi]])
                cuts = np.searchsorted(t, np.arange(1, hi - lo))
                at += [x.astype("<i4").tobytes() for x in np.split(k, cuts)]
                value += [x.astype("<f4").tobytes() for x in np.split(v, cuts)]
            kept = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["place"].take(kept), b["quality"].take(kept), pa.array(at, pa.binary()), pa.array(value, pa.binary())],
                ["place", "quality", "at", "value"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b["quality"].to_pylist(), b["at"].to_pylist(), b["value"].to_pylist())]
        model = Ftrl(1 << HASH_BITS)
        for _ in range(epochs):
            for label, at, value in rows:
                model.update(np.frombuffer(at, "<i4"), np.frombuffer(value, "<f4").astype(np.float64), label)
        w = model.weights()
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], ["bucket", "weight"])

    each = rows.mapInArrow(sparse, "place bigint, quality int, at binary, value binary")
    ordered = each.repartition(1).sortWithinPartitions("place", "quality", "at", "value")
    weights = np.zeros(1 << HASH_BITS)
    for r in ordered.mapInArrow(train, "bucket bigint, weight double").collect():
        weights[r["bucket"]] = r["weight"]
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of each row of (doc_id, text): the probability of label 1; null counts as empty."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b["bytes"].to_pylist()]
            score = np.zeros(len(texts))
            for lo, hi in chunks(texts):
                t, k, v = features(texts[lo:hi])
                score[lo:hi] = sigmoid(np.bincount(t, sent.value[k] * v, minlength=hi - lo))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score)], ["doc_id", "score"])

    read = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("bytes"))
    return read.mapInArrow(run, f"doc_id {id_type}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from four fifths of the labelled ids, scored for all."""
    ours = labels.filter(learned(F.col("doc_id"), FOLDS, HELD_OUT)).select("doc_id", "quality")
    texts = docs.select("doc_id", "text")
    scored = score_quality(texts, fit_quality(texts, ours))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
