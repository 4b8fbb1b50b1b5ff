"""Language by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed byte n-grams of its letters. Document frequencies
are counted over all learning documents; the centroids of a language come from spherical k-means
over a bounded sample of its documents. A text gets the language of the centroid with the largest
cosine. It is rejected where that centroid is hardly nearer than chance: n-grams that fall into
random buckets have a cosine too, which grows with their number, so the bound does as well, and a
short text is not rejected for being short, nor a long one for holding many different n-grams.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.arrays import chunks
from corpuslens.llm.folds import held_out, learned
from corpuslens.llm.scratch import stored

BUCKET_BITS = 13
DIMENSIONS = 1 << BUCKET_BITS
SIZES = (2, 3, 4)
#: Documents that the centroids of one language are fitted on, at most, and its centroids.
SAMPLE, CENTROIDS = 500, 4
#: Centroids that texts are compared with at a time.
BLOCK = 1024
#: A text is rejected where its cosine is below this multiple of the cosine that chance gives, and has come by less than
#: this part of the way from there to 1.
MARGIN, RISE = 2.0, 0.25
UNKNOWN = "und"
_TEXTS = 128
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_FACTORS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def counts(texts: list[bytes]) -> np.ndarray:
    """texts x DIMENSIONS: how often each hashed n-gram occurs. Texts are lower-case UTF-8.

    All that is no letter counts as one space; so does either end of the text.
    """
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    folded = [b" " + t.translate(_FOLD) + b" " for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in folded])
    b = np.frombuffer(b"".join(folded), dtype=np.uint8)
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (owner[1:] != owner[:-1])
    b, owner = b[keep].astype(np.uint32), owner[keep]
    flat = np.zeros(out.size, dtype=np.int64)
    for n in SIZES:
        if len(b) < n:
            continue
        x = b[: len(b) - n + 1].copy()
        for j in range(1, n):
            x |= b[j : len(b) - n + 1 + j] << np.uint32(8 * j)
        bucket = (x * np.uint32(_FACTORS[n])) >> np.uint32(32 - BUCKET_BITS)
        same = owner[: len(x)] == owner[n - 1 :]
        flat += np.bincount((owner[: len(x)] * DIMENSIONS + bucket)[same], minlength=out.size)
    out[:] = flat.reshape(out.shape)
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for lo, hi in chunks(texts):
        for k in range(lo, hi, _TEXTS):
            yield k, min(hi, k + _TEXTS)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]


def _prepared(text: Column) -> tuple[Column, Column]:
    """The text as lower-case bytes, and whether it has a letter."""
    return F.lower(text.cast("string")).cast("binary"), F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; summed up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS + 1, dtype=np.int64), 0
        for b in batches:
            texts = [t or b"" for t in b["bytes"].to_pylist()]
            for lo, hi in batches_of(texts):
                df[:-1] += (counts(texts[lo:hi]) > 0).sum(axis=0)
            n += len(texts)
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(df)], ["bucket", "n"])

    rows = texts.select("bytes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in rows.collect()}
    return np.array([found.get(k, 0) for k in range(DIMENSIONS)]), found.get(DIMENSIONS, 0)


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of spherical k-means that starts from far-apart rows."""
    starts = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[starts[0]]
    for _ in range(1, min(k, len(x))):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    centers = x[starts]
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[own == c].sum(axis=0) for c in range(len(centers))])
        norms = np.linalg.norm(sums, axis=1)
        centers = sums[norms > 0] / norms[norms > 0, None]
    return centers


def fit_languages(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel | None:
    """Learn from (doc_id, text, lang); rows without a language, a text or a letter are left out.

    Every language that occurs is learned. Document frequencies cover all rows; at most ``sample``
    rows of a language, those with the smallest hash of their id, are clustered. The model has
    some 130 KB for each language. None if there is nothing to learn from.
    """
    lower, has_letter = _prepared(F.col("text"))
    rows = docs.filter(F.col("lang").isNotNull() & has_letter).select(F.col("lang").cast("string").alias("lang"), "doc_id", lower.alias("bytes"))
    # Twice the sample by the rate first, so that only these rows are put in order.
    rate = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.count(F.lit(1)) + 0.01)
    per = stored(rows.groupBy("lang").agg(rate.alias("rate")), "languages")
    if per.isEmpty():
        return None
    df, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    placed = rows.withColumn("place", F.xxhash64("doc_id", F.lit("sample"))).join(per.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"))
    drawn = placed.filter(F.pmod("place", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    first = Window.partitionBy("lang").orderBy("place", "bytes")
    drawn = drawn.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample).select("lang", "k", "bytes")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = [bytes(t) for t in rows.sort_values("k")["bytes"]]
        x = np.concatenate([vectors(texts[lo:hi], idf) for lo, hi in batches_of(texts)])
        return pd.DataFrame({"lang": key[0], "vector": list(cluster(x, centroids).astype(np.float32))})

    found = drawn.groupBy("lang").applyInPandas(fit, "lang string, vector array<float>").collect()
    found.sort(key=lambda r: (r["lang"], r["vector"]))
    return LanguageModel(idf, np.array([r["vector"] for r in found], dtype=np.float32), [r["lang"] for r in found])


def predict_languages(docs: DataFrame, model: LanguageModel | None, margin: float = MARGIN, rise: float = RISE) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per row of (doc_id, text).

    The score is the cosine to the nearest centroid. A null text, a text without a letter, and
    every text if nothing was learned, is ``und`` with score 0 and rejected.
    """
    lower, has_letter = _prepared(F.col("text"))
    read = docs.select("doc_id", F.when(has_letter, lower).alias("bytes"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # Plain arrays, since a worker need not have this package.
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.idf, model.centroids, model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids, languages = sent.value or (None, None, [])
        means = centroids.mean(axis=1) if languages else None
        for b in batches:
            texts = b["bytes"].to_pylist()
            n = len(texts)
            lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
            at = [i for i, t in enumerate(texts) if t is not None and languages]
            some = [texts[i] for i in at]
            for lo, hi in batches_of(some):
                x = vectors(some[lo:hi], idf)
                best, top = np.zeros(hi - lo, dtype=np.int64), np.full(hi - lo, -np.inf, dtype=np.float32)
                for first in range(0, len(centroids), BLOCK):
                    cosine = x @ centroids[first : first + BLOCK].T
                    own = np.argmax(cosine, axis=1)
                    value = cosine[np.arange(hi - lo), own]
                    best, top = np.where(value > top, own + first, best), np.maximum(value, top)
                here = at[lo:hi]
                for i, c in zip(here, best):
                    lang[i] = languages[c]
                score[here] = np.clip(top, 0, 1)
                chance = x.sum(axis=1) * means[best]
                rejected[here] = (top < margin * chance) & (top - chance < rise * (1 - chance))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(lang), pa.array(score), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return read.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


FOLDS, HELD_OUT = 4, 2


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned from three quarters, predicted for all."""
    model = fit_languages(docs.filter(learned(F.col("doc_id"), FOLDS, HELD_OUT)).select("doc_id", "text", "lang"))
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected"
    )
