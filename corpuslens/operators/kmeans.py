"""K-means for several numbers of clusters at once, with their silhouettes.

Every step is one pass over the rows, whatever the number of k: a task adds up the members of each
cluster of each k, and the sums of all tasks are a few rows. Seeds are drawn by k-means||: a few rounds
sample rows by their distance from the seeds so far, and the driver thins out the few hundred it gets.
Silhouettes with squared distances follow from the same sums, so they need one more pass and no pairs.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.defaults import SEED

#: Rounds of seeding, and rows that one draws for each cluster of the largest k.
SEED_ROUNDS, OVERSAMPLING = 5, 2


def _vectors(df: DataFrame, column: str) -> DataFrame:
    values = vector_to_array(column) if df.schema[column].dataType.simpleString() == "vector" else F.col(column).cast("array<double>")
    return df.select(values.alias("x"))


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["x"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, one row per vector, by differences: products would cancel."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def seeds(vectors: DataFrame, ks: Sequence[int], seed: int = SEED) -> dict[int, np.ndarray]:
    """Starting centres for each k, from the different rows of ``vectors`` (x); fewer where there are not as many."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "x", "round")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    first = vectors.select(F.col("x"), F.lit(-1).alias("round")).orderBy(draw, "x").limit(1).collect()
    found = np.array([r["x"] for r in first])
    if not len(found):
        return {k: found for k in ks}
    wanted = OVERSAMPLING * max(ks)
    for k in range(SEED_ROUNDS):
        now = found

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield rows.assign(d=_distances(_matrix(rows), now).min(axis=1) if len(rows) else [])

        spread = vectors.mapInPandas(near, "x array<double>, d double")
        total = spread.agg(F.sum("d")).first()[0] or 0.0
        if total <= 0:
            break
        chance = F.col("d") * (wanted / total)
        drawn = spread.withColumn("round", F.lit(k)).filter((F.col("d") > 0) & (draw < chance)).select("x").distinct()
        # So many on average; equal rows are drawn once.
        found = np.concatenate([found, *[np.array([r["x"]]) for r in drawn.orderBy("x").collect()]])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(found), dtype=np.int64)
        for rows in batches:
            if len(rows):
                n += np.bincount(_distances(_matrix(rows), found).argmin(axis=1), minlength=len(found))
        yield pd.DataFrame({"i": np.arange(len(found)), "n": n})

    counted = vectors.mapInPandas(weigh, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(len(found))
    for r in counted:
        weight[r["i"]] = r["n"]
    return {k: _thinned(found, weight, k) for k in ks}


def _thinned(points: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the points: each next one is that with the most weighted distance from those before."""
    chosen = [int(np.argmax(weight))]
    near = _distances(points, points[chosen[:1]])[:, 0]
    while len(chosen) < k and (near * weight).max() > 0:
        chosen.append(int(np.argmax(near * weight)))
        near = np.minimum(near, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def cluster_sums(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(members, their sum, their summed squared norm) of each cluster of each k, in one pass."""
    offset = np.cumsum([0] + [len(c) for c in centres.values()])
    all_centres = np.concatenate(list(centres.values()))
    width = all_centres.shape[1]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((offset[-1], width + 2))
        for rows in batches:
            if len(rows):
                x = _matrix(rows)
                d = _distances(x, all_centres)
                full = np.hstack((np.ones((len(x), 1)), (x**2).sum(axis=1)[:, None], x))
                for lo, hi in zip(offset, offset[1:]):
                    np.add.at(sums, lo + d[:, lo:hi].argmin(axis=1), full)
        yield pd.DataFrame({"c": np.repeat(np.arange(offset[-1]), width + 2), "j": np.tile(np.arange(width + 2), offset[-1]), "v": sums.ravel()})

    found = vectors.mapInPandas(add, "c bigint, j bigint, v double").groupBy("c", "j").agg(F.sum("v").alias("v")).collect()
    table = np.zeros((offset[-1], width + 2))
    for r in found:
        table[r["c"], r["j"]] = r["v"]
    return {k: (table[lo:hi, 0], table[lo:hi, 2:], table[lo:hi, 1]) for k, lo, hi in zip(centres, offset, offset[1:])}


def fit_all(vectors: DataFrame, ks: Sequence[int], max_iter: int = 50, tol: float = 1e-4, seed: int = SEED) -> dict[int, np.ndarray]:
    """The centres for each k. As many passes as the slowest k needs steps; a cluster without members keeps its centre."""
    centres = seeds(vectors, ks, seed)
    open_ = [k for k in ks if len(centres[k])]
    for _ in range(max_iter):
        if not open_:
            break
        sums = cluster_sums(vectors, {k: centres[k] for k in open_})
        for k in list(open_):
            n, total, _ = sums[k]
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[k])
            if ((moved - centres[k]) ** 2).sum(axis=1).max() <= tol**2:
                open_.remove(k)
            centres[k] = moved
    return centres


def nearest_centres(rows: DataFrame, centres: dict[int, np.ndarray], column: str = "scaled_features") -> DataFrame:
    """``rows`` without the vector, with ``k`` and ``cluster``: the nearest centre of each k, the first on ties."""
    kept = [c for c in rows.columns if c != column]
    values = vector_to_array(column) if rows.schema[column].dataType.simpleString() == "vector" else F.col(column)
    x = F.col("_x")

    def distance(c: np.ndarray):
        return sum((F.get(x, F.lit(j)) - float(v)) ** 2 for j, v in enumerate(c))

    # A struct per k: arrays compare by distance first, then by number.
    best = [
        F.struct(F.lit(k).alias("k"), F.array_min(F.array(*[F.struct(distance(v).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(c)]))["i"].alias("cluster"))
        for k, c in centres.items()
    ]
    return rows.select(*kept, values.alias("_x")).select(*kept, F.inline(F.array(*best)))


def silhouettes(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette with squared distances of each k with several clusters; a row alone in its cluster has 0.

    One pass takes the sums of all clusters, a second one the mean over the rows.
    """
    sums = cluster_sums(vectors, centres)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows_seen = dict.fromkeys(centres, 0.0), 0
        for rows in batches:
            if not len(rows):
                continue
            x = _matrix(rows)
            rows_seen += len(x)
            norm = (x**2).sum(axis=1)
            for k, c in centres.items():
                n, s, q = sums[k]
                own = _distances(x, c).argmin(axis=1)
                at = np.arange(len(x))
                # The summed squared distance to all members of each cluster.
                far = np.maximum(n[None, :] * norm[:, None] + q[None, :] - 2 * x @ s.T, 0)
                inside = far[at, own] / np.maximum(n[own] - 1, 1)
                others = np.where(n[None, :] > 0, far / np.maximum(n, 1)[None, :], np.inf)
                others[at, own] = np.inf
                outside = others.min(axis=1)
                larger = np.maximum(inside, outside)
                good = (n[own] > 1) & (larger > 0) & np.isfinite(larger)
                total[k] += float(np.where(good, (outside - inside) / np.where(good, larger, 1), 0).sum())
        yield pd.DataFrame({"k": list(total), "v": list(total.values()), "n": rows_seen})

    found = vectors.mapInPandas(add, "k int, v double, n bigint").groupBy("k").agg(F.sum("v") / F.sum("n")).collect()
    return {k: v for k, v in map(tuple, found) if v is not None and (sums[k][0] > 0).sum() > 1}


def select_k_at_once(standardized: DataFrame, k_min: int = 3, k_max: int = 8, seed: int = SEED) -> tuple[int, DataFrame, dict[int, np.ndarray]]:
    """The k of ``k_min..k_max`` with the best silhouette, the smallest on ties; the table (k, silhouette); the centres.

    A k not below the number of rows is not tried.
    """
    vectors = _vectors(standardized, "scaled_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = vectors.count()
        ks = range(k_min, min(k_max, n - 1) + 1)
        if not len(ks):
            raise ValueError(f"{n} rows are too few for {k_min} clusters")
        centres = fit_all(vectors, ks, seed=seed)
        scores = silhouettes(vectors, centres)
    finally:
        vectors.unpersist()
    if not scores:
        raise ValueError("all rows are equal")
    best = max(scores, key=lambda k: (scores[k], -k))
    table = standardized.sparkSession.createDataFrame(sorted(scores.items()), "k int, silhouette double")
    return best, table, centres
