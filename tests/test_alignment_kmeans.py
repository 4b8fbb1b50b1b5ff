import itertools
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuslens.operators import alignment as A
from corpuslens.operators import clusters as C
from corpuslens.operators import kmeans as K
from corpuslens.operators import topics as M


@pytest.mark.parametrize("n, m", [(1, 1), (2, 5), (5, 5), (6, 7)])
def test_assignment_as_by_trying_all(n, m):
    rng = np.random.default_rng(n * m)
    for _ in range(30):
        worth = rng.integers(-5, 6, (n, m)) + (rng.random((n, m)) if _ % 2 else 0)
        best = max(sum(worth[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = A.assignment(worth)
        assert len(set(got.tolist())) == n and worth[np.arange(n), got].sum() == pytest.approx(best)


def terms(spark, matrix, first=0):
    rows = [(first + t, f"w{j}", float(x)) for t, r in enumerate(matrix) for j, x in enumerate(r) if x]
    return spark.createDataFrame(rows, "topic int, term string, weight double")


def test_a_permuted_model_is_mapped_back(spark):
    rng = np.random.default_rng(1)
    matrix = rng.dirichlet(np.full(40, 0.1), 12)
    order = rng.permutation(12)
    got = {r.topic: (r.aligned, round(r.cosine, 9)) for r in A.align_topics(terms(spark, matrix), terms(spark, matrix[order])).collect()}
    assert got == {i: (int(order[i]), 1.0) for i in range(12)}


def test_new_topics_get_new_numbers(spark):
    old = terms(spark, [[1, 0, 0, 0], [0, 1, 0, 0]])
    new = terms(spark, [[0, 0, 1, 0], [0.1, 5, 0, 0], [1, 0, 0, 0.2], [0, 0, 0, 1]])
    got = {r.topic: (r.aligned, r.cosine is None) for r in A.align_topics(old, new).collect()}
    assert got == {0: (2, True), 1: (1, False), 2: (0, False), 3: (3, True)}
    far = A.align_topics(old, terms(spark, [[1, 2, 0, 0]]), least=0.99).collect()
    assert [(r.topic, r.aligned) for r in far] == [(0, 2)]
    assert A.align_topics(old, new.limit(0)).collect() == []
    assert {r.aligned for r in A.align_topics(old.limit(0), new).collect()} == {0, 1, 2, 3}


def test_terms_of_a_fitted_model(spark):
    corpus = spark.createDataFrame([(" ".join(random.Random(i).choices(["apple", "pear", "plum"] if i % 2 else ["car", "train", "ship"], k=30)),) for i in range(40)], "text string")
    model = M.fit_topics(corpus, k=2, max_iter=5, min_df=1)
    table = A.topic_terms(model)
    assert table.count() == 2 * 6
    assert {r.topic: r.aligned for r in A.align_topics(table, table.withColumn("topic", 1 - F.col("topic"))).collect()} == {0: 1, 1: 0}


def blobs(spark, k, n=60, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(k, 4)) * 5
    rows = [(f"d{i}", (middle[i % k] + rng.normal(size=4) * spread).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "domain string, v array<double>").select("domain", array_to_vector("v").alias("scaled_features"))


@pytest.mark.parametrize("k", [3, 5])
def test_the_same_k_as_one_fit_per_k(spark, k):
    z = blobs(spark, k, seed=k)
    best, table, centres = K.select_k_at_once(z)
    other, scores = C.select_k(z)
    assert best == other == k and table.count() == scores.count()
    a, b = ({r.k: r.silhouette for r in t.collect()} for t in (table, scores))
    assert a[k] == pytest.approx(b[k], abs=1e-9)
    own = K.nearest_centres(z, centres).filter(F.col("k") == k)
    assert own.groupBy(F.substring("domain", 2, 9).cast("int") % k).agg(F.countDistinct("cluster").alias("n")).filter("n > 1").isEmpty()


def test_silhouettes_as_by_the_evaluator(spark):
    z = blobs(spark, 4, 90, 2, 4.0)
    rng = np.random.default_rng(3)
    centres = {k: rng.normal(size=(k, 4)) * 4 for k in (2, 3, 6)}
    scores = K.silhouettes(K._vectors(z, "scaled_features"), centres)
    for k in centres:
        placed = K.nearest_centres(z.withColumn("features", F.col("scaled_features")), {k: centres[k]})
        want = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(placed)
        assert scores[k] == pytest.approx(want, abs=1e-9)


def test_steps_do_not_depend_on_the_number_of_k(spark, monkeypatch):
    passes = []
    plain = K.cluster_sums
    monkeypatch.setattr(K, "cluster_sums", lambda v, c: passes.append(len(c)) or plain(v, c))
    vectors = K._vectors(blobs(spark, 3, seed=4), "scaled_features")
    K.fit_all(vectors, range(2, 9), max_iter=4)
    assert len(passes) <= 4 and passes[0] == 7


def test_few_and_equal_rows(spark):
    z = blobs(spark, 1, 5, 1, 0.0)
    with pytest.raises(ValueError, match="equal"):
        K.select_k_at_once(z)
    with pytest.raises(ValueError, match="too few"):
        K.select_k_at_once(z.limit(2))
