import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import bootstrap as B
from corpuslens.operators import clusters as C


def domains(n, seed, shift=0.0):
    r = random.Random(seed)
    return [(c, f"d{k}", k % 4, shift + (k % 4) * 0.1 + r.gauss(0, 0.2)) for c in ("x", "y") for k in range(n)]


def times(domain, replicate):
    u = int(hashlib.md5(f"42:{domain}:{replicate}".encode()).hexdigest()[:8], 16) / 2**32
    k, p, total = 0, math.exp(-1), math.exp(-1)
    while u >= total and k < 11:
        k += 1
        p /= k
        total += p
    return k


def index(rows):
    groups = {}
    for c, x in rows:
        groups.setdefault(c, []).append(x)
    n = len(rows)
    grand = math.fsum(x for _, x in rows) / n
    between = math.fsum(len(v) * (statistics.fmean(v) - grand) ** 2 for v in groups.values()) / n
    within = math.fsum(len(v) * (statistics.variance(v) if len(v) > 1 else 0.0) for v in groups.values()) / n
    return between / (between + within) if between + within > 0 else 0.0


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_replicates_as_by_repeating_domains(spark, shift):
    rows = domains(23, 3, shift)
    clusters = spark.createDataFrame(rows, "crawl string, domain string, cluster int, ideology_score double")
    got = {(r.crawl, r.replicate): r.polarization_index for r in B.replicated_index(clusters, ["crawl"], 25).collect()}
    for (crawl, rep), value in got.items():
        repeated = [(c, x) for cr, d, c, x in rows if cr == crawl for _ in range(1 if rep == 0 else times(d, rep))]
        assert math.isclose(value, index(repeated), rel_tol=1e-6, abs_tol=1e-9)
    assert len(got) == 2 * 26
    interval = {r.crawl: r for r in B.index_interval(clusters, ["crawl"], 25).collect()}
    for crawl in "xy":
        drawn = [v for (c, rep), v in got.items() if c == crawl and rep]
        assert interval[crawl].low == pytest.approx(np.quantile(drawn, 0.025), abs=6e-5)
        assert interval[crawl].high == pytest.approx(np.quantile(drawn, 0.975), abs=6e-5)
    if not shift:
        plain = {r.crawl: r.polarization_index for r in C.polarization_index(clusters.withColumn("total_docs", F.lit(1)), ["crawl"]).collect()}
        assert plain == {c: r.polarization_index for c, r in interval.items()}


def test_weights_follow_the_law(spark):
    drawn = spark.range(20_000).select(B.poisson_weight(F.col("id"), F.lit(7)).alias("w"))
    mean, var = drawn.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.05


def test_changes_are_taken_within_replicates(spark):
    """Both crawls have the same domains and scores: no replicate shows a change."""
    rows = [r for c in ("x", "y") for r in [(c, *d[1:]) for d in domains(30, 5) if d[0] == "x"]]
    clusters = spark.createDataFrame(rows, "crawl string, domain string, cluster int, ideology_score double")
    assert [tuple(r) for r in B.index_changes(clusters, replicates=40).collect()] == [("y", 0.0, 0.0, 0.0)]


def test_no_groups_and_absent_scores(spark):
    clusters = spark.createDataFrame([("a", 0, 0.5), ("b", 1, None), ("c", 1, 0.5)], "domain string, cluster int, ideology_score double")
    assert B.index_interval(clusters, replicates=10).collect()[0][:] == (0.0, 0.0, 0.0)
    assert B.index_interval(clusters.limit(0), ["cluster"], 5).collect() == []
