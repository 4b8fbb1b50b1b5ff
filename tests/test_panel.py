import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpuslens.defaults import FEATURES
from corpuslens.operators import clusters as C
from corpuslens.operators import ideology as G
from corpuslens.operators import trends as TR


def test_join_keys(spark):
    topics = spark.createDataFrame(
        [("u", "c1", "d", "m", 1, 0.5), ("u", "c2", "d", "m", 2, 0.1), (None, "c1", "d", "m", 1, 0.0)],
        "url string, crawl string, domain string, year_month string, dominant_topic int, topic_ideology_score double",
    )
    scores = spark.createDataFrame(
        [("u", "c1", 0.1, -1.0, 0.2, 0.3), ("u", "c2", 0.2, 1.0, 0.2, 0.3), (None, "c1", 0.0, 0.0, 0.0, 0.0)],
        "url string, crawl string, sentiment_compound double, partisan_score double, sentiment_pos double, "
        "sentiment_neg double",
    )
    assert G.join_scores(topics, scores, ["url"]).count() == 4
    both = G.composite_ideology(G.join_scores(topics, scores)).collect()
    assert sorted((r.crawl, r.composite_ideology) for r in both) == [("c1", -0.25), ("c2", 0.55)]


def test_ideology_panel_median_and_mode(spark):
    topics = [3, 3, 1, 1, 5, 2, 7]
    rows = [("d", "m", 0.1 * i, t, 0.0, 0.0, 0.0, 0.0, 0.0) for i, t in enumerate(topics)] + [("d", "n", 0.0, 1) + (0.0,) * 5] * 4
    scored = spark.createDataFrame(
        rows, "domain string, year_month string, composite_ideology double, dominant_topic int, "
        "sentiment_compound double, sentiment_pos double, sentiment_neg double, topic_ideology_score double, "
        "partisan_score double"
    )
    (row,) = G.ideology_panel(scored).collect()
    assert (row.doc_count, row.median_topic, row.modal_topic) == (7, 3, 1)
    assert math.isclose(row.ideology_std, statistics.stdev(0.1 * i for i in range(7)))


def test_build_panel_takes_any_number_of_crawls(spark):
    def frame(i):
        df = spark.createDataFrame([("d", float(i))], "domain string, ideology_score double")
        return df if i % 2 else df.select("ideology_score", "domain")

    for n in (1, 2, 3, 4):
        rows = G.build_panel({f"c{i}": frame(i) for i in range(n)}).collect()
        assert {(r.crawl, r.domain, r.ideology_score) for r in rows} == {(f"c{i}", "d", float(i)) for i in range(n)}
    with pytest.raises(ValueError):
        G.build_panel({})


def _panel(spark, domains=24, months=4):
    rng = random.Random(2)
    rows = []
    for d in range(domains):
        for m in range(months):
            centre = (d % 4) - 1.5
            rows.append((f"d{d}", f"2024-{m + 1:02d}", rng.randint(3, 12), *[centre + rng.gauss(0, 0.05) for _ in FEATURES]))
    return spark.createDataFrame(
        rows, "domain string, year_month string, doc_count bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    )


def test_domain_features(spark):
    panel = spark.createDataFrame(
        [("a", "1", 30, *[1.0] * 6), ("a", "2", 10, *[2.0] * 6), ("b", "1", 19, *[1.0] * 6)],
        "domain string, year_month string, doc_count bigint, " + ", ".join(f"{f} double" for f in FEATURES),
    )
    (plain,) = C.domain_features(panel).collect()
    assert (plain.domain, plain.total_docs, plain.ideology_score) == ("a", 40, 1.5)
    assert C.domain_features(panel, weighted=True).first().ideology_score == 1.25


@pytest.fixture(scope="module")
def standardized(spark):
    return C.standardize(C.domain_features(_panel(spark), 5)).cache()


def test_standardize_skips_rows_with_gaps(spark, standardized):
    z = C.scaled_columns(standardized).toPandas()[[f"z_{f}" for f in FEATURES]]
    assert (abs(z.mean()) < 1e-9).all() and (abs(z.std(ddof=1) - 1) < 1e-9).all()
    gap = _panel(spark).withColumn("avg_sentiment", F.when(F.col("domain") != "d0", F.col("avg_sentiment")))
    assert C.standardize(C.domain_features(gap, 5)).count() == 23


def test_k_is_chosen_by_silhouette(standardized):
    k, table = C.select_k(standardized)
    scores = {r.k: r.silhouette for r in table.collect()}
    assert k == 4 and set(scores) == {3, 4, 5, 6, 7, 8}
    assert scores[4] == max(scores.values())


def test_too_few_rows_for_k(standardized):
    with pytest.raises(ValueError):
        C.select_k(standardized.limit(3))
    assert {r.k for r in C.select_k(standardized.limit(5))[1].collect()} <= {3, 4}


def test_clusters_follow_the_groups(standardized):
    rows = C.cluster_domains(standardized, 4).collect()
    assert len(rows) == 24
    assert len({(int(r.domain[1:]) % 4, r.cluster) for r in rows}) == 4


def test_projection_is_centred_and_ordered(standardized):
    xy = C.project_2d(standardized).select("x", "y").toPandas()
    assert (abs(xy.mean()) < 1e-9).all()
    assert xy.x.var() > xy.y.var()


def _clusters(spark, rows):
    return spark.createDataFrame(
        [(f"d{i}", c, s, 0.0, 60) for i, (c, s) in enumerate(rows)],
        "domain string, cluster int, ideology_score double, avg_sentiment double, total_docs bigint",
    )


def _index(rows):
    n = len(rows)
    mean = sum(s for _, s in rows) / n
    groups = {}
    for c, s in rows:
        groups.setdefault(c, []).append(s)
    between = sum(len(g) * (statistics.mean(g) - mean) ** 2 for g in groups.values()) / n
    within = sum(len(g) * (statistics.variance(g) if len(g) > 1 else 0.0) for g in groups.values()) / n
    return (between / (between + within) if between + within > 0 else 0.0, between, within, len(groups), n)


def test_polarization_index(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), rng.uniform(-1, 1)) for _ in range(60)] + [(9, 0.7)]
    got = tuple(C.polarization_index(_clusters(spark, rows), digits=9).first())
    assert all(math.isclose(a, b, abs_tol=1e-8) for a, b in zip(got, _index(rows)))
    renamed = [((c + 1) % 10, s) for c, s in rows]
    assert tuple(C.polarization_index(_clusters(spark, renamed), digits=9).first()) == got


def test_polarization_of_single_domains_and_of_nothing(spark):
    assert C.polarization_index(_clusters(spark, [(0, -1.0), (1, 1.0)])).first().polarization_index == 1.0
    assert C.polarization_index(_clusters(spark, [(0, 0.5), (0, 0.5)])).first().polarization_index == 0.0
    assert C.polarization_index(_clusters(spark, [(0, 0.5)]).limit(0)).count() == 0


@pytest.mark.parametrize("k, names", [
    (3, ["Left", "Center", "Right"]),
    (5, ["Far Left", "Center-Left", "Center", "Center-Right", "Far Right"]),
    (7, ["Far Left", "Center-Left", "Center", "Center-Right", "Far Right", "Cluster 5", "Cluster 6"]),
])
def test_labels_follow_the_mean_of_their_own_cluster(spark, k, names):
    order = list(range(k))
    random.Random(k).shuffle(order)
    clusters = _clusters(spark, [(c, float(rank)) for rank, c in enumerate(order)])
    labelled = C.label_clusters(C.cluster_summary(clusters), k)
    by_mean = [r.ideology_label for r in labelled.orderBy("ideology_score_mean").collect()]
    assert by_mean == names
    domains = C.label_domains(clusters, labelled).orderBy("ideology_score").collect()
    assert [r.ideology_label for r in domains] == names


def test_label_summary_counts_visible_domains(spark):
    clusters = _clusters(spark, [(0, 0.0), (0, 1.0), (1, 2.0)]).withColumn("ideology_label", F.col("cluster").cast("string"))
    clusters = clusters.withColumn("total_docs", F.when(F.col("domain") == "d1", 49).otherwise(50))
    rows = {r.ideology_label: (r.domains, r.avg_ideology, r.total_docs) for r in C.label_summary(clusters).collect()}
    assert rows == {"0": (1, 0.0, 50), "1": (1, 2.0, 50)}


def test_trends(spark):
    panel = spark.createDataFrame(
        [("a", "2024-02", 0.2), ("a", "2024-01", 0.1), ("b", "2024-01", 0.3)],
        "domain string, year_month string, ideology_score double",
    )
    assert [tuple(r) for r in TR.domain_trend(panel, ["a"]).collect()] == [("a", "2024-01", 0.1), ("a", "2024-02", 0.2)]
    with pytest.raises(ValueError):
        TR.domain_trend(panel, ["a"], "domain")
    metrics = spark.createDataFrame(
        [("c2", 0.5, 0.1, 0.1), ("c1", 0.4, 0.2, 0.2), ("c3", 0.7, 0.3, 0.4)],
        "crawl string, polarization_index double, between_cluster_var double, within_cluster_var double",
    )
    row = TR.polarization_trend(metrics).first()
    assert (row.earliest_crawl, row.latest_crawl, row.latest_between_var) == ("c1", "c3", 0.3)
    assert math.isclose(row.delta, 0.3)
