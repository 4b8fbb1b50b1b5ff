import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslens.functions.topics import dominant_topic, topic_ideology
from corpuslens.operators import ideology as G
from corpuslens.operators import terms as TM
from corpuslens.operators import topics as M
from plans import plan


@pytest.fixture(scope="module")
def corpus(spark):
    themes = ["tax budget vote senate law", "rain cloud storm wind snow", "goal match team coach league"]
    rows = []
    for i in range(60):
        words = themes[i % 3].split()
        rows.append((f"http://h/{i}", "C", "h", "2024-01", " ".join(words[(i + j) % 5] for j in range(30)) + " the said"))
    return spark.createDataFrame(rows, "url string, crawl string, domain string, year_month string, text string").cache()


@pytest.fixture(scope="module")
def model(corpus):
    return M.fit_topics(corpus, k=3, max_iter=20, min_df=2)


def test_vocabulary_and_idf_equal_the_feature_stages(corpus, model):
    tokens = TM.remove_stop_words(TM.tokens(corpus.select("url", "text")))
    long = TM.tfidf(tokens, "url", vocab_size=None, min_df=2).collect()
    vector = {r.url: r.v for r in model.features.transform(corpus).select("url", vector_to_array("features").alias("v")).collect()}
    index = {t: i for i, t in enumerate(model.terms)}
    assert {r.term for r in long} == set(index)
    assert all(math.isclose(vector[r.url][index[r.term]], r.tfidf) for r in long)
    counts = Counter(w for r in corpus.collect() for w in r.text.split() if w not in ("the", "said"))
    vocab = TM.vocabulary(TM.term_counts(tokens, "url"), vocab_size=4, min_df=2).collect()
    assert [(r.term, r.total) for r in vocab] == sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:4]


def test_topics_part_the_themes(corpus, model):
    rows = M.document_topics(model, corpus).collect()
    assert len(rows) == 60
    assert all(math.isclose(sum(r.topic_dist_arr), 1.0, abs_tol=1e-6) for r in rows)
    assert all(r.topic_dist_arr[r.dominant_topic] == max(r.topic_dist_arr) for r in rows)
    assert len({r.doc_id for r in rows}) == 60
    theme = {r.url: int(r.url.rsplit("/", 1)[1]) % 3 for r in rows}
    assert len({(theme[r.url], r.dominant_topic) for r in rows}) == 3


def test_top_terms_are_ranked_by_weight(model):
    rows = M.top_terms(model, 5).collect()
    for topic in range(3):
        ranked = sorted((r for r in rows if r.topic == topic), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5]
        assert [r.weight for r in ranked] == sorted((r.weight for r in ranked), reverse=True)
        weights = model.lda.topicsMatrix().toArray()[:, topic]
        weights = weights / weights.sum()
        assert math.isclose(ranked[0].weight, weights.max(), rel_tol=1e-9)
        assert model.terms[int(weights.argmax())] == ranked[0].term


def test_quality_and_storage(spark, corpus, model, tmp_path):
    row = M.topic_quality(model, corpus).first()
    assert row.log_likelihood < 0 < row.log_perplexity
    M.save_topic_model(model, str(tmp_path / "m"))
    again = M.load_topic_model(str(tmp_path / "m"))
    assert again.terms == model.terms
    assert sorted(map(tuple, M.top_terms(again).collect())) == sorted(map(tuple, M.top_terms(model).collect()))


def test_expectation_maximisation_runs(corpus):
    em = M.fit_topics(corpus, k=3, max_iter=3, min_df=2, optimizer="em")
    assert M.document_topics(em, corpus).count() == 60


def test_rank_weights(spark):
    df = spark.createDataFrame([(0, [f"t{i}" for i in range(25)]), (1, ["a"])], "topic int, terms array<string>")
    rows = {(r.topic, r["rank"]): (r.term, r.weight) for r in TM.rank_weights(df).collect()}
    assert len(rows) == 21 and rows[0, 20] == ("t19", 1 / 20) and rows[1, 1] == ("a", 1.0)


def test_topic_ideology(spark):
    df = spark.createDataFrame(
        [([0.5, 0.25, 0.25],), ([0.0, 0.0, 0.0],), (None,), ([2.0, 2.0, 0.0, 4.0],)], "topic_dist_arr array<float>"
    )
    want = [0.25, 0.0, 0.0, 0.25]
    labels = {0: 1.0, 2: -1.0, 9: 0.5}
    assert [r[0] for r in df.select(topic_ideology(F.col("topic_dist_arr"), labels)).collect()] == want
    table = spark.createDataFrame(list(labels.items()), "topic int, label double")
    for given in (labels, table):
        assert [r.topic_ideology_score for r in G.score_topics(df, given).collect()] == want


def test_dominant_topic_is_the_first_maximum(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), (None,)], "a array<double>")
    assert [r[0] for r in df.select(dominant_topic(F.col("a"))).collect()] == [1, None]


def test_topic_prevalence(spark):
    df = spark.createDataFrame([("m", [1.0, 0.0]), ("m", [0.5, 0.5])], "year_month string, topic_dist_arr array<double>")
    assert {(r.topic, r.avg_share) for r in M.topic_prevalence(df).collect()} == {(0, 0.75), (1, 0.25)}


def test_counting_terms_needs_no_shuffle(corpus):
    tokens = TM.tokens(corpus.select("url", "text"))
    assert "Exchange" not in plan(TM.term_counts(tokens, "url")).split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in plan(TM.tfidf(tokens, "url", vocab_size=100, min_df=2))
    empty = tokens.withColumn("tokens", F.array().cast("array<string>"))
    assert TM.term_counts(empty, "url").count() == 0
    got = {(r.url, r.term): r.tf for r in TM.term_counts(tokens, "url").collect()}
    want = {(r.url, w): n for r in tokens.collect() for w, n in Counter(r.tokens).items()}
    assert got == want


def test_the_fit_deals_its_rows_to_all_cores(spark, monkeypatch):
    docs = spark.createDataFrame([(f"alpha beta gamma delta{i % 3}",) for i in range(40)], "text string").coalesce(1)
    seen = []
    monkeypatch.setattr(M.LDA, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()))
    M.fit_topics(docs, k=2, max_iter=1, min_df=1)
    assert seen == [M.TASKS_PER_CORE * spark.sparkContext.defaultParallelism]


def test_counts_of_named_terms(spark, corpus):
    odd = spark.createDataFrame([("u1", ""), ("u2", "tax tax xtax the rain"), ("u3", None)], "url string, text string")
    tokens = TM.tokens(corpus.select("url", "text").unionByName(odd))
    names = ["tax", "rain", "absent", "tax"]
    want = Counter((r.term, r.tf) for r in TM.term_counts(tokens, "url").filter(F.col("term").isin(names)).collect())
    assert Counter((r.term, r.tf) for r in TM.named_counts(tokens, names).collect()) == want
    assert TM.named_counts(tokens, []).count() == 0
    # Other words become no rows.
    assert "sort_array" not in plan(TM.named_counts(tokens, names))


def test_expectation_maximisation_reads_texts_once_for_its_vectors(corpus, monkeypatch):
    seen = []
    monkeypatch.setattr(M.LDA, "fit", lambda self, rows: seen.append((rows.columns, rows.storageLevel.useMemory)))
    M.fit_topics(corpus, k=2, max_iter=1, min_df=2, optimizer="em")
    M.fit_topics(corpus, k=2, max_iter=1, min_df=2)
    # The online fit stores its own rows, as bytes.
    assert seen == [(["features"], True), (["ids", "counts"], False)]
