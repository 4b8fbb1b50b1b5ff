import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import alignment as A
from corpuslens.operators import coherence as C
from corpuslens.operators import topics as M
from plans import plan


def brute(docs, terms, size):
    windows = [set(d[s : s + size]) for d in docs if d for s in range(max(len(d) - size + 1, 1))]
    n = len(windows)
    out = {}
    for topic, words in terms.items():
        values = []
        for i, a in enumerate(sorted(words)):
            for b in sorted(words)[i + 1 :]:
                both = sum(a in w and b in w for w in windows)
                if not both:
                    values.append(-1.0)
                elif both == n:
                    values.append(1.0)
                else:
                    pa, pb = (sum(x in w for w in windows) / n for x in (a, b))
                    values.append(math.log(both / n / (pa * pb)) / -math.log(both / n))
        out[topic] = sum(values) / len(values)
    return out


@pytest.mark.parametrize("size", [1, 3, 10])
def test_coherence_as_by_brute_force(spark, size):
    r = random.Random(size)
    docs = [[r.choice("abcdefg") for _ in range(r.choice([0, 1, 4, 30]))] for _ in range(60)]
    terms = {0: ["a", "b", "c"], 1: ["c", "d", "never"], 2: ["e", "a"]}
    rows = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    listed = spark.createDataFrame([(t, w) for t, ws in terms.items() for w in ws], "topic int, term string")
    got = {x.topic: x.coherence for x in C.topic_coherence(rows, listed, size).collect()}
    want = brute(docs, terms, size)
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    assert C.topic_coherence(rows.limit(0), listed, size).filter("coherence <> -1").isEmpty()


def themes(spark, n, seed):
    r = random.Random(seed)
    words = [[f"{t}word{chr(97 + i)}" for i in range(12)] for t in ("red", "green", "blue")]
    return spark.createDataFrame([(" ".join(r.choice(words[k % 3]) for _ in range(60)),) for k in range(n)], "text string")


def test_themes_are_more_coherent_and_foretell_more_than_mixed_terms(spark):
    corpus = themes(spark, 90, 1)
    model = M.fit_topics(corpus, k=3, max_iter=15, min_df=1)
    tokens = corpus.select(F.split("text", "[^a-z]+").alias("tokens"))
    good = M.top_terms(model, 8).select("topic", "term")
    mixed = good.withColumn("topic", F.pmod(F.hash("term"), F.lit(3)))
    score = lambda t: C.topic_coherence(tokens, t).agg(F.avg("coherence")).first()[0]
    assert score(good) > score(mixed) + 0.2
    held = themes(spark, 30, 2)
    told = C.completion(model, held).first()
    one = C.completion(M.fit_topics(corpus, k=2, max_iter=1, min_df=1), held).first()
    assert told.tokens == one.tokens > 700 and told.per_token > one.per_token
    # Not better than knowing the theme and nothing else of its twelve words.
    assert told.per_token < -math.log(12) + 0.05
    assert A.topic_terms(model).count() == 3 * 36


def test_windows_hold_places_of_terms(spark):
    """Numbers are compared and counted in windows, not words."""
    rows = spark.createDataFrame([(["a", "x", "b", "a"],), (["x", "y", "z"],)], "tokens array<string>")
    got = [r[0] for r in rows.select(C._windows(F.col("tokens"), ["a", "b"], 2)).collect()]
    assert got == [[[0], [1], [0, 1]], []]


def test_completion_as_by_brute_force_and_without_a_shuffle_of_words(spark, monkeypatch):
    corpus = themes(spark, 60, 3)
    odd = ["", "--", "redworda", " redworda bluewordb", "a redworda b bluewordb, redwordc'x", "12 redworda redwordb ÄÖ greenwordc greenwordd"]
    held = themes(spark, 20, 4).collect() + [(t,) for t in odd] + [(None,)]
    rows = spark.createDataFrame([tuple(r) for r in held], "text string").repartition(3)
    monkeypatch.setattr(C, "JUDGED", 7)
    for optimizer in ("online", "em"):
        model = M.fit_topics(corpus, k=3, max_iter=10, min_df=1, optimizer=optimizer)
        matrix = model.lda.topicsMatrix().toArray()
        matrix, places = matrix / matrix.sum(axis=0), {t: i for i, t in enumerate(model.terms)}
        pieces = [re.split("[^a-z]+", (r[0] or "").lower()) for r in held]
        halves = spark.createDataFrame([(i, " ".join(p[::2])) for i, p in enumerate(pieces)], "i int, text string")
        shares = {r.i: r.mix for r in M.shares(model.lda, model.features.transform(halves), "mix").select("i", "mix").collect()}
        total, tokens = 0.0, 0
        for i, p in enumerate(pieces):
            for w in p[1::2]:
                if w in places:
                    q = sum(a * b for a, b in zip(shares[i], matrix[places[w]]))
                    tokens, total = tokens + 1, total + (math.log(q) if q > 0 else 0.0)
        got = C.completion(model, rows)
        assert "Join" not in plan(got)
        got = got.first()
        assert got.tokens == tokens and got.log_likelihood == pytest.approx(total, rel=1e-3)
        assert got.per_token == got.log_likelihood / got.tokens
        assert tuple(C.completion(model, rows.limit(0)).first()) == (None, None, None)
        alone = C.completion(model, spark.createDataFrame([("12 redworda",)], "text string")).first()
        assert tuple(alone) == (None, 1, None)
