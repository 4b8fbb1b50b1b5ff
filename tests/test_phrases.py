import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.defaults import LEFT_PHRASES, RIGHT_PHRASES
from corpuslens.functions import phrases as P
from corpuslens.functions import text as X
from plans import plan


def by_python(text, groups):
    low = (text or "").lower()
    return [sum(low.count(p) for p in g) for g in groups]


def counted(spark, texts, groups):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string").repartition(3)
    got = dict(rows.select("n", P.phrase_counts(F.col("text"), *groups)).collect())
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("n_phrases", [1, 30, 5000])
def test_counts_as_by_python(spark, n_phrases):
    r = random.Random(n_phrases)
    words = ["".join(r.choice("abcé ") for _ in range(r.randrange(1, 9))) for _ in range(n_phrases)]
    groups = [words[: n_phrases // 3], words[n_phrases // 3 :], ["aa", "aa", "abab", "É"]]
    texts = ["".join(r.choice("abcdé  ABÉ") for _ in range(r.choice([0, 5, 200, 3000]))) for _ in range(120)]
    texts += [None, "", "a" * 999, "ab" * 70_001, " ".join(words[:300])]
    assert counted(spark, texts, groups) == [by_python(t, groups) for t in texts]


@pytest.mark.parametrize("lanes, block", [(1, 7), (3, 50), (64, 1 << 20)])
def test_lanes_and_blocks_do_not_change_counts(monkeypatch, lanes, block):
    monkeypatch.setattr(P, "LANES", lanes)
    monkeypatch.setattr(P, "BLOCK", block)
    phrases = [b"abab", b"a", b"bb a", b"aaa"]
    a = P.Automaton(phrases)
    r = random.Random(2)
    texts = [bytes(r.choice(b"ab ") for _ in range(r.randrange(40))) for _ in range(60)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    got = a.count(data, offsets, np.arange(4), 4)
    assert got.tolist() == [[t.count(p) for p in phrases] for t in texts]


def test_no_phrases_and_empty_ones(spark):
    assert counted(spark, ["a", None], [[], ["a"]]) == [[0, 1], [0, 0]]
    with pytest.raises(ValueError, match="empty phrase"):
        P.phrase_counts(F.col("x"), [""])


def test_both_ways_to_count_agree(spark):
    r = random.Random(5)
    pool = [*LEFT_PHRASES, *RIGHT_PHRASES, "other", "words"]
    rows = spark.createDataFrame([(" ".join(r.choice(pool).upper() if r.random() < 0.3 else r.choice(pool) for _ in range(r.randrange(9))),) for _ in range(200)], "t string")
    one_by_one = X.slant(X.phrase_count(F.col("t"), LEFT_PHRASES), X.phrase_count(F.col("t"), RIGHT_PHRASES))
    got = rows.select(X.partisan_score(F.col("t")).alias("a"), one_by_one.alias("b"))
    assert got.filter("a <> b").count() == 0 and got.filter("a <> 0").count() > 50
    assert plan(got).count("ArrowEvalPython") == 1
