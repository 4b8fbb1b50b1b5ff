import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from corpuslens.defaults import NEGATORS
from corpuslens.operators import sentiment as S

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "no": -1.2, "kind": 2.4, "awful": -2.0, "very": 0.5, "best": 3.2}
# Single words and phrases; some overlap, some hold terms of the lexicon.
IDIOMS = {"plain word": 1.1, "good plain word": -2.0, "very good": 0.0, "word of plain": 2.2, "or nor": -1.5, "great at": 0.7}
BOOSTERS = S.BOOSTERS | {"word plain": 0.4, "of at or": -0.5, "kind of": -0.293}
PIECES = [
    "GOOD", "BAD", "VERY", "Great", "BARELY", "PLAIN", "NO", "kind of", "word plain", "plain word", "sort of",
    *LEXICON, "not", "isn't", "never", "so", "this", "without", "doubt", "very", "barely", "but", "least", "at", "or", "nor",
    "of", "plain", "word", "good!", "bad?", "(great),", "?", "!", ":)", "but,", "a.",
]


def brute(text: str, max_chars: int | None = 2000) -> tuple[float, float, float, float]:
    """One text at a time, straight from the description of the scheme."""
    text = (text or "")[:max_chars]
    written = []
    for t in text.split():
        bare = t.strip(string.punctuation)
        written.append(t if len(bare) <= 2 else bare)
    words = [t.lower() for t in written]
    differ = 0 < sum(t.isupper() for t in written) < len(written)

    def louder(i, v):
        return 0 if not differ or not written[i].isupper() else 0.733 if v > 0 else -0.733

    def phrase(i, j, known):
        return known.get(" ".join(words[i:j])) if 0 <= i and j <= len(words) else None

    def word(i):
        return words[i] if i >= 0 else None

    def negated(w):
        return w in NEGATORS or "n't" in w

    values = []
    for i, w in enumerate(words):
        following = words[i + 1] if i + 1 < len(words) else None
        if w not in LEXICON or w in BOOSTERS or (w == "kind" and following == "of"):
            values.append(0.0)
            continue
        p1, p2, p3 = word(i - 1), word(i - 2), word(i - 3)
        v = LEXICON[w]
        if w == "no" and following in LEXICON:
            v = 0.0
        if p1 == "no" or p2 == "no" or (p3 == "no" and p1 in ("or", "nor")):
            v = LEXICON[w] * -0.74
        v += louder(i, v)
        for d, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            p = word(i - d)
            if p is None or p in LEXICON:
                continue
            if p in BOOSTERS:
                v += (BOOSTERS[p] * (-1 if v < 0 else 1) + louder(i - d, v)) * damp
            if d == 1:
                v *= -0.74 if negated(p1) else 1
            elif d == 2:
                if p2 == "never" and p1 in ("so", "this"):
                    v *= 1.25
                elif p2 == "without" and p1 == "doubt":
                    pass
                elif negated(p2):
                    v *= -0.74
            else:
                if (p3 == "never" and p2 in ("so", "this")) or p1 in ("so", "this"):
                    v *= 1.25
                elif p3 == "without" and (p2 == "doubt" or p1 == "doubt"):
                    pass
                elif negated(p3):
                    v *= -0.74
                for a, b in ((i - 1, i + 1), (i - 2, i + 1), (i - 2, i), (i - 3, i), (i - 3, i - 1)):
                    if phrase(a, b, IDIOMS) is not None:
                        v = phrase(a, b, IDIOMS)
                        break
                for b in (i + 2, i + 3):
                    if phrase(i, b, IDIOMS) is not None:
                        v = phrase(i, b, IDIOMS)
                for a, b in ((i - 3, i), (i - 3, i - 1), (i - 2, i)):
                    v += phrase(a, b, BOOSTERS) or 0.0
        if p1 == "least" and p1 not in LEXICON and p2 not in ("at", "very"):
            v *= -0.74
        values.append(v)
    if "but" in words:
        at = words.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1.0) for i, v in enumerate(values)]
    if not values:
        return (0.0, 0.0, 0.0, 0.0)
    marks = text.count("?")
    amp = min(text.count("!"), 4) * 0.292 + (0 if marks <= 1 else marks * 0.18 if marks <= 3 else 0.96)
    total = round(sum(values), 9)
    total += amp if total > 0 else -amp if total < 0 else 0
    up, down = round(sum(v + 1 for v in values if v > 0), 9), round(sum(1 - v for v in values if v < 0), 9)
    calm = sum(v == 0 for v in values)
    up, down = up + (amp if up > down else 0), down + (amp if down > up else 0)
    whole = up + down + calm
    return (total / math.sqrt(total * total + 15), up / whole, down / whole, calm / whole)


def _docs(spark, n=800):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "  "), (n + 2, "good " * 900)], "doc_id int, text string")


def _score(spark, docs, **more):
    return S.lexicon_sentiment(docs, S.lexicon_table(spark, LEXICON), **{"boosters": BOOSTERS, "idioms": IDIOMS} | more)


@pytest.mark.parametrize("max_chars", [2000, 40, None])
def test_equals_scoring_one_text_at_a_time(spark, max_chars):
    docs = _docs(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = _score(spark, docs, max_chars=max_chars).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id], max_chars)
        got = (r.sentiment_compound, r.sentiment_pos, r.sentiment_neg, r.sentiment_neu)
        assert all(abs(a - b) <= t for a, b, t in zip(got, want, (5.01e-5, 5.01e-4, 5.01e-4, 5.01e-4))), (
            texts[r.doc_id], got, want)


def test_a_lexicon_that_is_shuffled_gives_the_same_scores(spark):
    docs = _docs(spark, 200)
    want = sorted(map(tuple, _score(spark, docs).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = _score(spark, docs)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_lexicon_of_published_size(spark):
    made = {f"made{i}": 1.0 + i % 3 for i in range(7_500)}
    docs = _docs(spark, 200)
    got = S.lexicon_sentiment(docs, S.lexicon_table(spark, LEXICON | made), boosters=BOOSTERS, idioms=IDIOMS)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _score(spark, docs).collect()))


# Texts and scores as published with the scheme, and the valences that they need.
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316),
    ("VADER is smart, handsome, and funny!", 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
    ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404),
    ("The book was kind of good.", 0.3832),
    ("At least it isn't a horrible book.", 0.431),
    ("Today SUX!", -0.5461),
    ("Not bad at all", 0.431),
]
VALENCES = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "kind": 2.4, "horrible": -2.5, "sux": -1.5, "bad": -2.5}


def test_published_examples(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PUBLISHED)], "doc_id int, text string")
    got = S.lexicon_sentiment(docs, S.lexicon_table(spark, VALENCES))
    assert {r.doc_id: r.sentiment_compound for r in got.collect()} == {i: v for i, (_, v) in enumerate(PUBLISHED)}


def test_idioms_and_degree_phrases(spark):
    texts = {
        "they say that is the shit": 3.0, "the party was the bomb": 3.0, "it gave me the kiss of death": -1.5,
        "well so it is bad ass": 1.5, "the film is just enough good": 1.9 - 0.293, "a film that is sort of good": 1.9 - 0.293,
        "is the bomb": -1.0, "the good ones are the bomb": 3.0 + 1.9,
    }
    lexicon = {"shit": -2.6, "bomb": -1.0, "kiss": 1.8, "death": -2.9, "bad": -2.5, "good": 1.9}
    docs = spark.createDataFrame([(t, t) for t in texts], "id string, text string")
    got = {r.id: r.sentiment_compound for r in S.lexicon_sentiment(docs, S.lexicon_table(spark, lexicon)).collect()}
    want = {t: v / math.sqrt(v * v + 15) for t, v in texts.items()}
    want["it gave me the kiss of death"] = None  # Both terms take the value of the phrase.
    for t, v in want.items():
        assert v is None and got[t] == round(-3.0 / math.sqrt(9 + 15), 4) or got[t] == round(v, 4), (t, got[t], v)


def test_equal_rows_stay_apart(spark):
    docs = spark.createDataFrame([(1, "good")] * 3, "doc_id int, text string")
    rows = _score(spark, docs).collect()
    assert len(rows) == 3 and len(set(rows)) == 1
    assert rows[0].sentiment_compound == 0.4404


def test_text_without_hits_is_neutral(spark):
    docs = spark.createDataFrame([(1, "plain words !!! ???")], "doc_id int, text string")
    assert tuple(_score(spark, docs).first()) == (1, 0.0, 0.0, 0.0, 1.0)


def test_scored_words_are_not_shuffled(spark):
    p = _score(spark, _docs(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "Python" not in p


def test_panel_counts_and_minimum(spark):
    rows = [("a", "2024-01", 0.5, 1.0, 0.1, 0.2)] * 10 + [("a", "2024-02", 0.5, 1.0, 0.1, 0.2)] * 9
    scored = spark.createDataFrame(
        rows, "domain string, year_month string, sentiment_compound double, partisan_score double, "
        "sentiment_pos double, sentiment_neg double"
    )
    got = S.sentiment_panel(scored).collect()
    assert [(r.year_month, r.doc_count, r.avg_sentiment, r.std_sentiment) for r in got] == [("2024-01", 10, 0.5, 0.0)]
    assert S.sentiment_panel(scored, 9).count() == 2
    assert S.sentiment_panel(scored.limit(1), 1).select(F.col("std_sentiment")).first()[0] is None


def test_only_terms_become_rows(spark):
    """Words are told apart inside the text's list: one look-up, of the valence, instead of one for each neighbour."""
    p = _score(spark, _docs(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert p.count("BroadcastHashJoin") == 1 and "posexplode" not in p


def test_large_lexicon_gives_the_same(spark, monkeypatch):
    docs = _docs(spark, 60)
    few = sorted(map(str, _score(spark, docs).collect()))
    monkeypatch.setattr(S, "MAX_TERMS", 3)
    many = _score(spark, docs)
    assert "posexplode" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, many.collect())) == few


def test_rows_are_copied_once_between_the_steps(spark):
    p = _score(spark, _docs(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert p.count("transform(array(base") == 1 and "\\s" not in p


def test_words_with_and_without_outer_marks(spark):
    """Words are cut and stripped as Python does it, with any white space between them."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB9é'.,(! \t\n\x0b\x1f\u3000") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", S._words(F.col("text")).alias("words")).collect():
        bare = [(t, t.strip(string.punctuation)) for t in r.text.split()]
        assert r.words == [t if len(b) <= 2 else b for t, b in bare]
