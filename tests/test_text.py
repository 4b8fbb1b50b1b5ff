import hashlib
import random

from pyspark.sql import functions as F

from corpuslens.functions import text as X
from plans import plan

PIECES = [
    "a", "b", "é", "ﬁ", "½", "@", ".", "http://", "https://", " ", " ", "\n", "\n", "\t", "\x85", "\xa0", "\u2003",
    "\u2028", "\u3000", "\x1c", "\x1f", "\u200b", "’", "x", "www", "/", "Ab c",
]


def _texts(spark, n=4000):
    rng = random.Random(3)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return spark.createDataFrame([(t,) for t in [*made, "", None]], "t string")


def _pairs(spark, pairs, f):
    """What ``f`` makes of the first of each pair, next to the second."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string")
    got = {r.i: r.got for r in df.select("i", f(F.col("t")).alias("got")).collect()}
    return [(pairs[i][0], got[i]) for i in range(len(pairs))], pairs


CLEANED = [
    ("See HTTP://a.b/c?d and HTTPS://x now", "see and now"),
    ("write to Me@Host.org or not", "write to or not"),
    ("a@b is kept, as is @c.d and e@.", "a@b is kept, as is @c.d and e@."),
    ("(mail: <me@host.org>,) ends", "(mail: ends"),
    ("one\t\ttwo\n\nthree\xa0four\u3000five", "one two three four five"),
    ("one\x1ctwo\x85three", "one two three"),
    ("zero\u200bwidth stays", "zero\u200bwidth stays"),
    ("http:// alone", "http:// alone"),
    ("xhttp://glued/y z", "x z"),
    ("single", None), ("http://only.link", None), ("", None), (None, None), (" \n ", None),
]


def test_cleaned_texts(spark):
    got, want = _pairs(spark, CLEANED, lambda t: X.clean_for_nlp(t, 2))
    assert got == want


def test_cleaned_texts_hold_no_link_and_cleaning_again_changes_nothing(spark):
    once = _texts(spark).select(X.clean_for_nlp(F.col("t"), 2).alias("c")).filter("c IS NOT NULL")
    rows = once.select("c", X.clean_for_nlp(F.col("c"), 2).alias("again")).collect()
    assert len(rows) > 1000
    for r in rows:
        assert r.c == r.c.lower() and r.c == r.c.strip() and "  " not in r.c and len(r.c.split(" ")) >= 2
        assert not any(w.startswith(("http://", "https://")) and len(w) > 8 for w in r.c.split(" "))
        # A link that was cut out can leave a mail address behind, never a longer text.
        assert r.again is None or len(r.again) <= len(r.c)


def test_long_unbroken_run_is_cleaned_in_linear_time(spark):
    run = "x" * 300_000
    df = spark.createDataFrame([(f"{run} a@b {run}@c {run}",)], "t string")
    assert df.select(F.length(X.clean_for_nlp(F.col("t"), 1))).first()[0] == 3 * len(run) + 8


def test_filter_on_cleaned_text_cleans_once(spark):
    df = _texts(spark, 10).select(F.explode(X.cleaned(F.col("t"), 2)).alias("t"))
    assert plan(df).count("lower(") == 1


NORMALIZED = [
    ("ﬁne ½ Ⅷ", "fine 1⁄2 VIII"), ("e\u0301", "é"), ("a \t b\xa0\xa0c", "a b c"), ("a\r\nb", "a \nb"), ("a\n\n\n\n\nb", "a\n\nb"),
    ("a\n\nb", "a\n\nb"), ("a\n \n \nb", "a\n \n \nb"), (" \n a \n ", "a"), ("\u3000wide\u3000", "wide"), ("", ""), (None, None),
]


def test_normalized_texts(spark):
    got, want = _pairs(spark, NORMALIZED, X.normalize_text)
    assert got == want


def test_normalising_again_changes_nothing(spark):
    rows = _texts(spark).select(X.normalize_text(F.col("t")).alias("n")).filter("n IS NOT NULL")
    for r in rows.select("n", X.normalize_text(F.col("n")).alias("again")).collect():
        assert r.again == r.n and "\n\n\n" not in r.n and "  " not in r.n and "\xa0" not in r.n


def test_fingerprints_of_texts(spark):
    texts = ["The  Cat\n", "the cat", "THE\tCAT", "\xa0the cat ", "the cats", "", None]
    got, _ = _pairs(spark, [(t, None) for t in texts], X.text_fingerprint)
    keys = [k for _, k in got]
    assert set(keys[:4]) == {hashlib.md5(b"the cat").hexdigest()} and keys[4] not in keys[:4] and keys[5:] == [None, None]


def test_texts_that_differ_after_a_long_equal_opening_have_two_keys(spark):
    opening = "word " * 200
    df = spark.createDataFrame([(opening + "one",), (opening + "two",)], "t string")
    assert df.select(X.text_fingerprint(F.col("t"))).distinct().count() == 2
    assert df.select(X.text_fingerprint(F.col("t"), 500)).distinct().count() == 1


def test_non_ascii_ratio(spark):
    rows = _texts(spark).select("t", X.non_ascii_ratio(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.r == (sum(ord(c) > 127 for c in r.t) / len(r.t) if r.t else 1.0)


def test_ratio_at_the_limit_is_kept(spark):
    from corpuslens.plans.corpus import ascii_only

    df = spark.createDataFrame([("é" * 15 + "a" * 85,), ("é" * 16 + "a" * 84,)], "text string")
    assert ascii_only(df).count() == 1


def test_phrase_count_has_no_overlap_and_no_word_bounds(spark):
    df = spark.createDataFrame([("aaaa Free Market freemarket free marketing",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(X.phrase_count(F.col("t"), ["aa", "free market"])).collect()]
    assert got == [4, 0, 0]


def test_partisan_score_range_and_negation(spark):
    df = _texts(spark)
    left, right = ["a", "www"], ["b", "x"]
    rows = df.select(
        X.partisan_score(F.col("t"), left, right).alias("p"), X.partisan_score(F.col("t"), right, left).alias("q"),
        X.phrase_count(F.col("t"), left + right).alias("n"),
    ).collect()
    assert all(r.p == -r.q and -1 <= r.p <= 1 and (r.n > 0 or r.p == 0.0) for r in rows)
    assert len({r.p for r in rows}) > 5


def test_tokenize(spark):
    df = spark.createDataFrame([("It's 4 BIG-time é days",)], "t string")
    assert df.select(X.tokenize(F.col("t"))).first()[0] == ["big", "time", "days"]


def test_only_normalisation_uses_python(spark):
    df = _texts(spark, 10)
    t = F.col("t")
    native = df.select(
        X.clean_for_nlp(t), X.text_fingerprint(t), X.non_ascii_ratio(t), X.partisan_score(t, ["of the"], ["in the"]), X.tokenize(t),
    )
    assert "Python" not in plan(native)
    assert "BatchEvalPython" not in plan(df.select(X.normalize_text(t)))
