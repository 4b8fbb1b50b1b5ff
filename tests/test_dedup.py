import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import text_fingerprint
from corpuslens.functions.urls import url_fingerprint
from corpuslens.operators import dedup as D
from corpuslens.plans.corpus import build_corpus
from plans import plan

DDL = "url string, crawl string, fetch_time string, text string"
WORDS = " ".join(f"word{i}" for i in range(60))


def _pages(spark, n=600):
    """A third of the rows share one address and a third one text; some rows are full copies."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        url = None if i % 50 == 0 else f"http://h/{0 if i % 3 == 0 else rng.randint(0, 99)}{rng.choice(['', '/', '?q'])}"
        text = None if i % 60 == 1 else f"{0 if i % 3 == 1 else rng.randint(0, 150)} {WORDS}"
        rows.append((url, "C-2024-10", f"{rng.randint(0, 40):03d}", text))
    return spark.createDataFrame(rows + rows[:40], DDL)


def _keyed(df):
    return [
        tuple(r) for r in df.select(
            *[c.split()[0] for c in DDL.split(", ")],
            url_fingerprint(F.col("url")).alias("u"), text_fingerprint(F.col("text")).alias("t"),
        ).collect()
    ]


def _winners(rows, key):
    """Order values (fetch time, address) of the row that stays in each group; nulls come first."""
    best = {}
    for r in rows:
        order = (r[2], r[0] is not None, r[0] or "")
        if r[key] not in best or order < best[r[key]]:
            best[r[key]] = order
    return sorted(best.items(), key=str)


@pytest.mark.parametrize("dedup, key", [(D.dedup_by_url, 4), (D.dedup_by_text, 5)])
def test_earliest_of_each_group_stays(spark, dedup, key):
    pages = _pages(spark)
    kept = _keyed(dedup(pages))
    assert len(kept) == len({r[key] for r in kept})
    assert _winners(kept, key) == _winners(_keyed(pages), key)
    assert sum(r[key] is None for r in kept) == 1


@pytest.mark.parametrize("dedup", [D.dedup_by_url, D.dedup_by_text])
def test_idempotent_and_independent_of_partitioning(spark, dedup):
    pages = _pages(spark)
    once = sorted(map(str, dedup(pages).collect()))
    assert sorted(map(str, dedup(dedup(pages)).collect())) == once
    assert sorted(map(str, dedup(pages.repartition(13)).collect())) == once


def test_tie_goes_to_the_smaller_url(spark):
    df = spark.createDataFrame([("http://h/p?b", "C", "1", "x"), ("http://h/p?a", "C", "1", "y")], DDL)
    assert D.dedup_by_url(df).first().url == "http://h/p?a"


def test_crawls_are_kept_apart(spark):
    rows = [("http://h/p", "C-2022-05", "1", f"x {WORDS}"), ("http://h/p", "C-2024-10", "2", f"x {WORDS}"),
            ("http://h/p?q", "C-2024-10", "3", f"x {WORDS}")]
    got = build_corpus(spark.createDataFrame(rows, DDL)).select("crawl", "url").collect()
    assert sorted(map(tuple, got)) == [("C-2022-05", "http://h/p"), ("C-2024-10", "http://h/p")]


def test_articles_with_an_equal_opening_both_stay(spark):
    opening = "word " * 200
    rows = [("http://h/1", "C", "1", opening + "one"), ("http://h/2", "C", "2", opening + "two")]
    assert build_corpus(spark.createDataFrame(rows, DDL)).count() == 2


def test_url_pass_goes_before_text_pass(spark):
    # The text pass must not see row b, which the URL pass removes.
    rows = [("http://h/1", "C", "1", f"x {WORDS}"), ("http://h/1?b", "C", "2", f"y {WORDS}"),
            ("http://h/2", "C", "3", f"y {WORDS}")]
    got = {r.url for r in build_corpus(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {"http://h/1", "http://h/2"}


def test_copies_are_chosen_before_texts_are_filtered(spark):
    # The earliest copy is too foreign to stay, and its later copy does not take its place.
    rows = [("http://h/1", "C", "1", "é" * 80 + f" {WORDS}"[:100]), ("http://h/1", "C", "2", WORDS)]
    assert build_corpus(spark.createDataFrame(rows, DDL)).count() == 0


def test_corpus_columns_and_month(spark):
    df = spark.createDataFrame([("http://h/1", "C-2024-10", "1", f"See http://x.y {WORDS.upper()} me@x.org")], DDL)
    row = build_corpus(df).first()
    assert (row.text, row.year_month) == (f"see {WORDS}", "2024-03")


def test_texts_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(build_corpus(_pages(spark, 20)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning(_id1") == 2  # texts once, ids once
    assert p.count("partial_min(struct(fetch_time") == 2
    assert "Window" not in p and "Python" not in p
