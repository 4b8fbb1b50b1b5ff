import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import ideology as G
from corpuslens.operators import partials as P
from corpuslens.operators import sentiment as S

SCHEMA = (
    "domain string, year_month string, crawl string, dominant_topic int, sentiment_compound double, partisan_score double, "
    "sentiment_pos double, sentiment_neg double, topic_ideology_score double, composite_ideology double"
)


def documents(n, seed, shift=0.0):
    r = random.Random(seed)

    def score():
        return None if r.random() < 0.03 else round(r.uniform(-1, 1), 4)

    return [
        (r.choice(["a", "b", "c", None]), r.choice(["2024-01", "2024-02"]), r.choice("pqr"), r.choice([None, 0, 1, 2, 7]), score(),
         r.choice([None, -1.0, 0.0, 0.3]), score(), score(), r.uniform(-1, 1), shift + r.uniform(-1e-3, 1e-3))
        for _ in range(n)
    ]


def same(got, want, by):
    key = lambda r: tuple(str(r[c]) for c in by)
    a, b = ({key(r): r.asDict() for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and set(got.columns) == set(want.columns)
    for k in a:
        for c, x in a[k].items():
            y = b[k][c]
            assert x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)), (k, c, x, y)


@pytest.mark.parametrize("by", [("domain",), ("domain", "year_month")])
def test_panels_from_parts_equal_panels_from_documents(spark, tmp_path, by):
    docs = spark.createDataFrame(documents(900, 1), SCHEMA)
    base = str(tmp_path / "parts")
    for crawl in "pqr":
        own = docs.filter(F.col("crawl") == crawl)
        assert P.add_part(own, f"{base}/s", crawl, P.SENTIMENT, by) == own.select(*by).distinct().count()
        P.add_part(own, f"{base}/i", crawl, P.IDEOLOGY, by, "dominant_topic")
    same(P.sentiment_panel_of(P.read_parts(spark, f"{base}/s", "pqr", by), 3, by), S.sentiment_panel(docs, 3, by), by)
    same(P.ideology_panel_of(P.read_parts(spark, f"{base}/i", "pqr", by), 3, by), G.ideology_panel(docs, 3, by), by)


def test_a_part_is_replaced_and_merged_parts_merge_again(spark, tmp_path):
    docs = spark.createDataFrame(documents(400, 2), SCHEMA)
    base, by = str(tmp_path), ("domain",)
    for crawl in ("p", "q", "r", "p"):
        P.add_part(docs.filter(F.col("crawl") == crawl), base, crawl, P.IDEOLOGY, by, "dominant_topic")
    two = P.read_parts(spark, base, ["p", "q"], by)
    third = P.read_parts(spark, base, ["r"], by)
    again = P.merge_parts(two.unionByName(third), by)
    same(P.ideology_panel_of(again, 1, by), G.ideology_panel(docs, 1, by), by)


def test_deviations_far_from_zero_do_not_cancel(spark):
    """Values of 1e8 that differ by a thousandth: sums of squares would lose the difference."""
    docs = spark.createDataFrame(documents(600, 3, 1e8), SCHEMA)
    parts = [P.panel_parts(docs.filter(F.col("crawl") == c), list(P.IDEOLOGY), ("year_month",), "dominant_topic") for c in "pqr"]
    merged = P.merge_parts(parts[0].unionByName(parts[1]).unionByName(parts[2]), ("year_month",))
    got = {r.year_month: r.ideology_std for r in P.ideology_panel_of(merged, 1, ("year_month",)).collect()}
    for month, values in {m: [r[9] for r in documents(600, 3, 1e8) if r[1] == m] for m in got}.items():
        mean = math.fsum(values) / len(values)
        assert math.isclose(got[month], math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1)), rel_tol=1e-3)


def test_no_documents_and_absent_parts(spark, tmp_path):
    docs = spark.createDataFrame(documents(20, 4), SCHEMA)
    assert P.add_part(docs.limit(0), str(tmp_path), "p", P.SENTIMENT) == 0
    assert P.read_parts(spark, str(tmp_path), ["p"]).count() == 0
    with pytest.raises(ValueError, match="no part"):
        P.read_parts(spark, str(tmp_path), ["p", "q"])
    with pytest.raises(ValueError, match="no crawls"):
        P.read_parts(spark, str(tmp_path), [])


def test_documents_are_not_gathered(spark):
    docs = spark.createDataFrame(documents(50, 5), SCHEMA)
    plan = P.panel_parts(docs, list(P.SENTIMENT))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1
