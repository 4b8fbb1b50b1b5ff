from pyspark.sql import functions as F

from corpuslens.plans.corpus import build_corpus

COLUMNS = "doc int, url string, crawl string, fetch_time string, text string"


def _pages(spark):
    rows = []
    for i in range(60):
        text = " ".join(f"word{(i % 40) * 7 + j}" for j in range(70))
        # Rows 40 to 59 repeat texts of earlier ones; the copy that is fetched first stays.
        rows.append((i, f"https://h/{i % 50}", f"C{i % 2}", f"{(i * 37) % 61:03d}", text))
    rows += [(60, "https://h/1", "C1", "999", "too short"), (61, None, "C1", "998", "x " * 80)]
    return spark.createDataFrame(rows + rows[:5], COLUMNS)


def test_named_documents_are_those_of_the_whole_corpus(spark):
    pages = _pages(spark)
    whole = sorted(map(tuple, build_corpus(pages).collect()), key=str)
    only = pages.filter("doc % 3 = 0").select("crawl", "url").union(spark.createDataFrame([("C9", "https://none"), ("C1", None)], "crawl string, url string"))
    names = {tuple(r) for r in only.collect()}
    got = sorted(map(tuple, build_corpus(pages, only=only).collect()), key=str)
    columns = build_corpus(pages).columns
    url, crawl = columns.index("url"), columns.index("crawl")
    assert got == [r for r in whole if r[url] is not None and (r[crawl], r[url]) in names]
    assert 0 < len(got) < len(whole)


def test_only_texts_that_stay_are_cleaned(spark):
    pages = _pages(spark)
    copies = pages.withColumn("fetch_time", F.concat(F.lit("z"), "fetch_time"))
    plan = build_corpus(pages.union(copies))._jdf.queryExecution().optimizedPlan().toString()
    # The cleaning stands above the join with the survivors.
    assert plan.index("Generate explode") < plan.index("Join LeftSemi")
