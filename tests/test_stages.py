import json

import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from corpuslens import schemas
from corpuslens.operators.index import filter_index, sample_index, sample_index_by_url
from corpuslens.plans import stages as P
from corpuslens.sources import stages as ST
from plans import plan

SF = "/root/testdata/sf0.001"


def test_whole_study(spark, tmp_path):
    out = str(tmp_path / "study")
    located, root = I.archive(spark, SF)
    rows = P.collect_corpus(located, root, out, domains=["example.com", "example.org", "example.net"])
    assert rows["segments"] == rows["raw-html"] >= rows["clean-text"] >= rows["corpus"] > 0
    assert spark.read.parquet(f"{out}/corpus").count() == rows["corpus"]
    rows |= P.score_corpus(spark, out, I.lexicon(spark), I.LEFT, I.RIGHT, I.NEGATORS, I.BOOSTERS, min_docs=1)
    assert rows["sentiment/by_document"] == rows["corpus"]
    rows |= P.model_topics(spark, out, k=4, max_iter=2, vocab_size=500, min_df=2)
    assert rows["topics/doc_topics"] == rows["corpus"]
    terms = [json.loads(r.value) for r in spark.read.text(f"{out}/topics/topic_terms").collect()]
    assert sorted(t["topic"] for t in terms) == [0, 1, 2, 3] and all(len(t["terms"]) == 20 for t in terms)
    rows |= P.score_ideology(spark, out, {0: -1.0, 1: 1.0}, min_docs=1)
    rows |= P.cluster_panel(spark, out, k=3, min_docs=1)
    clusters = spark.read.parquet(f"{out}/clusters/domain_clusters")
    assert clusters.count() == rows["clusters/domain_clusters"] > 3
    assert {"domain", "cluster", "total_docs", "x", "y", "ideology_label"} <= set(clusters.columns)
    summary = spark.read.option("header", True).csv(f"{out}/clusters/cluster_summary")
    assert {r.ideology_label for r in summary.collect()} == {"Left", "Center", "Right"}
    metrics = spark.read.json(f"{out}/clusters/polarization_metrics").collect()
    assert {m.k for m in metrics} == {3} and sum(m.n_domains for m in metrics) == rows["clusters/domain_clusters"]
    assert rows["rejects"] == 0 and rows["fetched"] == rows["segments"]
    trends = P.trend_tables(spark, out, ["example.com", "example.org"], 20)
    assert trends["trends/polarization_trend"] == 1 and trends["trends/polarization_interval"] == 6 and trends["trends/polarization_changes"] == 5
    assert trends["trends/topic_prevalence"] == 4 * spark.read.parquet(f"{out}/corpus").select("year_month").distinct().count()
    crawls = P.publish_crawls(spark, out, str(tmp_path / "published"))
    assert len(crawls) == 6 == len(metrics)
    panels = ST.read_panel(spark, str(tmp_path / "published"), crawls)
    assert sum(p.count() for p in panels.values()) == rows["ideology/domain_ideology"]
    assert ST.read_metrics(spark, str(tmp_path / "published")).count() == 6


def test_study_from_archive_files_without_an_index(spark, tmp_path):
    """The same corpus as by the index, but for the blank lines that end a record."""
    located, root = I.archive(spark, SF)
    domains = ["example.com", "example.org"]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    P.collect_corpus(located.withColumn("content_mime_detected", F.lit("text/html")), root, one, domains=domains)
    rows = P.collect_archive(spark, I.archive_folder(spark, SF), two, domains=domains, splitBytes=20_000)
    a, b = (sorted(map(tuple, spark.read.parquet(f"{o}/corpus").select("url", "crawl", "fetch_time", "text").collect())) for o in (one, two))
    assert a == b and len(a) == rows["corpus"] > 5 and rows["rejects"] == 0
    some = P.collect_archive(spark, I.archive_folder(spark, SF), str(tmp_path / "some"), I.CRAWLS[:2], domains)
    assert some["fetched"] == sum(r[1] in I.CRAWLS[:2] for r in spark.read.parquet(f"{two}/fetched").select("url", F.col("crawl").cast("string")).collect())


def test_too_many_lost_records_stop_the_study(spark, tmp_path):
    located, root = I.archive(spark, SF)
    lost = located.withColumn("warc_filename", F.lit("absent.warc"))
    with pytest.raises(RuntimeError, match="could not be read"):
        P.collect_corpus(lost, root, str(tmp_path / "study"), domains=["example.com"])
    assert spark.read.parquet(str(tmp_path / "study" / "rejects")).count() > 0


def test_missing_column_is_an_error(spark, tmp_path):
    spark.range(1).selectExpr("'u' AS url").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="crawl"):
        ST.read_stage(spark, str(tmp_path / "t"), schemas.SEGMENTS)


def test_crawl_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "seg")
    assert ST.write_stage(I.index(spark, SF), path, ["crawl"]) == I.index(spark, SF).count()
    stored = ST.read_stage(spark, path, schemas.SEGMENTS)
    p = plan(filter_index(stored, "CC-MAIN-2024-10"))
    assert "PartitionFilters: [isnotnull(crawl" in p
    assert "EqualTo(content_mime_detected,text/html)" in p
    assert "Python" not in p


def test_number_of_files(spark, tmp_path):
    path = tmp_path / "t"
    ST.write_stage(spark.range(100), str(path), files=3)
    assert len(list(path.glob("part-*.parquet"))) == 3


def test_topic_labels(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"0": -0.5,\n "12": 1}')
    rows = ST.read_topic_labels(spark, str(tmp_path / "labels.json")).collect()
    assert {tuple(r) for r in rows} == {(0, -0.5), (12, 1.0)}


def test_panels_of_absent_crawls_are_skipped(spark, tmp_path):
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.DOMAIN_IDEOLOGY])
    row.write.parquet(str(tmp_path / "c1" / "domain_ideology"))
    with pytest.warns(UserWarning, match="c2"):
        assert list(ST.read_panel(spark, str(tmp_path), ["c1", "c2"])) == ["c1"]
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        ST.read_panel(spark, str(tmp_path), ["c3"])


def test_shared_folder_setting_is_used(spark, monkeypatch, tmp_path):
    with pytest.raises(ValueError, match="share"):
        # The warehouse of this session is a local folder, which other machines would not see.
        class Elsewhere:
            conf = type("C", (), {"get": staticmethod(lambda k, *d: None if k == "spark.checkpoint.dir" else "file:/tmp/warehouse")})
            sparkContext = type("S", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})

        ST.shared_dir(Elsewhere, "x")
    assert ST.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_samples(spark):
    index = I.index(spark, SF)
    assert sample_index(index, 1.0) is index
    assert sorted(map(str, sample_index_by_url(index, 0.3).collect())) == sorted(
        map(str, sample_index_by_url(index.repartition(5), 0.3).collect())
    )
    small, large = (sample_index_by_url(index, f).select("url") for f in (0.2, 0.6))
    assert small.exceptAll(large).count() == 0 < small.count() < large.count() < index.count()
