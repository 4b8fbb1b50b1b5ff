import gzip

import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from corpuslens.schemas import SEGMENTS
from corpuslens.sources import archive as A
from plans import plan

HEAD = "WARC/1.0\r\nWARC-Type: response\r\nwarc-target-URI:  http://h/p:1 \r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def _parse(spark, raws):
    df = spark.createDataFrame([("given", i, r) for i, r in enumerate(raws)], "url string, n int, raw string")
    return {r.n: (r.url, r.html) for r in A.parse_records(df).collect()}


def test_parse(spark):
    got = _parse(spark, [
        HEAD + HTTP + "<p>a\r\n\r\nb</p>",
        HEAD + HTTP + " \r\n ",
        "WARC/1.0\r\nWARC-Type: response\r\n\r\n" + HTTP + "body",
        HEAD + "only two parts",
        "",
        None,
    ])
    assert got == {0: ("http://h/p:1", "<p>a\r\n\r\nb</p>")}


def test_body_length(spark):
    df = spark.createDataFrame([(HEAD + HTTP + "x" * 600_000,)], "raw string")
    assert len(A.parse_records(df).first().html) == 600_000
    assert len(A.parse_records(df, max_html_chars=500_000).first().html) == 500_000


def test_a_record_is_split_once(spark):
    df = spark.range(1).select(F.concat(F.lit(HEAD + HTTP), "id").alias("raw"))
    assert plan(A.parse_records(df)).count("split(") == 1


def test_malformed_bytes_are_replaced(spark):
    df = spark.createDataFrame([(bytearray((HEAD + HTTP).encode() + b"a\xffb"),)], "raw binary")
    assert A.parse_records(df).first().html == "a�b"


@pytest.fixture
def manifest(spark, tmp_path):
    plain = [f"{HEAD}{HTTP}body {i} é".encode() for i in range(40)]
    rows, at = [], 0
    with open(tmp_path / "a.warc", "wb") as out:
        for i, r in enumerate(plain):
            data = gzip.compress(r) if i % 2 else r
            rows.append((f"u{i}", "t", "a.warc", at, len(data), "text/html", "C"))
            at += out.write(data)
    rows.append(("gone", "t", "missing.warc", 0, 10, "text/html", "C"))
    rows.append(("beyond", "t", "a.warc", at + 100, 10, "text/html", "C"))
    rows.append(("null", "t", "a.warc", None, 10, "text/html", "C"))
    rows.append(("short", "t", "a.warc", at - 5, 10, "text/html", "C"))
    rows.append(("empty", "t", "a.warc", 0, 0, "text/html", "C"))
    return spark.createDataFrame(rows, SEGMENTS)


@pytest.mark.parametrize("tasks", [None, 1, 7])
def test_fetch_reads_ranges_and_reports_bad_rows(spark, tmp_path, manifest, tasks):
    every = A.fetch_records(manifest, str(tmp_path), tasks)
    assert every.count() == manifest.count()
    lost = {r.url: r.error.split(":")[0] for r in A.rejected(every).collect()}
    assert lost == {
        "gone": "FileNotFoundError", "beyond": "EOFError", "null": "TypeError" if lost["null"] == "TypeError" else "ValueError",
        "short": "EOFError", "empty": "ValueError",
    }
    got = A.fetched(every)
    assert {bytes(r.raw).decode().rsplit("body ")[1] for r in got.collect()} == {f"{i} é" for i in range(40)}
    assert A.parse_records(got).count() == 40


def test_stored_archive_gives_back_every_page(spark):
    located, root = I.archive(spark, "/root/testdata/sf0.001")
    got = A.parse_records(A.fetched(A.fetch_records(located, root))).select("url", "html")
    want = I.pages(spark, "/root/testdata/sf0.001").select("url", "html")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_errors_of_the_store_are_tried_again(spark, tmp_path, manifest, monkeypatch):
    reads = []

    class Flaky:
        def read_at(self, length, offset):
            reads.append(offset)
            if len(reads) < 3:
                raise OSError("time-out")
            return b"x" * length

        def close(self):
            pass

    class Store:
        def open_input_file(self, path):
            return Flaky()

    monkeypatch.setattr(A, "open_store", lambda root: (Store(), root))
    monkeypatch.setattr(A.time, "sleep", lambda s: None)
    run = []
    monkeypatch.setattr(type(manifest), "mapInPandas", lambda self, f, schema: run.append(f) or self)
    A.fetch_records(manifest, "nowhere", 1)
    rows = manifest.filter("url = 'u0'").toPandas()
    out = next(run[-1](iter([rows])))
    assert len(reads) == 3 and out["error"].isna().all()


def test_a_relative_folder_is_resolved_before_it_is_sent(spark, tmp_path, manifest, monkeypatch):
    monkeypatch.chdir(tmp_path.parent)
    got = A.fetched(A.fetch_records(manifest, tmp_path.name, 2))
    monkeypatch.chdir("/")
    assert got.count() == 40
    with pytest.raises(ValueError, match="no folder"):
        A.fetch_records(manifest, "")
