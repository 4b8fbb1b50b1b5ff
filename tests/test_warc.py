import gzip
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from corpuslens.sources import archive as A
from corpuslens.sources import warc as W

SF = "/root/testdata/sf0.001"


def body(r, n):
    return b"HTTP/1.1 200 OK\r\n\r\n" + r.randbytes(n)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files per kind; some bodies hold archives, which are kept uncompressed within members."""
    r, top = random.Random(3), tmp_path_factory.mktemp("warc")
    inner = b"".join(gzip.compress(I.warc_record("response", f"http://in/{k}", "d", body(r, 3000))) for k in range(40))
    inner_plain = b"".join(I.warc_record("response", f"http://in/{k}", "d", body(r, 300)) for k in range(30))
    want = []
    for name, zipped in (("CC-MAIN-2024-10/a.warc.gz", True), ("CC-MAIN-2024-10/b.warc", False), ("CC-MAIN-2023-06/sub/c.warc.gz", True), ("d.warc", False)):
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, "wb") as out:
            for k in range(60):
                block = inner if k % 20 == 7 else inner_plain[:-4] if k % 20 == 9 else body(r, r.choice([0, 50, 2000, 70_000]))
                kind = "warcinfo" if k == 0 else r.choice(["request", "response"])
                raw = I.warc_record(kind, f"http://h/{name}/{k}", str(k), block)
                data = gzip.compress(raw, 0 if k % 20 == 7 else 6) if zipped else raw
                want.append((f"http://h/{name}/{k}", str(k), kind, name, out.tell(), len(data), raw))
                out.write(data)
    (top / "notes.txt").write_text("not an archive")
    return str(top), want


@pytest.mark.parametrize("split", [1 << 30, 300_000, 70_000, 9_999])
def test_every_record_once_whatever_the_ranges(folder, split):
    root, want = folder
    reader = W.WarcReader(W.COLUMNS, {"path": root, "types": "all", "splitbytes": str(split)})
    parts = reader.partitions()
    rows = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert [x["error"] for x in rows if x["error"]] == []
    got = [(x["url"], x["fetch_time"], x["record_type"], x["warc_filename"], x["warc_offset"], x["warc_length"], x["raw"]) for x in rows]
    assert sorted(got) == sorted(want)
    assert (len(parts) > 100) == (split < 10_000)


def test_the_same_rows_as_by_manifest(spark, folder):
    root, want = folder
    found = W.read_archive(spark, root, splitBytes=100_000)
    assert found.count() == sum(w[2] == "response" for w in want)
    manifest = found.select(
        "url", "fetch_time", "warc_filename", F.col("warc_offset").alias("warc_record_offset"),
        F.col("warc_length").alias("warc_record_length"), F.lit("").alias("content_mime_detected"), "crawl",
    )
    fetched = A.fetched(A.fetch_records(manifest, root))
    assert sorted(map(tuple, found.select(*fetched.columns).collect()), key=str) == sorted(map(tuple, fetched.collect()), key=str)


def test_options_and_columns(spark, folder):
    root, want = folder
    heads = W.read_archive(spark, root, ["record_type", "warc_offset"], types="request,warcinfo", crawls="CC-MAIN-2024-10")
    assert heads.columns == ["record_type", "warc_offset"]
    assert heads.count() == sum(w[2] != "response" and w[3].startswith("CC-MAIN-2024") for w in want)
    assert W.read_archive(spark, root, suffixes=".none").count() == 0
    with pytest.raises(Exception, match="not those of an archive"):
        spark.read.format("warc").schema("body string").load(root).count()
    with pytest.raises(Exception, match="(?i)not.?found|no such|does not exist|cannot get"):
        W.read_archive(spark, f"{root}/absent").count()


def test_relative_folder(spark, folder, monkeypatch):
    root, want = folder
    monkeypatch.chdir(os.path.dirname(root))
    assert W.read_archive(spark, os.path.basename(root)).count() == sum(w[2] == "response" for w in want)
    with pytest.raises(ValueError, match="no folder"):
        W.read_archive(spark, "")


@pytest.mark.parametrize("split", [1 << 30, 40_000])
def test_faults_are_reported_and_the_rest_is_read(tmp_path, split):
    r = random.Random(9)
    raws = [I.warc_record("response", f"http://h/{k}", str(k), body(r, 20_000)) for k in range(30)]
    data = [gzip.compress(x) for x in raws]
    data[4] = data[4][:500] + b"\0" * 40 + data[4][540:]
    data[17] = b"nothing of the kind"
    data[29] = data[29][:-300]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(data))
    plain = list(raws)
    plain[3] = plain[3].replace(b"Content-Length: 2", b"Content-Length: 9999992")
    plain[8] = b"garbage" + plain[8][7:]
    plain[11] = plain[11].replace(b"Content-Length", b"Content-Size")
    plain[29] = plain[29][:-5000]
    (tmp_path / "y.warc").write_bytes(b"".join(plain))
    reader = W.WarcReader(W.COLUMNS, {"path": str(tmp_path), "splitbytes": str(split)})
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    read = {n: sorted(int(x["fetch_time"]) for x in rows if x["warc_filename"] == n and not x["error"]) for n in ("x.warc.gz", "y.warc")}
    assert read["x.warc.gz"] == [k for k in range(30) if k not in (4, 17, 29)]
    assert read["y.warc"] == [k for k in range(30) if k not in (3, 8, 29)]
    assert sum(bool(x["error"]) for x in rows if x["warc_filename"] == "x.warc.gz") == 3
    assert sum(bool(x["error"]) for x in rows if x["warc_filename"] == "y.warc") == 3
    assert next(x for x in rows if x["fetch_time"] == "11" and x["warc_filename"] == "y.warc")["raw"] == plain[11]


def test_one_member_of_many_records(tmp_path):
    raws = [I.warc_record("response", f"http://h/{k}", str(k), b"x" * k * 100_000) for k in range(30)]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(raws)))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    for split in (1 << 30, 1000):
        reader = W.WarcReader(W.COLUMNS, {"path": str(tmp_path), "splitbytes": str(split)})
        rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
        assert [x["raw"] for x in rows] == raws and {x["warc_offset"] for x in rows} == {0}


def test_errors_of_the_store_are_tried_again():
    tries = []

    def read():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("time-out")
        return "done"

    assert W.tried(read, 3, 0) == "done" and len(tries) == 3
    with pytest.raises(OSError):
        tries.clear()
        W.tried(read, 2, 0)


def test_archive_of_the_pages(spark):
    root = I.archive_folder(spark, SF)
    got = W.read_archive(spark, root, ["url", "crawl"], splitBytes=5000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, I.pages(spark, SF).select("url", "crawl").collect()))
    assert len(got) == pq.read_metadata(f"{SF}/pages.parquet").num_rows
