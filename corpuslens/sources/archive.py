"""Archived web records: byte-range reads and record parsing."""

import gzip
import os
import re
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import NativeFile, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.defaults import FETCH_ATTEMPTS, RECORDS_PER_TASK

RAW_RECORD = (
    "url string, crawl string, fetch_time string, warc_filename string, warc_offset bigint, raw binary, error string"
)


def _inflate(data: bytes) -> bytes:
    """The decompressed record, or the bytes as they are when they are not gzip."""
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        return data


def absolute_root(spark: SparkSession, root: str) -> str:
    """A path that means the same in every task: a relative one is resolved here, where Spark would resolve it, too."""
    if not root:
        raise ValueError("no folder given")
    if root.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root):
        return root
    if not spark.conf.get("spark.hadoop.fs.defaultFS", "file:").startswith("file:"):
        raise ValueError(f"a relative folder of a remote store cannot be read by range; give its URI: {root}")
    return os.path.abspath(root)


def open_store(root: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a folder given as a path or URI."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root[len("file:"):]
    return fs.FileSystem.from_uri(root)


def _read_range(file: NativeFile, offset: int, length: int) -> bytes:
    """Exactly ``length`` bytes: less is an error, not a record."""
    if length <= 0 or offset < 0:
        raise ValueError(f"no byte range: offset {offset}, length {length}")
    data = file.read_at(length, offset)
    if len(data) != length:
        raise EOFError(f"{len(data)} of {length} bytes at {offset}")
    return data


def fetch_records(manifest: DataFrame, root: str, tasks: int | None = None, attempts: int = FETCH_ATTEMPTS) -> DataFrame:
    """Read the byte range of every manifest row from the archive files under ``root``.

    ``root`` is a mounted folder or any file-system URI that Arrow reads by range. Rows are
    spread by file and slice of 4 MiB over tasks of about ``RECORDS_PER_TASK`` records, however
    many one file holds, and a task reads in ascending order. The number of tasks is set here,
    since the manifest is small in bytes and would otherwise be coalesced into a few tasks.

    Every manifest row comes back: with ``raw``, or with ``error`` if it could not be read whole.
    Errors of the store are tried again up to ``attempts`` times; a missing file or a range that
    does not fit the file is final. See ``fetched`` and ``rejected``.
    """
    schemas.require_columns(manifest, *schemas.SEGMENTS.fieldNames())
    root = absolute_root(manifest.sparkSession, root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        opened: tuple[str, NativeFile] | None = None

        def fetch(r) -> bytes:
            nonlocal opened
            for k in range(attempts):
                try:
                    if opened is None or opened[0] != r.warc_filename:
                        if opened is not None:
                            opened[1].close()
                        opened = None
                        opened = (r.warc_filename, store.open_input_file(f"{base}/{r.warc_filename}"))
                    return _inflate(_read_range(opened[1], int(r.warc_record_offset), int(r.warc_record_length)))
                except (FileNotFoundError, EOFError, TypeError, ValueError):
                    raise
                except OSError:
                    opened = None
                    if k + 1 == attempts:
                        raise
                    time.sleep(0.2 * 2**k)
            raise ValueError("attempts must be positive")

        # Few records at a time, since one may be megabytes long.
        for rows in (b[i:i + RECORDS_PER_TASK] for b in batches for i in range(0, len(b), RECORDS_PER_TASK)):
            raws, errors = [], []
            for r in rows.itertuples(index=False):
                try:
                    raws.append(fetch(r))
                    errors.append(None)
                except (OSError, EOFError, TypeError, ValueError) as e:
                    raws.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            out = rows.rename(columns={"warc_record_offset": "warc_offset"}).assign(raw=raws, error=errors)
            yield out.drop(columns="warc_record_length")

    wanted = manifest.select(
        "url", "crawl", F.col("fetch_time").cast("string").alias("fetch_time"), "warc_filename",
        "warc_record_offset", "warc_record_length",
    )
    if tasks is None:
        cores = manifest.sparkSession.sparkContext.defaultParallelism
        tasks = max(cores, manifest.count() // RECORDS_PER_TASK)
    slices = (F.col("warc_record_offset") / F.lit(4 * 1024 * 1024)).cast("bigint")
    spread = wanted.repartition(tasks, F.col("warc_filename"), slices)
    return spread.sortWithinPartitions("warc_filename", "warc_record_offset").mapInPandas(read, RAW_RECORD)


def fetched(records: DataFrame) -> DataFrame:
    """The records that could be read."""
    return records.filter("error IS NULL").drop("error")


def rejected(records: DataFrame) -> DataFrame:
    """The records that could not be read, with the reason."""
    return records.filter("error IS NOT NULL").drop("raw")


def parse_records(records: DataFrame, raw_col: str = "raw", max_html_chars: int | None = None) -> DataFrame:
    """Archived responses as (url, crawl, fetch_time, html, warc_filename, warc_offset).

    A record is archive head, HTTP head and body, parted by blank lines. Records with fewer
    parts, without a target URI or with a blank body are dropped.
    """
    if dict(records.dtypes)[raw_col] == "binary":
        # Malformed bytes are replaced, not an error.
        records = records.withColumn(raw_col, F.make_valid_utf8(F.col(raw_col).cast("string")))
    carried = [c for c in records.columns if c not in ("url", raw_col)]

    def response(parts: Column) -> Column:
        uri = F.trim(F.regexp_extract(F.get(parts, F.lit(0)), r"(?im)^warc-target-uri:([^\r\n]*)", 1))
        body = F.get(parts, F.lit(2))
        html = body if max_html_chars is None else F.substring(body, 1, max_html_chars)
        return F.struct(uri.alias("url"), html.alias("html"), body.rlike(r"\S").alias("filled"))

    # As an array of at most one response, since a filter would be evaluated below the projection and split again.
    found = F.transform(F.array(F.split(F.col(raw_col), r"\r\n\r\n", 3)), response)
    found = F.filter(found, lambda r: (r["url"] != "") & r["filled"])
    parsed = records.select(*carried, F.inline(found)).drop("filled")
    return parsed.select("url", *[c for c in carried if c in ("crawl", "fetch_time")], "html",
                         *[c for c in carried if c not in ("crawl", "fetch_time")])
