"""Archive folders as a Spark data source: ``spark.read.format("warc").load(folder)``.

No manifest is needed. Partitions are byte ranges of files, and a record belongs to the range in
which it starts, or its gzip member does. Where a range starts inside a file of members, the
first member is found by its magic number and proved: see ``_synced``. Ranges end where the next
one's first member starts, by the same rule, so every record is read once whatever the ranges are.
"""

import re
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import NativeFile, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuslens.defaults import FETCH_ATTEMPTS
from corpuslens.sources.archive import absolute_root, open_store

_LONG = ("warc_offset", "warc_length")
COLUMNS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("url", "crawl", "fetch_time", "record_type", "warc_filename")]
    + [T.StructField(c, T.LongType()) for c in _LONG]
    + [T.StructField("raw", T.BinaryType()), T.StructField("error", T.StringType())]
)
#: Bytes of a partition, and of one read.
SPLIT, BLOCK = 64 << 20, 1 << 20
#: Records and bytes of a batch at most, but for a single larger record.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Files whose names end like this are read.
SUFFIXES = ".warc,.warc.gz"
_MAGIC, _HEAD_END, _GAP = b"\x1f\x8b\x08", b"\r\n\r\n", b"\r\n\r\nWARC/1."
#: A gzip member copied into another one lies in stored blocks, and these hold 65,535 bytes at most.
_STORED = 65_536
_CRAWL = re.compile(r"CC-MAIN-\d{4}-\d{2}")


def tried(read: Callable, attempts: int, pause: float = 0.2):
    """The result of ``read``; errors of the store are tried again, a missing file is final."""
    for k in range(attempts):
        try:
            return read()
        except FileNotFoundError:
            raise
        except OSError:
            if k + 1 == attempts:
                raise
            time.sleep(pause * 2**k)


class _File:
    """Bytes of a file by offset; the last block that was read is kept."""

    def __init__(self, open_: Callable[[], NativeFile], size: int, attempts: int):
        self.open, self.size, self.attempts = open_, size, attempts
        self.file, self.at, self.block = None, 0, b""

    def _read(self, offset: int, n: int) -> bytes:
        try:
            if self.file is None:
                self.file = self.open()
            return self.file.read_at(n, offset)
        except OSError:
            self.file = None
            raise

    def get(self, offset: int, n: int) -> bytes:
        """At most n bytes, fewer only at the end of the file."""
        n = max(0, min(n, self.size - offset))
        lo = offset - self.at
        if not 0 <= lo <= lo + n <= len(self.block):
            want = min(max(n, BLOCK), self.size - offset)
            block = tried(lambda: self._read(offset, want), self.attempts)
            if len(block) != want:
                raise EOFError(f"{len(block)} of {want} bytes at {offset}")
            self.at, self.block, lo = offset, block, 0
        return self.block[lo : lo + n]

    def find(self, mark: bytes, offset: int) -> int:
        """The first place of the mark from the offset on, or -1."""
        while offset < self.size:
            block = self.get(offset, BLOCK)
            k = block.find(mark)
            if k >= 0:
                return offset + k
            offset += max(1, len(block) - len(mark) + 1)
        return -1

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Member:
    """One gzip member: ``chunks`` are its contents; once they are used up, ``end`` is the place after it."""

    def __init__(self, file: _File, offset: int):
        self.file, self.offset, self.end = file, offset, -1

    def chunks(self) -> Iterator[bytes]:
        inflate, at = zlib.decompressobj(31), self.offset
        while not inflate.eof:
            data = self.file.get(at, 1 << 16)
            if not data:
                raise EOFError(f"member at {self.offset} is cut off")
            at += len(data)
            # A little may become a lot: no more than a block is inflated at a time.
            out = inflate.decompress(data, BLOCK)
            while out:
                yield out
                out = inflate.decompress(inflate.unconsumed_tail, BLOCK)
        self.end = at - len(inflate.unused_data)


def _proved(file: _File, offset: int) -> bool:
    """Whether a member of the file itself starts here.

    It begins with a record, and members follow one another without a fault over ``_STORED``
    bytes or to the end of the file. A member inside a member's contents lies in stored blocks,
    whose heads would be such a fault.
    """
    at = offset
    try:
        while at < file.size and at - offset < _STORED:
            member, first = _Member(file, at), b""
            for chunk in member.chunks():
                if at == offset and len(first) < 5:
                    first += chunk[:5]
                    if not b"WARC/".startswith(first[:5]):
                        return False
            at = member.end
        return True
    except (zlib.error, EOFError):
        return False


def _synced(file: _File, offset: int) -> int:
    """The first proved member from the offset on, or the end of the file."""
    while True:
        offset = file.find(_MAGIC, offset)
        if offset < 0:
            return file.size
        if _proved(file, offset):
            return offset
        offset += 1


@dataclass
class _Head:
    type: str | None
    url: str | None
    date: str | None
    length: int | None


def _head(data: bytes) -> _Head:
    """Fields of the head of a record."""
    fields = {}
    for line in data.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())

    def text(name: bytes) -> str | None:
        return fields[name].decode(errors="replace") if name in fields else None

    url, n = text(b"warc-target-uri"), fields.get(b"content-length", b"")
    if url and url.startswith("<") and url.endswith(">"):
        url = url[1:-1]
    return _Head(text(b"warc-type"), url, text(b"warc-date"), int(n) if n.isdigit() else None)


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[_Head, bytes]]:
    """(head, bytes) of the records in the contents of a member, one at a time; without a length the rest is one record."""
    buffer, more = bytearray(), True

    def fill(n: int | None, mark: bytes | None = None) -> None:
        nonlocal more
        while more and (mark not in buffer if mark else n is None or len(buffer) < n):
            chunk = next(chunks, None)
            more = chunk is not None
            buffer.extend(chunk or b"")

    while True:
        fill(None, _HEAD_END)
        if not buffer.strip(b"\r\n"):
            fill(None)
            if not buffer.strip(b"\r\n"):
                return
        if not buffer.startswith(b"WARC/"):
            raise ValueError("no record")
        cut = buffer.find(_HEAD_END)
        head = _head(bytes(buffer[: cut if cut >= 0 else len(buffer)]))
        fill(None if cut < 0 or head.length is None else cut + 4 + head.length + 4)
        end = len(buffer) if cut < 0 or head.length is None else cut + 4 + head.length
        if end > len(buffer):
            raise EOFError("record is cut off")
        while end < len(buffer) and buffer[end : end + 1] in (b"\r", b"\n"):
            end += 1
        yield head, bytes(buffer[:end])
        del buffer[:end]


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        names = {f.name: f.dataType for f in COLUMNS}
        wrong = [f.name for f in schema if names.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"columns {wrong} are not those of an archive: {COLUMNS.simpleString()}")
        self.wanted = schema.fieldNames()
        self.root = options["path"]
        self.split = int(options.get("splitbytes", SPLIT))
        self.attempts = int(options.get("attempts", FETCH_ATTEMPTS))
        self.suffixes = tuple(options.get("suffixes", SUFFIXES).split(","))
        types = options.get("types", "response")
        self.types = None if types == "all" else frozenset(types.split(","))
        self.crawls = frozenset(options["crawls"].split(",")) if "crawls" in options else None
        if self.split < 1 or self.attempts < 1:
            raise ValueError("splitBytes and attempts must be positive")

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of large files, several small files together."""
        store, base = open_store(self.root)
        found = tried(lambda: store.get_file_info(fs.FileSelector(base, recursive=True)), self.attempts)
        parts, some, total = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            name = f.path[len(base.rstrip("/")) + 1 :]
            if f.type != fs.FileType.File or not name.endswith(self.suffixes) or not self._of_crawl(name):
                continue
            for start in range(0, f.size, self.split):
                end = min(start + self.split, f.size)
                if some and total + end - start > self.split:
                    parts.append(InputPartition(some))
                    some, total = [], 0
                some, total = [*some, (name, f.size, start, end)], total + end - start
        return [*parts, *([InputPartition(some)] if some else [])]

    def _of_crawl(self, name: str) -> bool:
        return self.crawls is None or _crawl(name) in self.crawls

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # So Spark asks where there are no partitions.
            return
        store, base = open_store(self.root)
        rows, size = [], 0
        for name, length, start, end in partition.value:
            file = _File(lambda: store.open_input_file(f"{base}/{name}"), length, self.attempts)
            scan = self._members if file.get(0, 3) == _MAGIC else self._plain
            try:
                for row in scan(file, start, end):
                    rows.append(row | {"warc_filename": name, "crawl": _crawl(name)})
                    size += len(row.get("raw") or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
            finally:
                file.close()
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {c: pa.int64() for c in _LONG} | {"raw": pa.binary()}
        columns = [pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.wanted]
        return pa.RecordBatch.from_arrays(columns, self.wanted)

    def _row(self, head: _Head, offset: int, length: int, raw: bytes | None) -> Iterator[dict]:
        if self.types is None or head.type in self.types:
            yield {
                "url": head.url, "fetch_time": head.date, "record_type": head.type, "warc_offset": offset, "warc_length": length,
                "raw": raw if "raw" in self.wanted else None,
            }

    def _members(self, file: _File, start: int, end: int) -> Iterator[dict]:
        """Records of the members from the first one of this range to the first one of the next."""
        at = start if start == 0 else _synced(file, start)
        stop = file.size if end >= file.size else _synced(file, end)
        while at < stop:
            member, found = _Member(file, at), []
            try:
                if file.get(at, 3) != _MAGIC:
                    raise ValueError("no gzip member")
                for head, raw in _records(member.chunks()):
                    # The first record waits for the end of the member, which is checked there; most have one.
                    yield from (row for h, r in found for row in self._row(h, at, None, r))
                    found = [(head, raw)]
                yield from (row for h, r in found for row in self._row(h, at, member.end - at, r))
                at = member.end
            except (zlib.error, EOFError, ValueError) as e:
                yield {"warc_offset": at, "error": f"{type(e).__name__}: {e}"}
                at = _synced(file, at + 1)

    def _plain(self, file: _File, start: int, end: int) -> Iterator[dict]:
        """Records of an uncompressed file; from its start on only heads are read up to this range.

        So a record that holds an archive of its own is not mistaken for several.
        """
        at = 0
        while at < min(end, file.size):
            cut = file.find(_HEAD_END, at)
            head = _head(file.get(at, cut - at)) if cut >= 0 and file.get(at, 5) == b"WARC/" else None
            after = file.find(_GAP, at + 1) if head is None or head.length is None else -1
            if head is not None and head.length is not None:
                stop = cut + 4 + head.length
            else:
                stop = after if after >= 0 else file.size
            fault = None if head is not None and stop <= file.size else "ValueError: no record" if head is None else "EOFError: record is cut off"
            if fault and head is not None:
                # Its length is wrong: the next record is where one looks like it.
                after = file.find(_GAP, at + 1)
                stop = after if after >= 0 else file.size
            gap = file.get(stop, 64)
            stop += len(gap) - len(gap.lstrip(b"\r\n"))
            if at >= start:
                if fault:
                    yield {"warc_offset": at, "error": fault}
                elif self.types is None or head.type in self.types:
                    raw = file.get(at, stop - at) if "raw" in self.wanted else None
                    yield from self._row(head, at, stop - at, raw)
            at = stop


def _crawl(name: str) -> str | None:
    found = _CRAWL.search(name)
    return found.group() if found else None


class WarcDataSource(DataSource):
    """Format ``warc``. Columns that the given schema leaves out are not built, and bodies not kept for them.

    Options: ``path``; ``splitBytes`` of a partition; ``types`` of records, comma-separated
    (``response``; ``all``); ``crawls``, as named in the paths; ``suffixes`` of the files;
    ``attempts`` of a read. ``warc_offset`` and ``warc_length`` are the byte range of the record
    with the blank lines after it, or of its gzip member; the length is null for all but the last
    record of a member with several. A part of a file that cannot be read is a row with an ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return COLUMNS

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_archive(spark: SparkSession, root: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The records of all archive files under ``root``, see ``WarcDataSource``."""
    spark.dataSource.register(WarcDataSource)
    read = spark.read.format("warc").options(**options)
    if columns is not None:
        read = read.schema(T.StructType([COLUMNS[c] for c in columns]))
    return read.load(absolute_root(spark, root))
