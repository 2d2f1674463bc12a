"""Files in byte ranges: a batch source of fixed-length records and a replayable line stream (Python Data Sources).

Both list files and read ranges through ``pyarrow.fs``, so a path may be local (``file:``) or a store that it knows
(``s3:``, ``gs:``, ``hdfs:``).  A file is read in ranges of a bounded size, each a task's partition, and comes back in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of a file or of the files below a folder, by name; names that begin with ``_`` or ``.`` are left out."""
    store, path = _open(uri)
    info = store.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.record = options["path"], int(options["recordlength"])
        self.header = int(options.get("labelbytes", 1))
        self.range = max(self.record, int(options.get("rangebytes", RANGE_BYTES)) // self.record * self.record)
        if self.record <= self.header:
            raise ValueError("a record must be longer than its label")

    def partitions(self) -> list[ByteRange]:
        files = _files(self.uri)
        odd = [f"{p} ({n} bytes)" for p, n in files if n % self.record]
        if odd:
            raise ValueError(f"not a whole number of records of {self.record} bytes: {', '.join(odd[:5])}")
        return [ByteRange(p, a, min(n, a + self.range)) for p, n in files for a in range(0, n, self.range)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        store, _ = _open(self.uri)
        step = max(1, BATCH_BYTES // self.record) * self.record
        with store.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.end, step):
                raw = f.read_at(min(step, partition.end - at), at)
                if len(raw) % self.record:
                    raise ValueError(f"{partition.path} was cut while it was read")
                n = len(raw) // self.record
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.record), n, [None, pa.py_buffer(raw)])
                rows = [r.as_py() for r in whole]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(range(at // self.record, at // self.record + n), pa.int64()),
                                                  pa.array([int.from_bytes(r[:self.header], "big") for r in rows], pa.int32()), pa.array([r[self.header:] for r in rows], pa.binary())],
                                                 names=["path", "record", "label", "planar"])


class RecordSource(DataSource):
    """Files of fixed-length records (label bytes, then planar bytes)."""

    @classmethod
    def name(cls) -> str:
        return "label_records"

    def schema(self) -> str:
        return "path string, record bigint, label int, planar binary"

    def reader(self, schema) -> RecordReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})


def record_file(spark: SparkSession, path: str, record_length: int, label_bytes: int = 1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, record, label, planar`` of fixed-length record files, a file read in ranges of whole records.

    ``record`` is the 0-based number in its file.  A file whose size is no multiple of the record is an
    error that names it.  Empty files give no rows.
    """
    spark.dataSource.register(RecordSource)
    return (spark.read.format("label_records").option("path", path).option("recordLength", record_length)
            .option("labelBytes", label_bytes).option("rangeBytes", range_bytes).load())


class LineReader(DataSourceStreamReader):
    """Lines of the files of a folder, in the order of the files' names.

    The offset is the last file of a batch.  Files only come with later names and are complete when they come (as segments of
    a log), so an offset stands for all files before it, does not grow, and any batch can be read again.  A
    batch holds all files that are there when it begins."""

    def __init__(self, options: dict):
        self.uri, self.range = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.uri)
        return {"file": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        files = [(p, n) for p, n in _files(self.uri) if start["file"] < p <= end["file"]]
        return [ByteRange(p, a, min(n, a + self.range)) for p, n in files for a in range(0, n, self.range)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range; the last one is read to its end beyond it."""
        store, _ = _open(self.uri)
        with store.open_input_file(partition.path) as f:
            size, at = f.size(), partition.start
            if at and f.read_at(1, at - 1) != b"\n":
                at = self._after_line(f, at, size)
            while at < partition.end:
                upto = min(at + BATCH_BYTES, partition.end)
                if f.read_at(1, upto - 1) != b"\n":
                    upto = self._after_line(f, upto, size)
                raw = f.read_at(upto - at, at)
                lines = raw.split(b"\n")
                if not lines[-1]:
                    lines.pop()
                places, place = [], at
                for line in lines:
                    places.append(place)
                    place += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines], pa.string()), pa.array([partition.path] * len(lines), pa.string()),
                                                  pa.array(places, pa.int64())], names=["value", "partition", "seq"])
                at = upto

    @staticmethod
    def _after_line(f, at: int, size: int) -> int:
        """The place after the line that ``at`` lies in."""
        while at < size:
            raw = f.read_at(min(1 << 16, size - at), at)
            end = raw.find(b"\n")
            if end >= 0:
                return at + end + 1
            at += len(raw)
        return size

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    """Lines with their places, as a stream."""

    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return "value string, partition string, seq bigint"

    def streamReader(self, schema) -> LineReader:
        return LineReader({k.lower(): v for k, v in self.options.items()})


def placed_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Line stream whose rows carry the arrival key (``partition``: the file, ``seq``: the line's place in it).

    Files are taken in the order of their names and read in byte ranges; a query resumes after the file in its
    checkpoint and reads the same rows again for the same batch.
    """
    spark.dataSource.register(LineSource)
    return spark.readStream.format("placed_lines").option("path", path).option("rangeBytes", range_bytes).load()
