"""Capture files as a Spark data source, and from any store.

``capture`` reads classic pcap and pcapng, told apart by the first four bytes; ``pcap`` and ``pcapng``
read one kind.  Option ``table``: frames (default), blocks, interfaces, statistics or names.

``read_captures`` lists files with Spark's binaryFile source.  Files of up to ``split`` bytes are read by it too, in
Arrow batches of whole files; where larger ones lie in a store that workers can open, all are read by ranges
(``framelight.sources.ranges``).  The data source opens paths that Python can open (a mounted or local folder), one
partition for each file, streaming through it in bounded batches.
"""

from __future__ import annotations

import glob
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from framelight.sources.ranges import SPLIT, can_open, read_ranges
from framelight.sources.scan import TABLES, scan


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], kind: str, table: str):
        self.files, self.kind, self.table = files, kind, table

    def partitions(self):
        return [_File(p) for p in self.files]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from scan(partition.path, f, os.path.getsize(partition.path), self.table, self.kind)


def _files(options) -> list[str]:
    path = options.get("path")
    if not path:
        raise ValueError("a capture source needs a path")
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    pattern = options.get("pathGlobFilter", "*")
    found = sorted(glob.glob(path))
    out = [f for p in found for f in (sorted(glob.glob(os.path.join(p, "**", pattern), recursive=True)) if os.path.isdir(p) else [p])]
    out = [f for f in out if os.path.isfile(f)]
    if not out:
        raise FileNotFoundError(f"no regular file at {path}")
    return out


class CaptureSource(DataSource):
    """Format ``capture``: pcap or pcapng by content."""

    kind = "capture"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    @property
    def table(self) -> str:
        table = self.options.get("table", "frames")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self.table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_files(self.options), self.kind, self.table)


class PcapSource(CaptureSource):
    kind = "pcap"


class PcapngSource(CaptureSource):
    kind = "pcapng"


def register(spark: SparkSession) -> None:
    for source in (CaptureSource, PcapSource, PcapngSource):
        spark.dataSource.register(source)


def parse_files(files: DataFrame, table: str = "frames", kind: str = "capture") -> DataFrame:
    """``files``: path, content (of binaryFile, batch or stream) to one of the tables."""

    def run(parts):
        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                data = content.as_buffer() or pa.py_buffer(b"")  # the batch's own bytes, no copy of them
                yield from scan(path, pa.BufferReader(data), data.size, table, kind)

    return files.select("path", "content").mapInArrow(run, TABLES[table])


def read_captures(spark: SparkSession, path: str, table: str = "frames", kind: str = "capture", pattern: str = "*.pcap*", split: int = SPLIT) -> DataFrame:
    """Captures in any store that Spark reads, each record once, with the numbers and anchors that it has in its file.

    Where a file is larger than ``split`` bytes, tasks read ranges of about that size.  In a store that only Spark can
    open a task reads whole files (at most 2 GB each).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    largest = files.agg(F.max("length").alias("n"), F.first("path").alias("path")).first()
    if (largest.n or 0) > split and can_open(largest.path):
        return read_ranges(files, table, kind, split)
    return parse_files(files, table, kind)
