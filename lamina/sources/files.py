"""Log and table files as DataFrames, read through Spark's binary reader, and Python data sources that write them.

Reading works on any store that Spark reads. A file is parsed by one task, as its format demands; many files are many
tasks. The writers are Python data sources: each partition is a file of the folder, which must be mounted everywhere.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lamina.model import Corruption

from .codec import Damage, build_table, read_records, read_table, write_records

RECORDS = "path string, record_no long, frag_offset long, payload binary, damage string, damaged_bytes long"
ENTRIES = "path string, user_key binary, seq long, value_type int, value binary, damage string"


def table_name(number: int) -> str:
    """Six digits, as segments are named."""
    return f"{number:06d}.ldb"


def _each(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows_of) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            for row in rows_of(path, data or b""):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_log(spark: SparkSession, path: str, initial_offset: int = 0) -> DataFrame:
    """Records of log files (a file, folder or pattern); damage comes as rows of its own, with no payload."""
    schema = pa.schema([("path", pa.string()), ("record_no", pa.int64()), ("frag_offset", pa.int64()), ("payload", pa.binary()), ("damage", pa.string()), ("damaged_bytes", pa.int64())])

    def rows_of(name: str, data: bytes) -> Iterator[tuple]:
        n = 0
        for x in read_records(data, initial_offset):
            if isinstance(x, Damage):
                yield name, None, x.offset, None, x.reason, x.size
            else:
                yield name, n, x[0], x[1], None, None
                n += 1

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _each(batches, schema, rows_of), RECORDS)


def read_tables(spark: SparkSession, path: str, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
    """Versions of table files with lo <= key < hi; a file that contradicts its format gives one row with ``damage``."""
    schema = pa.schema([("path", pa.string()), ("user_key", pa.binary()), ("seq", pa.int64()), ("value_type", pa.int32()), ("value", pa.binary()), ("damage", pa.string())])

    def rows_of(name: str, data: bytes) -> Iterator[tuple]:
        try:
            for key, seq, kind, value in read_table(data, lo, hi):
                yield name, key, seq, kind, value, None
        except Corruption as e:
            yield name, None, None, None, None, str(e)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _each(batches, schema, rows_of), ENTRIES)


@dataclass
class _Done(WriterCommitMessage):
    path: str | None
    final: str | None


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict, suffix: str, overwrite: bool) -> None:
        self.folder, self.suffix = re.sub("^file:(//)?", "", options["path"]), suffix
        os.makedirs(self.folder, exist_ok=True)
        old = [int(p.stem) for p in Path(self.folder).glob(f"*{suffix}") if p.stem.isdigit()]
        self.first, self.old = max([*old, 1]) + 1, [str(p) for p in Path(self.folder).glob(f"*{suffix}")] if overwrite else []

    def chunks(self, rows: Iterator) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        at = f"{self.folder}/.{n}-{TaskContext.get().taskAttemptId()}{self.suffix}.part"
        size = 0
        with open(at, "wb") as f:
            for x in self.chunks(rows):
                size += f.write(x)
        if not size:
            os.remove(at)
            return _Done(None, None)
        return _Done(at, f"{self.folder}/{self.first + n:06d}{self.suffix}")

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path:
                os.replace(m.path, m.final)
        for p in self.old:
            os.remove(p)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class _LogWriter(_FileWriter):
    def chunks(self, rows: Iterator) -> Iterator[bytes]:
        return write_records(bytes(r["payload"]) for r in rows)


class _TableWriter(_FileWriter):
    def chunks(self, rows: Iterator) -> Iterator[bytes]:
        entries = [(bytes(r["user_key"]), r["seq"], r["value_type"], bytes(r["value"])) for r in rows]
        if any((b[0], -b[1], -b[2]) <= (a[0], -a[1], -a[2]) for a, b in zip(entries, entries[1:], strict=False)):
            raise Corruption("a table's rows must be in internal order, each version once")
        if entries:
            yield build_table(entries)


class LogFiles(DataSource):
    """``df.write.format("lamina_log").save(folder)``: column payload, a log file per partition, in the order of its rows."""

    @classmethod
    def name(cls) -> str:
        return "lamina_log"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(self.options, ".log", overwrite)


class TableFiles(DataSource):
    """``df.write.format("lamina_table").save(folder)``: versions in internal order, a table file per partition."""

    @classmethod
    def name(cls) -> str:
        return "lamina_table"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TableWriter(self.options, ".ldb", overwrite)


def register(spark: SparkSession) -> None:
    for source in (LogFiles, TableFiles):
        spark.dataSource.register(source)
