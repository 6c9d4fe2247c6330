"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def local(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lamina")
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **conf}.items():
        builder = builder.config(k, v)
    return share_code(builder.getOrCreate())


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it; a no-op where it is installed or shipped."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def scratch(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lamina-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def _file_system(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def delete(spark: SparkSession, at: str) -> None:
    fs, path = _file_system(spark, at)
    fs.delete(path, True)


def delete_on_exit(spark: SparkSession, at: str) -> None:
    """The folder goes when the application ends."""
    fs, path = _file_system(spark, at)
    fs.deleteOnExit(path)


#: Bytes of input files that a range of rows stands for, at most, and rows of a file that are sorted by one task.
RANGE_BYTES, RANGE_ROWS = 4 << 20, 1_000_000


def ranges(df: DataFrame, rows: int | None = None) -> list[int]:
    """The number of ranges to deal ``df`` into by its ``rows``, or the files that it reads if they aren't known; [] where the session's own number will do.

    So what one task sorts stays the same however long the input is.
    """
    if rows is not None:
        n = -(-rows // RANGE_ROWS)
    else:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        n = -(-sum(s for s in sizes if s < 1 << 60) // RANGE_BYTES)  # larger: unknown
    return [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """What ``materialised`` writes within goes at the end; results must be written elsewhere by then."""
    mark = _WRITTEN.set([])
    try:
        yield
    finally:
        for at in _WRITTEN.get() or []:
            delete(spark, at)
        _WRITTEN.reset(mark)


def materialised(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df``, written as Parquet in the shared folder and read again; the files go with ``tables`` around it, or when the application ends."""
    spark = df.sparkSession
    at = f"{scratch(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    delete_on_exit(spark, at)
    if (own := _WRITTEN.get()) is not None:
        own.append(at)
    return spark.read.schema(df.schema).parquet(at)
