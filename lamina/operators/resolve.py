"""Visibility: what a snapshot sees of an operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import Corruption, NotFound, ValueType


def visible(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Versions that a reader at ``snapshot`` may see; without one, all. The filter reaches the scan."""
    return ops if snapshot is None else ops.where(F.col("seq") <= snapshot)


def latest(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of each key, deletions included: one aggregate, with a partial one before its shuffle."""
    newest = visible(ops, snapshot).groupBy("user_key").agg(F.max(F.struct("seq", "value_type", "value")).alias("v"))
    return newest.select("user_key", "v.seq", "v.value_type", "v.value")


def live(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys that exist at the snapshot. Deletions go only after the newest version is picked, else deleted keys would rise again."""
    return latest(ops, snapshot).where(F.col("value_type") == int(ValueType.VALUE))


def history(ops: DataFrame, key: bytes | None = None) -> DataFrame:
    """All versions, newest first within a key, with their place ``age`` (0 is the newest); of one key or all."""
    from pyspark.sql import Window

    rows = ops if key is None else ops.where(F.col("user_key") == F.lit(bytearray(key)))
    return rows.withColumn("age", (F.row_number().over(Window.partitionBy("user_key").orderBy(F.desc("seq"), F.desc("value_type"))) - 1).cast("long"))


FOUND, DELETED, ABSENT = "FOUND", "DELETED", "ABSENT"


def get_status(ops: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(probe, status, value): found, deleted or never written, for each row of ``probes`` (one column, ``probe``).

    Only versions of probed keys are resolved: the semi-join comes before the aggregate.
    """
    asked = visible(ops, snapshot).join(probes.select(F.col("probe").alias("user_key")).distinct(), "user_key", "left_semi")
    got = latest(asked)
    status = F.when(F.col("value_type") == int(ValueType.VALUE), FOUND).when(F.col("value_type") == int(ValueType.DELETION), DELETED).otherwise(ABSENT)
    met = probes.join(got, F.col("probe") == F.col("user_key"), "left")
    return met.select("probe", status.alias("status"), F.when(F.col("value_type") == int(ValueType.VALUE), F.col("value")).alias("value"))


def get(ops: DataFrame, key: bytes, snapshot: int | None = None) -> bytes | None:
    """The value of one key: None if it was never written, NotFound if deleted, Corruption for an unknown type. The key is a pushed filter."""
    row = visible(ops, snapshot).where(F.col("user_key") == F.lit(bytearray(key))).agg(F.max(F.struct("seq", "value_type", "value")).alias("v")).first()
    if row is None or row["v"] is None:
        return None
    if row["v"]["value_type"] == ValueType.DELETION:
        raise NotFound(key)
    if row["v"]["value_type"] != ValueType.VALUE:
        raise Corruption(f"type {row['v']['value_type']}")
    return bytes(row["v"]["value"])


def contains(ops: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes whose key has any version."""
    return probes.join(ops.select(F.col("user_key").alias("probe")), "probe", "left_semi")


def duplicates(ops: DataFrame) -> DataFrame:
    """Internal keys that occur more than once; a valid log has none."""
    return ops.groupBy("user_key", "seq", "value_type").count().where("count > 1")
