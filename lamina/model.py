"""The data model: versions of keys in an operation log, their order, and logs derived from tables."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sequence numbers take 56 bits, the rest of a tag is the type.
MAX_SEQUENCE = (1 << 56) - 1


class ValueType(IntEnum):
    DELETION = 0
    VALUE = 1
    NOT_SET = 16


OPLOG = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value_type", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), False),
    ]
)
VERSION = [f.name for f in OPLOG.fields]


class StoreError(Exception):
    """What all errors of this package derive from."""


class NotFound(StoreError):
    """The key's newest visible version is a deletion."""


class NotSupported(StoreError):
    """The call makes no sense, such as a write without operations."""


class Corruption(StoreError):
    """Stored bytes contradict their format."""


def internal_order() -> list[Column]:
    """Key ascending by unsigned bytes, then newest first."""
    return [F.col("user_key").asc(), F.col("seq").desc(), F.col("value_type").desc()]


def _log(df: DataFrame, key: Column, seq: Column, deleted: Column, value: Column) -> DataFrame:
    return df.select(
        key.cast("binary").alias("user_key"),
        seq.cast("long").alias("seq"),
        F.when(deleted, int(ValueType.DELETION)).otherwise(int(ValueType.VALUE)).alias("value_type"),
        F.when(deleted, F.lit("")).otherwise(value).cast("binary").alias("value"),
    )


def padded(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def events_log(events: DataFrame) -> DataFrame:
    """Users' events as writes of their properties; an error deletes the user. Event ids count from 0, sequences from 1."""
    return _log(events, F.concat(F.lit("user_"), padded("user_id", 8)), F.col("event_id") + 1, F.col("event_type") == "error", F.col("props"))


def orders_log(orders: DataFrame) -> DataFrame:
    """Orders by key, each written once; finished ones are deleted."""
    return _log(orders, padded("o_orderkey", 10), F.col("o_orderkey") + 1, F.col("o_orderstatus") == "F", F.col("o_orderpriority"))


def lineitem_key() -> Column:
    return F.concat(padded("l_orderkey", 10), F.lit("/"), padded("l_linenumber", 2))


def lineitem_log(numbered: DataFrame) -> DataFrame:
    """Line items (with a column ``seq``) by order and line; returned ones are deleted."""
    return _log(numbered, lineitem_key(), F.col("seq"), F.col("l_returnflag") == "R", F.col("l_partkey").cast("string"))


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """Keys and values as strings, for results."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("user_key", "value") if c in df.columns})
