"""Ordered access to live keys: seeks, neighbours, ranges and prefixes, as plans and as a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.keys import prefix_end

from .ordering import Ordered, lower_bounds
from .resolve import live


def _bytes(key: bytes):
    return F.lit(bytearray(key))


def between(ops: DataFrame, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
    """Versions of keys in [lo, hi); both bounds reach the scan and pass below any aggregate over the key."""
    if lo is not None:
        ops = ops.where(F.col("user_key") >= _bytes(lo))
    return ops if hi is None else ops.where(F.col("user_key") < _bytes(hi))


def range_scan(ops: DataFrame, lo: bytes | None = None, hi: bytes | None = None, snapshot: int | None = None) -> DataFrame:
    return live(between(ops, lo, hi), snapshot)


def prefix_scan(ops: DataFrame, prefix: bytes, snapshot: int | None = None) -> DataFrame:
    """Live keys that begin with ``prefix``: the range up to the next key that doesn't."""
    return range_scan(ops, prefix, prefix_end(prefix), snapshot)


def seek_first(ops: DataFrame, snapshot: int | None = None, n: int = 1) -> DataFrame:
    """The first live keys, by a bounded top-k instead of a sort."""
    return live(ops, snapshot).orderBy("user_key").limit(n)


def seek_last(ops: DataFrame, snapshot: int | None = None, n: int = 1) -> DataFrame:
    return live(ops, snapshot).orderBy(F.desc("user_key")).limit(n)


def seek(ops: DataFrame, key: bytes, snapshot: int | None = None, n: int = 1) -> DataFrame:
    """The first live keys at or after ``key``."""
    return seek_first(between(ops, key), snapshot, n)


def seek_many(ops: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(probe, found): a seek for each probe."""
    return lower_bounds(probes, live(ops, snapshot))


def forward(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """All live keys with ``rank`` in key order."""
    return Ordered(live(ops, snapshot), ["user_key"]).ranked()


def backward(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """All live keys with ``rank`` in reverse key order."""
    return Ordered(live(ops, snapshot), [F.desc("user_key")]).ranked()


def next_keys(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(user_key, next_key) of live keys."""
    return Ordered(live(ops, snapshot).select("user_key"), ["user_key"]).neighbour("user_key", "next_key", 1)


def prev_keys(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(user_key, prev_key) of live keys."""
    return Ordered(live(ops, snapshot).select("user_key"), ["user_key"]).neighbour("user_key", "prev_key", -1)


class Cursor:
    """A position among the live keys of one snapshot; turns in either direction at any point.

    Each fetch reads ``page`` live keys on from the position, by key-range filters and a top-k, so a scan of n keys
    takes n / page queries and the driver holds one page.
    """

    def __init__(self, ops: DataFrame, snapshot: int | None = None, page: int = 1000) -> None:
        self._ops, self._page = ops, page
        self._snapshot = ops.agg(F.max("seq")).first()[0] or 0 if snapshot is None else snapshot
        self._rows: list[tuple[bytes, bytes]] = []
        self._at = -1

    def _fetch(self, rows: DataFrame, down: bool) -> list[tuple[bytes, bytes]]:
        order = F.desc("user_key") if down else F.asc("user_key")
        got = live(rows, self._snapshot).orderBy(order).limit(self._page).select("user_key", "value").collect()
        return [(bytes(r["user_key"]), bytes(r["value"])) for r in got]

    def _set(self, rows: list[tuple[bytes, bytes]], at: int) -> None:
        self._rows, self._at = rows, at if rows else -1

    def seek_to_first(self) -> None:
        self._set(self._fetch(self._ops, False), 0)

    def seek_to_last(self) -> None:
        rows = self._fetch(self._ops, True)[::-1]
        self._set(rows, len(rows) - 1)

    def seek(self, key: bytes) -> None:
        self._set(self._fetch(between(self._ops, key), False), 0)

    def next(self) -> None:
        self._check()
        if self._at + 1 < len(self._rows):
            self._at += 1
        else:
            self._set(self._fetch(self._ops.where(F.col("user_key") > _bytes(self.key())), False), 0)

    def prev(self) -> None:
        self._check()
        if self._at > 0:
            self._at -= 1
        else:
            rows = self._fetch(between(self._ops, None, self.key()), True)[::-1]
            self._set(rows, len(rows) - 1)

    def valid(self) -> bool:
        return self._at >= 0

    def key(self) -> bytes:
        return self._rows[self._at][0] if self.valid() else b""

    def value(self) -> bytes:
        return self._rows[self._at][1] if self.valid() else b""

    def _check(self) -> None:
        if not self.valid():
            raise ValueError("the cursor isn't on a key")
