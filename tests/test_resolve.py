"""Snapshots, deletions and cursors against a plain dictionary of versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lamina.model import OPLOG, NotFound
from lamina.operators import cursor, resolve
from lamina.operators.ordering import Ordered, lower_bounds


def log(spark, ops):
    return spark.createDataFrame([(bytearray(k), s, t, bytearray(v)) for k, s, t, v in ops], OPLOG)


def expected(ops, snapshot):
    newest = {}
    for k, s, t, v in ops:
        if s <= snapshot and (k not in newest or (s, t) > newest[k][:2]):
            newest[k] = (s, t, v)
    return {k: v for k, (s, t, v) in sorted(newest.items()) if t == 1}


def found(df):
    return {bytes(r.user_key): bytes(r.value) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_every_snapshot_matches_a_dictionary(spark, seed):
    rng = random.Random(seed)
    keys = [bytes(rng.choice(b"\x00a\xff") for _ in range(rng.randint(0, 3))) for _ in range(8)]
    ops = [(rng.choice(keys), s, int(rng.random() < 0.7), b"v%d" % s) for s in range(1, 25)]
    ops = [(k, s, t, v if t else b"") for k, s, t, v in ops]
    df = log(spark, ops).cache()
    for snapshot in (0, 1, 7, 13, 24):
        assert found(resolve.live(df, snapshot)) == expected(ops, snapshot)
    ranks = {r["rank"]: bytes(r["user_key"]) for r in cursor.forward(df).collect()}
    assert [ranks[i + 1] for i in range(len(ranks))] == list(expected(ops, 24))


def test_deleted_first_key_and_prefix_keys(spark):
    df = log(spark, [(b"a", 1, 1, b"1"), (b"a", 2, 0, b""), (b"b", 3, 1, b"x"), (b"b", 4, 1, b"y"), (b"ba", 5, 1, b"z")])
    assert found(resolve.live(df)) == {b"b": b"y", b"ba": b"z"}
    assert found(resolve.live(df, 3)) == {b"b": b"x"}
    assert found(resolve.live(df, 1)) == {b"a": b"1"}


def test_an_overwrite_after_the_snapshot_leaves_the_older_version(spark):
    df = log(spark, [(b"a", 1, 1, b"1"), (b"aa", 2, 1, b"2"), (b"aa", 3, 1, b"3")])
    assert found(resolve.live(df, 2)) == {b"a": b"1", b"aa": b"2"}


def test_get_has_three_outcomes(spark):
    df = log(spark, [(b"foo", 1, 1, b"bar"), (b"foo", 2, 0, b""), (b"k", 3, 1, b"")])
    assert resolve.get(df, b"foo", 1) == b"bar"
    with pytest.raises(NotFound):
        resolve.get(df, b"foo")
    assert resolve.get(df, b"none") is None
    assert resolve.get(df, b"k") == b""
    probes = spark.createDataFrame([(bytearray(k),) for k in (b"foo", b"k", b"none")], "probe binary")
    assert {bytes(r.probe): r.status for r in resolve.get_status(df, probes).collect()} == {b"foo": "DELETED", b"k": "FOUND", b"none": "ABSENT"}


def test_cursor_turns_and_ends(spark):
    df = log(spark, [(b"a", 1, 1, b"1"), (b"b", 2, 1, b"2"), (b"c", 3, 1, b"3"), (b"bb", 4, 0, b"")])
    for page in (1, 2, 100):
        c = cursor.Cursor(df, page=page)
        c.seek_to_first()
        seen = []
        while c.valid():
            seen.append((c.key(), c.value()))
            c.next()
        assert seen == [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")]
        assert c.key() == b"" and c.value() == b""
        c.seek(b"b")
        c.next()
        assert c.key() == b"c"
        c.prev()
        assert c.key() == b"b"
        c.seek(b"bb")
        assert c.key() == b"c"
        c.seek(b"d")
        assert not c.valid()
        c.seek_to_last()
        assert c.key() == b"c"
        c.seek_to_first()
        c.prev()
        assert not c.valid()
        with pytest.raises(ValueError):
            c.next()


def test_seeks_over_many_ranges(spark):
    rng = random.Random(5)
    keys = sorted({b"%06d" % rng.randint(0, 99999) for _ in range(500)})
    df = log(spark, [(k, i + 1, 1, b"v") for i, k in enumerate(keys)]).repartition(7)
    probes = [b"%06d" % rng.randint(0, 110000) for _ in range(200)]
    got = cursor.seek_many(df, spark.createDataFrame([(bytearray(p),) for p in probes], "probe binary"))
    want = {p: next((k for k in keys if k >= p), None) for p in probes}
    assert {bytes(r.probe): r.found and bytes(r.found) for r in got.collect()} == want
    after = {bytes(r.user_key): r.next_key and bytes(r.next_key) for r in cursor.next_keys(df).collect()}
    assert after == dict(zip(keys, [*keys[1:], None], strict=True))


def test_lower_bounds_in_a_long_range(spark):
    """Each row of a range is read once, not once for each row before it: 200,000 keys in one range take seconds."""
    import time

    keys = spark.range(0, 400_000, 2).select(F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("user_key"))
    probes = spark.range(0, 400_001, 40_000).select((F.col("id") + 1).alias("id")).union(spark.range(0, 4, 2)).select(F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("probe"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        began = time.monotonic()
        got = {int(r.probe): r.found and int(r.found) for r in lower_bounds(probes, keys).collect()}
        took = time.monotonic() - began
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i + 1: i + 2 for i in range(0, 400_000, 40_000)} | {400_001: None, 0: 0, 2: 2} and took < 60


def test_prefix_scan_of_all_ones(spark):
    df = log(spark, [(b"\xff", 1, 1, b"1"), (b"\xff\xff", 2, 1, b"2"), (b"\xfe", 3, 1, b"3")])
    assert set(found(cursor.prefix_scan(df, b"\xff"))) == {b"\xff", b"\xff\xff"}
    assert set(found(cursor.prefix_scan(df, b""))) == {b"\xff", b"\xff\xff", b"\xfe"}


def test_empty_log(spark):
    df = log(spark, [])
    assert resolve.live(df).count() == 0
    assert Ordered(df, ["user_key"]).ranked().count() == 0
    c = cursor.Cursor(df)
    c.seek_to_first()
    assert not c.valid()


def test_equal_internal_keys_are_found(spark):
    df = log(spark, [(b"a", 1, 1, b"1"), (b"a", 1, 1, b"2"), (b"a", 2, 1, b"1")])
    assert resolve.duplicates(df).count() == 1


def test_key_and_snapshot_filters_reach_the_scan(spark, tmp_path):
    log(spark, [(b"a", 1, 1, b"1")]).write.parquet(str(tmp_path / "t"))
    df = cursor.range_scan(spark.read.parquet(str(tmp_path / "t")), b"a", b"c", 5)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(user_key" in pushed and "LessThan(user_key" in pushed and "LessThanOrEqual(seq,5)" in pushed
