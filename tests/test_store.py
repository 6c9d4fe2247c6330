"""The store: writes, flushes, reopening, snapshots, failures, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.model import NotFound, NotSupported, StoreError
from lamina.operators import manifest, write_path
from lamina.operators.ordering import Ordered
from lamina.plans.store import Config, Store, WriteBatch
from lamina.streaming.ingest import ingest


def test_put_get_delete_and_batch(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.put(b"foo", b"bar")
    assert s.get(b"foo") == b"bar"
    s.delete(b"foo")
    with pytest.raises(NotFound):
        s.get(b"foo")
    assert s.get(b"foo", snapshot=1) == b"bar" and s.get(b"none") is None
    s.write(WriteBatch().put(b"k1", b"v1").put(b"k2", b"x").put(b"k2", b"v2").delete(b"k3"))
    assert s.get(b"k2") == b"v2" and s.snapshot() == 6
    with pytest.raises(NotSupported):
        s.write(None)


def test_flush_reopen_and_deletions_across_segments(spark, tmp_path):
    at = str(tmp_path / "db")
    s = Store(spark, at)
    s.write(WriteBatch().put(b"a", b"1").put(b"b", b"2").put(b"", b"empty"))
    s.flush()
    s.delete(b"a")
    s.put(b"c", b"3")
    reopened = Store(spark, at)  # the log gives the buffer back
    assert reopened.snapshot() == 5 and list(reopened) == [(b"", b"empty"), (b"b", b"2"), (b"c", b"3")]
    reopened.flush()
    again = Store(spark, at)
    assert [x.file_number for x in again.version.segments] == [2, 3] and again.version.last_seq == 5
    with pytest.raises(NotFound):
        again.get(b"a")
    assert again.get(b"a", snapshot=3) == b"1"
    assert again.ops().count() == 5  # hidden versions and deletions are kept
    assert again.manifest().count() == 2
    again.compact()
    assert [x.level for x in again.version.segments] == [1] and dict(again) == {b"": b"empty", b"b": b"2", b"c": b"3"}


def test_rotation_is_looked_at_once_a_group(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"), Config(log=False))
    batch = WriteBatch()
    for i in range(107):
        batch.put(b"key_%d" % i, b"x" * 1024)
    s.write(batch)
    assert not s.version.segments  # the group that exceeds the limit stays
    s.put(b"new_key", b"v")
    assert len(s.version.segments) == 1 and s.version.segments[0].entries == 107
    assert s.get(b"key_106") == b"x" * 1024 and s.get(b"new_key") == b"v"
    held = Store(spark, str(tmp_path / "held"), Config(auto_flush=False, log=False))
    held.write(batch)
    held.put(b"new_key", b"v")
    assert not held.version.segments


def test_a_failed_flush_loses_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "db"))
    s.put(b"a", b"1")
    monkeypatch.setattr(s, "_commit", lambda v: (_ for _ in ()).throw(StoreError("full")))
    with pytest.raises(StoreError):
        s.flush()
    monkeypatch.undo()
    assert s.get(b"a") == b"1" and not s.version.segments
    s.flush()
    assert len(s.version.segments) == 1 and s.get(b"a") == b"1"


def test_segments_out_of_range_are_not_read(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    for k in (b"a", b"m", b"z"):
        s.put(k, k)
        s.flush()
    assert len(s.ops(b"m", b"m").inputFiles()) < len(s.ops().inputFiles())
    assert [bytes(r.user_key) for r in s.scan(b"b", b"n").collect()] == [b"m"]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "db")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id"), F.concat(F.lit("k"), (F.col("id") % 15).cast("string")).alias("k")).coalesce(1).write.mode("append").parquet(src)
    s = Store(spark, at)
    stream = spark.readStream.schema("id long, k string").option("maxFilesPerTrigger", 1).parquet(src)
    ops = stream.select("id", F.col("k").cast("binary").alias("user_key"), F.lit(1).alias("value_type"), F.col("id").cast("string").cast("binary").alias("value"))
    ingest(ops, s, ["id"], str(tmp_path / "cp")).awaitTermination()
    assert len(s.version.segments) == 3 and s.snapshot() == 30 and s.scan().count() == 15
    batch = s.ops().limit(5).withColumn("id", F.col("seq"))
    s.write_frame(batch, ["id"], "stream", 2)  # a repeated batch
    assert s.snapshot() == 30


def test_edits_and_overlaps(spark):
    base = spark.createDataFrame([(0, 2, "a"), (0, 3, "b")], "level int, file_number long, path string")
    edits = spark.createDataFrame([(1, "delete", 0, 3, None), (2, "add", 0, 4, "c"), (3, "add", 0, 2, "a2"), (4, "delete", 0, 9, None), (5, "delete", 0, 5, None), (6, "add", 0, 5, "d")], "edit_no int, action string, level int, file_number long, path string")
    assert sorted((r.file_number, r.path) for r in manifest.apply_edits(base, edits).collect()) == [(2, "a2"), (4, "c"), (5, "d")]


def test_restarts():
    import numpy as np

    assert write_path.restarts(np.array([5, 5, 5, 5]), 10, False).tolist() == [0, 0, 1, 1]
    assert write_path.restarts(np.array([5, 5, 5, 5]), 10, True).tolist() == [0, 0, 0, 1]
    assert write_path.restarts(np.array([], dtype=int), 10, True).tolist() == []
    assert write_path.restarts(np.array([50, 1]), 10, False).tolist() == [0, 1]


def test_folds_in_parts_match_a_fold_in_one():
    import numpy as np

    rng = np.random.default_rng(1)
    for strictly in (True, False):
        sizes = rng.integers(0, 9, 500)
        whole, parts, run, held = write_path.restarts(sizes, 20, strictly), [], 0, 0
        for part in np.split(sizes, sorted(rng.integers(0, 500, 40).tolist())):
            runs, run, held = write_path.folded(part, 20, strictly, run, held)
            parts += runs.tolist()
        assert parts == whole.tolist()


def test_threads_write_at_once(spark, tmp_path):
    """Every write is there once, with a sequence of its own, and each thread's in its order; commits are shared."""
    from concurrent.futures import ThreadPoolExecutor

    s = Store(spark, str(tmp_path / "db"), Config(auto_flush=False))

    def work(t):
        s.put(b"t%03d" % t, b"1")
        s.write(WriteBatch().put(b"t%03d" % t, b"2"))

    with ThreadPoolExecutor(50) as pool:
        list(pool.map(work, range(150)))
    s.write(WriteBatch().put(b"a", b"").put(b"b", b"").delete(b"a").put(b"c", b"").put(b"d", b"").put(b"e", b"").put(b"f", b""))
    assert s.snapshot() == 307 and sorted(r[1] for r in s._buffer) == list(range(1, 308))
    assert len(s.files.names("log")) < 301
    reopened = Store(spark, str(tmp_path / "db"))
    assert reopened.snapshot() == 307 and all(reopened.get(b"t%03d" % t) == b"2" for t in (0, 77, 149)) and reopened.scan().count() == 155


def test_threads_write_whole_frames_at_once(spark, tmp_path, monkeypatch):
    """Frames wait in the queue as batches do, in the order of each thread; their rows don't pass the driver."""
    from concurrent.futures import ThreadPoolExecutor

    s = Store(spark, str(tmp_path / "db"))
    s.put(b"first", b"0")

    def frame(t, n, kind):
        return spark.range(n).select(F.concat(F.lit(f"t{t}/"), F.col("id").cast("string")).cast("binary").alias("user_key"), F.lit(kind).alias("value_type"), F.lit("v").cast("binary").alias("value"))

    def work(t):
        s.write(frame(t, 50, 1))
        s.write(frame(t, 10, 0))

    taken = []
    monkeypatch.setattr(s, "_take", lambda *row: taken.append(row))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(work, range(6)))
    monkeypatch.undo()
    assert not taken and s.snapshot() == 361 and sorted(r.seq for r in s.ops().collect()) == list(range(1, 362))
    assert s.scan().count() == 241 and len(s.version.segments) <= 13
    s.put(b"t0/0", b"again")
    assert Store(spark, str(tmp_path / "db")).get(b"t0/0") == b"again"
    with pytest.raises(Exception, match="no_column"):
        s.write(frame(0, 1, 1).withColumnRenamed("value", "no_column"))
    assert s.snapshot() == 362


def test_groups_of_a_frame_leave_the_segments_of_single_writes(spark, tmp_path, monkeypatch):
    """The same segments as one batch after another, in one job, and the same reads after reopening and compaction."""
    ops = [(i, b"k%03d" % (i * 37 % 60), i % 5 != 0, b"v" * (i % 9)) for i in range(90)]
    one, all_ = Store(spark, str(tmp_path / "one"), Config(memtable_bytes=150, group=4)), Store(spark, str(tmp_path / "all"), Config(memtable_bytes=150, group=4))
    for s in (one, all_):
        s.put(b"a", b"before")
        s.flush()
    one.write_group([WriteBatch().put(k, v) if put else WriteBatch().delete(k) for _, k, put, v in ops])
    one.flush()
    monkeypatch.setattr(all_, "_take", None)  # no row passes the buffer
    frame = spark.createDataFrame([(i, bytearray(k), int(put), bytearray(v if put else b"")) for i, k, put, v in reversed(ops)], "id long, user_key binary, value_type int, value binary")
    all_.write_groups(frame, ["id"])
    monkeypatch.undo()
    facts = [[(x.level, x.file_number, x.entries, x.file_size, x.smallest_key, x.largest_key, x.smallest_seq, x.largest_seq) for x in s.version.segments] for s in (one, all_)]
    assert facts[0] == facts[1] and len(facts[0]) > 5
    again = Store(spark, str(tmp_path / "all"), Config(memtable_bytes=150, group=4, keep_versions=1))
    assert sorted(map(tuple, again.ops().collect())) == sorted(map(tuple, one.ops().collect())) and again.snapshot() == 91
    again.vacuum()
    assert dict(again) == dict(one)
    again.compact()
    assert dict(again) == dict(one) and len(again.files.names("segments")) == 1


def test_a_failed_commit_fails_its_writers_only(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "db"))
    monkeypatch.setattr(s.files, "write", lambda *a: (_ for _ in ()).throw(StoreError("full")))
    with pytest.raises(StoreError):
        s.put(b"a", b"1")
    monkeypatch.undo()
    assert s.get(b"a") is None and s.snapshot() == 0
    s.put(b"a", b"2")
    assert s.get(b"a") == b"2" and s.snapshot() == 1


def test_a_cursor_outlives_a_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"), Config(keep_versions=1))
    for i in range(3):
        s.put(b"k%d" % i, b"old")
        s.flush()
    c = s.cursor(page=1)
    c.seek_to_first()
    s.write(WriteBatch().put(b"k1", b"new").delete(b"k2"))
    s.compact()
    assert len(s.files.names("segments")) == 4
    seen = []
    while c.valid():
        seen.append((c.key(), c.value()))
        c.next()
    assert seen == [(b"k0", b"old"), (b"k1", b"old"), (b"k2", b"old")]
    del c
    s.vacuum()
    assert len(s.files.names("segments")) == 1 and dict(s) == {b"k0": b"old", b"k1": b"new"}


def test_long_inputs_have_more_ranges_not_longer_ones(spark, tmp_path, monkeypatch):
    """What one task sorts is bounded: the number of ranges and of a segment's files goes with the input."""
    from lamina import session

    monkeypatch.setattr(session, "RANGE_BYTES", 4000)
    monkeypatch.setattr(session, "RANGE_ROWS", 1000)
    spark.range(0, 20_000, 1, 4).selectExpr("id * 7919 % 20000 AS id", "CAST(id AS STRING) AS s").write.parquet(f"{tmp_path}/in")
    s = Store(spark, str(tmp_path / "db"))
    rows = spark.read.parquet(f"{tmp_path}/in").select("id", F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("user_key"), F.lit(1).alias("value_type"), F.col("s").cast("binary").alias("value"))
    ranged = Ordered(rows, ["id"])
    assert ranged.rows.select("_range").distinct().count() > 10 and ranged.count() == 20_000
    s.write_frame(rows, ["id"])
    assert len(s.ops().inputFiles()) >= 20 and s.ops().where("seq <> CAST(CAST(user_key AS STRING) AS LONG) + 1").isEmpty()


def test_numbers_come_without_another_shuffle(spark, tmp_path):
    """Rows are numbered as their ranges are written; reading them joins a broadcast table only."""
    numbered = Ordered(spark.range(1000).selectExpr("id % 10 AS a", "id AS b"), [F.desc("a"), "b"]).ranked("seq")
    assert "Exchange hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.b) for r in numbered.orderBy("seq").collect()] == sorted(((i % 10, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert sorted(r.seq for r in numbered.collect()) == list(range(1, 1001)) and numbered.columns == ["a", "b", "seq"]


def test_loaded_versions_are_unique_and_new(spark, tmp_path):
    from lamina.model import OPLOG, Corruption

    s = Store(spark, str(tmp_path / "db"))
    rows = [(bytearray(b"a"), 1, 1, bytearray(b"x")), (bytearray(b"a"), 2, 0, bytearray())]
    s.load(spark.createDataFrame(rows, OPLOG))
    assert s.snapshot() == 2 and s.ops().count() == 2
    with pytest.raises(NotSupported):
        s.load(spark.createDataFrame(rows, OPLOG))
    with pytest.raises(Corruption):
        s.load(spark.createDataFrame([(bytearray(b"b"), 3, 1, bytearray(b"x"))] * 2, OPLOG))
    s.files.write("log/00000000000000000003.log", b"".join(__import__("lamina.sources.codec", fromlist=["x"]).write_records([b"\x03abc"])))
    with pytest.raises(Corruption):
        Store(spark, str(tmp_path / "db"))


def test_a_range_reaches_the_sorted_files(spark, tmp_path):
    """Bounds are pushed to the scan, and the statistics of files sorted by key leave few rows to read."""
    s = Store(spark, str(tmp_path / "db"))
    rows = spark.range(40_000).select(F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("user_key"), F.lit(1).alias("value_type"), F.lit("v").cast("binary").alias("value"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.write_frame(rows.repartition(5), ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = s.scan(b"00010000", b"00010100")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_key" in plan and "LessThan(user_key" in plan and found.count() == 100
    edges = sorted((min(k), max(k)) for f in s.ops().inputFiles() if (k := [bytes(r.user_key) for r in spark.read.parquet(f).select("user_key").collect()]))
    assert len(edges) > 1 and all(a[1] < b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_pruning_has_no_nested_loop(spark):
    stats = spark.createDataFrame([(2, bytearray(b"a"), bytearray(b"m")), (3, bytearray(b"b"), bytearray(b"b")), (4, bytearray(b"x"), bytearray(b"z"))], "file_number long, smallest_key binary, largest_key binary")
    probes = spark.createDataFrame([(bytearray(c.encode()),) for c in "abcmnxyz{"], "probe binary")
    found = manifest.zone_prune(stats, probes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((bytes(r.probe), r.file_number) for r in found.collect()) == [(b"a", 2), (b"b", 2), (b"b", 3), (b"c", 2), (b"m", 2), (b"x", 4), (b"y", 4), (b"z", 4)]
    assert manifest.zone_prune(stats, probes.limit(0)).count() == 0 and manifest.zone_prune(stats.limit(0), probes).count() == 0
