"""Candidate buckets of any size, near signs within them, and the connected components of the links found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spanning, written

#: Rows of a bucket that one block takes. A block of a larger bucket holds two parts of it, so twice as many.
BLOCK = 2048


def blocks(rows: DataFrame, key: str, member: Column, block: int = BLOCK) -> DataFrame:
    """Deal ``rows`` into blocks so that each two rows of one bucket ``key`` meet in at least one block.

    A bucket of up to ``block`` rows is one block. A larger one is cut by hash of ``member`` into parts, and each two
    parts are a block: exact, with no task above about twice ``block`` rows of a bucket. Buckets of one row go.
    Adds ``_part`` (a row's own part) and ``_lo``, ``_hi`` (the parts of the block); partitions are sorted by
    (key, _lo, _hi, _part). ``rows`` must be a written table: it is read twice.
    """
    sizes = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    parts = F.ceil(F.col("_n") / block).cast("int")
    met = rows.join(sizes, key).withColumn("_k", parts).withColumn("_part", F.pmod(F.xxhash64(member, F.lit(key)), F.col("_k")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    met = met.withColumn("_lo", F.least("_part", "_other")).withColumn("_hi", F.greatest("_part", "_other")).drop("_n", "_k", "_other")
    return met.repartition(key, "_lo", "_hi").sortWithinPartitions(key, "_lo", "_hi", "_part")


# ---------------------------------------------------------------- near signs within buckets


def near_signs(s: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(s[i] ^ s[j]).sum(axis=1, dtype=np.int64) <= most


PAIR, STAR, LATER = 0, 1, 2


def _found(words: int, kind: int, a: np.ndarray, b: np.ndarray, bucket: np.ndarray | None = None, signs: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    none = pa.nulls(n, pa.int64())
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), none if bucket is None else pa.array(bucket)]
    cols += [none if signs is None else pa.array(signs[:, k].copy().view(np.int64)) for k in range(words)]
    return pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "bucket", *[f"s{k}" for k in range(words)]])


def _candidates(ids: np.ndarray, signs: np.ndarray, starts: np.ndarray, apart: np.ndarray | None, most: int, few: int) -> Iterator[pa.RecordBatch]:
    """Pairs of ids for vectors of few candidates in their run; the others are named, by links to one of each dense group.

    ``apart`` are the rows' parts in blocks of two parts, where only rows of different parts meet.
    """
    end, at, n = starts[1:][np.repeat(np.arange(len(starts) - 1), np.diff(starts))], np.arange(len(ids)), len(ids)
    left, right = [], []
    for step in range(1, int(np.diff(starts).max(initial=1))):
        at = at[at + step < end[at]]
        i = at if apart is None else at[apart[at] != apart[at + step]]
        i = i[near_signs(signs, i, i + step, most)]
        left.append(i)
        right.append(i + step)
    i, j = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
    degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    dense = (degree[i] >= few) | (degree[j] >= few)
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    if (~dense).any():
        yield _found(signs.shape[1], PAIR, a[~dense], b[~dense])
    if dense.any():
        x, y = spanning(a[dense], b[dense])
        yield _found(signs.shape[1], STAR, np.array(x, np.int64), np.array(y, np.int64))


def _meet(words: int, most: int, few: int, run: int, blocked: bool):
    """Candidates of bucket rows sorted by bucket; a run too long for one task's memory is passed on row by row, for blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "_lo", "_hi"] if blocked else ["bucket"]
        kept: dict[str, np.ndarray] | None = None
        long_run: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy() for c in [*names, "node", *(["_part"] if blocked else [])]}
            x["signs"] = np.stack([batch.column(f"s{k}").to_numpy() for k in range(words)], axis=1).view(np.uint64)
            if long_run is not None:  # the run goes on
                same = np.ones(len(x["node"]), bool)
                for c, v in zip(names, long_run, strict=True):
                    same &= x[c] == v
                n = int(same.sum())
                if n:
                    yield _found(words, LATER, x["node"][:n], x["node"][:n], x["bucket"][:n], x["signs"][:n])
                    x = {c: v[n:] for c, v in x.items()}
                if not len(x["node"]):
                    continue
                long_run = None
            if kept is not None:
                x = {c: np.concatenate((kept[c], v)) for c, v in x.items()}
            new = np.ones(len(x["node"]), bool)
            new[1:] = np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in names])
            starts = np.append(np.flatnonzero(new), len(new))
            last, kept = int(starts[-2]), None
            yield from _runs(x, starts[:-1], most, few, run, blocked)
            rest = {c: v[last:] for c, v in x.items()}
            if not blocked and len(rest["node"]) > run:
                long_run = tuple(rest[c][0] for c in names)
                yield _found(words, LATER, rest["node"], rest["node"], rest["bucket"], rest["signs"])
            else:
                kept = rest
        if kept is not None:
            yield from _runs(kept, np.array([0, len(kept["node"])]), most, few, run, blocked)

    return work


def _runs(x: dict[str, np.ndarray], starts: np.ndarray, most: int, few: int, run: int, blocked: bool) -> Iterator[pa.RecordBatch]:
    if len(starts) < 2:
        return
    end, size = int(starts[-1]), np.diff(starts)
    if not blocked and (size > run).any():
        own = np.repeat(size > run, size)
        yield _found(x["signs"].shape[1], LATER, x["node"][:end][own], x["node"][:end][own], x["bucket"][:end][own], x["signs"][:end][own])
        x = {c: v[:end][~own] for c, v in x.items()}
        starts = np.concatenate(([0], np.cumsum(size[size <= run])))
        end = int(starts[-1])
    x = {c: v[:end] for c, v in x.items()}
    apart = np.where(x["_lo"] == x["_hi"], -1 - np.arange(end), x["_part"]) if blocked else None
    share = np.cumsum(np.diff(starts) ** 2) >> 22  # what is looked at together holds some millions of pairs at most, or one run
    for k in np.unique(share):
        runs_of = np.flatnonzero(share == k)
        s, e = int(starts[runs_of[0]]), int(starts[runs_of[-1] + 1])
        yield from _candidates(x["node"][s:e], x["signs"][s:e], starts[runs_of[0] : runs_of[-1] + 2] - s, None if apart is None else apart[s:e], most, few)


def candidates(dealt: DataFrame, words: int, most: int, dense: int, run: int, spread: DataFrame | None = None) -> DataFrame:
    """A written table of (kind, a, b) from (bucket, node, s0, s1, ...): nodes of one bucket whose ``words`` * 64 signs differ in at most ``most`` places.

    A node with fewer than ``dense`` such partners in its bucket is named with each (``PAIR``); what else they connect
    comes as links that join the same nodes (``STAR``), so no bucket makes more rows than ``dense`` times its own.
    Rows meet in one shuffle. A bucket of more than ``run`` rows isn't held: its rows pass through and go, with those of
    ``spread``, to blocks.
    """
    schema = "kind int, a long, b long, bucket long, " + ", ".join(f"s{k} long" for k in range(words))
    found = written(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(words, most, dense, run, False), schema), "candidates")
    later = found.where(f"kind = {LATER}").select("bucket", F.col("a").alias("node"), *[f"s{k}" for k in range(words)])
    later = written(later if spread is None else later.unionByName(spread), "later")
    if not later.isEmpty():
        met = blocks(later, "bucket", F.col("node"), run // 2).mapInArrow(_meet(words, most, dense, run, True), schema)
        found = found.unionByName(written(met, "candidates"))
    return found.where(f"kind <> {LATER}").select("kind", "a", "b")


# ---------------------------------------------------------------- components

#: Links that one task joins at most; more are joined by rounds over written tables.
ONE_TASK = 1 << 20


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of ``links``, the smallest node that it reaches.

    Alternating large-star and small-star steps; each writes its table to the shared folder, so no lineage grows and
    no node's neighbours are gathered. A hot centre is one side of a join of written tables, which AQE splits. Once at
    most ``ONE_TASK`` links are left, one task joins them.
    """
    found = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    found, mark = written(found, "links"), None
    while True:
        if found.count() <= ONE_TASK:
            return found.coalesce(1).mapInArrow(_joined, "node long, component long")
        now = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
        both = found.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(found.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large")
        large = found.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large.distinct(), "links")
        low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "small")
        small = large.join(low, "hi")
        small = small.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        found = written(small.unionByName(low.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct(), "links")
    stars = found.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(found.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches]
    hi, lo = (np.concatenate([np.zeros(0, np.int64), *(y[k] for y in x)]) for k in (0, 1))
    node, least = (np.array(y, np.int64) for y in spanning(hi, lo))
    root = np.unique(least)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node, root))), pa.array(np.concatenate((least, root)))], ["node", "component"])
