"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

A normalised vector v has in each table the key of ``per_key`` values floor((a . v + b) / width), a from the normal
distribution. Two unit vectors of cosine c lie sqrt(2 - 2c) apart, so the chance that one value agrees follows from the
width, and the number of tables from the recall asked for. ``per_key`` grows with the logarithm of the number of
vectors, so that unrelated vectors of a bucket are about as many at every size.

What moves to the buckets is not vectors but ids with the signs of ``SIGNS`` projections. Signs that differ in more
places than two vectors at the threshold ever would (``reach``) part a pair; the others of a bucket are candidates. Where
a vector has few candidates in a bucket, they are pairs of ids, which meet once whatever the number of tables; a dense
bucket names its members instead, and what such buckets connect is compared in blocks. Either way vectors are fetched by
id and compared by exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PAIR, STAR, blocks, candidates, components
from .common import Forest, runs, spanning, written

#: One value's width: at cosine 0.95 it agrees with chance 0.87, at right angles with 0.49.
WIDTH = 2.0
#: Chance that a pair just at the threshold shares a bucket, and unrelated vectors that a vector meets in a bucket, about.
RECALL, LOAD = 0.996, 128
SIGNS = 128
#: A bucket's members beyond this number are dense, and a run of bucket rows beyond it goes to blocks.
DENSE, RUN = 32, 2048
#: Vectors whose buckets are looked at to find hot ones; this only decides how rows travel.
SAMPLE = 16_384


def shape(n: int, cosine: float, width: float = WIDTH, sure: float = RECALL, load: float = LOAD) -> tuple[int, int]:
    """(per_key, tables) for ``n`` vectors: a bucket holds about ``load`` at right angles, a pair at ``cosine`` is found with chance ``sure``."""
    per_key = max(4, ceil(log(max(n, 1) / load) / -log(agreement(sqrt(2), width)))) if n > load else 4
    return per_key, ceil(log(1 - sure) / log(1 - agreement(sqrt(2 - 2 * cosine), width) ** per_key))


def reach(cosine: float, deviations: float = 6.0) -> int:
    """Signs of ``SIGNS`` that two vectors of that cosine differ in at most, but for a chance of about 1e-9."""
    p = acos(max(-1.0, min(1.0, cosine))) / pi
    return min(SIGNS, ceil(SIGNS * p + deviations * sqrt(SIGNS * p * (1 - p))))


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash value of two vectors at that distance agrees."""
    if distance == 0:
        return 1.0
    c = width / distance
    return erf(c / sqrt(2)) - sqrt(2 / pi) / c * (1 - exp(-c * c / 2))


def recall(cosine: float, per_key: int, tables: int, width: float = WIDTH) -> float:
    """Chance that a pair of that cosine shares a bucket."""
    return 1 - (1 - agreement(sqrt(2 - 2 * cosine), width) ** per_key) ** tables


class Hashes:
    """Bucket keys and signs of unit vectors of one length."""

    def __init__(self, dim: int, per_key: int, tables: int, width: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.standard_normal((dim, tables * per_key + SIGNS)), rng.random(tables * per_key) * width
        self.mix = rng.integers(1, 2**63, (tables, per_key), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shape, self.width = (tables, per_key), width

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, tables) and (vectors, 2) of 64 signs each."""
        out, signs = np.empty((len(unit), self.shape[0]), np.uint64), np.empty((len(unit), SIGNS // 64), np.uint64)
        for i in range(0, len(unit), 4096):
            at = unit[i : i + 4096] @ self.a
            n = len(self.b)
            signs[i : i + 4096] = np.packbits(at[:, n:] >= 0, axis=1).view(np.uint64)
            cell = np.floor((at[:, :n] + self.b) / self.width).astype(np.int64).view(np.uint64).reshape(len(at), *self.shape)
            k = (cell * self.mix).sum(axis=2, dtype=np.uint64) ^ (np.arange(self.shape[0], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            k = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out[i : i + 4096] = k ^ (k >> np.uint64(29))
        return out.view(np.int64), signs.view(np.int64)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column in double precision, at length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    top = np.abs(v).max(axis=1, keepdims=True, initial=0)
    v = v / np.where(top > 0, top, 1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vector: str):
    """Neither null nor empty nor zero, and all components finite."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    return x.isNotNull() & F.coalesce(fine, F.lit(False))


def _check(cosine: float):
    """Which pairs (rows of the same a and b beside each other, a vector each) are links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("va").value_lengths().to_numpy(), b.column("vb").value_lengths().to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for d in np.unique(size[0]).tolist():
                own = np.flatnonzero((size[0] == d) & (size[1] == d))
                for k in range(0, len(own), 4096):
                    rows = pa.array(own[k : k + 4096])
                    u, w = unit_rows(b.column("va").take(rows)), unit_rows(b.column("vb").take(rows))
                    keep[own[k : k + 4096]] = (u * w).sum(axis=1) >= cosine
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])

    return work


def _count(cosine: float):
    """Links within dense groups, block by block: for each vector their number, and one link that joins it to its component there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, ["component", "_lo", "_hi"]):
            ids, copies, part = (t.column(c).to_numpy() for c in ("node", "copies", "_part"))
            whole = t.column("_lo").to_numpy() == t.column("_hi").to_numpy()
            dims = pc.list_value_length(t.column("v")).to_numpy()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for d in np.unique(dims[s:e]).tolist():
                    rows = s + np.flatnonzero(dims[s:e] == d)
                    u, n = unit_rows(t.column("v").take(pa.array(rows))), np.zeros(len(rows), np.int64)
                    forest = Forest()
                    for i in range(0, len(rows), 512):
                        near = u[i : i + 512] @ u.T >= cosine - 1e-9
                        x, y = np.nonzero(near)
                        x = x + i
                        fine = (x < y) & (whole[s] | (part[rows[x]] != part[rows[y]]))
                        x, y = x[fine], y[fine]
                        exact = (u[x] * u[y]).sum(axis=1) >= cosine
                        x, y = x[exact], y[exact]
                        n += np.bincount(x, copies[rows[y]], len(rows)).astype(np.int64) + np.bincount(y, copies[rows[x]], len(rows)).astype(np.int64)
                        for p, q in zip(*spanning(ids[rows[x]], ids[rows[y]]), strict=True):
                            forest.link(p, q)
                    some = np.flatnonzero(n)
                    if len(some):
                        own = ids[rows[some]]
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.array([forest.root(z) for z in own.tolist()], np.int64)), pa.array(n[some])], ["a", "b", "n"])

    return work


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, sure: float = RECALL, width: float = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    Links join vectors of cosine >= ``cosine``, of those that share a bucket. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, and vectors of different lengths not with each other. Equal
    vectors are one node before any bucket, so copies cost nothing; buckets and dense groups of any size are compared in
    full, in blocks. A component's id is its smallest vec_id; rows without vec_id count as links but name no component.
    Repeated rows are vectors of their own; an empty table gives an empty result; other columns play no part.
    """
    exact = vectors.schema[vector].dataType.simpleString() if vector in vectors.columns else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable(vector), F.col(vector).cast(exact if exact == "array<float>" else "array<double>")).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = written(nodes, "nodes")
    n = nodes.count()
    per_key, tables = shape(n, cosine, width, sure)
    most = reach(cosine)

    def hashed(column: pa.Array, made: dict[int, Hashes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = column.value_lengths().to_numpy()
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            if d not in made:
                made[d] = Hashes(d, per_key, tables, width)
            yield own, *made[d].keys(unit_rows(column.take(pa.array(own))))

    # Buckets that hold many of a bounded sample: their rows go to blocks at once, the sooner to be spread.
    share = F.pmod("node", F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    seen = nodes.where(share).select("v").limit(4 * SAMPLE).toArrow()
    hot = np.zeros(0, np.int64)
    if seen.num_rows > 256:
        keys = [k.ravel() for _, k, _ in hashed(seen.column("v").combine_chunks(), {})]
        names, held = np.unique(np.concatenate(keys), return_counts=True)
        hot = names[held > max(RUN * seen.num_rows // n, seen.num_rows // 64, 64)]

    def deal(only: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, Hashes] = {}
            for b in batches:
                node = b.column("node").to_numpy()
                for own, keys, signs in hashed(b.column("v"), made):
                    at, bucket = np.repeat(np.arange(len(own)), tables), keys.ravel()
                    if len(hot):
                        keep = np.isin(bucket, hot) == only
                        at, bucket = at[keep], bucket[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node[own][at]), pa.array(signs[at, 0]), pa.array(signs[at, 1])], ["bucket", "node", "s0", "s1"])

        return work

    schema = "bucket long, node long, s0 long, s1 long"
    spread = nodes.select("node", "v").mapInArrow(deal(True), schema) if len(hot) else None
    found = candidates(nodes.select("node", "v").mapInArrow(deal(False), schema), SIGNS // 64, most, DENSE, RUN, spread)

    # What dense buckets connect is compared in blocks; pairs of ids that lie in one such group are compared there.
    stars = written(found.where(f"kind = {STAR}").select("a", "b").distinct(), "stars")
    pairs = found.where(f"kind = {PAIR}").select("a", "b").distinct()
    held = nodes.select("node", "v", "copies")
    links = None
    if not stars.isEmpty():
        group = written(components(stars), "dense")
        met = written(group.join(held, "node"), "dense")
        links = written(blocks(met, "component", F.col("node")).mapInArrow(_count(cosine), "a long, b long, n long"), "links")
        for end in ("a", "b"):
            pairs = pairs.join(group.select(F.col("node").alias(end), F.col("component").alias(f"g{end}")), end, "left")
        pairs = pairs.where("ga is null or gb is null or ga <> gb").select("a", "b")
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    some = written(held.join(ends, "node", "left_semi"), "vectors")
    for end in ("a", "b"):
        pairs = pairs.join(some.select(F.col("node").alias(end), F.col("v").alias(f"v{end}"), F.col("copies").alias(f"n{end}")), end)
    checked = written(pairs.select("a", "b", "va", "vb", "na", "nb").mapInArrow(_check(cosine), "a long, b long, na long, nb long"), "links")
    both = checked.select("a", "b", F.col("nb").alias("n")).unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("na").alias("n")))
    links = both if links is None else both.unionByName(links)
    member = components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    nodes = nodes.select("node", "first", "copies")
    named = nodes.join(counts, nodes.node == counts.a, "left").join(member, nodes.node == member.node, "left").select(nodes.node, "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", nodes.node).alias("component"))
    named = written(named, "named")
    least = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = written(named.join(least, "component").select(F.col("node").alias("_node"), "n_links", "component_id"), "named")
    out = rows.select("vec_id", "node").join(named, F.col("node") == F.col("_node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
