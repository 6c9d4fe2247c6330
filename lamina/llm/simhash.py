"""SimHash near-duplicates, found through pivot distance tables.

Every fingerprint gets its Hamming distances to many reference fingerprints (pivots). Distances obey the triangle
inequality, so two fingerprints within ``d`` bits differ by at most ``d`` in every coordinate of that table.

The pivots are the zero fingerprint and, for each of ``ranges`` runs of bits, random ones that are set only inside the
run. The distance to such a pivot less the distance to zero depends on the run's bits alone, so two fingerprints within
``d`` bits agree in all these coordinates of at least ``ranges - d`` runs: each choice of that many runs is a bucket key
that a linked pair shares for certain. Inside a bucket, pairs whose largest coordinate difference exceeds ``d`` go, and
the survivors are verified on the fingerprints themselves. No link is lost and none is added.

``near_texts`` uses the same tables for texts whose sets of five-word shingles overlap by 0.8 or more: fingerprints of
more bits, a radius that such texts keep within, and an exact check of the overlap at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks, candidates, components
from .common import Forest, own, runs, written
from .overlap import LEAST, SHINGLE, class_of, hashes, overlapping, shingles

BITS = 64
_CHUNK = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _majority(hashes: np.ndarray) -> int:
    return int(np.packbits(2 * _ones(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats included; zero without words."""
    own = hashes(text, shingle)
    return _majority(own) if len(own) else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``; a null or blank text has fingerprint 0. Other columns play no part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x or b"", shingle) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(work, "doc_id long, fp long")


class Pivots:
    """The reference fingerprints and the table of distances to them."""

    def __init__(self, max_bits: int = 2, ranges: int = 4, per_range: int = 12, seed: int = 7) -> None:
        rng, width = np.random.default_rng(seed), BITS // ranges
        inside = np.uint64(2**width - 1)
        self.refs = [np.zeros(1, np.uint64)] + [(rng.integers(1, 2**width, per_range, dtype=np.uint64) & inside) << np.uint64(width * r) for r in range(ranges)]
        self.all = np.concatenate(self.refs)
        self.mix = [rng.integers(1, 2**63, per_range, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(ranges)]
        self.keys = list(combinations(range(ranges), ranges - max_bits))

    def table(self, fp: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[:, None] ^ self.all[None, :]).astype(np.int8)

    def buckets(self, fp: np.ndarray) -> np.ndarray:
        """One column for each choice of runs: a hash of the coordinates of those runs' pivots, less the distance to zero."""
        table, n = self.table(fp).astype(np.int64), len(self.refs[1])
        ranges = [((table[:, 1 + r * n : 1 + (r + 1) * n] - table[:, :1]).view(np.uint64) * self.mix[r]).sum(axis=1, dtype=np.uint64) for r in range(len(self.mix))]
        out = np.empty((len(fp), len(self.keys)), np.uint64)
        for k, chosen in enumerate(self.keys):
            x = np.full(len(fp), 0x9E3779B97F4A7C15 * (k + 1) % 2**64, np.uint64)
            for r in chosen:
                x = (x ^ ranges[r]) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(29)
            out[:, k] = x
        return out.view(np.int64)


def survivors(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those that no pivot discards and whose fingerprints differ by at most ``max_bits``."""
    for c in range(table.shape[1]):
        if not len(i):
            break
        near = np.abs(table[i, c] - table[j, c]) <= max_bits
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
    return i[near], j[near]


def _links(max_bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, forest = Pivots(max_bits), Forest()

        def out() -> Iterator[pa.RecordBatch]:
            pairs = [(x, forest.root(x)) for x in forest.up]
            pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            forest.up.clear()

        for t, starts in runs(batches, ["bucket", "_lo", "_hi"]):
            fp, bucket_of = t.column("fp").to_numpy().view(np.uint64), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            table, part, lo, hi = pivots.table(fp), t.column("_part").to_numpy(), t.column("_lo").to_numpy(), t.column("_hi").to_numpy()
            end, at = starts[1:][bucket_of], np.arange(len(fp))
            # Each row meets the rows below it in its run, one distance at a time; in a block of two parts, those of the other part.
            for step in range(1, int(np.diff(starts).max())):
                at = at[at + step < end[at]]
                other = (lo[at] == hi[at]) | (part[at] != part[at + step])
                i, j = survivors(fp, table, at[other], at[other] + step, max_bits)
                for x, y in zip(fp[i].view(np.int64).tolist(), fp[j].view(np.int64).tolist(), strict=True):
                    forest.link(x, y)
            if len(forest.up) > 1_000_000:
                yield from out()
        yield from out()

    return work


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints within ``max_bits`` bits are linked; a component's id is its smallest doc_id.

    One row for each row of ``docs``. Null and blank texts have fingerprint 0 and are linked like others. Rows without
    doc_id count for the links, but name no component. Equal fingerprints are one class before any pairing, so copies
    cost nothing; between different fingerprints no link is lost.
    """
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = Pivots(max_bits)
        for b in batches:
            fp = b.column(0).to_numpy()
            keys = pivots.buckets(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, keys.shape[1]))], ["bucket", "fp"])

    dealt = written(classes.select("fp").mapInArrow(deal, "bucket long, fp long"), "buckets")
    links = written(blocks(dealt, "bucket", F.col("fp")).mapInArrow(_links(max_bits), "a long, b long"), "links")
    member = components(links)
    classes = classes.join(member, classes.fp == member.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    classes = written(classes, "classes")
    least = written(classes.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = written(classes.join(least, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- wide radius, for texts that overlap

#: Words of a wide fingerprint, unrelated fingerprints that one meets in a bucket (about), and the chance that a pair of
#: the least similarity shares one.
WORDS, LOAD, SURE = 3, 128, 0.99
#: Chance that a bit differs at similarity 0.8: for large sets, and the largest for any (4 shingles beside the same and a fifth).
TYPICAL, APART = 0.1514, 0.1875
RUN = 2048


def wide(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of ``words`` * 64 bits of distinct hashes: later words vote on the hashes mixed anew."""
    out = np.empty(words, np.uint64)
    for k in range(words):
        x = own + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        if k:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out[k] = _majority(x)
    return out


def radius(words: int = WORDS, deviations: float = 5.0) -> int:
    """Bits that two wide fingerprints at the least similarity differ in at most, but for a chance below 1e-6 (1e-3 for the smallest sets)."""
    n = BITS * words
    return ceil(n * TYPICAL + deviations * sqrt(n * TYPICAL * (1 - TYPICAL)))


class Runs:
    """Pivots for a radius too wide for pigeonholes: each lies inside a random run of bits, and buckets are equal coordinates of one run's pivots.

    How long runs are follows from the number of fingerprints, and how many there are from the chance that a pair at the
    least similarity agrees in one.
    """

    def __init__(self, n: int, words: int = WORDS, per_run: int = 12, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.long = min(max(6, ceil(log2(max(n, 1) / LOAD))), 60) if n > LOAD else 6
        self.runs = ceil(log(1 - SURE) / log(1 - (1 - APART) ** self.long))
        self.pivots = np.zeros((self.runs, per_run, words), np.uint64)
        for r in range(self.runs):
            bits = rng.choice(BITS * words, self.long, replace=False)
            for k in range(per_run):
                for b in bits[rng.random(self.long) < 0.5].tolist():
                    self.pivots[r, k, b // BITS] |= np.uint64(1 << b % BITS)
        self.mix = rng.integers(1, 2**63, (self.runs, per_run), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def buckets(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints, runs): a hash of the distances to a run's pivots, each less the distance to zero (their size less twice what is set in both)."""
        out = np.empty((len(fp), self.runs), np.uint64)
        for r in range(self.runs):
            common = np.bitwise_count(fp[:, None, :] & self.pivots[r][None]).sum(axis=2, dtype=np.uint64)
            k = ((common + np.uint64(1)) * self.mix[r]).sum(axis=1, dtype=np.uint64) ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)
            k = (k ^ (k >> np.uint64(31))) * _MIX
            out[:, r] = k ^ (k >> np.uint64(29))
        return out.view(np.int64)


_MIX = np.uint64(0xBF58476D1CE4E5B9)


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, component, component_id): texts whose shingle sets have a Jaccard similarity of ``least`` (0.8 or more) are linked.

    Wide fingerprints of the sets share buckets of pivot coordinates and are verified by Hamming distance; at this radius
    the largest coordinate difference would discard next to nothing. What survives is brought together, whole sets, each
    once and in blocks of bounded size, and compared exactly: no link is added. A component's id is its smallest doc_id,
    null if it has none. One row for each row of ``docs``; null and blank texts are equal to each other; equal sets are
    one class before any pairing. An empty table gives an empty result; other columns play no part.
    """
    signs = [f"s{k}" for k in range(WORDS)]
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, fps = np.empty(b.num_rows, np.uint64), np.empty((b.num_rows, WORDS), np.uint64)
            for i, x in enumerate(b.column(2).to_pylist()):
                own = shingles(x or b"", shingle)
                names[i], fps[i] = class_of(own), wide(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names.view(np.int64)), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(WORDS))], ["doc_id", "text_hash", "class", *signs])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(x or b"", shingle) for x in b.column(0).to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            values = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([class_of(x) for x in own], np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["class", "own"])

    rows = written(texts.mapInArrow(deal, "doc_id long, text_hash long, class long, " + ", ".join(f"{s} long" for s in signs)), "fingerprints")
    classes = written(rows.groupBy("class").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("least"), *[F.first(s).alias(s) for s in signs]), "classes")
    pivots = Runs(classes.count())

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.stack([b.column(s).to_numpy() for s in signs], axis=1).view(np.uint64)
            at = np.repeat(np.arange(b.num_rows), pivots.runs)
            yield pa.RecordBatch.from_arrays([pa.array(pivots.buckets(fps).ravel()), *(b.column(c).take(pa.array(at)) for c in ("class", *signs))], ["bucket", "node", *signs])

    dealt = classes.select("class", *signs).mapInArrow(bucketed, "bucket long, node long, " + ", ".join(f"{s} long" for s in signs))
    coarse = candidates(dealt, WORDS, radius(), 0, RUN)
    member = written(components(coarse), "coarse")

    # The whole sets of classes with company, each once; a doc_id may stand for several texts, so classes are told again.
    some = classes.join(member, classes["class"] == member.node, "left_semi").select("first", "least")
    met = texts.join(some.where("first is not null"), F.col("doc_id") == F.col("first"), "left_semi").select("text")
    unnamed = texts.where("doc_id is null").join(some.where("first is null"), F.col("text_hash") == F.col("least"), "left_semi")
    met = met.unionByName(unnamed.dropDuplicates(["text_hash"]).select("text"))
    met = met.mapInArrow(sets, "class long, own array<long>").join(member, F.col("class") == F.col("node"))
    met = written(met.groupBy("class").agg(F.first("component").alias("component"), F.first("own").alias("own")), "sets")
    links = written(blocks(met, "component", F.col("class")).mapInArrow(overlapping(least), "a long, b long"), "links")
    last = components(links)
    named = classes.join(last, classes["class"] == last.node, "left").select("class", "first", F.coalesce("component", "class").alias("component"))
    named = written(named, "classes")
    ids = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = written(named.join(ids, "component").select("class", "component", "component_id"), "named")
    return rows.join(named, "class").select("doc_id", "text_hash", "component", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``near_texts``, the one of smallest doc_id; columns stay as they are.

    Of rows that repeat that doc_id, the one whose text hashes lowest stays. A row without doc_id stays only if no row
    of its component has one, and then one of them does.
    """
    found, p = written(near_texts(docs, doc_id, text), "texts"), own(docs)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(f"{p}kept")).distinct()
    stays = docs.where(F.col(doc_id).isNotNull()).join(first, F.col(doc_id).cast("long") == F.col(f"{p}kept"), "left_semi")
    by, row = Window.partitionBy(doc_id).orderBy(F.xxhash64(text)), f"{p}row"
    stays = stays.withColumn(row, F.row_number().over(by)).where(F.col(row) == 1).drop(row)
    alone = found.where("doc_id is null and component_id is null").groupBy("component").agg(F.min("text_hash").alias(f"{p}hash")).select(f"{p}hash")
    unnamed = docs.where(F.col(doc_id).isNull()).withColumn(f"{p}text", F.xxhash64(text))
    unnamed = unnamed.join(alone, F.col(f"{p}text") == F.col(f"{p}hash"), "left_semi").dropDuplicates([f"{p}text"]).drop(f"{p}text")
    return stays.unionByName(unnamed)
