from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lamina.llm import blocks, simhash
from lamina.llm.common import Forest

SF = "/root/testdata/sf0.001"


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, ids, max_bits):
    forest = Forest()
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= max_bits:
                forest.link(i, j)
    first = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = forest.root(i)
            first[r] = min(first.get(r, d), d)
    return [first.get(forest.root(i)) for i in range(len(ids))]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    fps = [plain(texts[d]) for d in ids]
    assert [got[d][0] for d in ids] == fps
    assert [got[d][1] for d in ids] == brute(fps, ids, 2)


def test_query_of_fingerprints(spark):
    from lamina.llm.queries import op3_simhash

    out = op3_simhash(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [plain(texts[d]) for d in ids]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()} == dict(zip(ids, zip((f"{x:016x}" for x in fps), brute(fps, ids, 2), strict=True), strict=True))


def test_dense_buckets_split_and_lose_nothing(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)})
    pivots = simhash.Pivots(2)
    signed = np.array(fps, np.uint64)
    for i in range(len(fps)):
        keys = pivots.buckets(signed[[i]])
        near = [j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2]
        assert (pivots.buckets(signed[near]) == keys).any(axis=1).all()  # a linked pair shares a bucket
    rows = spark.createDataFrame([(0, int(x)) for x in signed.view(np.int64)], "bucket long, fp long")
    dealt = blocks.blocks(rows, "bucket", rows.fp, block=64)
    assert dealt.groupBy("_lo", "_hi").count().agg({"count": "max"}).first()[0] < 64 * 4
    links = blocks.components(dealt.mapInArrow(simhash._links(2), "a long, b long"))
    label = {r.node: r.component for r in links.collect()}
    ids = [int(x) for x in signed.view(np.int64)]
    assert [label.get(x, x) for x in ids] == brute(fps, ids, 2)


@pytest.mark.parametrize("one_task", [blocks.ONE_TASK, 3])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    """In one task, and in rounds over written tables."""
    monkeypatch.setattr(blocks, "ONE_TASK", one_task)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in blocks.components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
    assert blocks.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == {(next(iter(by[1]))[0], 1)} and next(iter(by[2]))[1] == 1 and next(iter(by[8]))[1] == 7
    assert {next(iter(by[d])) for d in (4, 5, 6)} == {(0, 4)}
    assert len(by[3]) == 1 and {c for _, c in by[None]} == {None}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 7, 9, 10, 11, 12]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
