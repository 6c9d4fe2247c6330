from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from lamina.llm import overlap, simhash
from lamina.llm.common import Forest

SF = "/root/testdata/sf0.001"


def grams(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(sets, ids):
    forest = Forest()
    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                forest.link(i, j)
    first = {}
    for i, d in enumerate(ids):
        r = forest.root(i)
        first[r] = min(first.get(r, d), d)
    return [first[forest.root(i)] for i in range(len(ids))]


def test_stage_keeps_one_of_each_overlapping_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    texts = dict(sorted((r.doc_id, r.text) for r in docs.collect()))
    want = brute([grams(t) for t in texts.values()], list(texts))
    assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == sorted(set(want))


def test_edited_copies_far_apart_in_bits_are_linked(spark):
    rng, rows = random.Random(1), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        edited = list(words)
        for i in (40, 90, 140, 190)[: k % 5]:
            edited[i] = "edited"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    got = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == brute([grams(t) for _, t in rows], [d for d, _ in rows]) and sum(got[2 * k + 1] == 2 * k for k in range(40)) == 40
    bits = [int(np.bitwise_count(simhash.wide(overlap.shingles(a.encode())) ^ simhash.wide(overlap.shingles(b.encode()))).sum()) for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    assert max(bits) > 15 and max(bits) <= simhash.radius()


def test_links_of_a_block_connect_as_all_pairs_do():
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(12, rng.integers(1, 11), replace=False).tolist()) for _ in range(120)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    forest = Forest()
    for i, j in overlap.alike(at, np.array([x for s in sets for x in sorted(s)], np.int64), 0.8):
        assert 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
        forest.link(i, j)
    want = brute(sets, list(range(120)))
    assert [forest.root(i) for i in range(120)] == want


def test_odd_rows(odd, nothing):
    got = {r.doc_id: r.component_id for r in simhash.near_texts(odd).collect()}
    assert simhash.near_texts(odd).count() == odd.count() and got[2] == 1 and got[8] == 7 and got[6] == got[5] == 4
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(nothing).count() == 0


def test_rows_without_id_are_kept_once(spark):
    a, b = "one two three four five six seven eight nine ten", "some other words that nobody else has written so far"
    docs = spark.createDataFrame([(None, a), (None, a), (5, a), (None, b), (None, b), (None, b + " x y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(5, a), (0, b), (0, b + " x y")])


def test_pairs_at_the_least_similarity_share_a_run():
    rng = np.random.default_rng(5)
    pivots, found, near = simhash.Runs(100_000), [], []
    for size in (4, 9, 40, 400):
        for _ in range(40):
            shared, more = rng.integers(0, 2**63, size, dtype=np.uint64), rng.integers(0, 2**63, max(1, size // 4), dtype=np.uint64)
            half = len(more) // 2
            x, y = simhash.wide(np.concatenate((shared, more[:half]))), simhash.wide(np.concatenate((shared, more[half:])))
            keys = pivots.buckets(np.stack((x, y)))
            found.append((keys[0] == keys[1]).any())
            near.append(int(np.bitwise_count(x ^ y).sum()) <= simhash.radius())
    assert np.mean(found) > 0.97 and all(near)
