from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing

SF = "/root/testdata/sf0.01"


def filled(sizes, weights, limit):
    """Water-filling by rounds, as the targets are defined."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > limit * sizes[i]}
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = limit * sizes[i]
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 1000, 500, 3, 0, 70], [1, 1, 1], [5], [100, 1, 1, 1]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.by_rank(rows)).collect()}
    want = filled(sizes, [1 + i % 3 for i in range(len(sizes))], 3)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_pivotal_keeps_words_and_expectations():
    rng, sums = random.Random(1), [0.0] * 12
    share = [rng.random() * 0.98 + 0.01 for _ in sums]
    size = sorted((rng.randint(1, 50) for _ in sums), reverse=True)
    rounds = 4000
    for _ in range(rounds):
        own = list(share)
        held = mixing.pivotal(own, size, [rng.random() for _ in own])
        assert sum(a * b for a, b in zip(own, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(share, size, strict=True)))
        assert [k for k, x in enumerate(own) if x not in (0.0, 1.0)] in ([], [held])
        sums = [a + b for a, b in zip(sums, own, strict=True)]
    assert [s / rounds for s in sums] == pytest.approx(share, abs=0.04)


def test_mix_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(docs, fan=16).toPandas()
    again = mixing.mix(docs.repartition(7), fan=16).toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert len(found) == docs.count() and (found.taken <= 3 * found["size"]).all()
    by = found.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.largest).all()
    whole = mixing.mix(docs).toPandas().groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((whole.taken - whole.target).abs() / whole.target).max() < 0.05
    words = {r.doc_id: len(r.text.split()) if r.text.isascii() else None for r in docs.collect()}
    assert all(words[d] in (None, s) for d, s in zip(found.doc_id, found["size"], strict=True))


def test_mix_of_odd_rows(spark, odd, nothing):
    found = mixing.mix(odd).toPandas()
    assert len(found) == odd.count() and (found.taken == found.copies * found["size"]).all()
    assert (found[found.doc_id.isin([4, 5, 6])].taken == 0).all()
    assert found[found.source.isna()].target.nunique() == 1
    again = mixing.mix(odd.repartition(5)).toPandas()
    assert sorted(again.taken.tolist()) == sorted(found.taken.tolist())
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == found[found["size"] > 0].copies.sum()
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_sources_that_share_ids_and_sizes_keep_their_words(spark):
    rows = [(i, "w " * (1 + i % 7), s) for s in ("x", "y") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).toPandas().set_index("source")
    mixed = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).toPandas().set_index("source")
    assert mixed.n.to_dict() == mix.n.to_dict() and ((mix.n - mix.t).abs() <= 7).all() and mix.t["y"] == 2 * mix.t["x"]


def test_a_hot_repeated_row_is_one_unit(spark):
    rows = [(None, "a b c", None)] * 3000 + [(1, "a b", "s")] * 500 + [(i, "w " * (1 + i % 9), "s") for i in range(2, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = mixing.mix(docs, fan=16).toPandas()
    assert len(found) == len(rows) and (found.taken <= 3 * found["size"]).all()
    by = found.groupby("source", dropna=False).agg(t=("target", "first"), n=("taken", "sum"))
    assert ((by.t - by.n).abs() <= 9).all()
    hot = found[found.doc_id.isna()].copies
    assert hot.max() - hot.min() <= 1
    assert mixing.mixed(docs).count() == mixing.mix(docs).toPandas().copies.sum()


def test_query_of_all_documents(spark):
    from lamina.llm.queries import op1_mixing

    out = op1_mixing(spark, SF)
    assert dict(out.dtypes) | {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"} == dict(out.dtypes)
    found = out.toPandas()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    assert found.set_index("doc_id")["size"].to_dict() == size
    sources = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d, r in docs.items() if r.source == s) for s in sources}
    want = dict(zip(sources, filled([total[s] for s in sources], [1 + i % 3 for i in range(len(sources))], 3), strict=True))
    for r in found.itertuples():
        s = docs[r.doc_id].source
        assert r.source_size == total[s] and r.target == pytest.approx(want[s]) and r.taken % max(r.size, 1) == 0
    taken = {s: 0 for s in sources}
    for r in found.itertuples():
        taken[docs[r.doc_id].source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sources)
