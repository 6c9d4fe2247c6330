from __future__ import annotations

import random

import numpy as np
import pytest

from lamina.llm import ann, blocks, common, embed_dedup

ODD = [None, [0.0] * 4, [float("nan"), 0.0, 0.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], [None, 1.0, 0.0, 0.0], []]


def clustered(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = [(centres[i % 12] if i % 3 else rng.normal(size=dim)) + rng.normal(size=dim) * 0.12 for i in range(n)]
    return np.array(v).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    v = clustered()
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000 + i, x) for i, x in enumerate(ODD)] + [(None, rows[7][1]), (3, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


def fine(x):
    return x is not None and len(x) > 0 and all(e is not None and np.isfinite(e) for e in x) and any(x)


def test_links_match_all_pairs(vectors):
    df, rows = vectors
    good = [(i, np.array(x, float)) for i, x in rows if fine(x)]
    u = np.array([x / np.linalg.norm(x) for _, x in good])
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    label = list(range(len(u)))
    for _ in range(len(u)):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(links[i]))]) for i in range(len(u))]
        if new == label:
            break
        label = new
    ids = {}
    for (i, _), la in zip(good, label, strict=True):
        if i is not None:
            ids[la] = min(ids.get(la, i), i)
    want = sorted(((-1 if i is None else i), int(links[k].sum()), ids[label[k]]) for k, (i, _) in enumerate(good))
    found = embed_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in found if r.vec_id is None or not 2000 <= r.vec_id < 2100) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in found if r.vec_id and 2000 <= r.vec_id < 2100)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_recall_formula():
    for n in (10, 1000, 10**5, 10**8):
        per_key, tables = embed_dedup.shape(n, 0.95)
        assert embed_dedup.recall(0.95, per_key, tables) >= embed_dedup.RECALL
        assert n * embed_dedup.agreement(np.sqrt(2)) ** per_key <= max(embed_dedup.LOAD, n * 0.06)
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(400, 32))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.95 * u + np.sqrt(1 - 0.95**2) * w
    h = embed_dedup.Hashes(32, 4, 200, 2.0)
    (ku, su), (kv, sv) = h.keys(u), h.keys(v)
    assert (ku == kv).mean() == pytest.approx(embed_dedup.agreement(np.sqrt(0.1)) ** 4, abs=0.03)
    at = np.arange(400)
    assert blocks.near_signs(np.concatenate((su, sv)).view(np.uint64), at, at + 400, embed_dedup.reach(0.95)).all()
    assert blocks.near_signs(su.view(np.uint64), at[:-1], at[1:], embed_dedup.reach(0.95)).mean() < 0.05


def links_of(found):
    return {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}


def brute_links(v, cosine=0.95):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & ~np.eye(len(u), dtype=bool)
    label = np.arange(len(u))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(u)).min(axis=1))
        if (new == label).all():
            return {i: (int(near[i].sum()), int(label[i])) for i in range(len(u))}
        label = new


@pytest.mark.parametrize("run", [2048, 64])
def test_dense_groups_and_long_runs_match_all_pairs(spark, monkeypatch, run):
    """A group far above ``DENSE``, buckets beyond ``RUN`` (in blocks of many parts), hot buckets, and sparse pairs."""
    monkeypatch.setattr(embed_dedup, "RUN", run)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 24))
    v = np.vstack((centre[0] + rng.normal(size=(500, 24)) * 0.1, centre[1] + rng.normal(size=(150, 24)) * 0.2, rng.normal(size=(300, 24)), centre[2] + rng.normal(size=(20, 24)) * 0.15)).astype(np.float32)
    v = v[rng.permutation(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    assert links_of(embed_dedup.near_duplicates(df, sure=0.999999)) == brute_links(v)


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(6)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = rng.uniform(0.9502, 0.96, len(u))[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(np.vstack((u, c * u + np.sqrt(1 - c * c) * w)))]
    found = links_of(embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert np.mean([found[4000 + i] == (1, i) for i in range(4000)]) >= 0.99


def test_spanning_links_join_what_links_join():
    rng = random.Random(3)
    x, y = (np.array([rng.randrange(60) for _ in range(50)]) for _ in range(2))
    low, high = common.spanning(x, y)
    from lamina.llm.common import Forest

    a, b = Forest(), Forest()
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        a.link(p, q)
    for p, q in zip(low, high, strict=True):
        b.link(p, q)
    assert all(a.root(k) == b.root(k) for k in range(60)) and len(low) < 60


@pytest.mark.parametrize("block", [16_384, 40])
def test_search_matches_all_pairs_when_all_leaves_are_opened(spark, vectors, block):
    """Also with cells of few vectors, where leaves are cut into several."""
    df, rows = vectors
    queries = df.where("vec_id % 20 = 0")
    got = {}
    for r in ann.search(df, queries, k=20, trees=2, depth=3, share=3.0, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(x, float) for i, x in rows if i is not None and fine(x)}
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        found.sort()
        want = sorted(((-float((good[q] * x).sum()), i) for i, x in good.items() if i != q))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1] for f in found] == [i for _, i in want]
        assert [f[2] for f in found] == pytest.approx([-s for s, _ in want], abs=1e-12)


def test_share_falls_where_vectors_have_structure():
    """Isotropic vectors need most of the index; on clustered ones the work of a query grows slower than the table."""
    rng, work = np.random.default_rng(3), {}
    for n in (4000, 32_000):
        c = rng.normal(size=(n // 100, 32))
        x = c[rng.integers(0, len(c), n)] + rng.normal(size=(n, 32)) * 0.2
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        work[n] = n * ann.measured_share(ann.Trees(x, 1.0, 3, int(np.log2(n / ann.LEAF))), x, 20)
    assert work[32_000] < 4 * work[4000]
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ann.measured_share(ann.Trees(x, 1.0, 3, 4), x, 20) > 0.5


def test_cells_hold_neighbouring_leaves():
    first, several = ann.cells_of(np.array([5, 4, 30, 0, 2, 9, 9, 1]), 2, 10)
    assert several.tolist() == [1, 1, 3, 1, 1, 1, 1, 1]
    assert first[0] == first[1] != first[2] and len({first[0], *range(first[2], first[2] + 3), first[4], first[5], first[6]}) == 7


def test_vectors_of_several_lengths_are_searched_apart(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(10 + i, [float(i), 1.0, 2.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4] and got[4] == [3, 2, 1, 0] and got[10] == [11, 12, 13] and got[13] == [12, 11, 10]


def test_recall_on_embeddings(spark):
    from lamina.llm.queries import op8_nearest

    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    v, ids = np.stack(table.embedding).astype(float), table.vec_id.values
    hits = []
    for q, own in op8_nearest(spark, sf).toPandas().groupby("query_id"):
        s = v @ v[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -np.inf
        hits.append(len(set(ids[np.argsort(-s)[:20]]) & set(own.vec_id)) / 20)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_repeated_rows_hide_no_id(spark):
    rows = [(1, [1.0, 0.0])] * 50 + [(i, [1.0, 0.0]) for i in range(2, 30) for _ in range(3)] + [(100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id in (1, 29)"), k=20, trees=2, depth=1, share=2.0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 1] == list(range(2, 22)) and [r.vec_id for r in got if r.query_id == 29] == list(range(1, 21))


def test_few_distinct_vectors_give_all_their_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(21, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    for n in (5, 21):
        df = spark.createDataFrame(rows[:n], "vec_id long, embedding array<double>")
        got: dict[int, list] = {}
        for r in ann.search(df, df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        unit = np.array([x for _, x in rows[:n]])
        assert got == {i: sorted(set(range(n)) - {i}, key=lambda j, i=i: -(unit[i] @ unit[j])) for i in range(n)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, node long, leaf long")
    assert embed_dedup.near_duplicates(none).count() == 0 and ann.search(none, none).count() == 0
    one = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.search(one, one).count() == 0
