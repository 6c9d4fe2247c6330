from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import packing
from lamina.llm.queries import op7_packing, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "a  b", "\n\nx \ny", "tab\t x", "<|endoftext|> hi", "x <|endoftext|> y <|endoftext|>\n", "<|endoftext", "a <| b", "a " * 500, "\x1c a\x1fb", "don't  I'll", " lead", "trail ", "a\n\nb", "a\r\nb c", "x 　y 12 34", "\u0085x y", "x  y", "ña.ó,x! '''s"]


def test_ids_are_those_of_the_tokenizer(spark):
    fresh, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encoder.encode("x <|endoftext|> y"), "<u4")


def optimum(sizes, room):
    """Fewest bins, by trying all first-open placements."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= room and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(5, 70, 12).tolist(), reverse=True)
    counts = Counter(sizes)
    found = packing.bin_completion(counts, 100)
    held = Counter()
    for fill, n in found:
        assert sum(fill) <= 100
        for s in fill:
            held[s] += n
    assert held == counts
    assert sum(n for _, n in found) == optimum(sizes, 100) >= packing.lower_bound(counts, 100)


def test_counts_of_any_size_cost_the_same():
    found = packing.bin_completion({600: 10**9, 424: 10**9, 300: 5}, 1024)
    assert sum(n for _, n in found) == 10**9 + 2 and len(found) <= 4
    assert packing.bin_completion({}, 1024) == []


def check(rows, docs, size, end):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    fresh = Tokenizer.from_file(tokenizer_path())
    for d, text in docs.items():
        ids = fresh.encode(text or "", add_special_tokens=False).ids + [end]
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == size for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= size


def test_documents_in_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op7_packing(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = out.collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, 1024, 2)
    counts = Counter(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= packing.lower_bound(counts, 1024) * 1.02 + 1


def test_odd_rows(spark, odd, nothing):
    parts = packing.pieces(odd, tokenizer_path(), size=64)
    rows = packing.pack(parts, size=64).collect()
    assert len(rows) == parts.count() and {r.length for r in rows if r.doc_id in (4, 5)} == {1}
    places = Counter((r.sequence_id, r.offset) for r in rows)
    assert max(places.values()) == 1  # repeated rows have places of their own
    assert packing.pack(packing.pieces(nothing, tokenizer_path())).count() == 0
    assert packing.pieces(nothing, tokenizer_path(), end=None).count() == 0


def test_common_lengths_are_ranked_in_groups(spark):
    parts = spark.range(4000).select((F.col("id") % 1300).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") < 2500, 30).when(F.col("id") < 3000, 100).otherwise(40 + F.col("id") % 40).cast("long").alias("length"), F.col("id").alias("ids_crc32"), F.lit(7).alias("_r"), F.lit("x").alias("_salt"))
    out = packing.pack(parts, size=100, group=64)
    assert out.columns == [*parts.columns, "sequence_id", "offset"]
    used: dict[int, list] = {}
    rows = out.collect()
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 4000 and len({r.ids_crc32 for r in rows}) == 4000
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    counts = Counter(r.length for r in rows if r.length < 100)
    assert len(used) == 500 + sum(n for _, n in packing.bin_completion(counts, 100)) <= 500 + sum(n for _, n in packing.best_fit(counts, 100))
