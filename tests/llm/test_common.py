from __future__ import annotations

import random

import pyarrow as pa

from lamina.llm import common


def test_runs_are_whole_however_batches_cut_them():
    rng = random.Random(1)
    for _ in range(200):
        keys = sorted((rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(60)))
        rows = pa.table({"a": pa.array([k[0] for k in keys], pa.int64()), "b": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array(list(range(len(keys))), pa.int64())})
        cuts, batches = sorted(rng.randrange(len(keys) + 1) for _ in range(rng.randrange(12))), []
        for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            batches += rows.slice(s, e - s).to_batches() or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["a", "b", "n"])]
        seen = []
        for table, starts in common.runs(iter(batches), ["a", "b"]):
            assert starts[0] == 0 and starts[-1] == table.num_rows
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = table.slice(s, e - s).to_pylist()
                assert part and len({(r["a"], r["b"]) for r in part}) == 1
                seen.append(((part[0]["a"], part[0]["b"]), [r["n"] for r in part]))
        assert [k for k, _ in seen] == sorted(set(keys)) and [n for _, x in seen for n in x] == list(range(len(keys)))


def test_a_prefix_of_ones_own(spark):
    assert common.own(spark.createDataFrame([(1, 2)], "_a int, __B int")) == "___"
