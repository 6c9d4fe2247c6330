"""What several operators of this folder share: written tables in the shared folder, and runs of sorted rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.session import materialised, scratch

shared_dir, written = scratch, materialised


def own(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for helper columns beside all of its own."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` (integers), as tables of whole runs with the starts of the runs and the end.

    Holds one batch and the run that its end cuts; a run over many batches is put together once.
    """
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts, first = _starts(table, keys), tuple(table.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield _whole(held)
            held = []
        if len(starts) > 1:
            before = sum(t.num_rows for t in held)
            done = pa.concat_tables([*held, table.slice(0, starts[-1])]).combine_chunks()
            yield done, np.concatenate(([0], starts[1:] + before))
            held = []
        held.append(table.slice(starts[-1]))
        last = tuple(table.column(k)[table.num_rows - 1].as_py() for k in keys)
    if held:
        yield _whole(held)


def _whole(run: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
    table = pa.concat_tables(run).combine_chunks()
    return table, np.array([0, table.num_rows])


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """At most one link a node that join what the links (x, y) join."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    i, j, low = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        now = low.copy()
        np.minimum.at(now, i, low[j])
        np.minimum.at(now, j, low[i])
        now = now[now]
        if (now == low).all():
            break
        low = now
    moved = low != np.arange(len(nodes))
    return nodes[moved].tolist(), nodes[low[moved]].tolist()


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        lo, hi = (x, y) if x < y else (y, x)
        self.up.setdefault(lo, lo)
        self.up[hi] = lo
