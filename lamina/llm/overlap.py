"""Exact overlap of sets of word shingles: which of the texts that a rougher method brings together are near copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

from .common import Forest, runs

SHINGLE, LEAST = 5, 0.8


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hash of each word shingle, repeats included: ASCII letters lower-cased, words cut at ASCII white space. A text of fewer words is one shingle, one without words has none."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    cut = map(slice, begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter(map(digest, map(joined.__getitem__, cut), repeat(42)), np.uint64, len(words) - shingle + 1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes; a text without words is one shingle of its own kind."""
    own = np.unique(hashes(text, shingle))
    return own if len(own) else np.zeros(1, np.uint64)


def class_of(own: np.ndarray) -> int:
    """A name of the set."""
    return xxhash.xxh64_intdigest(own.tobytes())


def prefixes(at: np.ndarray, values: np.ndarray, least: float) -> list[np.ndarray]:
    """Groups of sets that share one of their rarest values, each group once.

    Of n values, the n - ceil(least * n) + 1 rarest form a set's prefix: two sets of similarity ``least`` or more share a
    value of both prefixes, whatever order of rarity they are taken in, so long as it is the same.
    """
    size, often = np.diff(at), np.bincount(values)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((values, often[values], owner))
    keep = np.arange(len(values)) - np.repeat(at[:-1], size) < np.repeat(size - np.ceil(least * size - 1e-9).astype(np.int64) + 1, size)
    held, owner = values[order][keep], owner[order][keep]
    some = often[held] > 1
    held, owner = held[some], owner[some]
    order = np.lexsort((owner, held))
    held, owner = held[order], owner[order]
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(held))
    starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
    if not len(starts):
        return []
    mixed = (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.append(np.uint64(0), np.cumsum((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64))
    _, first = np.unique(np.stack((mixed[ends] - mixed[starts], (ends - starts).astype(np.uint64))), axis=1, return_index=True)
    return [owner[s:e] for s, e in sorted(zip(starts[first].tolist(), ends[first].tolist(), strict=True), key=lambda x: x[1] - x[0])]


def alike(at: np.ndarray, values: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that connect the sets ``values[at[i]:at[i + 1]]`` (distinct values each) exactly as all pairs of similarity ``least`` do.

    Sets are compared only within the groups of ``prefixes``, and only where they aren't connected yet: a group of
    copies costs a pass over its sets, not its pairs.
    """
    names, values = np.unique(values, return_inverse=True)
    at, size, mark, out, forest = np.asarray(at, np.int64), np.diff(at), np.zeros(len(names), bool), [], Forest()
    for group in prefixes(at, values, least):
        roots = np.array([forest.root(i) for i in group.tolist()])
        todo, reached = group[roots != roots[0]], group[roots == roots[0]].tolist()
        while len(todo):
            n = size[todo]
            first = np.cumsum(n) - n
            rest = values[np.arange(n.sum()) + np.repeat(at[:-1][todo] - first, n)]
            while reached and len(todo):
                i = reached.pop()
                fits = np.minimum(size[i], size[todo]) >= least * np.maximum(size[i], size[todo]) - 1e-9
                if not fits.any():
                    continue
                own = values[at[i] : at[i + 1]]
                mark[own] = True
                common = np.add.reduceat(mark[rest], first, dtype=np.int64)
                mark[own] = False
                near = common * (1 + least) >= least * (size[i] + size[todo]) - 1e-9
                if near.any():
                    for j in todo[near].tolist():
                        out.append((i, j))
                        forest.link(i, j)
                    top = forest.root(i)
                    joined = np.array([forest.root(j) == top for j in todo.tolist()])
                    reached += todo[joined].tolist()
                    todo = todo[~joined]
                    n = size[todo]
                    first = np.cumsum(n) - n
                    rest = values[np.arange(n.sum()) + np.repeat(at[:-1][todo] - first, n)]
            if len(todo):
                top = forest.root(int(todo[0]))
                same = np.array([forest.root(j) == top for j in todo.tolist()])
                reached, todo = todo[same].tolist(), todo[~same]
    return out


def overlapping(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, ["component", "_lo", "_hi"]):
            name, own = t.column("class").to_numpy(), t.column("own").combine_chunks()
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            at = np.concatenate(([0], np.cumsum(own.value_lengths().to_numpy()))).astype(np.int64)
            values = own.flatten().to_numpy()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                pairs = np.array(alike(at[s : e + 1] - at[s], values[at[s] : at[e]], least), np.int64).reshape(-1, 2)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(name[s + pairs[:, 0]]), pa.array(name[s + pairs[:, 1]])], ["a", "b"])

    return work
