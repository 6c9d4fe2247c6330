"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the sequence length, so all that packing needs to know of the corpus is how many pieces
there are of each length: a table of at most ``size`` counts, whatever the corpus. Branch and bound works on it: it
takes the largest piece left, enumerates the undominated fillings around it, applies one as often as the counts allow,
and goes on; waste bounds prune, and best-fit solutions are the incumbents. Its answer is a list of patterns, each with
a number of sequences; at most one pattern per distinct length ends at each step, so the list is bounded as well.
Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own, written

#: Rows of one length that are ranked in one group, about.
GROUP = 1 << 19


#: Fixed value: how the byte-level pre-tokenizer of ``tokenizers`` cuts a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte-level vocabularies write bytes that aren't printable in Latin-1 as the letters from U+0100 on, in order.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_OF = {chr(b): b for b in range(256) if b not in _HIDDEN} | {chr(0x100 + i): b for i, b in enumerate(_HIDDEN)}
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers, by a byte-level BPE file of ``tokenizers``.

    The file's vocabulary is in the order of its merges, so the ranks of ``tiktoken`` give the same ids several times
    as fast; tests hold them against ``tokenizers`` itself (``raw``). In that pattern no pre-token crosses a line feed
    or reaches left over a single space, so words are encoded once and remembered (up to ``memory`` of them, then
    afresh). Where white space runs together or ends a text, the cut is made only at single spaces between other
    characters. A text that holds the string of an added token goes to ``tokenizers`` as it is, which gives that token.
    """

    def __init__(self, path: str, memory: int = 1 << 19) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(map(_BYTE_OF.__getitem__, k)): i for k, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if k not in self.added}
        bpe = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory, self.first, self.rest = memory, _Words(bpe, ""), _Words(bpe, " ")

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if len(self.first) + len(self.rest) > self.memory:
            self.first.clear()
            self.rest.clear()
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.raw([text])[0]
        words = text.split()
        if len("".join(words)) + len(words) - 1 != len(text):  # white space is not one character between each two words
            return self._line(_SINGLE.split(text))
        return self.first["\n"].join([self._line(x.split(" ")) for x in text.split("\n")])

    def _line(self, words: list[str]) -> bytes:
        if len(words) == 1:
            return self.first[words[0]]
        return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))


class _Words(dict):
    """Ids of a word with what stands before it."""

    def __init__(self, bpe, before: str) -> None:
        self.ids, self.before = bpe.encode_ordinary, before

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.ids(self.before + word)).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end: int | None = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids, then ``end``, in pieces of ``size``; only the first may be shorter.

    A null text is empty and has the one id ``end`` (or no piece, without ``end``). Repeated rows have pieces of their own;
    an empty table has none; other columns play no part. Texts of any length are encoded whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder(tokenizer), b"" if end is None else np.array([end], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.encode(x or "") + tail
                n, at, k = len(ids) // 4, 0, 0
                length = (n - 1) % size + 1
                while at < n:
                    out.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, k, length = at + length, k + 1, size
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- bin completion over counts

Pattern = tuple[tuple[int, ...], int]
#: Nodes that the search opens, and completions that it looks at in each: bounds on its time alone.
NODES, WIDTH = 96, 32


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing over counts: around the largest piece the largest that still fits, again and again."""
    left, out = {k: n for k, n in counts.items() if n}, []
    order = sorted(left)
    while order:
        fill, room, own = [], size, {}
        while (k := bisect_right(order, room)) and (s := _usable(order, k, left, own)) is not None:
            fill.append(s)
            own[s] = own.get(s, 0) + 1
            room -= s
        out.append(_apply(fill, left))
        order = [s for s in order if left.get(s)]
    return out


def _usable(order: list[int], k: int, left: dict[int, int], own: dict[int, int]) -> int | None:
    while k:
        if left[order[k - 1]] > own.get(order[k - 1], 0):
            return order[k - 1]
        k -= 1
    return None


def _apply(fill: list[int], left: dict[int, int]) -> Pattern:
    times = min(left[s] // fill.count(s) for s in set(fill))
    for s in set(fill):
        left[s] -= times * fill.count(s)
        if not left[s]:
            del left[s]
    return tuple(fill), times


def completions(left: dict[int, int], size: int, most: int) -> list[list[int]]:
    """Fillings around the largest piece, least waste first, without dominated ones; ``most`` is how many are looked at.

    A filling is dominated if another has, in place of one of its pieces, a larger one that is to be had and fits too,
    or has a piece more: so every filling here is maximal, and no piece can be swapped for a larger one that fits.
    """
    order = sorted(left, reverse=True)
    top, found, seen = order[0], [], [0]

    def extend(fill: list[int], at: int, room: int) -> None:
        if seen[0] >= most:
            return
        tight = True
        for k in range(at, len(order)):
            s = order[k]
            if s <= room and fill.count(s) < left[s]:
                tight = False
                extend([*fill, s], k, room - s)
                if seen[0] >= most or (found and not found[0][0]):
                    return
        if tight:
            seen[0] += 1
            if not any(x > s and x - s <= room and fill.count(x) < left[x] for s in set(fill[1:]) for x in order) and not any(s <= room and fill.count(s) < left[s] for s in order):
                found.append((room, fill))
                found.sort(key=lambda f: f[0])

    extend([top], 0, size - top)
    return [f for _, f in found] or [[top]]


def lower_bound(left: dict[int, int], size: int) -> int:
    """The volume bound, or for some cut more: pieces over half stand alone, and their spare room limits what shares with them."""
    n = np.zeros(size + 2, np.int64)
    n[list(left)] = list(left.values())
    upto, volume = np.cumsum(n), np.cumsum(n * np.arange(size + 2))
    half, cut = size // 2, np.arange(1, size // 2 + 1)
    alone = upto[-1] - upto[half]
    pairing, spare_of = upto[size - cut] - upto[half], volume[size - cut] - volume[half]
    rest = volume[half] - volume[cut - 1]
    over = np.maximum(0, -(-(rest - (pairing * size - spare_of)) // size))
    return int(max(-(-volume[-1] // size), alone + over.max(initial=0)))


def bin_completion(counts: dict[int, int], size: int, nodes: int = NODES, width: int = WIDTH) -> list[Pattern]:
    """Patterns (lengths, number of sequences) that hold all pieces, in as few sequences as the search finds.

    Undominated completions around the largest piece left are tried in order of how often a branch left the first of
    them (limited discrepancies), so that early choices are revised as well as late ones; a branch goes when its
    sequences plus the lower bound of what is left reach the incumbent. Each node's best-fit solution is tried as an
    incumbent. Ends when the incumbent meets the lower bound, or after ``nodes`` nodes: then it is the best found, and
    at most its distance to ``lower_bound`` from the fewest. No piece is left out either way.
    """
    counts = {s: n for s, n in counts.items() if n}
    least, best = lower_bound(counts, size), best_fit(counts, size)
    best_n, spent, made_so_far = sum(n for _, n in best), 0, count()
    queue: list[tuple] = [(0, 0, next(made_so_far), counts, [], 0)]
    while queue and spent < nodes and best_n > least:
        off, depth, _, left, made, used = heappop(queue)
        spent += 1
        if not left:
            if used < best_n:
                best, best_n = made, used
            continue
        if used + lower_bound(left, size) >= best_n:
            continue
        if depth:
            rest = best_fit(left, size)
            if (n := used + sum(k for _, k in rest)) < best_n:
                best, best_n = made + rest, n
        for k, fill in enumerate(completions(left, size, width)):
            after = dict(left)
            pattern = _apply(fill, after)
            heappush(queue, (off + min(k, 1), depth - 1, next(made_so_far), after, [*made, pattern], used + pattern[1]))
    return best


# ---------------------------------------------------------------- placing


def pack(parts: DataFrame, size: int = 1024, nodes: int = NODES, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``parts`` (doc_id, piece, length, ...); lengths are at most ``size``.

    Pieces that fill a sequence have one each, without any ranking; its number is negative. The others are ranked within
    groups of about ``group`` rows of a length and shifted by the groups before, so no length, however common, is ranked
    in one task. Repeated rows are pieces of their own; an empty table gives an empty one; columns of any name pass
    through. Each sequence is gapless from offset 0.
    """
    p = own(parts)
    parts = written(parts, "pieces")
    whole, rest = parts.where(F.col("length") == size), parts.where(F.col("length") < size)
    whole = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    lengths = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # below ``size`` rows
    many = {length: -(-n // group) for length, n in lengths.items() if n > group}
    salt = F.lit(0)
    if many:
        groups = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in sorted(many.items()) for x in pair]), F.col("length").cast("long"))
        salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.coalesce(groups, F.lit(1))).cast("int")
    rest = rest.withColumn(f"{p}salt", salt)
    found = {(r["length"], r[f"{p}salt"]): r["count"] for r in rest.groupBy("length", f"{p}salt").count().collect()}  # one for each ``group`` rows and length
    counts: dict[int, int] = {}
    shift: list[tuple[int, int, int]] = []
    for (length, k), n in sorted(found.items()):
        shift.append((length, k, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    by_length: dict[int, list[tuple]] = {}
    sequence, taken = 0, dict.fromkeys(counts, 0)
    for fill, times in bin_completion(counts, size, nodes):
        at = 0
        for length in fill:
            by_length.setdefault(length, []).append((taken[length], sequence, at))
            taken[length] += times
            at += length
        sequence += times
    # Both tables have a bound: a row for each length and ``group`` pieces, and the pieces of at most one pattern per emptied length.
    spark = parts.sparkSession
    names = {x: f"{p}{x}" for x in ("salt", "r", "l", "s", "shift", "pl", "los", "firsts", "ats", "k")}
    shifts = F.broadcast(spark.createDataFrame(shift, f"{names['l']} int, {names['s']} int, {names['shift']} long"))
    places = [(length, [x[0] for x in q], [x[1] for x in q], [x[2] for x in q]) for length, q in sorted(by_length.items())]
    plan = F.broadcast(spark.createDataFrame(places, f"{names['pl']} int, {names['los']} array<long>, {names['firsts']} array<long>, {names['ats']} array<long>"))
    rank = F.row_number().over(Window.partitionBy("length", names["salt"]).orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rest.withColumn(names["r"], rank).join(shifts, (F.col("length") == F.col(names["l"])) & (F.col(names["salt"]) == F.col(names["s"])), "left")
    ranked = ranked.withColumn(names["r"], F.col(names["r"]) + F.col(names["shift"])).join(plan, F.col("length") == F.col(names["pl"]), "left")
    ranked = ranked.withColumn(names["k"], F.size(F.filter(names["los"], lambda x: x <= F.col(names["r"]))) - 1)
    sequence_id = F.get(names["firsts"], F.col(names["k"])) + F.col(names["r"]) - F.get(names["los"], F.col(names["k"]))
    ranked = ranked.withColumn("sequence_id", sequence_id).withColumn("offset", F.get(names["ats"], F.col(names["k"])))
    return ranked.drop(*names.values()).unionByName(whole)
