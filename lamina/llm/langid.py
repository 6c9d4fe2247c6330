"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds every substring of a bounded sample of its text. A text is parsed from left
to right into phrases, each the longest match in the sample; the language that needs the fewest phrases, normalised by
what a phrase costs (the logarithm of its sample's length), wins.

The parse needs no suffix links: it follows the automaton's transitions, and where there is none it counts a phrase and
goes on from the root. So all automata are one table of transitions, and segments of all texts of a batch step through
it together, for all languages at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own

#: Characters of sample per language; a bound on what training gathers, and on the tables.
SAMPLE = 40_000
#: Characters that one labelled text adds to its language's sample, so that no single text fills it.
PER_TEXT = 400
#: Cells of a dense table of transitions at most (4 bytes each); for more languages or letters the transitions are hashed.
CELLS = 1 << 25
#: Texts are parsed in segments of this length, all of them; a phrase ends at a segment's end.
SEGMENT = 1024


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", characters: int = SAMPLE, per_text: int = PER_TEXT) -> dict[str, str]:
    """For each language, pieces (``per_text`` characters, lower-cased) of the labelled texts that hash lowest, up to ``characters``.

    A piece is cut at a hashed place of the whole text, or at its first letter if that piece has none. Copies count
    once, before the rate of a language is set; a language whose draw ends below the bound is drawn anew at a higher
    rate, up to all its texts. Null labels and texts without letters play no part. What comes to the driver: a count
    and some 4 * characters for each language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text, F.lit(11)).alias("h"), F.col(text).cast("string").alias("t")).where(F.col("t").rlike(r"\p{L}"))
    size = F.least(F.length("t"), F.lit(per_text))
    sizes = rows.groupBy("lang", "h").agg(F.max(size).alias("size")).groupBy("lang").agg(F.sum("size").alias("size")).collect()
    rate = {r["lang"]: min(1.0, 4 * characters / r["size"]) for r in sizes}
    piece = F.substring("t", F.pmod(F.xxhash64("h"), F.length("t") - size + 1).cast("int") + 1, F.lit(per_text))
    piece = F.when(piece.rlike(r"\p{L}"), piece).otherwise(F.substring(F.regexp_extract("t", r"(?s)\p{L}.*", 0), 1, per_text))
    found: dict[str, str] = {}
    while rate:
        rates = F.create_map(*[F.lit(x) for r in sorted(rate.items()) for x in r])
        some = rows.where(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.try_element_at(rates, F.col("lang")))
        drawn: dict[str, list] = {}
        for r in some.select("lang", "h", F.lower(piece).alias("t")).groupBy("lang", "h").agg(F.min("t").alias("t")).collect():
            drawn.setdefault(r["lang"], []).append((r["h"] % (1 << 30), r["h"], r["t"]))
        full = {la for la, x in rate.items() if x >= 1 or sum(len(t) + 1 for *_, t in drawn.get(la, ())) > characters}
        found |= {la: _fill([t for *_, t in sorted(drawn[la])], characters) for la in full if la in drawn}
        rate = {la: min(1.0, 4 * x) for la, x in rate.items() if la not in full}
    return dict(sorted(found.items()))


def _fill(rows: list[str], characters: int) -> str:
    out, size = [], 0
    for t in rows:
        if size >= characters:
            break
        out.append(t)
        size += len(t) + 1
    return " ".join(out)[:characters]


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root, from which every substring can be followed."""
    go: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, p = len(go), last
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(go[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go


class _Hashed:
    """Numbers by key, both not negative, in open addressing; -1 for keys that it doesn't hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free, first = np.unique(slot[left], return_index=True)
            first = first[self.keys[free] < 0]
            taken = left[first]
            self.keys[slot[taken]], self.values[slot[taken]] = keys[taken], values[taken]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot, out, left = self._slot(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            left, slot = left[on], (slot[on] + 1) % len(self.keys)
        return out


class Parser:
    """Counts the phrases of texts over the automata of all languages at once. Every letter of the samples has a code."""

    def __init__(self, samples: tuple[tuple[str, str], ...], cells: int = CELLS) -> None:
        self.langs = [la for la, _ in samples]
        texts = ["".join(c if _lettered(c) else " " for c in t) for _, t in samples]
        #: Codes: 0 unseen letters, 1 whatever isn't a letter, then the samples' letters.
        self.code = {" ": 1} | {c: i + 2 for i, (c, _) in enumerate(Counter("".join(texts).replace(" ", "")).most_common())}
        self.lut = np.zeros(0x110000, np.int32)
        self.lut[:0x20000] = np.fromiter((0 if _lettered(chr(i)) else 1 for i in range(0x20000)), np.int32, 0x20000)
        for c, k in self.code.items():
            self.lut[ord(c)] = k
        self.width = len(self.code) + 1
        steps, self.roots, base = [], [], 0
        fresh = np.empty((len(texts), self.width), np.int32)
        for n, t in enumerate(texts):
            go = automaton(t)
            at = np.array([(i + base) * self.width + self.code[c] for i, own in enumerate(go) for c in own], np.int64)
            to = np.array([x + base << 2 for own in go for x in own.values()], np.int32)
            fresh[n] = (base << 2) | 2  # a phrase ends; an unseen letter is one more
            root = at < (base + 1) * self.width
            fresh[n, at[root] - base * self.width] = to[root] | 1
            lost = np.flatnonzero(fresh[n] & 2)  # at the root no phrase ends
            steps += [(at, to), (base * self.width + lost, np.full(len(lost), (base << 2) | 1, np.int32))]
            self.roots.append(base)
            base += len(go)
        at, to = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int64, np.int32), zip(*steps, strict=True), strict=True)) if steps else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.fresh, self.table, self.hashed = fresh, None, None
        if base * self.width <= cells:
            self.table = np.repeat(fresh, np.diff([*self.roots, base]), axis=0).ravel() if texts else np.zeros(0, np.int32)
            self.table[at] = to
        else:
            self.hashed = _Hashed(at, to)
        self.cost = np.array([np.log2(len(t) + 2) for t in texts])

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """For each language (row) and text the next state times 4 plus the phrases that end."""
        at = state * self.width + code
        if self.table is not None:
            return self.table[at]
        found = self.hashed.get(at.ravel()).reshape(at.shape)
        return np.where(found >= 0, found, self.fresh[:, code])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(languages, texts)."""
        flat = self.lut[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        first = np.cumsum(size) - size
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, length = first[owner] + nth * SEGMENT, np.minimum(SEGMENT, size[owner] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        at, length, owner = at[order], length[order], owner[order]
        roots = np.array(self.roots, np.int64)[:, None]
        state, count = np.repeat(roots, len(at), axis=1), np.zeros((len(self.roots), len(at)), np.int64)
        active = len(length) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")
        for t, n in enumerate(active.tolist()):
            v = self._step(state[:, :n], flat[at[:n] + t])
            count[:, :n] += v & 3
            state[:, :n] = v >> 2
        count += state != roots
        out = np.zeros((len(self.roots), len(texts)), np.int64)
        for k in range(len(out)):
            out[k] = np.bincount(owner, count[k], len(texts))
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """For each text the language that needs the fewest normalised phrases (first in order on ties), and how far the others are behind."""
        lang, score, some, size = ["und"] * len(texts), [0.0] * len(texts), [], 0
        for i, x in enumerate(texts):
            if x and self.langs and has_letter(x):
                some.append(i)
                size += len(x)
            if some and (size > 1 << 22 or i == len(texts) - 1):
                bits = self.phrases([texts[k].lower() for k in some]) * self.cost[:, None]
                best = bits.argmin(axis=0)
                lead = 1 / np.exp2((bits.min(axis=0) - bits) / self.cost.max()).sum(axis=0)
                for k, b, s in zip(some, best.tolist(), lead.tolist(), strict=True):
                    lang[k], score[k] = self.langs[b], s
                some, size = [], 0
        return lang, score


_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether some character is of a letter category; ``\\w`` alone would take numerals such as one half for letters."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def _lettered(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def predict(text: Column, samples: dict[str, str]) -> Column:
    """A struct (lang, score): the language of each whole text, ``und`` with score 0 if it is null or has no letter.

    Only the text is looked at. Repeated texts get equal answers; without any sample every text is ``und``; an empty
    table gives an empty column; columns beside the text play no part. The score
    is 1 over the sum of 2 to the power of minus each language's lag in phrases: 1 if all others are far behind.
    """
    fixed = tuple(sorted(samples.items()))

    @F.pandas_udf("lang string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = _parser(fixed)
        for texts in batches:
            lang, score = parser.judge([None if x is None else str(x) for x in texts.tolist()])
            yield pd.DataFrame({"lang": lang, "score": score})

    return judged(text.cast("string"))


def known(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` without the documents that language ID rejects: null texts and texts without a letter. Columns stay as they are."""
    lang = f"{own(docs)}lang"
    found = docs.withColumn(lang, predict(F.col(text), samples))
    return found.where(F.col(lang)["lang"] != "und").select(docs.columns)
