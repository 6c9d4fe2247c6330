"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs fall into ``BUCKETS`` buckets by hash. The target model is the distribution over buckets of texts
labelled good, the raw model that of all texts. Both are generative: a text's likelihood is the product over its
n-grams, so the logarithm of its importance is the sum of their log ratios. Adding Gumbel noise to it and taking the k
largest draws k texts without replacement in proportion to their importance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 10_000
#: Labelled good texts that train the target model, about; the raw model counts every text.
TARGET = 20_000
#: What the sampling draws of all texts: at sf0.1 0.6 % of the texts labelled bad and 95 % of those labelled good.
KEEP = 0.8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def ngrams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of all words and pairs of neighbouring words: ASCII letters lower-cased, words cut at ASCII white space."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[flat]
    ends = np.flatnonzero(space & ~np.concatenate(([True], space[:-1])))
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Polynomial hash of each word, modulo 2**64, by Horner's rule over columns of words that are long enough.
    h = np.full(len(begins), np.uint64(1469598103934665603))
    size, order = ends - begins, np.argsort(begins - ends, kind="stable")
    at, long = begins[order], size[order]
    counts = len(long) - np.searchsorted(long[::-1], np.arange(int(long[0])), side="right")
    own = h[order]
    for k, n in enumerate(counts.tolist()):
        own[:n] = (own[:n] ^ _FOLD[flat[at[:n] + k]]) * np.uint64(1099511628211)
    h[order] = own
    stops = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(stops, begins, side="right")
    same = owner[1:] == owner[:-1]
    pair = (h[:-1] * _A + h[1:])[same]
    every = np.concatenate((h, pair))
    every = (every ^ (every >> np.uint64(31))) * _B
    return np.concatenate((owner, owner[:-1][same])), ((every >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _batched(texts: list[bytes | None], most: int = 1 << 23) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or b"")
        if size > most or i == len(texts) - 1:
            yield at, [t or b"" for t in texts[at : i + 1]]
            at, size = i + 1, 0


def train(docs: DataFrame, good: list[int], doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw for each bucket, counted over all of ``docs`` in one pass; ``good`` names the target's doc_ids, a bounded list."""
    wanted = np.array(sorted(good), np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for b in batches:
            named = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            target = named & np.isin(b.column(0).fill_null(0).to_numpy(), wanted)
            for at, texts in _batched(b.column(1).to_pylist()):
                owner, bucket = ngrams(texts, buckets)
                counts[0] += np.bincount(bucket, minlength=buckets)
                counts[1] += np.bincount(bucket[target[at + owner]], minlength=buckets)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(work, "bucket long, raw long, target long")
    found = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # a row a bucket
    counts = np.full((2, buckets), smooth)
    for r in found:
        counts[:, r["bucket"]] += r["raw"], r["target"]
    share = np.log(counts / counts.sum(axis=1, keepdims=True))
    return share[1] - share[0]


def importance(docs: DataFrame, model: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_ratio): the sum of log ratios over a text's n-grams; 0 for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for at, texts in _batched(b.column(1).to_pylist()):
                owner, bucket = ngrams(texts, len(model))
                n[at : at + len(texts)] = np.bincount(owner, minlength=len(texts))
                total[at : at + len(texts)] = np.bincount(owner, model[bucket], len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total)], ["doc_id", "n_grams", "log_ratio"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(work, "doc_id long, n_grams long, log_ratio double")


def gumbel(key: Column) -> Column:
    """Gumbel noise as a function of a hash."""
    u = (F.pmod(key, F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """``rows`` (a written table) with ``selected``: whether a row is among the k largest by (``by``, ``tie``).

    Radix search: histograms of ever finer slices of the key, at most 4096 counts each, close in on the k-th largest;
    no sort, and nothing grows on the driver. Rows equal in both columns are all in or all out.
    """
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    if lo is None or k <= 0:
        return rows.withColumn("selected", F.lit(False))

    def settle(column: str, lo: float, hi: float, above: int, among: DataFrame) -> tuple[float, float, int]:
        """A slice [lo, hi] of the column that holds the k-th largest, and how many rows lie above it."""
        for _ in range(6):
            if hi <= lo:
                break
            width = (hi - lo) / 4096 or math.ulp(hi)
            slot = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(4095)).cast("int")
            counts = among.where((F.col(column) >= lo) & (F.col(column) <= hi)).groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
            for r in sorted(counts, key=lambda r: -r["s"]):
                if above + r["n"] >= k:
                    lo, hi = r["lo"], r["hi"]
                    break
                above += r["n"]
            else:
                return -math.inf, -math.inf, above
        return lo, hi, above

    edge, top, above = settle(by, float(lo), float(hi), 0, rows)
    if edge == -math.inf:
        return rows.withColumn("selected", F.lit(True))
    ties = rows.where((F.col(by) >= edge) & (F.col(by) <= top))
    t = ties.agg(F.min(tie), F.max(tie)).first()
    low, _, _ = settle(tie, t[0], t[1], above, ties)
    return rows.withColumn("selected", (F.col(by) > top) | ((F.col(by) >= edge) & (F.col(tie) >= low)))


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP, target: int = TARGET, by_length: bool = False) -> DataFrame:
    """(doc_id, n_grams, log_ratio, gumbel_key, selected): one row for each row of ``docs``; ``selected`` marks the drawn ones.

    ``labels`` has (doc_id, quality); the target model takes about ``target`` documents of quality 1, those that hash
    lowest. Labels that are null count for nothing; without any good label the draw follows lengths alone. Null and
    blank texts have ratio 0. k is ``keep`` of the rows, rounded up. ``by_length`` draws by the mean log ratio instead
    of the sum. Noise derives from doc_id and n-gram statistics, so reruns agree; repeated rows are in or out together.
    An empty table gives an empty result; other columns play no part.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("d")).distinct()
    n = good.count()
    some = good.where(F.pmod(F.xxhash64("d"), F.lit(1 << 30)) < int(min(1.0, target / max(n, 1)) * (1 << 30))).collect()
    model = train(docs, [r["d"] for r in some], doc_id, text)
    rows = importance(docs, model, doc_id, text)
    weight = F.col("log_ratio") / F.greatest("n_grams", F.lit(1)) if by_length else F.col("log_ratio")
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "n_grams", F.lit(17))).withColumn("gumbel_key", weight + gumbel(F.col("tie")))
    rows = written(rows, "importance")
    return top_k(rows, "gumbel_key", "tie", math.ceil(rows.count() * keep)).drop("tie")
