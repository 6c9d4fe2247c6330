"""Mixing sources to target weights by pivotal dependent rounding.

A document's share of its source's target is a number of copies; the whole part is taken, and the fractional part is
rounded dependently: two documents with fractional parts p, q meet, and words (not mere probability) move from one to
the other, at random in the way that keeps both expectations, until one of them is whole. The other goes on. So each
meeting keeps the source's words, every expectation stays, and what is left of a group is one document.
Groups are leaves of bounded expected size within a source; what is left of them meets in groups of the next level,
up to one document a source. That one is drawn by its own fraction, and smaller documents of its group flip to make up
for the words that its draw gains or loses, so each source's words end within about one small document of its target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ordering import Ordered

from .common import own, runs, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one group rounds, on average; also how many groups feed one of the next level.
FAN = 512


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, limit: float = 3.0, total: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight), one row a source.

    Targets share ``total`` times all sizes by weight; none exceeds ``limit`` times its source's size, and what is cut
    off is shared anew by weight until none does. Each round is one aggregate over the sources, however many they are:
    the level (a target is level * weight) rises until no further source is cut. Needs ``total <= limit``.
    """
    cap, weight = F.col("source_size") * F.lit(float(limit)), F.col("weight").cast("double")
    level, cut = 0.0, -1
    while True:
        over = (F.lit(level) * weight > cap) if cut >= 0 else F.lit(False)
        r = sizes.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("given"), F.sum(F.when(~over, weight)).alias("open"), F.sum(over.cast("long")).alias("cut")).first()
        if (r["cut"] or 0) == cut or not r["open"]:
            break
        level, cut = ((r["all"] or 0) * total - (r["given"] or 0.0)) / r["open"], r["cut"] or 0
    return sizes.select("source", "source_size", F.least(cap, F.lit(level) * weight).alias("target"))


def by_rank(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds ``weight``: 1, 2, ..., ``cycle``, repeating, by source in code point order with null last; ranks come from ranges, not from one partition."""
    ranked = Ordered(sizes, [F.col("source").asc_nulls_last()]).ranked("weight")
    return ranked.withColumn("weight", (F.pmod(F.col("weight") - 1, F.lit(cycle)) + 1).cast("double"))


def _chance(group: tuple[int, ...], n: int) -> np.ndarray:
    seed = hashlib.blake2b(repr(group).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(seed, "little"))).random(n)


def pivotal(share: list[float], size: list[float], chance: list[float]) -> int:
    """Round ``share`` (each in (0, 1)) in place, keeping the sum of share * size; gives the place of the one left, or -1.

    At each meeting of a and b either a gains up = min(1 - a, b * size_b / size_a) or b gains the counterpart, with the
    chances that leave both expectations as they are.
    """
    held = -1
    for k in range(len(share)):
        if held < 0:
            held = k
            continue
        a, b, wa, wb = share[held], share[k], size[held], size[k]
        up, down = min(1 - a, b * wb / wa), min(a, (1 - b) * wb / wa)
        if chance[k] * (up + down) < down:
            a_full, b_empty = 1 - a <= b * wb / wa, b * wb / wa <= 1 - a
            a, b = (1.0 if a_full else a + up), (0.0 if b_empty else b - up * wa / wb)
        else:
            a_empty, b_full = a <= (1 - b) * wb / wa, (1 - b) * wb / wa <= a
            a, b = (0.0 if a_empty else a - down), (1.0 if b_full else b + down * wa / wb)
        share[held], share[k] = a, b
        if a in (0.0, 1.0):
            held = k if b not in (0.0, 1.0) else -1
    return held


_ROW = "doc_id long, key long, size long, source_id long, node long, rows long, whole long, taken long, share double"


def draw_last(share: list[float], size: list[float], held: int, chance: float) -> None:
    """Draw the one left, and flip smaller documents, largest first, to make up for the words that the draw adds or takes.

    It is drawn by its own fraction, unless flips after the other draw end nearer to the target.
    """
    ends = []
    for up in sorted((True, False), key=lambda up: up != (chance < share[held])):
        off, flips = (up - share[held]) * size[held], []
        for k in range(len(share)):  # sizes descend
            if k != held and share[k] == float(off > 0) and size[k] <= abs(off):
                off -= size[k] if off > 0 else -size[k]
                flips.append(k)
        ends.append((abs(off), up, flips))
    _, up, flips = min(ends, key=lambda e: e[0])
    share[held] = float(up)
    for k in flips:
        share[k] = 1.0 - share[k]


def _level(last: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, ["source_id", "node"]):
            share, size = t.column("share").to_numpy().copy(), t.column("size").to_numpy().astype(float)
            source, node = t.column("source_id").to_numpy(), t.column("node").to_numpy()
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part, words_of = share[i:j].tolist(), size[i:j].tolist()
                chance = _chance((int(source[i]), int(node[i]), j - i), j - i).tolist()
                held = pivotal(part, words_of, chance)
                if last and held >= 0:
                    draw_last(part, words_of, held, chance[0])
                share[i:j] = part
            yield t.set_column(t.schema.get_field_index("share"), "share", pa.array(share)).to_batches()[0]

    return work


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A written table with ``name``: its rows numbered from 1 within ``keys``, however many a key has.

    A task numbers a key's rows of one part of the table; the parts' counts, added up, shift them.
    """
    p = own(rows)
    part, at, before = f"{p}part", f"{p}at", f"{p}before"
    rows = rows.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id())
    counts = rows.groupBy(*keys, part).agg(F.count("*").alias(before))
    shift = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(shift), F.lit(0)))
    counts = counts.select(*[F.col(k).alias(f"{p}_{i}") for i, k in enumerate(keys)], F.col(part).alias(f"{p}_part"), before)
    same = F.col(part) == F.col(f"{p}_part")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"{p}_{i}"))
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, part).orderBy(at))).join(counts, same)
    return rows.withColumn(name, F.col(name) + F.col(before)).drop(at, part, before, f"{p}_part", *[f"{p}_{i}" for i in range(len(keys))])


def rounded(rows: DataFrame, weights: DataFrame | None = None, limit: float = 3.0, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, rows, whole, up, source_size, target): one row for each distinct (doc_id, source, size) of the written table ``rows``.

    ``rows`` is how many rows it stands for: ``up`` of them are taken ``whole`` + 1 times, the others ``whole`` times.
    Rows that repeat are one unit before any group is formed: what their fractions make up whole is taken at once, and
    only one fraction goes on, so no key is hot in a group.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = written(sizes, "sources")
    weighed = by_rank(sizes) if weights is None else sizes.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").fillna(0.0, ["weight"])
    plan = targets(weighed.select("source", "source_size", "weight"), limit)
    units = written(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "units")
    widths = units.where("size > 0").groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "_n")
    plan = plan.join(widths, F.col("source").eqNullSafe(F.col("_n")), "left").drop("_n").fillna(0, ["n"])
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0))
    plan = written(plan.withColumn("source_id", F.xxhash64("source", F.col("source").isNull())), "targets")
    per = units.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    leaves = F.greatest(F.ceil(F.col("n") / fan), F.lit(1))
    per = per.withColumn("key", F.xxhash64("doc_id", "size"))
    per = per.withColumn("node", F.pmod("key", leaves)).withColumn("whole", F.floor("ratio").cast("long"))
    due = F.when(F.col("size") > 0, (F.col("ratio") - F.col("whole")) * F.col("rows")).otherwise(0.0)
    per = per.withColumn("share", due).withColumn("taken", F.floor("share").cast("long")).withColumn("share", F.col("share") - F.col("taken"))
    cols = [x.split()[0] for x in _ROW.split(", ")]
    done, going, depth = [], per.where("share > 0").select(cols), 1
    widest = plan.agg(F.max("n")).first()[0] or 0
    while True:
        last = -(-widest // fan**depth) <= 1
        going = going.repartition("source_id", "node").sortWithinPartitions("source_id", "node", F.col("size").desc(), "key", "doc_id", "share")
        level = written(going.mapInArrow(_level(last), _ROW), "level")
        if last:
            done.append(level)
            break
        done.append(level.where("share = 0 or share = 1"))
        going = level.where("share > 0 and share < 1").withColumn("node", F.floor(F.col("node") / fan).cast("long"))
        depth += 1
    out = per.where("share = 0").select(cols)
    for x in done:
        out = out.unionByName(x.select(cols))
    named = plan.select(F.col("source_id").alias("_id"), "source", "source_size", "target")
    out = out.join(named, F.col("source_id") == F.col("_id"))
    whole = F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "source", "size", "rows", whole.alias("whole"), (F.col("taken") + F.col("share").cast("long")).alias("up"), "source_size", "target")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size")), "sizes")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None, limit: float = 3.0, fan: int = FAN) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): one row for each row of ``docs``.

    ``weights`` has (source, weight); without it, sources weigh 1, 2, 3, repeating, in code point order, null last.
    Null is a source like others. Null or blank texts have size 0 and are taken zero times; an empty table gives an
    empty result. Rows that repeat doc_id, source and size are rounded together, and what they are taken is dealt out
    to them one by one. The outcome is a function of the rows alone, not of their partitions or order: groups, order
    within groups and chances derive from hashes. Other columns play no part.
    """
    rows = _sized(docs, doc_id, text, source)
    found = written(rounded(rows, weights, limit, fan), "rounded")
    keys = ["doc_id", "source", "size"]
    alone = found.where("rows = 1").withColumn("copies", F.col("whole") + F.col("up"))
    cols = ["doc_id", "size", "source", "source_size", "target", "copies"]
    out = alone.select(cols)
    several = found.where("rows > 1")
    if not several.isEmpty():
        names = [F.col(k).alias(f"_{k}") for k in keys]
        met = F.lit(True)
        for k in keys:
            met &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = written(rows.join(several.select(names), met, "left_semi"), "repeated")
        dealt = numbered(same, keys, "nth").join(several.select(*names, "whole", "up", "source_size", "target"), met)
        out = out.unionByName(dealt.withColumn("copies", F.col("whole") + (F.col("nth") <= F.col("up")).cast("long")).select(cols))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None, limit: float = 3.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; columns stay as they are.

    Rows that share doc_id, source and size share what is taken of them. Rows without doc_id or source are treated
    alike. Texts without words go; an empty table gives an empty one.
    """
    p = own(docs)
    found = rounded(_sized(docs, doc_id, text, source), weights, limit)
    found = found.where("whole + up > 0").select(*[F.col(k).alias(f"{p}{k}") for k in ("doc_id", "source", "size", "rows", "whole", "up")])
    found = written(found, "taken")
    sized = docs.withColumn(f"{p}n", words(F.col(text)))

    def meets() -> Column:
        return F.col(doc_id).cast("long").eqNullSafe(F.col(f"{p}doc_id")) & F.col(source).cast("string").eqNullSafe(F.col(f"{p}source")) & (F.col(f"{p}n") == F.col(f"{p}size"))

    # Texts move once: only rows that repeat need to be numbered before they meet what is taken of them.
    alone, several = found.where(F.col(f"{p}rows") == 1), found.where(F.col(f"{p}rows") > 1)
    met = sized.join(alone.hint("merge"), meets())  # what is taken grows with the documents: never broadcast
    met = met.withColumn(f"{p}copies", F.col(f"{p}whole") + F.col(f"{p}up"))
    if not several.isEmpty():
        same = written(sized.join(several, meets(), "left_semi"), "repeated")
        dealt = numbered(same, [doc_id, source, f"{p}n"], f"{p}nth").join(several, meets())
        copies = F.col(f"{p}whole") + (F.col(f"{p}nth") <= F.col(f"{p}up")).cast("long")
        met = met.unionByName(dealt.withColumn(f"{p}copies", copies).drop(f"{p}nth"))
    times = F.expr(f"explode(sequence(1, cast({p}copies as int)))")
    return met.where(F.col(f"{p}copies") > 0).select(*docs.columns, times.alias(f"{p}i")).select(docs.columns)
