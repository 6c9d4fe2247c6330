"""Segments and their statistics, versions of the set of segments, and the order in which sources are asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.keys import entry_size

#: The first segment's number.
FIRST_NUMBER = 2


def segmented(ops: DataFrame, rows: int) -> DataFrame:
    """Adds ``file_number``: consecutive sequences, ``rows`` a segment."""
    return ops.withColumn("file_number", F.expr(f"(seq - 1) div {int(rows)}") + FIRST_NUMBER)


def segment_stats(segments: DataFrame) -> DataFrame:
    """(file_number, entries, tombstones, file_size, smallest_key, smallest_seq, largest_key, largest_seq) for each segment."""
    return segments.groupBy("file_number").agg(
        F.count("*").alias("entries"),
        F.sum((F.col("value_type") == 0).cast("long")).alias("tombstones"),
        F.sum(entry_size(F.col("user_key"), F.col("value"))).alias("file_size"),
        F.min("user_key").alias("smallest_key"),
        F.max("user_key").alias("largest_key"),
        F.min("seq").alias("smallest_seq"),
        F.max("seq").alias("largest_seq"),
    )


def zone_prune(stats: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, file_number): segments whose key range holds a probe.

    Probes are dealt into ranges; a segment goes to each range that its keys meet, and meets the probes of its range
    only. What the driver holds is the first and last probe of each range.
    """
    from .ordering import Ordered

    dealt = Ordered(probes.select("probe"), ["probe"])
    edges = dealt.rows.groupBy("_range").agg(F.hex(F.min("probe")).alias("lo"), F.hex(F.max("probe")).alias("hi")).where("lo is not null").orderBy("lo").collect()
    if not edges:
        return dealt.rows.select("probe", F.lit(None).cast("long").alias("file_number")).limit(0)
    ranges, lows, highs = (F.split(F.lit(",".join(str(r[c]) for r in edges)), ",") for c in ("_range", "lo", "hi"))
    first = F.size(F.filter(highs, lambda x: x < F.hex("smallest_key")))
    last = F.size(F.filter(lows, lambda x: x <= F.hex("largest_key"))) - 1
    placed = stats.select("file_number", "smallest_key", "largest_key", first.alias("_a"), last.alias("_b")).where("_a <= _b")
    placed = placed.withColumn("_at", F.explode(F.sequence("_a", "_b"))).withColumn("_range", F.get(ranges, F.col("_at")).cast("int"))
    met = dealt.rows.join(placed, "_range").where(F.col("probe").between(F.col("smallest_key"), F.col("largest_key")))
    return met.select("probe", "file_number")


def find_file(stats: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, file_number): in a level of disjoint segments, the first that ends at or after the probe, if it holds it."""
    from .ordering import lower_bounds

    ends = lower_bounds(probes, stats.select(F.col("largest_key").alias("user_key")), "end")
    met = ends.join(stats, F.col("end") == F.col("largest_key"), "left")
    return met.select("probe", F.when(F.col("smallest_key") <= F.col("probe"), F.col("file_number")).alias("file_number"))


def overlaps(stats: DataFrame) -> DataFrame:
    """Neighbouring segments, in order of (smallest_key, file_number), of which the later begins at or before the largest key so far."""
    order = Window.orderBy("smallest_key", "file_number").rowsBetween(Window.unboundedPreceding, -1)
    with_reach = stats.withColumn("reach", F.max("largest_key").over(order))
    return with_reach.where(F.col("reach") >= F.col("smallest_key")).select("file_number", "smallest_key", "reach")


def apply_edits(base: DataFrame, edits: DataFrame, by: Sequence[str] = ("level", "file_number")) -> DataFrame:
    """(level, file_number, ...) after ``edits`` (order, action, level, file_number, ...): the last edit of a file decides.

    An addition replaces the base's row of that number; deleting what isn't there changes nothing. ``by`` says what tells
    files apart, where numbers alone don't.
    """
    keep = [c for c in base.columns]
    last = edits.withColumn("_last", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("edit_no")))).where("_last = 1")
    stays = base.join(last.select(*by), list(by), "left_anti")
    return stays.select(keep).unionByName(last.where("action = 'add'").select(keep))


def precedence_get(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, value_type, value, level, file_number): the version that sources give when asked in order.

    Levels from 0 on, newer files first, newest version first within a file; the first that has the key ends the search.
    """
    met = sources.join(probes.select(F.col("probe").alias("user_key")).distinct(), "user_key", "left_semi")
    order = Window.partitionBy("user_key").orderBy("level", F.desc("file_number"), F.desc("seq"))
    return met.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(F.col("user_key").alias("probe"), "value_type", "value", "level", "file_number")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """All versions of all sources, none dropped; order by ``internal_order()`` for the merged run."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def shadowing(segments: DataFrame) -> DataFrame:
    """(file_number, entries, tombstones, shadowed): what a compaction of each segment alone could drop."""
    per_key = segments.groupBy("file_number", "user_key").agg(F.count("*").alias("n"), F.sum((F.col("value_type") == 0).cast("long")).alias("t"))
    return per_key.groupBy("file_number").agg(F.sum("n").alias("entries"), F.sum("t").alias("tombstones"), F.sum(F.col("n") - 1).alias("shadowed"))


def compacted(ops: DataFrame, oldest_snapshot: int | None = None, bottom: bool = True) -> DataFrame:
    """What a compaction keeps: versions that some snapshot from ``oldest_snapshot`` on may see; without it, the newest of each key.

    Deletions go as well where nothing lies below (``bottom``). This goes beyond the store's flushes.
    """
    if oldest_snapshot is None:
        from .resolve import latest

        kept = latest(ops)
        return kept.where("value_type = 1") if bottom else kept
    newest = ops.where(F.col("seq") <= oldest_snapshot).groupBy("user_key").agg(F.max(F.struct("seq", "value_type", "value")).alias("v")).select("user_key", "v.*")
    later = ops.where(F.col("seq") > oldest_snapshot).select("user_key", "seq", "value_type", "value")
    return (newest.where("value_type = 1") if bottom else newest).unionByName(later)
