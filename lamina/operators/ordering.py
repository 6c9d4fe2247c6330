"""Global order without one-partition windows: range-partitioned rows, and what each range says to its neighbours."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import materialised, ranges


class Ordered:
    """Rows dealt into ranges of ``by``, and numbered in order (``_at``, from 0) as they are written; neighbours come from windows within ranges.

    Long inputs have more ranges, not longer ones. What leaves the executors is a count, a first and a last value for each
    range: as many rows as partitions.
    """

    def __init__(self, df: DataFrame, by: Sequence[Column | str]) -> None:
        by = [F.col(c) if isinstance(c, str) else c for c in by]
        dealt = df.repartitionByRange(*ranges(df), *by).sortWithinPartitions(*by)
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        self.by, self.rows = by, materialised(dealt.select("*", F.spark_partition_id().alias("_range"), at.alias("_at")), "ordered")
        self.window = Window.partitionBy("_range").orderBy("_at")
        self._stats: dict[str, list] = {}

    def _looked(self, expr: Column, key: str) -> list:
        if key not in self._stats:
            self._stats[key] = sorted(self.rows.groupBy("_range").agg(expr.alias("x")).where("x is not null").collect())
        return self._stats[key]

    def count(self) -> int:
        return sum(r["x"] for r in self._looked(F.count("*"), "count"))

    def _beside(self, rows: DataFrame, values: dict[int, object], kind: str, name: str) -> DataFrame:
        """``rows`` with what ``values`` say of their range; a table of as many rows as partitions, so it is broadcast."""
        table = rows.sparkSession.createDataFrame(sorted(values.items()), f"_of int, {name} {kind}")
        return rows.join(F.broadcast(table), F.col("_range") == F.col("_of"), "left").drop("_of")

    def ranked(self, name: str = "rank") -> DataFrame:
        """Rows numbered from 1 over all ranges."""
        before, offsets = 0, {}
        for r in self._looked(F.count("*"), "count"):
            offsets[r["_range"]] = before
            before += r["x"]
        rows = self._beside(self.rows, offsets, "long", "_before")
        return rows.withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_range", "_at", "_before")

    def neighbour(self, value: str, name: str, step: int) -> DataFrame:
        """``value`` of the next (``step`` 1) or previous (-1) row; null at the ends. Keeps other columns; ``by`` must ascend."""
        kind = self.rows.schema[value].dataType.simpleString()
        pick = F.min_by if step > 0 else F.max_by
        edges = {r["_range"]: r["x"] for r in self._looked(pick(value, F.struct(*self.by)), f"edge {value} {step}")}
        out, near = {}, None
        for r in self._looked(F.count("*"), "count")[:: -step]:  # from the far end, each range sees the nearest edge so far
            i = r["_range"]
            if near is not None:
                out[i] = near
            near = edges.get(i, near)
        beside = F.lead(value).over(self.window) if step > 0 else F.lag(value).over(self.window)
        rows = self._beside(self.rows.withColumn(name, beside), out, kind, "_edge")
        return rows.withColumn(name, F.coalesce(name, "_edge")).drop("_range", "_at", "_edge")


def lower_bounds(probes: DataFrame, keys: DataFrame, name: str = "found") -> DataFrame:
    """(probe, found): for each row of ``probes`` the smallest ``user_key`` of ``keys`` that is no smaller; null if there is none.

    Probes and keys share one range partitioning; a probe behind all keys of its range takes the first key of a later one.
    """
    both = probes.select(F.col("probe").alias("_k"), F.lit(0).alias("_side")).unionByName(keys.select(F.col("user_key").alias("_k"), F.lit(1).alias("_side")))
    dealt = Ordered(both, ["_k", "_side"])
    key = F.when(F.col("_side") == 1, F.col("_k"))
    firsts = dealt._looked(F.min(key), "first key")
    ranges = [r["_range"] for r in dealt._looked(F.count("*"), "count")]
    later = {i: firsts[j]["x"] for i in ranges if (j := bisect_right([r["_range"] for r in firsts], i)) < len(firsts)}
    ahead = Window.partitionBy("_range").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a frame that only grows is read once
    rows = dealt._beside(dealt.rows.withColumn(name, F.last(key, ignorenulls=True).over(ahead)).where("_side = 0"), later, "binary", "_later")
    return rows.select(F.col("_k").alias("probe"), F.coalesce(name, "_later").alias(name))
