"""Writes: sequence numbers, group commits, rotation of the memory table, and blocks of a table file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.keys import encoded_size, entry_size

from .ordering import Ordered

# Messages of a group, the memory table's limit, the least size of a closed block.
GROUP, MEMTABLE, BLOCK = 100, 100_000, 4_096


def sequenced(ops: DataFrame, by: Sequence[Column | str], last: int = 0) -> DataFrame:
    """Adds ``seq``: operations numbered on from ``last`` in order of ``by``, without a one-partition window."""
    return Ordered(ops, by).ranked("seq").withColumn("seq", F.col("seq") + last)


def group_commits(ops: DataFrame, group: int = GROUP) -> DataFrame:
    """(group_no, n_ops, first_seq, last_seq): groups of ``group`` one-operation messages; ``last_seq`` is what a group publishes."""
    number = F.expr(f"(seq - 1) div {int(group)}")
    return ops.groupBy(number.alias("group_no")).agg(F.count("*").alias("n_ops"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def restarts(sizes: np.ndarray, limit: int, strictly: bool, held: int = 0) -> np.ndarray:
    """For sizes in order, the number of the run each falls in; a run ends once its sum reaches (or exceeds) ``limit``. ``held`` is the sum of the first run so far."""
    ends, total = np.zeros(len(sizes), np.int64), np.cumsum(sizes)
    start, base, run = 0, -held, 0
    while start < len(sizes):
        stop = int(np.searchsorted(total, base + limit, side="right" if strictly else "left"))
        ends[start : stop + 1] = run
        if stop >= len(sizes):
            break
        start, base, run = stop + 1, int(total[stop]), run + 1
    return ends


def folded(sizes: np.ndarray, limit: int, strictly: bool, run: int, held: int) -> tuple[np.ndarray, int, int]:
    """``restarts`` of a part, and the run and its sum that the next part goes on with."""
    runs = restarts(sizes, limit, strictly, held) + run
    if len(sizes):
        last = int(runs[-1])
        held = int(sizes[runs == last].sum()) + (held if last == run else 0)
        run, held = (last + 1, 0) if held > limit or (held == limit and not strictly) else (last, held)
    return runs, run, held


def group_tables(ops: DataFrame, group: int = GROUP, limit: int = MEMTABLE) -> DataFrame:
    """(group_no, n_ops, bytes, first_seq, last_seq, table_no): each group of a log, and the memory table that it is in.

    The size is looked at once a group, before it is applied, so the group that exceeds the limit stays. The fold runs
    over one row a group, as one writer's order demands, batch by batch; many writers are many logs.
    """
    number = F.expr(f"(seq - 1) div {int(group)}")
    groups = ops.groupBy(number.alias("group_no")).agg(F.count("*").alias("n_ops"), F.sum(entry_size(F.col("user_key"), F.col("value"))).alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, held = 0, 0
        for rows in batches:
            tables, run, held = folded(rows["bytes"].to_numpy(), limit, True, run, held)
            yield rows.assign(table_no=tables)

    ordered = groups.coalesce(1).sortWithinPartitions("group_no")
    return ordered.mapInPandas(fold, "group_no long, n_ops long, bytes long, first_seq long, last_seq long, table_no long")


def rotated(ops: DataFrame, group: int = GROUP, limit: int = MEMTABLE) -> DataFrame:
    """(table_no, n_groups, n_ops, bytes, first_seq, last_seq): the memory tables that a log fills, one after another."""
    told = group_tables(ops, group, limit)
    return told.groupBy("table_no").agg(F.count("*").alias("n_groups"), F.sum("n_ops").alias("n_ops"), F.sum("bytes").alias("bytes"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def block_assigned(segments: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(file_number, entry_no, user_key, seq, size, block_no): entries of each segment in internal order, and their block.

    A block closes once the encoded sizes of its entries reach ``limit``. A segment is one task's, batch by batch.
    """
    sized = segments.select("file_number", "user_key", "seq", "value_type", encoded_size(F.col("user_key"), F.col("value")).alias("size"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, entry, run, held = None, 0, 0, 0
        for b in batches:
            for number, own in b.groupby("file_number", sort=False):
                if number != file:
                    file, entry, run, held = number, 0, 0, 0
                blocks, run, held = folded(own["size"].to_numpy(), limit, False, run, held)
                out = own.assign(entry_no=np.arange(entry + 1, entry + 1 + len(own)), block_no=blocks)
                entry += len(own)
                yield out[["file_number", "entry_no", "user_key", "seq", "size", "block_no"]]

    order = ["file_number", "user_key", F.desc("seq"), F.desc("value_type")]
    dealt = sized.repartition("file_number").sortWithinPartitions(*order)
    return dealt.mapInPandas(fold, "file_number long, entry_no long, user_key binary, seq long, size long, block_no long")


def log_fragments(payloads: DataFrame, size: Column, block: int = 32_768, header: int = 7) -> DataFrame:
    """Adds (frag_no, frag_type, frag_length, block_no): how a log of its own lays out each row's payload of ``size`` bytes.

    Closed arithmetic: a block holds ``block - header`` bytes of payload; an empty payload is one full fragment.
    """
    room = block - header
    n = F.greatest(F.ceil(size / room), F.lit(1)).cast("int")
    out = payloads.withColumn("_n", n).withColumn("_size", size).withColumn("frag_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    kind = F.when(F.col("_n") == 1, 1).when(F.col("frag_no") == 0, 2).when(F.col("frag_no") == F.col("_n") - 1, 4).otherwise(3)
    length = F.least(F.lit(room), F.col("_size") - F.col("frag_no") * room)
    return out.withColumn("frag_type", kind.cast("int")).withColumn("frag_length", length.cast("long")).withColumn("block_no", F.col("frag_no")).drop("_n", "_size")
