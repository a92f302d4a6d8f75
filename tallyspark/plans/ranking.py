"""Numbering a large set of keys in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add the one-based rank of each row by ``order`` (which must be unique).

    Rows are range-partitioned and sorted, and each gets its partition and its place in it.
    That intermediate is staged, so the partition numbers are fixed before the per-partition
    counts (one row per partition) are summed into offsets.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("_id", _ROW_BITS).alias("_part"),
            F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
        )
    )
    placed = stage(placed, "rank")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_row") + F.col("_before") + 1).alias(name)
    )
