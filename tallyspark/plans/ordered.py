"""Ordered per-key computations that survive a key holding a large part of all rows.

A window partitioned by session puts a whole session into one task.  Here a key with more
than ``hot_rows`` rows is cut into chunks of about that many rows along its order column;
each chunk is windowed on its own, one summary row per chunk is windowed per key, and the
result is carried back to the chunk.  Ordinary keys keep chunk 0 and need one shuffle.

Whether any key is that large is counted first, from the key columns alone.  Where none is, which
is the rule, the plan is the plain window: one shuffle, one sort, no join.  Pass a staged or stored
table, of which that count reads nothing but the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
CHUNK = "_chunk"
#: Approximate quantiles of a hot key's order values, from which its chunk bounds are taken.
QUANTILES = 1000


def tag_chunks(df: DataFrame, keys: Sequence[str], order: str,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_hot`` and ``_chunk``.  Keys must not be NULL; ``order`` is a unique BIGINT."""
    # Chunks hold about equal numbers of rows, however the order values lie.
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    ranks = [i / QUANTILES for i in range(1, QUANTILES)]
    step = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES) * F.lit(hot_rows) / F.col("_n"))).cast("int")
    hot = (
        df.select(*keys, order).join(large, list(keys))
        .groupBy(*keys).agg(F.first("_n").alias("_n"), F.percentile_approx(order, ranks, 10 * QUANTILES).alias("_q"))
        .select(*keys, F.filter("_q", lambda _, i: (i + 1) % step == 0).alias("_bounds"), F.lit(True).alias("_hot"))
    )
    chunk = F.size(F.filter("_bounds", lambda b: b < F.col(order))).cast("bigint")
    return (
        df.join(hot, list(keys), "left")
        .withColumn(CHUNK, F.when(F.col("_hot"), chunk).otherwise(F.lit(0).cast("bigint")))
        .withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False)))
        .drop("_bounds")
    )


def has_hot_key(df: DataFrame, keys: Sequence[str], hot_rows: int) -> bool:
    """Whether a key has more than ``hot_rows`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.filter(F.col("_n") > hot_rows).limit(1).isEmpty()


def in_chunk(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(order)


def across_chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK)


def with_previous(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column],
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add, per name, the latest earlier non-NULL value of its expression within the key."""
    names = list(values)
    if not has_hot_key(df, keys, hot_rows):
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"_v_{n}": e for n, e in values.items()}).select(
            *[F.col(c) for c in df.columns],
            *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(n) for n in names],
        )
    tagged = tag_chunks(
        df.withColumns({f"_v_{n}": e for n, e in values.items()}), keys, order, hot_rows
    )
    before = in_chunk(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumns(
        {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in names}
    )
    edges = (
        tagged.filter("_hot")
        .groupBy(*keys, CHUNK)
        .agg(
            *[
                F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(
                    f"_e_{n}"
                )
                for n in names
            ]
        )
    )
    earlier = across_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys, CHUNK,
        *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in names],
    )
    joined = local.join(carried, [*keys, CHUNK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in names],
    )


def with_position(df: DataFrame, keys: Sequence[str], order: str, name: str = "pos",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the zero-based position of each row within its key."""
    if not has_hot_key(df, keys, hot_rows):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint")
        return df.withColumn(name, place - 1)
    tagged = tag_chunks(df, keys, order, hot_rows)
    local = tagged.withColumn("_rn", F.row_number().over(in_chunk(keys, order)).cast("bigint"))
    counts = tagged.filter("_hot").groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    earlier = across_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, CHUNK, F.sum("_n").over(earlier).alias("_offset"))
    return local.join(offsets, [*keys, CHUNK], "left").select(
        *[F.col(c) for c in df.columns],
        (F.col("_rn") - 1 + F.coalesce(F.col("_offset"), F.lit(0))).alias(name),
    )
