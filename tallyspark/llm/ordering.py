"""Places and running sums along a hashed order, without one task per group.

A group may hold a third of all rows, so a window over the group alone would put that third
into one task.  Rows are ordered by a 60-bit hash of their own values.  The leading bits of the
hash cut each group into even slices; one small row per (group, slice) is summed into offsets,
and windows run per slice only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the values' texts (null: an empty text), as a BIGINT."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("bigint")


def slice_bits(rows: int, per_slice: int) -> int:
    """Leading bits that cut ``rows`` rows of one group into slices of about ``per_slice``."""
    return min(HASH_BITS - 1, max(0, (max(rows, 1) // per_slice).bit_length()))


def running(
    df: DataFrame, group: list[str], order: list[str], value: str, before: str, bits: int
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the earlier rows of the same ``group``.

    ``order[0]`` is a ``hash60`` column; the whole of ``order`` must be unique within a group.
    ``df`` is read twice and should be a staged table.
    """
    sliced = df.withColumn("_slice", F.shiftright(order[0], HASH_BITS - bits))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice").agg(F.sum(value).alias("_sum"))
        .select(*group, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(offsets, [*group, "_slice"])
        .withColumn(before, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .select(*df.columns, before)
    )
