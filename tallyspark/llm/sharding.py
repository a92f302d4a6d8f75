"""Shards by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a uniform number from the hash of (key, shard) and scores
``ln(u) / weight``; the highest score wins, the lower shard number on a tie.  A shard's score
does not depend on the other shards, so a new shard takes rows only into itself, and a weight
change moves rows only into or out of that shard.

Nulls: a null key counts as the key ``null``; a null text has no bytes.  Rows with equal keys
go to one shard.  Repeated rows keep their number and get slots of their own.  An empty table
gives an empty result.  Columns of the input stay; one that has the name of an added column is
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .ordering import hash60, running, slice_bits

#: Rows of one shard that a window sorts at a time.
ROWS_PER_SLICE = 50_000


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """``ln(u) / weight`` with u in (0, 1) from 52 bits of MD5(key # shard)."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"#{shard}"))
    draw = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return F.log((draw + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the winning shard; a shard of weight 0 or less gets nothing."""
    scores = [
        F.struct(shard_score(key, i, w).alias("score"), F.lit(-i).alias("rank"))
        for i, w in enumerate(weights) if w > 0
    ]
    if not scores:
        raise ValueError("no shard has a positive weight")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["rank"]).cast("int")


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None
) -> DataFrame:
    """Add ``shard``, and with ``grown`` weights also ``grown_shard``: a projection, no shuffle."""
    added = {"shard": rendezvous(df[key], weights)}
    if grown is not None:
        added["grown_shard"] = rendezvous(df[key], grown)
    return df.withColumns(added)


def number_slots(df: DataFrame, shard: str = "shard") -> DataFrame:
    """Add ``slot``: gapless places from 0 within each shard, in a hashed order of the rows.

    Equal rows are counted once and numbered as a run, so a row repeated any number of times
    is no hot key.  Select narrow columns first; all columns travel.
    """
    names = [c for c in df.columns if c.lower() != "slot"]
    rows = stage(
        df.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_order", hash60(*[F.col(n) for n in names])),
        "slots",
    )
    bits = slice_bits(rows.count(), ROWS_PER_SLICE)
    placed = running(rows, [shard], ["_order", *names], "_copies", "_before", bits)
    return placed.select(
        *names, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("_i"), "_before"
    ).select(*names, (F.col("_before") + F.col("_i")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(documents["text"], F.lit(""))
    sized = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = assign_shards(sized, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    return number_slots(placed).withColumn("law", F.lit("key"))
