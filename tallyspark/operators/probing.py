"""Which cache categories a backend shows, inferred from repeated identical calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.usage import parse_usage

_WHERE = {
    "cached_tokens": ("prompt_tokens_details", "cached_tokens"),
    "cache_creation_tokens": ("prompt_tokens_details", "cache_creation_tokens"),
    "reasoning_tokens": ("completion_tokens_details", "reasoning_tokens"),
}


def infer_cache_schema(probe_calls: DataFrame) -> DataFrame:
    """``backend, attempt, usage`` -> one row per (backend, category).

    A category surfaces if and only if a call after the first returned it: only then can an
    identical prompt hit the cache.
    """
    tokens = parse_usage(F.col("usage"))
    later = F.col("attempt") >= 2
    typed = probe_calls.select("backend", "attempt", tokens.alias("_t"))
    seen = typed.groupBy("backend").agg(
        *[
            F.coalesce(F.bool_or(later & F.col("_t")[group][name].isNotNull()), F.lit(False)).alias(c)
            for c, (group, name) in _WHERE.items()
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"), F.col(c).alias("surfaces"),
                F.when(F.col(c), F.array(*[F.lit(p) for p in path])).alias("path"),
            )
            for c, path in _WHERE.items()
        ]
    )
    return seen.select("backend", F.explode(entries).alias("e")).select("backend", "e.*")
