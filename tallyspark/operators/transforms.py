"""Context transforms over message tables: write-time caps and retroactive masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as m


def _with_text(table: DataFrame) -> DataFrame:
    return table.withColumn("_text", m.flatten(F.col("blocks")))


def _is_observation():
    return m.is_tool_observation(F.col("role"), F.col("blocks"), F.col("content_is_string"))


def admission_cap(table: DataFrame, cap_mode: str = "tokens", cap_tokens: int = m.CAP_TOKENS,
                  cap_lines: int | str = m.CAP_LINES) -> DataFrame:
    """Cap each tool observation once; add ``capped``.  Row-local and idempotent."""
    if cap_mode.lower() == "unlimited" or (cap_mode == "lines" and str(cap_lines).lower() == "unlimited"):
        return table.withColumn("capped", F.lit(False))
    text = F.col("_text")
    if cap_mode == "lines":
        cut, over = m.cap_by_lines(text, int(cap_lines)), F.size(F.split(text, "\n", -1)) > int(cap_lines)
    else:
        cut, over = m.cap_by_tokens(text, cap_tokens), F.length(text) > cap_tokens * m.CHARS_PER_TOKEN
    marked = _with_text(table).withColumn(
        "capped", _is_observation() & ~m.already_capped(text) & over
    )
    return marked.withColumn(
        "blocks", F.when(F.col("capped"), m.set_text(F.col("blocks"), cut)).otherwise(F.col("blocks"))
    ).drop("_text")


def admission_stats(capped: DataFrame) -> DataFrame:
    return capped.groupBy("conv_id").agg(F.count_if("capped").alias("obs_capped"))


def masking_plan(table: DataFrame, threshold_tokens: int = m.THRESHOLD_TOKENS,
                 min_obs_tokens: int = m.MIN_OBS_TOKENS) -> DataFrame:
    """Per conversation: estimated tokens and the position to elide (NULL for none).

    A plain aggregate: only lengths and positions are shuffled, combined before they are.
    """
    text = F.col("_text")
    tokens = m.token_estimate(text)
    eligible = (
        _is_observation()
        & (F.btrim(text, F.lit(" \t\n\r\x0b\x0c")) != m.STUB)
        & (tokens >= min_obs_tokens)
    )
    sized = _with_text(table).select(
        "conv_id", tokens.alias("_tokens"), F.when(eligible, F.col("pos")).alias("_pos")
    )
    total = F.sum("_tokens")
    return sized.groupBy("conv_id").agg(
        total.alias("total_tokens_est"),
        F.lit(threshold_tokens).alias("threshold"),
        F.when(total > threshold_tokens, F.min("_pos")).alias("elided_index"),
    )


def masking(table: DataFrame, threshold_tokens: int = m.THRESHOLD_TOKENS,
            min_obs_tokens: int = m.MIN_OBS_TOKENS) -> DataFrame:
    """Elide the first large observation of each conversation above the threshold; add
    ``elided``.  The join key (conversation, position) is unique, so no conversation is hot."""
    plan = masking_plan(table, threshold_tokens, min_obs_tokens)
    stubs = plan.filter(F.col("elided_index").isNotNull()).select(
        "conv_id", F.col("elided_index").alias("pos"), F.lit(True).alias("_elide")
    )
    joined = table.join(stubs, ["conv_id", "pos"], "left").withColumn(
        "elided", F.coalesce("_elide", F.lit(False))
    )
    return joined.withColumn(
        "blocks",
        F.when(F.col("elided"), m.set_text(F.col("blocks"), F.lit(m.STUB))).otherwise(F.col("blocks")),
    ).select(*table.columns, "elided")


def transform(table: DataFrame, arm: str, **params) -> DataFrame:
    """``admission``, ``masking``, or anything else for the unchanged table."""
    if arm == "admission":
        return admission_cap(table, **params)
    if arm == "masking":
        return masking(table, **params)
    return table
