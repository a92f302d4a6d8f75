"""Acceptance trials to success-rate intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson_interval
from ..functions.trajectory import is_blank

UNAVAILABLE = "ACCEPTANCE_UNAVAILABLE"
EMPTY_PATCH = "empty_patch"


def usable_commands(command_sets: DataFrame, kind_key: str = "D2") -> DataFrame:
    """Tasks with a credible, non-empty command of the given kind."""
    return command_sets.filter(
        (F.col("kind_key") == kind_key) & F.coalesce("credible", F.lit(False))
        & (F.coalesce("cmd", F.lit("")) != "")
    ).select("task_id", "cmd", F.lit(True).alias("available"))


def operating_points(trials: DataFrame, command_sets: DataFrame, kind_key: str = "D2",
                     command_set_id: str = "D2", command_set_sha: str | None = None,
                     z: float = 1.96) -> DataFrame:
    """One row per (task, patch): trials, passes, rate with a Wilson interval, last detail.

    An unusable command set is reported before an empty patch; an empty patch is rate 0 with
    a zero-width interval.
    """
    counted = trials.groupBy("task_id", "patch_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("passed").alias("_k"),
        F.max_by("detail", "trial").alias("_detail"),
        F.every(is_blank(F.col("patch"))).alias("_blank"),
    )
    known = counted.join(
        usable_commands(command_sets, kind_key).dropDuplicates(["task_id"]),
        "task_id", "left",
    ).withColumn("available", F.coalesce("available", F.lit(False)))
    open_, blank = F.col("available"), F.col("_blank")
    zero = F.lit(0).cast("bigint")
    passed = F.when(open_ & ~blank, F.col("_k")).otherwise(zero)
    ci = wilson_interval(F.col("_k"), F.col("_n"), z)
    bound = lambda f: F.when(open_ & ~blank, ci[f]).otherwise(F.lit(0.0)).alias(f)
    return known.select(
        "task_id", "patch_id",
        F.when(open_, F.col("_n")).otherwise(zero).alias("n_trials"),
        passed.alias("n_pass"),
        bound("point"), bound("ci_low"), bound("ci_high"),
        F.lit("wilson").alias("ci_method"),
        F.when(~open_, F.lit(UNAVAILABLE)).when(blank, F.lit(EMPTY_PATCH)).otherwise(F.col("_detail"))
        .alias("detail"),
        "available",
        F.lit(command_set_id).alias("command_set_id"),
        F.lit(command_set_sha).cast("string").alias("command_set_sha"),
    )
