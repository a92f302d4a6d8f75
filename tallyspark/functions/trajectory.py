"""Outcome predicates and the structural fingerprint of a trajectory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_TYPE = "STRUCT<role: STRING, text: STRING, is_observation: BOOLEAN>"
OBSERVATION_MARK = "OBSERVATION:"


def is_blank(text: Column) -> Column:
    return F.coalesce(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")) == "", F.lit(True))


def is_error(exit_status: Column) -> Column:
    return F.contains(F.lower(F.coalesce(exit_status, F.lit(""))), F.lit("error"))


def outcome(exit_status: Column, patch: Column) -> Column:
    return F.struct(
        exit_status.alias("exit_status"),
        is_blank(patch).alias("empty_patch"),
        is_error(exit_status).alias("error"),
        patch.alias("submitted_patch"),
        patch.alias("terminal_patch"),
    )


def shape(task_id: Column, steps: Column, exit_status: Column, patch: Column) -> Column:
    """Equal for two sources that recorded the same run."""
    return F.struct(
        task_id.alias("task_id"),
        F.size(steps).alias("n_steps"),
        F.transform(steps, lambda s: s["role"]).alias("roles"),
        F.size(F.filter(steps, lambda s: s["is_observation"])).alias("n_observations"),
        exit_status.alias("exit_status"),
        is_blank(patch).alias("empty_patch"),
    )
