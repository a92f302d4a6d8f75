"""Experiment inputs and outputs: outcome lines, plans, specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import text_lines

_LINE = "task STRING, arm STRING, rep INT, resolved STRING, session STRING"
#: JSON texts that count as not resolved, as in Python's truth of a value.
_FALSE = ("false", "0", "0.0", "-0.0", "", "null", "[]", "{}")
REQUIRED = ("task", "arm", "rep", "resolved")


def load_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome JSON lines in file order; blank lines are skipped and a line without one of
    the required keys fails the job."""
    rows = text_lines(spark, path).withColumnRenamed("line", "line_no").filter(F.btrim("value") != "")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys))
    checked = rows.filter(
        F.when(
            F.size(missing) > 0,
            F.raise_error(
                F.concat(F.lit("outcome row missing keys ["), F.array_join(missing, ", "),
                         F.lit("]: "), F.substring("value", 1, 80))
            ).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    resolved = ~F.coalesce(F.col("o.resolved"), F.lit("null")).isin(*_FALSE)
    return checked.select(F.from_json("value", _LINE).alias("o"), "line_no").select(
        "o.task", "o.arm", "o.rep", resolved.alias("resolved"), "o.session", "line_no")


def check_specs(specs: DataFrame) -> DataFrame:
    """A table of experiment specs (``extra`` keeps unknown keys as a map); a row without
    name, tasks or arms fails the job."""
    absent = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("arms", "name", "tasks")]),
        lambda c: c.isNotNull(),
    )
    return specs.filter(
        F.when(
            F.size(absent) > 0,
            F.raise_error(
                F.concat(F.lit("experiment spec missing keys ["), F.array_join(absent, ", "), F.lit("]"))
            ).cast("boolean"),
        ).otherwise(F.lit(True))
    )


def write_plan(plan: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines ordered by task position and run order."""
    plan.orderBy("task_position", "order").drop("task_position").write.mode(mode).json(path)
