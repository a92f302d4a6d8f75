"""Seeded run plans and paired comparisons."""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import stats
from ..functions.rounding import from_units, py_round

# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of the two arms every plan gets.
SHAM_ARM = "aa_sham"
RAW_ARM = "raw_trajectory"


@dataclass
class ExperimentSpec:
    """What to run.  Give ``seed`` explicitly to reproduce a plan made elsewhere."""

    name: str
    tasks: list[str]
    arms: list[str]
    reps: int = 3
    seed: str = "tallyspark"
    include_sham: bool = True
    include_raw_baseline: bool = True
    notes: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def all_arms(self) -> list[str]:
        added = [(RAW_ARM, self.include_raw_baseline), (SHAM_ARM, self.include_sham)]
        return list(dict.fromkeys([*self.arms, *[a for a, wanted in added if wanted]]))

    @classmethod
    def from_dict(cls, values: dict) -> ExperimentSpec:
        missing = sorted({"name", "tasks", "arms"} - set(values))
        if missing:
            raise ValueError(f"experiment spec missing keys {missing}")
        known = [k for k in cls.__dataclass_fields__ if k != "extra"]
        return cls(
            **{k: values[k] for k in known if k in values},
            extra={k: v for k, v in values.items() if k not in known},
        )


def with_mandatory_arms(arms: Column, include_raw: Column, include_sham: Column) -> Column:
    """The same rule as a column: missing mandatory arms go to the end, raw before sham."""
    none = F.array().cast("array<string>")
    added = F.concat(
        F.when(include_raw, F.array(F.lit(RAW_ARM))).otherwise(none),
        F.when(include_sham, F.array(F.lit(SHAM_ARM))).otherwise(none),
    )
    return F.array_union(arms, added)


@F.pandas_udf(ArrayType(IntegerType()))
def _permutation(sizes: pd.Series, keys: pd.Series) -> pd.Series:
    """Places in the order of a Fisher-Yates shuffle whose draws come from SHA-256 of key and step."""
    out = []
    for size, key in zip(sizes, keys, strict=True):
        order = list(range(int(size)))
        for i in range(int(size) - 1, 0, -1):
            j = int.from_bytes(hashlib.sha256(f"{key}|{i}".encode()).digest()[:8], "big") % (i + 1)
            order[i], order[j] = order[j], order[i]
        out.append(order)
    return pd.Series(out)


def shuffled(cells: Column, key: Column) -> Column:
    """Cells in shuffled order: a block's places are permuted in one pass, then its cells are picked."""
    return F.transform(_permutation(F.size(cells), key), lambda at: F.element_at(cells, at + 1))


def plan_for_tasks(tasks: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """One row per (task, arm, rep) for a table ``task, task_position`` of any size.

    Each task's block is a small array shuffled inside its row, so no shuffle stage is needed.
    """
    arms = F.array(*[F.lit(a) for a in spec.all_arms])
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(spec.reps - 1)),
            lambda rep: F.transform(arms, lambda arm: F.struct(arm.alias("arm"), rep.alias("rep"))),
        )
    ) if spec.reps > 0 else F.array().cast("array<struct<arm: string, rep: int>>")
    key = F.concat(F.lit(f"{spec.seed}|{spec.name}|"), F.col("task"))
    blocks = tasks.select("task", "task_position", cells.alias("_cells"), key.alias("_key"))
    ordered = blocks.select(
        "task", "task_position", F.posexplode(shuffled(F.col("_cells"), F.col("_key"))).alias("order", "c")
    )
    return ordered.select(
        "task", F.col("c.arm").alias("arm"), F.col("c.rep").alias("rep"), "order",
        F.concat_ws("::", "task", "c.arm", F.col("c.rep").cast("string")).alias("run_id"),
        "task_position",
    )


def build_plan(spark: SparkSession, spec: ExperimentSpec) -> DataFrame:
    from ..plans.local import local_table

    rows = [(str(t), i) for i, t in enumerate(spec.tasks)]
    return plan_for_tasks(local_table(spark, rows, "task STRING, task_position INT"), spec)


def plan_summary(plan: DataFrame, spec: ExperimentSpec) -> DataFrame:
    arms = F.array(*[F.lit(a) for a in spec.all_arms])
    return plan.agg(
        F.lit(spec.name).alias("name"),
        F.lit(spec.seed).alias("seed"),
        F.countDistinct("task").alias("tasks"),
        arms.alias("arms"),
        F.lit(spec.reps).alias("reps"),
        F.count(F.lit(1)).alias("total_runs"),
        F.lit(SHAM_ARM in spec.all_arms).alias("sham_included"),
        F.lit(RAW_ARM in spec.all_arms).alias("raw_baseline_included"),
    )


def last_outcomes(outcomes: DataFrame) -> DataFrame:
    """One row per (task, arm, rep): the last line wins.  Copies combine before the shuffle."""
    return outcomes.groupBy("task", "arm", "rep").agg(
        F.max_by(F.struct("resolved", "session"), "line_no").alias("_o"),
    ).select("task", "arm", "rep", F.coalesce("_o.resolved", F.lit(False)).alias("resolved"),
             "_o.session")


def paired_analysis(outcomes: DataFrame, control: str, costs: DataFrame | None = None,
                    alpha: float = 0.05) -> DataFrame:
    """Every arm against the control on equal (task, rep) cells, in one self-join.

    The A/A sham is the noise floor of the other arms and appears as a row with ``is_floor``.
    ``costs`` is (session, cost_tenths); a pair counts for the cost delta only when both
    sides are known.  Unmatched cells are dropped.  ``arm_order`` follows first appearance.
    """
    cells = last_outcomes(outcomes)
    base = cells.filter(F.col("arm") == control).select(
        "task", "rep", F.col("resolved").alias("a_ok"), F.col("session").alias("a_session")
    )
    others = cells.filter(F.col("arm") != control).select(
        "task", "rep", "arm", F.col("resolved").alias("b_ok"), F.col("session").alias("b_session")
    )
    pairs = others.join(base, ["task", "rep"])
    counted = pairs.groupBy("arm").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("b_ok") & ~F.col("a_ok")).alias("help"),
        F.count_if(F.col("a_ok") & ~F.col("b_ok")).alias("harm"),
        F.count_if(F.col("a_ok") == F.col("b_ok")).alias("null"),
    )
    arms = (
        outcomes.filter(F.col("arm") != control).groupBy("arm")
        .agg(F.min("line_no").alias("arm_order"))
    )
    table = arms.join(counted, "arm", "left").na.fill(0, ["pairs", "help", "harm", "null"])
    if costs is not None:
        known = pairs.filter(F.col("a_session").isNotNull() & F.col("b_session").isNotNull())
        side = lambda s: costs.select(
            F.col("session").alias(f"{s}_session"), F.col("cost_tenths").alias(f"{s}_cost")
        )
        deltas = (
            known.join(side("a"), "a_session").join(side("b"), "b_session")
            .groupBy("arm")
            .agg(
                F.count(F.lit(1)).alias("cost_pairs"),
                F.sum(F.col("b_cost") - F.col("a_cost")).alias("_delta"),
            )
        )
        table = table.join(deltas, "arm", "left")
    else:
        table = table.withColumns(
            {"cost_pairs": F.lit(0).cast("bigint"), "_delta": F.lit(None).cast("bigint")}
        )
    measured = table.select(
        F.lit(control).alias("arm_a"), F.col("arm").alias("arm_b"), "arm_order",
        "pairs", "help", "harm", "null",
        stats.discordant_rate(F.col("help"), F.col("harm"), F.col("pairs")).alias("discordant_rate"),
        stats.mcnemar_exact(F.col("help"), F.col("harm")).alias("p_value"),
        py_round(
            from_units(F.col("_delta"), 1) / F.nullif(F.col("cost_pairs").cast("double"), F.lit(0.0)), 1
        ).alias("cost_delta_tok_eq"),
        F.coalesce("cost_pairs", F.lit(0)).alias("cost_pairs"),
        (F.col("arm") == SHAM_ARM).alias("is_floor"),
    )
    # The floor is one value per table: the sham row's rate, read through an arm-sized window.
    from pyspark.sql import Window

    whole = Window.partitionBy("arm_a")
    floor = F.max(F.when(F.col("is_floor"), F.col("discordant_rate"))).over(whole)
    raw_present = F.max(F.col("arm_b") == RAW_ARM).over(whole)
    return measured.withColumns({"_floor": floor, "raw_baseline_present": raw_present}).select(
        *[c for c in measured.columns],
        stats.paired_verdict(
            F.col("p_value"), F.col("discordant_rate"), F.col("pairs"), F.col("help"), F.col("harm"),
            F.when(~F.col("is_floor"), F.col("_floor")), alpha,
        ).alias("verdict"),
        "raw_baseline_present",
    )


def compare_arms(outcomes: DataFrame, arm_a: str, arm_b: str,
                 costs: DataFrame | None = None) -> DataFrame:
    """One pair of arms, without a floor."""
    only = outcomes.filter(F.col("arm").isin(arm_a, arm_b))
    return paired_analysis(only, arm_a, costs).drop("verdict", "raw_baseline_present", "is_floor",
                                                    "arm_order")
