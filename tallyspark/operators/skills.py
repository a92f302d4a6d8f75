"""Matching skills to action streams, and pricing a skill library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import economics
from ..plans.ordered import HOT_ROWS, with_position


def recent_actions(actions: DataFrame, length: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``recent``: the last ``length`` actions of the session up to and with this one.

    Positions within the session cut it into blocks; the last ``length - 1`` actions of a
    block are handed to the next block as context, so a block is all a task needs.
    """
    placed = with_position(
        actions.select("session", "action_seq", "action"), ["session"], "action_seq", "pos", hot_rows
    )
    block = F.floor(F.col("pos") / hot_rows).cast("bigint")
    tail = F.col("pos") % hot_rows >= hot_rows - (length - 1)
    targets = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(True).alias("own")),
            F.when(tail, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
        )
    )
    rows = placed.select("session", "action_seq", "action", "pos", F.explode(targets).alias("t")).select(
        "session", "action_seq", "action", "pos", "t.block", "t.own"
    )
    window = Window.partitionBy("session", "block").orderBy("pos").rowsBetween(1 - length, 0)
    return rows.withColumn("recent", F.collect_list("action").over(window)).filter("own").select(
        "session", "action_seq", "action", "recent"
    )


def match_skills(actions: DataFrame, skills: DataFrame, hot_rows: int = HOT_ROWS,
                 presented: int = economics.GATES["max_presented_per_task"]) -> DataFrame:
    """For each action, the skills whose whole signature was just performed, best first, at
    most ``presented``.  No more than that many skills of one signature can be among them, so
    each signature is cut to its best before the join.

    Every suffix of the recent window that has the length of some signature is an equi-join
    key.  The signature lengths (a handful of integers) are the only thing read up front.
    """
    of_signature = Window.partitionBy("signature").orderBy(F.col("steps_replaced").desc(), F.col("file_order"))
    keyed = (
        skills.filter(F.size("signature") > 0)
        .withColumn("_rank", F.row_number().over(of_signature))
        .filter(F.col("_rank") <= presented)
        .select("name", "steps_replaced", "file_order", "signature")
    )
    lengths = sorted(r[0] for r in keyed.select(F.size("signature")).distinct().collect())
    if not lengths:
        lengths = [1]
    recent = recent_actions(actions, lengths[-1], hot_rows)
    suffixes = F.array_compact(
        F.array(
            *[F.when(F.size("recent") >= n, F.slice("recent", -n, n)) for n in lengths]
        )
    )
    hits = recent.select(
        "session", "action_seq", F.explode(suffixes).alias("signature")
    ).join(keyed, "signature")
    best = Window.partitionBy("session", "action_seq").orderBy(
        F.col("steps_replaced").desc(), F.col("file_order")
    )
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= presented)
        .select("session", "action_seq", "rank", "name", "steps_replaced")
    )


def price_skills(skills: DataFrame, step_cost: DataFrame,
                 remaining_turns: int = economics.DEFAULT_REMAINING_TURNS) -> DataFrame:
    """The price report of a library; ``step_cost`` is one row with ``step_cost_tok_eq``."""
    price = step_cost.select("step_cost_tok_eq").limit(1).scalar()
    sized = skills.withColumns(
        {"step_cost_tok_eq": price, "body_tokens": economics.estimate_tokens(F.col("body"))}
    )
    priced = sized.withColumns(
        {
            "net_steps_saved": economics.net_steps_saved(F.col("steps_replaced")),
            "remaining_turns": F.lit(remaining_turns),
            "hold_cost_tok_eq": economics.hold_cost(F.col("body_tokens"), remaining_turns),
            "break_even_steps": economics.break_even_steps(
                F.col("body_tokens"), F.col("step_cost_tok_eq"), remaining_turns
            ),
        }
    )
    return priced.select(
        "name", "signature", "source", "body_tokens", "steps_replaced", "net_steps_saved",
        "step_cost_tok_eq", "remaining_turns", "hold_cost_tok_eq", "break_even_steps",
        economics.skill_verdict(F.col("break_even_steps"), F.col("net_steps_saved")).alias("verdict"),
        economics.gate_failures(
            F.col("body_tokens"), F.col("steps_replaced"), F.col("signature")
        ).alias("gate_failures"),
        economics.roster_card(F.col("name"), F.col("description"), F.col("signature")).alias("card"),
    )


def library_failures(skills: DataFrame) -> DataFrame:
    """One row per violated gate, plus one when the library is too large."""
    per_skill = skills.select(
        "name",
        F.explode(
            economics.gate_failures(
                economics.estimate_tokens(F.col("body")), F.col("steps_replaced"), F.col("signature")
            )
        ).alias("f"),
    ).select(F.concat("name", F.lit(": "), "f").alias("failure"))
    most = economics.GATES["max_active_skills"]
    library = skills.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(
        F.format_string(f"library holds %d skills > {most} (shadowing territory)", "n").alias("failure")
    )
    return per_skill.unionByName(library)
