"""Mixing sources to target weights by hierarchical budgeting.

The levels (domain, language, source) form a tree.  A node's budget is shared out among its
children by weight.  A child whose tokens, repeated for at most ``max_epochs`` epochs, fall
short of its share gets all of them, and the rest goes to its siblings by weight; only what all
siblings together cannot take has already gone to the siblings of their parent, since a parent
never gets more than its own subtree holds.  A leaf with budget b and t tokens per epoch is
used whole ``b div t`` times, and in one more epoch the prefix of a seeded order whose tokens
before a document stay under ``b mod t`` (so it ends with the document that crosses the budget).

The prefix is found without sorting a leaf: a histogram over the leading bits of the seeded hash
shows the one slice in which the budget ends, and only the rows of that slice are ordered.  The
result is a cut-off hash per leaf, so documents are filtered in place and texts never travel.

Nulls: a null level is the node ``(none)``; a null text has no tokens and is never needed to
fill a budget, but belongs to whole epochs.  Repeated rows share one place in the order and are
taken or left together.  A weight of 0 gives nothing; nodes without a stated weight have 1.
An empty table gives an empty result.  Input columns named ``epoch`` or ``n_tokens`` are
replaced, all others keep their names and values.

All sums are integers, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.local import local_table
from ..plans.staging import stage
from .ordering import HASH_BITS, hash60, slice_bits

#: Rows of one leaf in the slice that is ordered exactly.
ROWS_PER_SLICE = 50_000
DECIMAL = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Words between blanks, as BIGINT; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n\\f]+")), F.lit(0)).cast("bigint")


def share_out(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Share ``budget`` (one value per parent) among children with ``weight`` and ``capacity``.

    Children are tried in the order of capacity per weight.  Those that fill up get their
    capacity; the others split the rest by weight.  Adds ``granted``.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(1e308))
    by = Window.partitionBy(*parent)
    along = by.orderBy("_ratio", "path")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = along.rowsBetween(0, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast(DECIMAL)
    filled = (
        children.withColumn("_ratio", ratio)
        .withColumn("_before", F.coalesce(F.sum("capacity").over(earlier), F.lit(0)).cast("bigint"))
        .withColumn("_weights", F.sum("weight").over(later).cast("bigint"))
        .withColumn("_fits", (F.col("weight") > 0) & (
            wide("capacity") * F.col("_weights") <= (F.col("budget") - F.col("_before")).cast(DECIMAL) * F.col("weight")))
        .withColumn("_full", F.min("_fits").over(upto))
    )
    open_weight = F.when(F.col("_full"), F.lit(0)).otherwise(F.col("weight"))
    rest = (
        filled
        .withColumn("_rest", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(F.lit(0))).over(by))
        .withColumn("_open", open_weight)
        .withColumn("_all", F.nullif(F.sum("_open").over(by), F.lit(0)))
        .withColumn("_cum", F.sum("_open").over(upto))
    )
    floor = lambda c: f"(CAST(_rest AS {DECIMAL}) * ({c})) div _all"
    part = F.coalesce(F.expr(f"{floor('_cum')} - {floor('_cum - _open')}"), F.lit(0))
    granted = F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(part, F.col("capacity")))
    return rest.select(*children.columns, granted.cast("bigint").alias("granted"))


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int],
    budget: int, max_epochs: int,
) -> DataFrame:
    """``leaves`` (levels, tokens) with ``granted`` tokens, from the root down."""
    spark = leaves.sparkSession
    rows = [("/".join(map(str, path)), int(w)) for path, w in weights.items()]
    given = local_table(spark, rows, "path string, weight bigint")
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
    granted = None
    for depth in range(1, len(levels) + 1):
        keys, parent = list(levels[:depth]), list(levels[: depth - 1])
        children = (
            nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
            .withColumn("path", F.concat_ws("/", *keys))
            .join(given, "path", "left")
            .withColumn("weight", F.coalesce("weight", F.lit(1)).cast("bigint"))
        )
        if granted is None:
            children = children.withColumn("budget", F.least(total, F.lit(int(budget))).cast("bigint"))
            parent = [F.lit(0)]
        else:
            children = children.join(granted.withColumnRenamed("granted", "budget"), parent)
        granted = share_out(children, parent).select(*keys, "granted")
    return leaves.join(granted, list(levels))


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, int],
    budget: int | float, max_epochs: int = 4, seed: int = 0,
    key: Sequence[str] = ("doc_id", "text"), tokens: Column | None = None,
) -> DataFrame:
    """The chosen documents with ``n_tokens`` and ``epoch`` (0, 1, ...); one row per use.

    ``budget`` is a number of tokens, or as a float the share of all tokens.  ``key`` names the
    columns that identify a row for the seeded order.
    """
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens")]
    names = [f"_level{i}" for i in range(len(levels))]
    # The document is one column, so its own columns may have any names.
    tagged = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("_row"),
        *[F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in zip(names, levels.values(), strict=True)],
        (word_count(docs["text"]) if tokens is None else tokens).alias("n_tokens"),
        F.md5(F.concat_ws("|", *[F.coalesce(docs[k].cast("string"), F.lit("")) for k in key])).alias("_key"),
    )
    narrow = stage(
        tagged.groupBy(*names, "_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")),
        "mixing",
    )
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    sums = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    wanted = int(sums[0] * budget) if isinstance(budget, float) else int(budget)
    bits = slice_bits(sums[1], ROWS_PER_SLICE)
    plan = stage(
        leaf_budgets(leaves, names, weights, wanted, max_epochs)
        .withColumn("whole", F.coalesce(F.expr("granted div nullif(tokens, 0)"), F.lit(0)).cast("bigint"))
        .withColumn("part", F.col("granted") - F.col("whole") * F.col("tokens")),
        "budgets",
    )
    order = lambda epoch: hash60(F.lit(str(seed)), epoch, F.col("_key"))

    # The slice of each leaf's last epoch in which the budget ends.
    placed = (
        narrow.join(plan.filter("part > 0").select(*names, "whole", "part"), names)
        .withColumn("_order", order(F.col("whole")))
        .withColumn("_slice", F.shiftright("_order", HASH_BITS - bits))
    )
    earlier = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        placed.groupBy(*names, "_slice").agg(F.sum("tokens").alias("_sum"), F.first("part").alias("part"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .filter((F.col("_offset") < F.col("part")) & (F.col("_offset") + F.col("_sum") >= F.col("part")))
        .select(*names, "_slice", "_offset")
    )
    inside = Window.partitionBy(*names).orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        placed.join(ends, [*names, "_slice"])
        .withColumn("_before", F.col("_offset") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .filter(F.col("_before") < F.col("part"))
        .groupBy(*names).agg(F.max("_order").alias("cut"))
    )
    chosen = plan.join(cuts, names, "left").select(
        *names, F.col("whole").alias("_whole"), F.coalesce("cut", F.lit(-1)).alias("_cut")
    )
    return (
        tagged.join(stage(chosen, "cuts"), names)
        .withColumn("_uses", F.col("_whole") + (order(F.col("_whole")) <= F.col("_cut")).cast("bigint"))
        .filter(F.col("_uses") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_uses") - 1).cast("int"))))
        .select("_row.*", "n_tokens", "epoch")
    )
