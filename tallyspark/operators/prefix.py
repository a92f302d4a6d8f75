"""Prefix stability and prefix mutations of the calls of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import PREFIX_MUTATION_MULTIPLIER
from ..functions.rounding import py_round
from ..functions.text import common_prefix_len
from ..plans.ordered import HOT_ROWS, with_previous
from .calls import BLOCK_CHARS, message_store

_SEGMENTS = ("tools", "system", "model")
#: Digests of up to so many blocks (about 50 bytes each) are broadcast to pick from the messages.
BROADCAST_BLOCKS = 500_000


def link_previous(calls: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add what each call needs from earlier calls of its session, in one ordered pass.

    ``prev_messages``: the last call with messages; ``prev_segments``: the last call;
    ``prev_prompt_tokens``: the last observed, non-zero prompt size.
    """
    return with_previous(
        calls, ["session"], "call_seq",
        {
            "prev_messages": F.when(
                F.col("n_messages") > 0, F.struct(
                    "call_seq", "prefix_keys", "message_chars", "message_sha256", "block_keys")
            ),
            "prev_segments": F.struct(
                F.col("tools_key").alias("tools"), F.col("system_key").alias("system"),
                F.col("request_model").alias("model"), "tool_names",
            ),
            "prev_prompt_tokens": F.nullif(F.col("usage_tokens")["prompt_tokens"], F.lit(0)),
        },
        hot_rows,
    )


def mutation() -> Column:
    """STRUCT of changed segments and their price over the columns of :func:`link_previous`;
    NULL when nothing changed or the session has no earlier call."""
    prev = F.col("prev_segments")
    now = {"tools": F.col("tools_key"), "system": F.col("system_key"), "model": F.col("request_model")}
    changed = F.filter(
        F.array(*[F.when(~prev[s].eqNullSafe(now[s]), F.lit(s)) for s in _SEGMENTS]),
        lambda s: s.isNotNull(),
    )
    names = F.col("tool_names")
    tokens = F.col("prev_prompt_tokens")
    return F.when(
        prev.isNotNull() & (F.size(changed) > 0),
        F.struct(
            changed.alias("segments"),
            F.array_sort(F.array_except(names, prev["tool_names"])).alias("tools_added"),
            F.array_sort(F.array_except(prev["tool_names"], names)).alias("tools_removed"),
            py_round(F.lit(PREFIX_MUTATION_MULTIPLIER) * tokens.cast("double"), 1).alias("cost_tok_eq"),
            F.when(tokens.isNotNull(), F.lit("observed_prev_prompt_tokens"))
            .otherwise(F.lit("unavailable")).alias("cost_basis"),
        ),
    )


def compare_messages(linked: DataFrame) -> DataFrame:
    """Replace the key and length arrays by counts: shared messages, shared characters, the
    previous open form's length, and, where a message was rewritten, in which block the two texts
    part (``differing``: the block's number and both sides' keys in the message store)."""
    prev = F.col("prev_messages")
    shared = F.size(
        F.filter(
            F.arrays_zip(
                F.col("prefix_keys").alias("now"), prev["prefix_keys"].alias("before")
            ),
            lambda z: z["now"] == z["before"],
        )
    )
    # ``shared`` is NULL-safe below: without a previous call everything stays NULL.
    n_prev = F.size(prev["prefix_keys"])
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    step1 = linked.withColumn("_shared", F.when(prev.isNotNull() & (F.col("n_messages") > 0), shared))
    same = F.col("_shared")
    differs = (same < n_prev) & (same < F.col("n_messages"))
    own_keys, old_keys = (F.try_element_at(k, same + 1) for k in (F.col("block_keys"), prev["block_keys"]))
    equal = F.zip_with(own_keys, old_keys, lambda a, b: a.eqNullSafe(b))
    block = F.greatest(F.array_position(equal, False), F.lit(1)).cast("int")
    differing = F.struct(
        (block - 1).alias("block"),
        F.try_element_at("message_sha256", same + 1).alias("own_sha"), F.try_element_at(own_keys, block).alias("own_key"),
        F.try_element_at(prev["message_sha256"], same + 1).alias("old_sha"), F.try_element_at(old_keys, block).alias("old_key"),
    )
    # "[" and the shared messages, each followed by a comma when both lists go on after it.
    chars = (
        F.lit(1) + total(F.slice(prev["message_chars"], F.lit(1), same))
        + F.greatest(same - 1, F.lit(0)) + F.when(differs & (same > 0), F.lit(1)).otherwise(F.lit(0))
    )
    return step1.withColumns(
        {
            "differing": F.when(differs, differing),
            "base_chars": F.when(same.isNotNull(), total(prev["message_chars"]) + n_prev),
            "shared_chars": F.when(same.isNotNull(), chars),
            "texts_differ": F.coalesce(differs, F.lit(False)),
        }
    ).drop("_shared", "prev_messages", "prefix_keys", "message_chars", "block_keys", "message_texts")


def differing_prefix(compared: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_seq, lcp): common characters of the first differing message pair.

    The digests say in which block the texts part, so two blocks per rewritten message are fetched
    from the message store; no body and no whole text is joined, and a long message is a block.
    """
    sides = compared.filter("texts_differ").select(
        "call_seq", "differing.block",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("own"), F.col("differing.own_sha").alias("sha"), F.col("differing.own_key").alias("key")),
                F.struct(F.lit(False).alias("own"), F.col("differing.old_sha").alias("sha"), F.col("differing.old_key").alias("key")),
            )
        ).alias("s"),
    ).select("call_seq", F.col("block").alias("number"), "s.*").filter(F.col("key").isNotNull())
    wanted = sides.select("sha", "key").distinct()
    few = wanted.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    pairs = sides.join(message_store(calls, wanted if few else None), ["sha", "key"]).groupBy("call_seq").agg(
        F.max("number").alias("number"),
        F.max(F.when(F.col("own"), F.col("block"))).alias("a"),
        F.max(F.when(~F.col("own"), F.col("block"))).alias("b"),
    )
    # A text that ends before the block shares nothing more.
    rest = F.coalesce(common_prefix_len(F.col("a"), F.col("b"), BLOCK_CHARS.bit_length()), F.lit(0))
    return pairs.select("call_seq", (F.col("number") * BLOCK_CHARS + rest).alias("lcp"))


def stable_ratio(lcp: Column) -> Column:
    """Share of the previous open form that the call starts with; 1.0 when only appended to."""
    return F.when(
        F.col("shared_chars").isNotNull(),
        F.least(F.col("base_chars"), F.col("shared_chars") + F.coalesce(lcp, F.lit(0))).cast("double")
        / F.col("base_chars").cast("double"),
    )
