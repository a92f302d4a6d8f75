"""Raw call records parsed into one narrow row per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rounding import py_round
from ..functions.usage import parse_usage, tool_names, with_usage

_REQUEST_DDL = (
    "model STRING, prompt VARIANT, tools VARIANT, system VARIANT, messages VARIANT, "
    "_bad STRING"
)
#: Characters of a message that one digest covers, and that one row of the message store holds.
BLOCK_CHARS = 1024
PARSE_ERROR = "JSONDecodeError"  # fixed value


def request_of(body: Column) -> Column:
    return F.from_json(body, _REQUEST_DDL, {"columnNameOfCorruptRecord": "_bad"})


def message_texts(request: Column) -> Column:
    """Canonical text of each message."""
    return F.coalesce(
        F.transform(messages_of(request), lambda m: F.to_json(m)), F.array().cast("array<string>")
    )


def messages_of(request: Column) -> Column:
    """The message list; NULL where ``messages`` is something else."""
    return F.try_variant_get(request["messages"], "$", "array<variant>")


def prefix_keys(digests: Column) -> Column:
    """128-bit digests of the message list cut after 1, 2, ... messages, from the messages' digests.

    Two calls share their first k messages exactly when they share key k.
    """
    def key(previous: Column, message: Column) -> Column:
        digest = F.sha2(F.concat(previous, F.lit("|").cast("binary"), message.cast("binary")), 256)
        return F.unhex(F.substring(digest, 1, 32))

    empty = F.array().cast("array<binary>")
    return F.aggregate(
        digests, empty,
        lambda keys, m: F.array_append(
            keys, key(F.coalesce(F.try_element_at(keys, F.lit(-1)), F.lit(bytearray(b""))), m)
        ),
    )


def text_blocks(message: Column) -> Column:
    """A text cut into blocks of ``BLOCK_CHARS`` characters."""
    return F.regexp_extract_all(message, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def message_store(calls: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Each different block of the calls' messages once: ``sha`` of its message, ``key``, ``block``.

    ``calls`` is the staged result of :func:`parse_calls`.  ``wanted`` (``sha``, ``key``) must be
    small enough to be broadcast; without it the map side already keeps one row per block.
    """
    messages = calls.select(
        F.explode(F.arrays_zip(
            F.col("message_sha256").alias("sha"), F.col("block_keys").alias("keys"),
            F.col("message_texts").alias("text"))).alias("m")
    )
    blocks = messages.select(
        F.col("m.sha").alias("sha"),
        F.explode(F.arrays_zip(F.col("m.keys").alias("key"), text_blocks(F.col("m.text")).alias("block"))).alias("b"),
    ).select("sha", "b.*")
    if wanted is not None:
        blocks = blocks.join(F.broadcast(wanted), ["sha", "key"], "left_semi")
    return blocks.groupBy("sha", "key").agg(F.first("block").alias("block"))


def parse_calls(call_raw: DataFrame, keep_text: bool = False) -> DataFrame:
    """Everything later steps need from the bodies, without the bodies.

    Of the texts only ``message_texts`` remain, for :func:`message_store`; a stored column that no
    other step reads.  ``keep_text`` adds ``canonical``, the text of the whole message list.

    A request that is not JSON keeps its row and is named in ``request_parse_error``; a
    response that cannot be read has NULL usage.
    """
    parsed = (
        with_usage(call_raw, "_res")
        .withColumn("_req", request_of(F.col("request_body")))
        .withColumn("_texts", message_texts(F.col("_req")))
        .withColumn("_digests", F.transform("_texts", lambda t: text.sha256_hex(t, 32)))
    )
    req = F.col("_req")
    texts = F.col("_texts")
    tools = text.canonical_json(req["tools"])
    system = text.canonical_json(req["system"])
    seed = text.canonical_json(req["prompt"])
    whole = text.canonical_list(texts)
    roles = F.transform(
        F.filter(messages_of(req), lambda m: F.startswith(F.to_json(m), F.lit("{"))),
        lambda m: F.try_variant_get(m, "$.role", "string"),
    )
    return parsed.select(
        "call_seq", "ts", "dialect", "path", "status",
        py_round(F.col("latency_ms"), 1).alias("latency_ms"),
        F.coalesce("injected", F.lit(False)).alias("gateway_injected"),
        F.coalesce("truncated", F.lit(False)).alias("tap_truncated"),
        "request_sha_before", "request_sha_after",
        F.when(F.col("session_header").isNotNull(), text.safe_session(F.col("session_header"))).alias(
            "header"
        ),
        F.when(req["_bad"].isNotNull(), F.lit(PARSE_ERROR)).alias("request_parse_error"),
        F.col("_res")["usage"].alias("usage"),
        parse_usage(F.col("_res")["usage"]).alias("usage_tokens"),
        F.coalesce(F.nullif(F.col("_res")["model"], F.lit("")), req["model"]).alias("model"),
        req["model"].alias("request_model"),
        text.sha256_hex(tools, 32).alias("tools_key"),
        text.sha256_hex(system, 32).alias("system_key"),
        tool_names(req["tools"]).alias("tool_names"),
        F.size(texts).alias("n_messages"),
        F.coalesce(roles, F.array().cast("array<string>")).alias("roles"),
        F.transform("_digests", lambda d: F.substring(d, 1, 16)).alias("message_sha256"),
        F.transform(texts, lambda t: F.octet_length(t).cast("bigint")).alias("message_bytes"),
        F.transform(texts, lambda t: F.length(t)).alias("message_chars"),
        prefix_keys(F.col("_digests")).alias("prefix_keys"),
        F.transform(texts, lambda t: F.transform(text_blocks(t), lambda b: F.xxhash64(b))).alias("block_keys"),
        texts.alias("message_texts"),
        text.auto_session(
            F.when(F.size(texts) > 0, whole).otherwise(F.coalesce(seed, F.lit("[]")))
        ).alias("auto_id"),
        *([whole.alias("canonical")] if keep_text else []),
    )
