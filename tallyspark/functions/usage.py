"""Provider usage: extraction from response bodies and event streams, and normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every token field either dialect may send; absent fields parse to NULL.
USAGE_DDL = (
    "prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT, "
    "input_tokens BIGINT, output_tokens BIGINT, reasoning_tokens BIGINT, "
    "cache_read_input_tokens BIGINT, cache_creation_input_tokens BIGINT, "
    "prompt_tokens_details STRUCT<cached_tokens: BIGINT, cache_creation_tokens: BIGINT, "
    "reasoning_tokens: BIGINT>, "
    "completion_tokens_details STRUCT<cached_tokens: BIGINT, cache_creation_tokens: BIGINT, "
    "reasoning_tokens: BIGINT>"
)

_BODY_DDL = "usage STRING, model STRING"
_CHUNK_DDL = "type STRING, model STRING, usage STRING, message STRING"
_MESSAGE_DDL = "model STRING, usage STRING"

# Line separators of a text stream: CR LF together, otherwise any single line-breaking character.
_LINE_BREAK = "\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
_BLANKS = " \t\n\r\x0b\x0c"


def _object_text(text: Column) -> Column:
    """Keep JSON text only when it is an object."""
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), text)


def _filled_object(text: Column) -> Column:
    return F.when(~F.rlike(text, F.lit("^\\s*\\{\\s*\\}\\s*$")), _object_text(text))


def _non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def sse_payloads(stream: Column) -> Column:
    """Payload texts of the ``data:`` lines, without blanks and the end marker."""
    lines = F.split(stream, _LINE_BREAK)
    payloads = F.transform(
        F.filter(lines, lambda line: F.startswith(line, F.lit("data:"))),
        lambda line: F.btrim(F.substr(line, F.lit(6)), F.lit(_BLANKS)),
    )
    return F.filter(payloads, lambda p: (p != "") & (p != "[DONE]"))


def sse_chunks(stream: Column) -> Column:
    """Parsed payloads.  A payload that is not JSON becomes a struct of NULLs, which every
    reader below skips."""
    return F.transform(sse_payloads(stream), lambda p: F.from_json(p, _CHUNK_DDL))


def openai_stream(chunks: Column) -> Column:
    """STRUCT<usage, model>: the last chunk with a filled usage, the last non-empty model."""
    usages = F.filter(
        F.transform(chunks, lambda c: _filled_object(c["usage"])), lambda u: u.isNotNull()
    )
    models = F.filter(F.transform(chunks, lambda c: _non_empty(c["model"])), lambda m: m.isNotNull())
    return F.struct(
        F.try_element_at(usages, F.lit(-1)).alias("usage"),
        F.try_element_at(models, F.lit(-1)).alias("model"),
    )


def anthropic_pieces(chunks: Column) -> Column:
    """Per chunk, the usage it adds and the model it names."""
    def parts(c: Column) -> Column:
        started = F.from_json(c["message"], _MESSAGE_DDL)
        starts = c["type"] == "message_start"
        return F.struct(
            F.when(starts, _filled_object(started["usage"]))
            .when(c["type"] == "message_delta", _filled_object(c["usage"]))
            .alias("usage"),
            F.when(starts, _non_empty(started["model"])).alias("model"),
        )

    return F.filter(
        F.transform(chunks, parts), lambda p: p["usage"].isNotNull() | p["model"].isNotNull()
    )


def overlaid_usage(pieces: Column) -> Column:
    """MAP<STRING, STRING> of usage keys; a key of a later piece replaces an earlier one."""
    empty = F.from_json(F.lit("{}"), "MAP<STRING, STRING>")

    def overlay(acc: Column, piece: Column) -> Column:
        update = F.coalesce(F.from_json(piece["usage"], "MAP<STRING, STRING>"), empty)
        return F.map_concat(
            F.map_filter(acc, lambda k, _v: ~F.map_contains_key(update, k)), update
        )

    return F.aggregate(pieces, empty, overlay)


def usage_text(merged: Column) -> Column:
    """JSON object text of :func:`overlaid_usage`; NULL when it is empty.

    Values are texts of numbers, nulls and nested objects; anything else is quoted.
    """
    body = F.array_join(
        F.transform(
            F.map_entries(merged),
            lambda e: F.concat(
                F.lit('"'), e["key"], F.lit('":'),
                F.when(e["value"].isNull(), F.lit("null"))
                .when(F.rlike(e["value"], F.lit(r"^(-?[0-9.eE+-]+|true|false|[\[{].*)$")), e["value"])
                .otherwise(F.concat(F.lit('"'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"'))),
            ),
        ),
        ",",
    )
    return F.when(F.size(F.map_keys(merged)) > 0, F.concat(F.lit("{"), body, F.lit("}")))


def with_usage(df: DataFrame, name: str = "_res") -> DataFrame:
    """Add STRUCT<usage, model> of each response, in the provider's own shape.

    Reads ``dialect``, ``response_body`` and ``response_is_sse``.  A body or a stream is
    parsed once; a response that cannot be read has NULL in both fields.
    """
    sse = F.coalesce("response_is_sse", F.lit(False))
    body, second = F.col("response_body"), F.col("dialect") == "anthropic"
    parsed = df.withColumns(
        {
            "_plain": F.when(~sse, F.from_json(body, _BODY_DDL)),
            "_chunks": F.when(sse, sse_chunks(body)),
        }
    )
    pieces = parsed.withColumn("_pieces", F.when(second, anthropic_pieces(F.col("_chunks"))))
    merged = pieces.withColumn("_merged", F.when(second, overlaid_usage(F.col("_pieces"))))
    plain = F.struct(
        _object_text(F.col("_plain")["usage"]).alias("usage"), F.col("_plain")["model"].alias("model")
    )
    named = F.filter("_pieces", lambda p: p["model"].isNotNull())
    joined = F.struct(
        usage_text(F.col("_merged")).alias("usage"),
        F.try_element_at(named, F.lit(-1))["model"].alias("model"),
    )
    return merged.withColumn(
        name,
        F.when(~sse, plain).when(second, joined).otherwise(openai_stream(F.col("_chunks"))),
    ).drop("_plain", "_chunks", "_pieces", "_merged")


def parse_usage(usage: Column) -> Column:
    """Typed token fields of a usage JSON text (NULL when there is no usage).

    A count may be sent as ``100.0``; that is the same count.
    """
    counts = F.regexp_replace(usage, r"(?<=[:\s])(-?\d+)\.0+(?=\s*[,}])", "$1")
    return F.when(usage.isNotNull(), F.from_json(counts, USAGE_DDL))


def normalize_anthropic(tokens: Column) -> Column:
    """Map the second dialect onto the first.

    Its input count leaves cache reads and writes out, the common form includes them.  A
    field that was not sent stays NULL.
    """
    read, written = tokens["cache_read_input_tokens"], tokens["cache_creation_input_tokens"]
    null = F.lit(None).cast("bigint")
    details = F.struct(
        read.alias("cached_tokens"),
        written.alias("cache_creation_tokens"),
        null.alias("reasoning_tokens"),
    )
    zero = F.lit(0)
    return F.when(
        tokens.isNotNull(),
        F.struct(
            (tokens["input_tokens"] + F.coalesce(read, zero) + F.coalesce(written, zero)).alias(
                "prompt_tokens"
            ),
            tokens["output_tokens"].alias("completion_tokens"),
            F.when(read.isNotNull() | written.isNotNull(), details).alias("prompt_tokens_details"),
        ),
    )


def normalized_tokens(dialect: Column, tokens: Column) -> Column:
    """Typed usage in the common form."""
    second = normalize_anthropic(tokens)
    is_second = dialect == "anthropic"
    pick = lambda name: F.when(is_second, second[name]).otherwise(tokens[name]).alias(name)
    return F.struct(
        pick("prompt_tokens"), pick("completion_tokens"), pick("prompt_tokens_details"),
        F.when(~is_second, tokens["completion_tokens_details"]).alias("completion_tokens_details"),
    )


def normalized_usage_json(dialect: Column, usage: Column) -> Column:
    """Usage JSON text in the common form, which cache-schema paths refer to."""
    return F.when(
        dialect == "anthropic", F.to_json(normalize_anthropic(parse_usage(usage)))
    ).otherwise(usage)


def call_tokens(native: Column, tokens: Column) -> tuple[Column, Column]:
    """(prompt, completion) of a ledger row, whichever dialect wrote it; unknown counts as 0."""
    zero = F.lit(0).cast("bigint")
    prompt = F.coalesce(
        native["prompt_tokens"],
        tokens["prompt_tokens"],
        tokens["input_tokens"]
        + F.coalesce(tokens["cache_read_input_tokens"], zero)
        + F.coalesce(tokens["cache_creation_input_tokens"], zero),
        zero,
    )
    completion = F.coalesce(
        native["completion_tokens"], tokens["completion_tokens"], tokens["output_tokens"], zero
    )
    return prompt, completion


def tool_names(tools: Column) -> Column:
    """Names in a ``tools`` VARIANT: ``function.name`` where a function object is given, else
    ``name``; unnamed entries are left out."""
    items = F.try_variant_get(tools, "$", "array<variant>")

    def name_of(tool: Column) -> Column:
        function = _filled_object(F.to_json(F.try_variant_get(tool, "$.function", "variant")))
        return F.when(
            function.isNotNull(), F.try_variant_get(tool, "$.function.name", "string")
        ).otherwise(F.try_variant_get(tool, "$.name", "string"))

    return F.coalesce(
        F.filter(F.transform(items, name_of), lambda n: n.isNotNull() & (n != "")),
        F.array().cast("array<string>"),
    )
