"""Message content: flattening, observation tests, caps and text write-back.

A message is ``role``, ``blocks ARRAY<STRUCT<type, text>>`` and ``content_is_string``.  String
content is held as a single text block; a block without text has NULL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts and defaults of the two transforms.
STUB = "[observation elided by retroactive masking]"
CAP_MARKER = "[admission-cap:"
CHARS_PER_TOKEN = 4
CAP_TOKENS = 800
CAP_LINES = 512
THRESHOLD_TOKENS = 24000
MIN_OBS_TOKENS = 800

_TRAILING_BLANKS = " \t\n\r\x0b\x0c"


def flatten(blocks: Column) -> Column:
    """Text blocks joined by newlines."""
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def is_tool_observation(role: Column, blocks: Column, content_is_string: Column) -> Column:
    """A tool message with text: any text block in a list, or a non-empty string."""
    as_list = F.exists(blocks, lambda b: b["text"].isNotNull())
    return (role == "tool") & F.coalesce(
        F.when(content_is_string, F.length(flatten(blocks)) > 0).otherwise(as_list), F.lit(False)
    )


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(text) / CHARS_PER_TOKEN))


def already_capped(text: Column) -> Column:
    tail = F.rtrim(text, F.lit(_TRAILING_BLANKS))
    return F.contains(text, F.lit(CAP_MARKER)) & (
        F.endswith(tail, F.lit("tokens]")) | F.endswith(tail, F.lit("lines]"))
    )


def cap_by_tokens(text: Column, cap_tokens: int = CAP_TOKENS) -> Column:
    limit = cap_tokens * CHARS_PER_TOKEN
    note = f"\n{CAP_MARKER} truncated to {cap_tokens} tokens]"
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))
    ).otherwise(text)


def cap_by_lines(text: Column, cap_lines: int = CAP_LINES) -> Column:
    note = f"\n{CAP_MARKER} truncated to {cap_lines} lines]"
    lines = F.split(text, "\n", -1)
    return F.when(
        F.size(lines) > cap_lines,
        F.concat(F.array_join(F.slice(lines, 1, cap_lines), "\n"), F.lit(note)),
    ).otherwise(text)


def set_text(blocks: Column, text: Column) -> Column:
    """The first text block gets the text, later text blocks become empty; others stay."""
    first = F.array_position(
        F.transform(blocks, lambda b: b["text"].isNotNull()), F.lit(True)
    )
    return F.transform(
        blocks,
        lambda b, i: F.when(b["text"].isNull(), b)
        .when(i + 1 == first, b.withField("text", text))
        .otherwise(b.withField("text", F.lit(""))),
    )
