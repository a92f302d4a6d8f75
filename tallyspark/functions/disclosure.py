"""Allowlist projections used when ledgers and traces are shared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed enums and the length bound of the shared schema.
ROLES = ("system", "user", "assistant", "tool")
PATHS = ("/v1/chat/completions", "/v1/completions", "/v1/messages")
DIALECTS = ("openai", "anthropic")
MAX_STRING = 120
TOP_KEYS = (
    "prompt_tokens", "completion_tokens", "total_tokens", "input_tokens", "output_tokens",
    "reasoning_tokens", "cache_read_input_tokens", "cache_creation_input_tokens",
)
DETAIL_KEYS = ("cached_tokens", "cache_creation_tokens", "reasoning_tokens")


def closed(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit("other"))


def _all_null(struct: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[struct[k] for k in keys]).isNull()


def clean_usage(tokens: Column) -> Column:
    """Allowlisted numeric fields of a typed usage struct; NULL when none is left."""
    details = {
        d: F.when(~_all_null(tokens[d], DETAIL_KEYS), tokens[d])
        for d in ("prompt_tokens_details", "completion_tokens_details")
    }
    nothing = _all_null(tokens, TOP_KEYS)
    for d in details.values():
        nothing = nothing & d.isNull()
    return F.when(
        ~nothing,
        F.struct(*[tokens[k].alias(k) for k in TOP_KEYS], *[c.alias(d) for d, c in details.items()]),
    )


def clean_cost(cost: Column) -> Column:
    return F.when(
        cost.isNotNull(),
        F.struct(
            cost["native_tokens"].alias("native_tokens"),
            cost["list_cost_usd"].alias("list_cost_usd"),
            cost["cache_status"].alias("cache_status"),
        ),
    )


def error_enum(error: Column) -> Column:
    text = F.lower(error)

    def has(part: str) -> Column:
        return F.contains(text, F.lit(part))

    return (
        F.when(F.coalesce(error, F.lit("")) == "", F.lit(None))
        .when(has("no dated price sheet"), F.lit("missing_price_sheet"))
        .when(has("not in price sheet") | has("no cache schema"), F.lit("unknown_model"))
        .when(has("accountant_model"), F.lit("no_profile"))
        .otherwise(F.lit("other"))
    )


def pseudonym(model: Column) -> Column:
    """Stable stand-in for a model name; NULL or empty stays NULL."""
    digest = F.substring(F.sha2(model.cast("binary"), 256), 1, 8)
    return F.when(F.coalesce(model, F.lit("")) != "", F.concat(F.lit("model-"), digest))


def refuse_long_strings(fields: dict[str, Column], where: str) -> Column:
    """A filter condition that fails the job when any field is longer than the bound."""
    condition = F.lit(True)
    for name, value in fields.items():
        condition = F.when(
            F.length(value) > MAX_STRING,
            F.raise_error(
                F.format_string(
                    f"content-leak guard: field '{name}' in {where} is %d chars - refusing to package",
                    F.length(value),
                )
            ).cast("boolean"),
        ).otherwise(condition)
    return condition
