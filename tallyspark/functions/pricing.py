"""List-price cost rows and step costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import py_round, to_units

# Provider-published multipliers of an uncached prompt token.
STEP_WEIGHTS = {"uncached": 1.0, "cached": 0.10, "cache_creation": 1.25, "output": 5.0}
H1_WEIGHTS = (1.0, 0.1, 5.0)
# A changed prefix is written again (1.25) instead of read again (0.10).
PREFIX_MUTATION_MULTIPLIER = 1.15

# Labels and notes.
UNPRICED_CREATION_NOTE = "cache_creation_tokens present but cache_creation_per_1m is null"
NO_ACCOUNTANT_MODEL = "no accountant_model in profile"
ESTIMATED = "estimated_under_no_cache_assumption"

CATEGORIES = ("cached_tokens", "cache_creation_tokens", "reasoning_tokens")

COST_TYPE = (
    "STRUCT<model: STRING, price_date: STRING, "
    "native_tokens: STRUCT<prompt_tokens: BIGINT, uncached_prompt_tokens: BIGINT, "
    "cached_tokens: BIGINT, cache_creation_tokens: BIGINT, completion_tokens: BIGINT, "
    "reasoning_tokens: BIGINT>, "
    "observed_flags: STRUCT<prompt_tokens: BOOLEAN, completion_tokens: BOOLEAN, "
    "cached_tokens: BOOLEAN, cache_creation_tokens: BOOLEAN, reasoning_tokens: BOOLEAN>, "
    "imputed_flags: STRUCT<cached_tokens: BOOLEAN, cache_creation_tokens: BOOLEAN>, "
    "list_price_per_1m: STRUCT<input_per_1m: DOUBLE, cached_input_per_1m: DOUBLE, "
    "output_per_1m: DOUBLE, cache_creation_per_1m: DOUBLE>, "
    "list_cost_usd: DOUBLE, list_cost_note: STRING, cache_status: STRING>"
)


def dig(usage_json: Column, path: Column) -> Column:
    """BIGINT at a data-driven path; NULL when the path is NULL or a hop is missing."""
    pointer = F.concat(F.lit("$['"), F.array_join(path, "']['"), F.lit("']"))
    found = F.call_function("get_json_object", usage_json, pointer)
    return F.when(path.isNotNull(), found.try_cast("bigint"))


# Where providers put a category unless a cache schema says otherwise.
_USUAL = {
    ("prompt_tokens_details", "cached_tokens"), ("prompt_tokens_details", "cache_creation_tokens"),
    ("completion_tokens_details", "reasoning_tokens"),
}


def _at(tokens: Column, usage_json: Column, path: Column) -> Column:
    """The value at a schema path: a typed field for the usual paths, else from the text."""
    value = None
    for group, field in sorted(_USUAL):
        hit = path == F.array(F.lit(group), F.lit(field))
        typed = tokens[group][field]
        value = F.when(hit, typed) if value is None else value.when(hit, typed)
    return value.otherwise(dig(usage_json, path))


def with_cost_row(df: DataFrame, tokens: str, usage_json: Column, model: str, price_date: str,
                  rates: str, spec: str, name: str = "cost") -> DataFrame:
    """Add the cost STRUCT of each call.

    ``tokens`` names the typed usage in the common form and ``usage_json`` is its JSON text,
    read only for an unusual path; ``rates`` is a struct of the four per-million rates and
    ``spec`` a map from cache category to STRUCT<surfaces, path>.  A
    category the route cannot show is never observed and never imputed; one it can show but
    left out is imputed to 0 and flagged.

    Intermediate values are columns of their own, so each is computed once per row.
    """
    zero = F.lit(0).cast("bigint")
    t = F.col(tokens)
    entry = {c: F.try_element_at(F.col(spec), F.lit(c)) for c in CATEGORIES}
    kept = df.columns
    read = df.withColumns(
        {
            "_prompt": t["prompt_tokens"],
            "_completion": t["completion_tokens"],
            **{f"_shows_{c}": F.coalesce(entry[c]["surfaces"], F.lit(False)) for c in CATEGORIES},
            **{
                f"_seen_{c}": F.when(entry[c]["surfaces"], _at(t, usage_json, entry[c]["path"]))
                for c in CATEGORIES
            },
        }
    )
    shows = {c: F.col(f"_shows_{c}") for c in CATEGORIES}
    seen = {c: F.col(f"_seen_{c}") for c in CATEGORIES}
    prompt, completion = F.col("_prompt"), F.col("_completion")
    filled = read.withColumns(
        {
            "_cached": F.coalesce(seen["cached_tokens"], zero),
            "_creation": F.when(
                shows["cache_creation_tokens"], F.coalesce(seen["cache_creation_tokens"], zero)
            ),
        }
    ).withColumn("_uncached", prompt - F.col("_cached") - F.coalesce(F.col("_creation"), zero))
    lines = {
        "_uncached": "input_per_1m", "_cached": "cached_input_per_1m",
        "_creation": "cache_creation_per_1m", "_completion": "output_per_1m",
    }
    raw = filled.withColumns(
        {
            f"_raw{c}": F.col(c).cast("double") / F.lit(1_000_000.0) * F.col(rates)[rate]
            for c, rate in lines.items()
        }
    )
    priced = raw.withColumns({f"_usd{c}": py_round(F.col(f"_raw{c}"), 8) for c in lines})
    nothing = F.lit(0.0)
    total = F.coalesce(F.col("_usd_uncached"), nothing)
    for c in ("_cached", "_creation", "_completion"):
        total = total + F.coalesce(F.col(f"_usd{c}"), nothing)
    summed = priced.withColumn("_total", total)

    unpriced = (F.coalesce(F.col("_creation"), zero) != 0) & F.col(rates)[
        "cache_creation_per_1m"
    ].isNull()
    complete = prompt.isNotNull() & completion.isNotNull()
    observed = F.struct(
        prompt.isNotNull().alias("prompt_tokens"),
        completion.isNotNull().alias("completion_tokens"),
        *[seen[c].isNotNull().alias(c) for c in CATEGORIES],
    )
    imputed = F.struct(
        (shows["cached_tokens"] & seen["cached_tokens"].isNull()).alias("cached_tokens"),
        (~shows["cache_creation_tokens"] | seen["cache_creation_tokens"].isNull()).alias(
            "cache_creation_tokens"
        ),
    )
    row = F.struct(
        F.col(model).alias("model"),
        F.col(price_date).alias("price_date"),
        F.struct(
            prompt.alias("prompt_tokens"),
            F.col("_uncached").alias("uncached_prompt_tokens"),
            F.col("_cached").alias("cached_tokens"),
            F.col("_creation").alias("cache_creation_tokens"),
            completion.alias("completion_tokens"),
            seen["reasoning_tokens"].alias("reasoning_tokens"),
        ).alias("native_tokens"),
        observed.alias("observed_flags"),
        imputed.alias("imputed_flags"),
        F.col(rates).alias("list_price_per_1m"),
        F.when(complete & ~unpriced, py_round(F.col("_total"), 8)).alias("list_cost_usd"),
        F.when(complete & unpriced, F.lit(UNPRICED_CREATION_NOTE)).alias("list_cost_note"),
        cache_status(observed, imputed).alias("cache_status"),
    )
    return summed.select(*kept, row.alias(name))


def cache_status(observed: Column, imputed: Column) -> Column:
    """observed / imputed_zero / unavailable.  A cost row without flags is taken as given."""
    return (
        F.when(observed["cached_tokens"], F.lit("observed"))
        .when(imputed["cached_tokens"], F.lit("imputed_zero"))
        .when(observed.isNull(), F.lit("observed"))
        .otherwise(F.lit("unavailable"))
    )


def cost_quality(cost: Column) -> Column:
    """exact, estimated, or (without a cost) unavailable."""
    prices, observed = cost["list_price_per_1m"], cost["observed_flags"]

    def hidden(category: str, rate: str) -> Column:
        return (
            ~F.coalesce(observed[category], F.lit(False))
            & prices[rate].isNotNull()
            & ~prices[rate].eqNullSafe(prices["input_per_1m"])
        )

    return (
        F.when(cost.isNull(), F.lit("unavailable"))
        .when(
            hidden("cached_tokens", "cached_input_per_1m")
            | hidden("cache_creation_tokens", "cache_creation_per_1m"),
            F.lit(ESTIMATED),
        )
        .otherwise(F.lit("exact"))
    )


def _step_cost_raw(native: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    prompt, completion = native["prompt_tokens"], native["completion_tokens"]
    cached = F.coalesce(native["cached_tokens"], zero)
    creation = F.coalesce(native["cache_creation_tokens"], zero)
    uncached = F.greatest(prompt - cached - creation, zero)
    w = STEP_WEIGHTS
    value = (
        F.lit(w["uncached"]) * uncached.cast("double")
        + F.lit(w["cached"]) * cached.cast("double")
        + F.lit(w["cache_creation"]) * creation.cast("double")
        + F.lit(w["output"]) * completion.cast("double")
    )
    return F.when(prompt.isNotNull() & completion.isNotNull(), value)


def step_cost(native: Column) -> Column:
    """Effective cost of one step in token equivalents, one decimal."""
    return py_round(_step_cost_raw(native), 1)


def step_cost_tenths(native: Column) -> Column:
    """The same cost as a BIGINT count of tenths, for exact sums."""
    return to_units(_step_cost_raw(native), 1)


def effective_cost_h1(tokens: Column, weights: tuple[float, float, float] = H1_WEIGHTS) -> Column:
    """Weighted uncached + cached + output tokens of a usage struct; NULL if incomplete.

    Reads the cached count from raw usage whatever the route's schema says, and ignores
    cache writes.
    """
    zero = F.lit(0).cast("bigint")
    prompt, completion = tokens["prompt_tokens"], tokens["completion_tokens"]
    cached = F.coalesce(tokens["prompt_tokens_details"]["cached_tokens"], zero)
    w_in, w_cached, w_out = (F.lit(float(w)) for w in weights)
    return F.when(
        prompt.isNotNull() & completion.isNotNull(),
        w_in * F.greatest(prompt - cached, zero).cast("double")
        + w_cached * cached.cast("double")
        + w_out * completion.cast("double"),
    )


def unexplained_miss(mutation: Column, cost: Column) -> Column:
    """An observed cache read of 0 although the prefix did not change."""
    return (
        mutation.isNull()
        & cost.isNotNull()
        & F.coalesce(cost["native_tokens"]["cached_tokens"] == 0, F.lit(False))
        & F.coalesce(cost["observed_flags"]["cached_tokens"], F.lit(False))
    )
