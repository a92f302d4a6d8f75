"""Raw calls to ledger and trace rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.text import ledger_day
from ..functions.usage import normalized_tokens, normalized_usage_json, parse_usage
from ..plans.local import columns_of, local_table
from ..plans.ordered import HOT_ROWS
from ..plans.staging import stage
from ..schemas import LEDGER, PROFILES, TRACE
from .calls import parse_calls
from .chaining import chain_sessions
from .prefix import compare_messages, differing_prefix, link_previous, mutation, stable_ratio

_RATES = ("input_per_1m", "cached_input_per_1m", "output_per_1m", "cache_creation_per_1m")


@dataclass
class AuditTables:
    ledger: DataFrame
    traces: DataFrame


def routes(profiles: DataFrame, prices: DataFrame, cache_schemas: DataFrame) -> DataFrame:
    """One row per dialect: the model and date to price with, its rates and cache schema, or
    the reason why it cannot be priced."""
    spec = cache_schemas.groupBy("accountant_model").agg(
        F.map_from_entries(
            F.collect_list(F.struct("category", F.struct("surfaces", "path")))
        ).alias("spec")
    )
    dated = prices.select("price_date").distinct().withColumn("_dated", F.lit(True))
    sheet = prices.select("price_date", "accountant_model", F.struct(*_RATES).alias("rates"))
    date = F.coalesce("price_date", F.lit("None"))
    model = F.nullif(F.col("accountant_model"), F.lit(""))
    error = (
        F.when(model.isNull(), F.lit(pricing.NO_ACCOUNTANT_MODEL))
        .when(F.col("_dated").isNull(), F.concat(F.lit("no dated price sheet for "), date))
        .when(F.col("rates").isNull(),
              F.concat(F.lit("model "), model, F.lit(" not in price sheet "), date))
        .when(F.col("spec").isNull(), F.concat(F.lit("no cache schema for provider/model "), model))
    )
    return (
        profiles.select("dialect", "accountant_model", "price_date")
        .join(dated, "price_date", "left")
        .join(sheet, ["price_date", "accountant_model"], "left")
        .join(spec, "accountant_model", "left")
        .select("dialect", "accountant_model", "price_date", "rates", "spec",
                error.alias("route_error"))
    )


def price_calls(calls: DataFrame, profiles: DataFrame, prices: DataFrame,
                cache_schemas: DataFrame) -> DataFrame:
    """Add ``cost``, ``cost_error`` and ``cost_quality`` to rows with dialect and usage."""
    priced = calls.join(
        routes(profiles, prices, cache_schemas), "dialect", "left"
    )
    typed = (
        F.col("usage_tokens") if "usage_tokens" in calls.columns else parse_usage(F.col("usage"))
    )
    normalized = priced.withColumn("_t0", typed).withColumn(
        "_t", normalized_tokens(F.col("dialect"), F.col("_t0"))
    )
    text = normalized_usage_json(F.col("dialect"), F.col("usage"))
    reason = F.when(
        F.col("usage").isNotNull(),
        F.when(F.col("accountant_model").isNull(), F.lit(pricing.NO_ACCOUNTANT_MODEL)).otherwise(
            F.col("route_error")
        ),
    )
    rows = pricing.with_cost_row(
        normalized.withColumn("cost_error", reason), "_t", text, "accountant_model", "price_date",
        "rates", "spec", "_cost",
    )
    priced_call = F.col("usage").isNotNull() & F.col("cost_error").isNull()
    return (
        rows.withColumn("cost", F.when(priced_call, F.col("_cost")))
        .withColumn("cost_quality", pricing.cost_quality(F.col("cost")))
        .select(*calls.columns, "cost", "cost_error", "cost_quality")
    )


def recompute(usage_rows: DataFrame, prices: DataFrame, cache_schemas: DataFrame, model: str,
              price_date: str) -> DataFrame:
    """Price a table of common-form ``usage`` texts with one model and date."""
    one = local_table(
        usage_rows.sparkSession, [("recompute", "recompute", model, price_date)], PROFILES
    )
    tagged = usage_rows.withColumn("dialect", F.lit("recompute"))
    return price_calls(tagged, one, prices, cache_schemas).drop("dialect")


def assign_sessions(calls: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``session``: the given id, the id of an empty call's prompt, or a chained session.

    Only calls that need chaining are joined with its result, and nothing is scanned when
    every call carries an id.
    """
    chained = F.col("header").isNull() & (F.col("n_messages") > 0)
    if calls.filter(chained).limit(1).count() == 0:
        return calls.withColumn("session", F.coalesce("header", "auto_id"))
    direct = calls.filter(~chained).withColumn("session", F.coalesce("header", "auto_id"))
    assigned = stage(chain_sessions(calls, hot_rows), "sessions")
    found = calls.filter(chained).join(assigned, "call_seq")
    return direct.unionByName(found.select(*direct.columns))


def build_ledger(call_raw: DataFrame, profiles: DataFrame, prices: DataFrame,
                 cache_schemas: DataFrame, hot_rows: int = HOT_ROWS) -> AuditTables:
    """Meter raw calls.

    Bodies are read and parsed once, into a staged table; sessions, previous-call links and
    prices read its narrow columns, and the comparison of rewritten messages its texts.  The linked rows are staged too, because the ledger, the traces and
    the text comparison all read them, and so is the outcome of that comparison.
    """
    calls = stage(parse_calls(call_raw), "calls")
    linked = link_previous(assign_sessions(calls, hot_rows), hot_rows)
    compared = stage(
        compare_messages(linked.withColumn("prefix_mutation", mutation())).drop(
            "prev_segments", "prev_prompt_tokens"
        ),
        "linked",
    )
    lcp = stage(differing_prefix(compared, calls), "lcp")
    settled = compared.filter(~F.col("texts_differ")).withColumn("lcp", F.lit(None).cast("int"))
    rewritten = compared.filter("texts_differ").join(lcp, "call_seq", "left")
    rows = settled.unionByName(rewritten.select(*settled.columns)).withColumn(
        "prefix_stable_ratio", stable_ratio(F.col("lcp"))
    )
    priced = price_calls(rows, profiles, prices, cache_schemas)
    ledger = priced.withColumns(
        {
            "ledger_day": ledger_day(F.col("ts")),
            "cache_miss_unexplained": pricing.unexplained_miss(F.col("prefix_mutation"), F.col("cost")),
        }
    ).select(*columns_of(LEDGER))
    traces = rows.select(*columns_of(TRACE))
    return AuditTables(ledger, traces)
