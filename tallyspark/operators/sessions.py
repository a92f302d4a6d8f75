"""Session accounting over a ledger, and the totals built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.rounding import from_units, py_round, to_units
from ..functions.usage import call_tokens
from ..plans.ordered import CHUNK, HOT_ROWS, across_chunks, has_hot_key, in_chunk, tag_chunks, with_position

UNKNOWN_SESSION = "?"
RATIO_DIGITS = 12

_SUMS = (
    "calls", "prompt_tokens", "completion_tokens", "known_cached", "cache_known_calls",
    "cache_known_prompt", "cache_unavailable_calls", "usd_units", "prefix_mutations",
    "mutation_tenths", "cache_miss_unexplained", "injected", "ratio_units", "ratio_calls",
    "step_tenths", "step_calls",
)


def _total(name: str) -> Column:
    """Counts of 10**-12 pass a BIGINT after nine million calls, so those sum as decimals."""
    wide = F.col(name).cast("decimal(28,0)") if name == "ratio_units" else F.col(name)
    return F.sum(wide).alias(name)


def session_key(session: Column) -> Column:
    return F.coalesce(F.nullif(session, F.lit("")), F.lit(UNKNOWN_SESSION))


def call_facts(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """One narrow row of integers and flags per call."""
    cost = F.col("cost")
    prompt, completion = call_tokens(cost["native_tokens"], F.col("usage_tokens"))
    status = F.coalesce(
        F.nullif(cost["cache_status"], F.lit("")),
        pricing.cache_status(cost["observed_flags"], cost["imputed_flags"]),
    )
    known = cost.isNotNull() & (status != "unavailable")
    quality = F.coalesce(F.nullif(F.col("cost_quality"), F.lit("")), pricing.cost_quality(cost))
    mutation = F.col("prefix_mutation")
    ratio = F.col("prefix_stable_ratio")
    tenths = pricing.step_cost_tenths(cost["native_tokens"])

    def flag(c: Column) -> Column:
        return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def if_(c: Column, value: Column) -> Column:
        return F.when(c, F.coalesce(value, F.lit(0))).otherwise(F.lit(0)).cast("bigint")

    keys = [session_key(F.col(k)).alias(k) if k == "session" else F.col(k) for k in by]
    return ledger.select(
        *keys,
        F.when(F.startswith(quality, F.lit("estimated")), F.lit("estimated"))
        .otherwise(quality).alias("_quality"),
        mutation["segments"].alias("_segments"),
        F.nullif(F.col("model"), F.lit("")).alias("_model"),
        F.lit(1).cast("bigint").alias("calls"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        if_(known, cost["native_tokens"]["cached_tokens"]).alias("known_cached"),
        flag(known).alias("cache_known_calls"),
        if_(known, prompt).alias("cache_known_prompt"),
        flag(cost.isNotNull() & (status == "unavailable")).alias("cache_unavailable_calls"),
        if_(cost.isNotNull(), to_units(cost["list_cost_usd"], 8)).alias("usd_units"),
        flag(mutation.isNotNull()).alias("prefix_mutations"),
        if_(mutation.isNotNull(), to_units(mutation["cost_tok_eq"], 1)).alias("mutation_tenths"),
        flag(F.col("cache_miss_unexplained")).alias("cache_miss_unexplained"),
        flag(F.col("gateway_injected")).alias("injected"),
        if_(ratio.isNotNull(), to_units(ratio, RATIO_DIGITS)).alias("ratio_units"),
        flag(ratio.isNotNull()).alias("ratio_calls"),
        if_(tenths.isNotNull(), tenths).alias("step_tenths"),
        flag(tenths.isNotNull()).alias("step_calls"),
    )


def _counted(labels: Column, amounts: Column, base: Column | None = None) -> Column:
    """MAP<label, total> of parallel label and amount arrays."""
    names = F.array_distinct(labels if base is None else F.concat(base, labels))
    pairs = F.arrays_zip(labels.alias("k"), amounts.alias("v"))
    total = lambda name: F.aggregate(
        F.filter(pairs, lambda p: p["k"] == name), F.lit(0).cast("bigint"), lambda a, p: a + p["v"]
    )
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, total(n))))


def compounding_growth(ledger: DataFrame, by: Sequence[str] = ("session",),
                       hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per key: ``series_calls`` and ``carried_growth``.

    ``carried_growth`` is the sum over calls with a prompt of max(next - current, 0) times the
    number of calls that come after the next one.  With i the position of the later call this
    is (n - 1) * sum(g) - sum(g * i), so chunks combine by adding.
    """
    prompt, _ = call_tokens(F.col("cost")["native_tokens"], F.col("usage_tokens"))
    keys = [session_key(F.col(k)).alias(k) if k == "session" else F.col(k) for k in by]
    series = ledger.select(*keys, "call_seq", prompt.alias("_p")).filter(F.col("_p") != 0)
    wide = F.col("_offset").cast("decimal(20,0)")
    weigh = F.coalesce(F.sum((F.col("_g") * F.col("_i")).cast("decimal(28,0)")), F.lit(0))
    if not has_hot_key(ledger.select(*keys), by, hot_rows):
        plain = Window.partitionBy(*by).orderBy("call_seq")
        totals = series.select(
            *by,
            F.greatest(F.col("_p") - F.lag("_p").over(plain), F.lit(0)).alias("_g"),
            (F.row_number().over(plain) - 1).cast("bigint").alias("_i"),
        ).groupBy(*by).agg(
            F.count(F.lit(1)).alias("series_calls"),
            F.coalesce(F.sum(F.col("_g").cast("decimal(20,0)")), F.lit(0)).alias("_growth"),
            weigh.alias("_weighted"),
        )
        return totals.select(*by, "series_calls", _carried().alias("carried_growth"))

    ordered = in_chunk(by, "call_seq")
    grown = tag_chunks(series, by, "call_seq", hot_rows).select(
        *by, CHUNK, "call_seq", "_p",
        F.greatest(F.col("_p") - F.lag("_p").over(ordered), F.lit(0)).alias("_g"),
        (F.row_number().over(ordered) - 1).cast("bigint").alias("_i"),
    )
    chunks = grown.groupBy(*by, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_p", "call_seq").alias("_first"),
        F.max_by("_p", "call_seq").alias("_last"),
        F.coalesce(F.sum("_g"), F.lit(0)).alias("_g"),
        weigh.alias("_gi"),
    )
    over = across_chunks(by)
    before = over.rowsBetween(-(2**31), -1)
    linked = chunks.select(
        *by, "_n", "_g", "_gi",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.coalesce(F.greatest(F.col("_first") - F.lag("_last").over(over), F.lit(0)), F.lit(0)).alias(
            "_edge"
        ),
    )
    totals = linked.groupBy(*by).agg(
        F.sum("_n").alias("series_calls"),
        F.sum((F.col("_g") + F.col("_edge")).cast("decimal(20,0)")).alias("_growth"),
        F.sum(wide * (F.col("_g") + F.col("_edge")).cast("decimal(17,0)") + F.col("_gi")).alias(
            "_weighted"
        ),
    )
    return totals.select(*by, "series_calls", _carried().alias("carried_growth"))


def _carried() -> Column:
    return ((F.col("series_calls") - 1).cast("decimal(12,0)") * F.col("_growth").cast("decimal(24,0)") - F.col("_weighted")).cast("double")


def session_report(ledger: DataFrame, by: Sequence[str] = ("session",),
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """One accounting row per session (or per ``by`` key).

    Cached figures cover only calls whose cache use is known; a session without such a call
    has NULL there.  Calls are first added up per (session, quality, changed segments, model)
    with fixed-width buffers, so a session of any size reaches the second step as a few rows.
    """
    facts = call_facts(ledger, by)
    partial = facts.groupBy(*by, "_quality", "_segments", "_model").agg(
        *[_total(c) for c in _SUMS]
    )
    merged = partial.groupBy(*by).agg(
        *[_total(c) for c in _SUMS],
        F.collect_list(F.struct(F.col("_quality").alias("k"), F.col("calls").alias("v"))).alias("_q"),
        F.collect_list(
            F.when(
                F.size("_segments") > 0,
                F.struct(F.col("_segments").alias("k"), F.col("prefix_mutations").alias("v")),
            )
        ).alias("_s"),
        F.sort_array(F.collect_set("_model")).alias("models"),
    )
    causes = F.flatten(
        F.transform("_s", lambda e: F.transform(e["k"], lambda s: F.struct(s.alias("k"), e["v"].alias("v"))))
    )
    growth = compounding_growth(ledger, by, hot_rows)
    # A call without a readable time has a NULL day, which must find its own growth.
    other = growth.withColumnsRenamed({k: f"_k_{k}" for k in by})
    same = F.lit(True)
    for k in by:
        right = F.col(f"_k_{k}")
        same = same & (F.col(k) == right if k == "session" else F.col(k).eqNullSafe(right))
    joined = merged.withColumn("_s", causes).join(other, same, "left")

    no_cache = F.col("cache_known_calls") == 0
    known = F.when(~no_cache, F.col("known_cached"))
    per = lambda units, n: units / F.nullif(F.col(n).cast("double"), F.lit(0.0))
    n = F.coalesce(F.col("series_calls"), F.lit(0))
    raw = joined.withColumns(
        {
            "_fraction": per(known.cast("double"), "cache_known_prompt"),
            "_usd": from_units(F.col("usd_units"), 8),
            "_ratio": per(from_units(F.col("ratio_units"), RATIO_DIGITS), "ratio_calls"),
            "_step": per(from_units(F.col("step_tenths"), 1), "step_calls"),
        }
    ).withColumn("mean_step_cost_tok_eq", py_round(F.col("_step"), 1))
    saving = raw.withColumn(
        "_saving",
        F.col("mean_step_cost_tok_eq")
        + F.lit(pricing.STEP_WEIGHTS["cached"]) * F.col("carried_growth")
        / F.greatest(n - 1, F.lit(1)).cast("double"),
    )
    return saving.select(
        *by,
        "calls", "prompt_tokens", "completion_tokens",
        known.alias("cached_tokens"),
        py_round(F.col("_fraction"), 4).alias("cached_fraction"),
        "cache_known_calls", "cache_known_prompt", "cache_unavailable_calls",
        py_round(F.col("_usd"), 6).alias("cost_usd"),
        _counted(
            F.col("_q")["k"], F.col("_q")["v"],
            F.array(F.lit("exact"), F.lit("estimated"), F.lit("unavailable")),
        ).alias("cost_quality"),
        "prefix_mutations",
        from_units(F.col("mutation_tenths"), 1).alias("prefix_mutation_cost_tok_eq"),
        _counted(F.col("_s")["k"], F.col("_s")["v"]).alias("mutation_causes"),
        "cache_miss_unexplained", "injected",
        py_round(F.col("_ratio"), 4).alias("mean_prefix_stable_ratio"),
        "models",
        "mean_step_cost_tok_eq",
        F.when(
            (n > 1) & F.col("mean_step_cost_tok_eq").isNotNull(), py_round(F.col("_saving"), 1)
        ).otherwise(F.col("mean_step_cost_tok_eq")).alias("mean_step_saving_tok_eq"),
    )


def step_means(ledger: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """``calls`` and ``mean_step_cost_tok_eq`` of the session report, without its other columns.

    One aggregation of integers that combines before the shuffle; no order of calls is needed.
    """
    sums = call_facts(ledger, by).groupBy(*by).agg(*[_total(c) for c in ("calls", "step_tenths", "step_calls")])
    mean = from_units(F.col("step_tenths"), 1) / F.nullif(F.col("step_calls").cast("double"), F.lit(0.0))
    return sums.select(*by, "calls", py_round(mean, 1).alias("mean_step_cost_tok_eq"))


def day_totals(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over session rows.  An unknown cache stays NULL, and the ratio is the
    unweighted mean of session means."""
    return report.groupBy(*by).agg(
        F.sum("calls").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        from_units(F.sum(to_units(F.col("cost_usd"), 6)), 6).alias("cost_usd"),
        F.sum("cached_tokens").alias("cached_tokens"),
        F.count_if(F.col("cached_tokens").isNull()).alias("cache_unavailable_sessions"),
        F.count(F.lit(1)).alias("sessions"),
        py_round(
            from_units(F.sum(to_units(F.col("mean_prefix_stable_ratio"), 4)), 4)
            / F.nullif(F.count("mean_prefix_stable_ratio").cast("double"), F.lit(0.0)),
            4,
        ).alias("mean_prefix_stable_ratio"),
    )


def report_totals(report: DataFrame) -> DataFrame:
    """The TOTAL row of a session report: sums, quality split, causes by count, step prices.

    Causes and model names ride along as extra rows in one pass over the report, so a name
    meets the others once, however many sessions have it.
    """
    whole = F.col("_cause").isNull() & F.col("_model").isNull()
    priced = F.col("mean_step_cost_tok_eq").isNotNull() & whole
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")

    def entry(cause: Column, count: Column, model: Column) -> Column:
        return F.struct(cause.alias("cause"), count.alias("count"), model.alias("model"))

    entries = F.concat(
        F.array(entry(none, zero, none)),
        F.transform(F.map_entries("mutation_causes"), lambda e: entry(e["key"], e["value"], none)),
        F.transform(F.coalesce("models", F.array().cast("array<string>")), lambda m: entry(none, zero, m)),
    )
    rows = report.withColumn("_e", F.explode(entries)).withColumns(
        {"_cause": F.col("_e")["cause"], "_count": F.col("_e")["count"], "_model": F.col("_e")["model"]}
    )
    calls = F.col("calls")

    def total(value: Column, when: Column = whole) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0))

    def quality(label: str) -> Column:
        return total(F.element_at("cost_quality", F.lit(label)))

    per_cause = rows.groupBy("_cause", "_model").agg(
        total(calls).alias("calls"),
        total(F.col("prompt_tokens")).alias("prompt_tokens"),
        total(F.col("completion_tokens")).alias("completion_tokens"),
        total(to_units(F.col("cost_usd"), 6)).alias("_usd"),
        F.sum(F.when(whole, F.col("cached_tokens"))).alias("cached_tokens"),
        F.count_if(whole & F.col("cached_tokens").isNull()).alias("cache_unknown_sessions"),
        quality("exact").alias("quality_exact"),
        quality("estimated").alias("quality_estimated"),
        quality("unavailable").alias("quality_unavailable"),
        total(F.col("prefix_mutations")).alias("prefix_mutations"),
        total(to_units(F.col("prefix_mutation_cost_tok_eq"), 1)).alias("_mutation"),
        total(to_units(F.col("mean_step_cost_tok_eq"), 1) * calls, priced).alias("_weighted"),
        total(to_units(F.col("mean_step_saving_tok_eq"), 1) * calls, priced).alias("_saving"),
        total(calls, priced).alias("priced_calls"),
        total(F.col("cache_miss_unexplained")).alias("cache_miss_unexplained"),
        F.sum("_count").alias("_cause_count"),
    )
    summed = [
        "calls", "prompt_tokens", "completion_tokens", "_usd", "cache_unknown_sessions",
        "quality_exact", "quality_estimated", "quality_unavailable", "prefix_mutations",
        "_mutation", "_weighted", "_saving", "priced_calls", "cache_miss_unexplained",
    ]
    one = per_cause.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed],
        F.sum("cached_tokens").alias("cached_tokens"),
        F.array_sort(F.collect_set("_model")).alias("models"),
        F.collect_list(
            F.when(
                F.col("_cause").isNotNull(),
                F.struct((-F.col("_cause_count")).alias("n"), F.col("_cause").alias("cause")),
            )
        ).alias("_causes"),
    )
    per_call = lambda c: from_units(F.col(c), 1) / F.nullif(F.col("priced_calls").cast("double"), F.lit(0.0))
    return one.select(
        "calls", "prompt_tokens", "completion_tokens",
        from_units(F.col("_usd"), 6).alias("cost_usd"),
        "cached_tokens", "cache_unknown_sessions", "models",
        "quality_exact", "quality_estimated", "quality_unavailable",
        "prefix_mutations",
        from_units(F.col("_mutation"), 1).alias("prefix_mutation_cost_tok_eq"),
        F.transform(
            F.sort_array("_causes"),
            lambda c: F.struct(c["cause"].alias("cause"), (-c["n"]).alias("count")),
        ).alias("mutation_causes"),
        per_call("_weighted").alias("step_cost_tok_eq"),
        per_call("_saving").alias("step_saving_tok_eq"),
        F.when(F.col("priced_calls") > 0, F.coalesce(
            (F.col("_saving").cast("double") / F.nullif(F.col("_weighted").cast("double"), F.lit(0.0)) - 1)
            * 100, F.lit(0.0))).alias("premium_pct"),
        "cache_miss_unexplained",
    )


def session_costs(ledger: DataFrame) -> DataFrame:
    """Effective cost per session in tenths of a token equivalent, summed over days.

    A day's cost is the mean over *priced* calls times *all* calls of that day.
    """
    daily = step_means(ledger, ("ledger_day", "session"))
    return (
        daily.filter(F.col("mean_step_cost_tok_eq").isNotNull())
        .groupBy("session")
        .agg(F.sum(to_units(F.col("mean_step_cost_tok_eq"), 1) * F.col("calls")).alias("cost_tenths"))
    )


def measured_step_cost(report: DataFrame) -> DataFrame:
    """One row: call-weighted mean step cost over priced sessions (NULL without any).

    ``report`` is a session report, or the cheaper :func:`step_means`.
    """
    priced = report.filter(F.col("mean_step_cost_tok_eq").isNotNull())
    return priced.agg(
        py_round(
            from_units(F.sum(to_units(F.col("mean_step_cost_tok_eq"), 1) * F.col("calls")), 1)
            / F.nullif(F.sum("calls").cast("double"), F.lit(0.0)),
            1,
        ).alias("step_cost_tok_eq")
    )


def _day_events(report: DataFrame, traces: DataFrame, day: str) -> DataFrame:
    return traces.filter(F.startswith("ts", F.lit(day))).join(
        report.select("session"), "session", "left_semi"
    )


def trace_shapes(report: DataFrame, traces: DataFrame, day: str) -> DataFrame:
    """Per session with trace events that day: calls, first and last message count.

    The ordered ratios of the same sessions are in :func:`trace_ratio_lists`.
    """
    return _day_events(report, traces, day).groupBy("session").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.min_by("n_messages", "call_seq").alias("n_messages_first"),
        F.max_by("n_messages", "call_seq").alias("n_messages_last"),
    )


def trace_ratio_lists(report: DataFrame, traces: DataFrame, day: str,
                      part_rows: int = 100_000) -> DataFrame:
    """(session, part, prefix_ratios): the ratios in call order, at most ``part_rows`` per row.

    A session has one row unless it is longer than that; no ratio is left out and no list
    grows with the session.
    """
    events = _day_events(report, traces, day).select("session", "call_seq", "prefix_stable_ratio")
    placed = with_position(events, ["session"], "call_seq", "_pos")
    part = F.floor(F.col("_pos") / part_rows).cast("bigint")
    entries = F.array_sort(F.collect_list(F.struct("_pos", "prefix_stable_ratio")))
    return placed.groupBy("session", part.alias("part")).agg(entries.alias("_r")).select(
        "session", "part", F.col("_r")["prefix_stable_ratio"].alias("prefix_ratios")
    )
