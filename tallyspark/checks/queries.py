"""The named queries.  Each works on whole tables derived from the driver's Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import economics, pricing, stats
from ..functions import messages as msg
from ..functions.text import canonical_json, safe_session
from ..functions.trajectory import shape
from ..functions.usage import normalize_anthropic
from ..operators import acceptance, experiment, privacy, probing, sessions, skills, transforms
from ..operators.ledger import AuditTables, build_ledger
from ..plans.ordered import with_position
from ..plans.ranking import global_rank
from ..plans.staging import stage, staging_root
from ..schemas import TRACE_JSON
from ..sources import derived, dimensions, ledgers, outcomes, trajectories
from ..sources.dimensions import builtin_cache_schemas, builtin_prices
from .sqltext import CALLS, LINKS, TURNS, dbl, report_ctes, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple, AuditTables] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def stored(spark: SparkSession, sf_dir: str, kind: str = "events") -> AuditTables:
    """The ledger and traces as stored tables, written once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED:
        raw = {
            "events": derived.event_calls,
            "named": lambda s, d: derived.conversation_calls(s, d, named=True),
            "chained": derived.conversation_calls,
        }[kind](spark, sf_dir)
        if kind != "events":  # events are dealt out before their bodies are built
            raw = raw.repartition(spark.sparkContext.defaultParallelism)
        built = build_ledger(stage(raw, "raw"), *derived.dimensions(spark))
        _STORED[key] = AuditTables(stage(built.ledger, "ledger"), stage(built.traces, "traces"))
    return _STORED[key]


def flat_report(report: DataFrame, *keys: str) -> DataFrame:
    """Session rows with maps and arrays as plain columns."""
    quality = lambda q: F.element_at("cost_quality", F.lit(q)).alias(f"quality_{q}")
    cause = lambda c: F.coalesce(
        F.try_element_at("mutation_causes", F.lit(c)), F.lit(0)).alias(f"cause_{c}")
    return report.select(
        *keys, "calls", "prompt_tokens", "completion_tokens", "cached_tokens", "cached_fraction",
        "cache_known_calls", "cache_known_prompt", "cache_unavailable_calls", "cost_usd",
        quality("exact"), quality("estimated"), quality("unavailable"), "prefix_mutations",
        "prefix_mutation_cost_tok_eq", cause("tools"), cause("system"), cause("model"),
        "cache_miss_unexplained", "injected", "mean_prefix_stable_ratio",
        F.array_join("models", ",").alias("models"), "mean_step_cost_tok_eq", "mean_step_saving_tok_eq",
    )


# --- Metering -------------------------------------------------------------------------------

@query("session_report", report_ctes("session") + " SELECT * FROM report")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_report(sessions.session_report(stored(spark, sf_dir).ledger), "session")


@query("session_report_by_day",
       report_ctes("day, session").replace("USING (day, session)", "USING (day, session)")
       + " SELECT CAST(day AS VARCHAR) AS ledger_day, * EXCLUDE (day) FROM report")
def session_report_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = sessions.session_report(stored(spark, sf_dir).ledger, ("ledger_day", "session"))
    return flat_report(report, "ledger_day", "session").withColumn(
        "ledger_day", F.col("ledger_day").cast("string"))


_LEDGER_COLUMNS = """seq AS call_seq, session, dialect, model,
  CAST(k * 2 AS DOUBLE) AS latency_ms, k % 6 = 0 AS gateway_injected,
  kind = 'error' AND k % 2 = 1 AS tap_truncated,
  CASE WHEN NOT parsed THEN 'JSONDecodeError' END AS request_parse_error"""


@query("call_costs", f"""WITH {CALLS} SELECT seq AS call_seq, dialect,
  CASE WHEN has_cost THEN p END AS prompt_tokens, CASE WHEN has_cost THEN k END AS completion_tokens,
  CASE WHEN has_cost THEN uncached END AS uncached_prompt_tokens,
  CASE WHEN has_cost THEN cached END AS cached_tokens, created AS cache_creation_tokens,
  CASE WHEN first THEN k // 2 END AS reasoning_tokens,
  CASE WHEN has_cost THEN second AND shown END AS cached_observed,
  CASE WHEN has_cost THEN second AND NOT shown END AS cached_imputed,
  CASE WHEN has_cost THEN NOT (second AND shown) END AS creation_imputed,
  CAST(usd8 AS DOUBLE) / 1e8 AS list_cost_usd,
  CASE WHEN first THEN 'unavailable' WHEN second AND shown THEN 'observed'
       WHEN second THEN 'imputed_zero' END AS cache_status,
  CASE WHEN first OR (second AND NOT shown) THEN 'estimated_under_no_cache_assumption'
       WHEN second THEN 'exact' ELSE 'unavailable' END AS cost_quality,
  CASE WHEN used AND NOT has_cost THEN 'no accountant_model in profile' END AS cost_error FROM step""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = "cost.native_tokens."
    return stored(spark, sf_dir).ledger.select(
        "call_seq", "dialect", native + "prompt_tokens", native + "completion_tokens",
        native + "uncached_prompt_tokens", native + "cached_tokens", native + "cache_creation_tokens",
        native + "reasoning_tokens", F.col("cost.observed_flags.cached_tokens").alias("cached_observed"),
        F.col("cost.imputed_flags.cached_tokens").alias("cached_imputed"),
        F.col("cost.imputed_flags.cache_creation_tokens").alias("creation_imputed"),
        "cost.list_cost_usd", "cost.cache_status", "cost_quality", "cost_error")


@query("ledger_rows", f"""WITH {CALLS}, {LINKS} SELECT {_LEDGER_COLUMNS},
  CAST(day AS VARCHAR) AS ledger_day,
  coalesce(NOT mutated AND second AND shown AND cached = 0, FALSE) AS cache_miss_unexplained FROM linked""")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).ledger.select(
        "call_seq", "session", "dialect", "model", "latency_ms", "gateway_injected", "tap_truncated",
        "request_parse_error", F.col("ledger_day").cast("string").alias("ledger_day"),
        "cache_miss_unexplained")


@query("usage_extraction", f"""WITH {CALLS} SELECT seq AS call_seq,
  CASE WHEN used AND NOT second THEN p END AS prompt_tokens,
  CASE WHEN used AND NOT second THEN k END AS completion_tokens,
  CASE WHEN used AND NOT second THEN hit END AS detail_cached,
  CASE WHEN used AND NOT second THEN k // 2 END AS detail_reasoning,
  CASE WHEN second THEN CASE WHEN shown THEN p - hit - made ELSE p END END AS input_tokens,
  CASE WHEN second THEN k END AS output_tokens,
  CASE WHEN second AND shown THEN hit END AS read_tokens,
  CASE WHEN second AND shown THEN made END AS written_tokens,
  CASE WHEN second THEN p END AS normalized_prompt FROM step""")
def usage_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = "usage_tokens."
    return stored(spark, sf_dir).ledger.select(
        "call_seq", u + "prompt_tokens", u + "completion_tokens",
        F.col(u + "prompt_tokens_details.cached_tokens").alias("detail_cached"),
        F.col(u + "completion_tokens_details.reasoning_tokens").alias("detail_reasoning"),
        u + "input_tokens", u + "output_tokens",
        F.col(u + "cache_read_input_tokens").alias("read_tokens"),
        F.col(u + "cache_creation_input_tokens").alias("written_tokens"),
        normalize_anthropic(F.col("usage_tokens"))["prompt_tokens"].alias("normalized_prompt"))


@query("step_costs", f"""WITH {CALLS} SELECT seq AS call_seq, step_cost AS step_cost_tok_eq,
  CASE WHEN used AND NOT second THEN CAST(greatest(p - hit, 0) AS DOUBLE)
    + {dbl(0.1)} * CAST(hit AS DOUBLE) + {dbl(5.0)} * CAST(k AS DOUBLE) END AS h1_cost FROM step""")
def step_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).ledger.select(
        "call_seq", pricing.step_cost(F.col("cost.native_tokens")).alias("step_cost_tok_eq"),
        pricing.effective_cost_h1(F.col("usage_tokens")).alias("h1_cost"))


@query("recomputed_costs", f"""WITH {CALLS} SELECT seq AS call_seq,
  CASE WHEN NOT second THEN p - hit END AS uncached,
  CASE WHEN NOT second THEN CAST((p - hit) * 300 + hit * 30 + k * 1500 AS DOUBLE) / 1e8 END AS list_cost_usd
  FROM step WHERE used""")
def recomputed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ledger import recompute

    usage = stored(spark, sf_dir).ledger.filter(F.col("usage").isNotNull())
    return recompute(
        usage.select("call_seq", "usage"), builtin_prices(spark), builtin_cache_schemas(spark),
        "anthropic/claude-cache", "2026-07-15",
    ).select("call_seq", F.col("cost.native_tokens.uncached_prompt_tokens").alias("uncached"),
             "cost.list_cost_usd")


@query("prefix_mutations", f"""WITH {CALLS}, {LINKS} SELECT seq AS call_seq,
  concat_ws(',', CASE WHEN d_tools THEN 'tools' END, CASE WHEN d_sys THEN 'system' END,
                 CASE WHEN d_model THEN 'model' END) AS segments,
  concat_ws(',', CASE WHEN coalesce(tools, '') = 'rg' AND coalesce(p_tools, '') <> 'rg' THEN 'grep' END,
                 CASE WHEN tools IS NOT NULL AND p_tools IS NULL THEN 'read' END) AS tools_added,
  concat_ws(',', CASE WHEN coalesce(p_tools, '') = 'rg' AND coalesce(tools, '') <> 'rg' THEN 'grep' END,
                 CASE WHEN p_tools IS NOT NULL AND tools IS NULL THEN 'read' END) AS tools_removed,
  mut_cost AS cost_tok_eq,
  CASE WHEN p_prompt IS NULL THEN 'unavailable' ELSE 'observed_prev_prompt_tokens' END AS cost_basis
  FROM linked WHERE mutated""")
def prefix_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = "prefix_mutation."
    return stored(spark, sf_dir).ledger.filter(F.col("prefix_mutation").isNotNull()).select(
        "call_seq", F.array_join(m + "segments", ",").alias("segments"),
        F.array_join(m + "tools_added", ",").alias("tools_added"),
        F.array_join(m + "tools_removed", ",").alias("tools_removed"),
        m + "cost_tok_eq", m + "cost_basis")


@query("prefix_ratios", f"WITH {CALLS}, {LINKS} SELECT seq AS call_seq, ratio AS prefix_stable_ratio FROM linked")
def prefix_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).ledger.select("call_seq", "prefix_stable_ratio")


_CONVERSATION_RATIO = """
cw AS (SELECT *, lag(canon) OVER (PARTITION BY conv_id ORDER BY t) AS before FROM ccalls),
cl AS (SELECT *, length(before) - 1 AS base_len, conv_id % 3 = 0 AND t = 4 AS edited FROM cw),
-- Only the first message changes, by a suffix to its text.
first_text AS (SELECT conv_id, length(CAST(to_json(text) AS VARCHAR)) AS chars FROM conversations WHERE turn = 0)
SELECT seq AS call_seq, CASE WHEN before IS NULL THEN NULL
  WHEN edited THEN CAST(1 + 11 + chars - 1 AS DOUBLE) / CAST(base_len AS DOUBLE) ELSE 1.0 END AS prefix_stable_ratio
FROM cl JOIN first_text USING (conv_id)"""


@query("conversation_prefix_ratios", f"WITH {TURNS}, {_CONVERSATION_RATIO}")
def conversation_prefix_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "named").ledger.select("call_seq", "prefix_stable_ratio")


@query("chained_sessions", f"""WITH {TURNS},
roots AS (SELECT conv_id, t, 'auto-' || substr(sha256(canon), 1, 10) AS sid FROM ccalls
          WHERE t = 0 OR (t = 4 AND conv_id % 3 = 0))
SELECT c.seq AS call_seq, arg_max(r.sid, r.t) AS session
FROM ccalls c JOIN roots r ON c.conv_id = r.conv_id AND r.t <= c.t GROUP BY c.seq""")
def chained_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "chained").ledger.select("call_seq", "session")


@query("trace_rows", f"""WITH {TURNS} SELECT 'c' || conv_id AS session, seq AS call_seq,
  CAST(n_messages AS INTEGER) AS n_messages, roles, hashes, bytes FROM ccalls""")
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "named").traces.select(
        "session", "call_seq", "n_messages", F.array_join("roles", ",").alias("roles"),
        F.array_join("message_sha256", ",").alias("hashes"),
        F.array_join(F.transform("message_bytes", lambda b: b.cast("string")), ",").alias("bytes"))


@query("streamed_ledger", f"""WITH {TURNS},
roots AS (SELECT conv_id, t, 'auto-' || substr(sha256(canon), 1, 10) AS sid FROM ccalls
          WHERE t = 0 OR (t = 4 AND conv_id % 3 = 0))
SELECT c.seq AS call_seq, arg_max(r.sid, r.t) AS session, c.canon LIKE '[%' AS parsed,
  CASE WHEN max(r.t) = max(c.t) THEN NULL ELSE 1.0 END AS prefix_stable_ratio
FROM ccalls c JOIN roots r ON c.conv_id = r.conv_id AND r.t <= c.t GROUP BY c.seq, c.canon""".replace(
    "1.0 END", "CAST(1.0 AS DOUBLE) END"))
def streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a stream of calls without ids, through the stateful operator."""

    from ..schemas import CALL_RAW
    from ..streaming.live import start_ledger_stream

    base = f"{staging_root(spark)}/tallyspark/stream-{uuid.uuid4().hex}"
    derived.conversation_calls(spark, sf_dir).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(CALL_RAW).parquet(f"{base}/in")
    running = start_ledger_stream(stream, *derived.dimensions(spark), f"{base}/out", f"{base}/checkpoint")
    running.awaitTermination()
    return spark.read.parquet(f"{base}/out/ledger").select(
        "call_seq", "session", F.col("request_parse_error").isNull().alias("parsed"), "prefix_stable_ratio")


@query("streamed_totals", f"""WITH {CALLS} SELECT CAST(day AS VARCHAR) AS ledger_day, session, count(*) AS calls,
  CAST(sum(CASE WHEN used THEN p ELSE 0 END) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN used THEN k ELSE 0 END) AS BIGINT) AS completion_tokens,
  CAST(sum(CASE WHEN second THEN cached END) AS BIGINT) AS cached_tokens,
  CAST(sum(coalesce(usd8, 0)) AS DOUBLE) / 1e8 AS cost_usd FROM step GROUP BY day, session""")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running day and session totals over the ledger read as a stream, after its last batch.

    Update mode writes each changed row again; the newest version of a row is its total.
    """

    from ..streaming.live import running_totals

    base = f"{staging_root(spark)}/tallyspark/totals-{uuid.uuid4().hex}"
    ledger = stored(spark, sf_dir).ledger
    ledger.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    running_totals(stream).writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.parquet(f"{base}/out")
    sums = ["calls", "prompt_tokens", "completion_tokens", "cached_tokens", "cost_usd"]
    return versions.groupBy(F.col("ledger_day").cast("string").alias("ledger_day"), "session").agg(
        F.max_by(F.struct(*sums), "batch_id").alias("s")).select("ledger_day", "session", "s.*")


@query("streamed_broken_calls", f"""WITH {CALLS} SELECT seq AS call_seq, session,
  CASE WHEN NOT parsed THEN 'JSONDecodeError' END AS request_parse_error, kind = 'error' AND k % 2 = 1 AS tap_truncated,
  (SELECT count(*) FROM step) AS calls, (SELECT count(*) FROM step WHERE NOT parsed) AS unread,
  (SELECT count(*) FROM step WHERE kind = 'error' AND k % 2 = 1) AS truncated
  FROM step WHERE NOT parsed OR (kind = 'error' AND k % 2 = 1)""")
def streamed_broken_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that could not be read, set aside by the stream, with the counts that it observed."""
    from ..schemas import CALL_RAW
    from ..streaming.live import start_ledger_stream

    base = f"{staging_root(spark)}/tallyspark/broken-{uuid.uuid4().hex}"
    # A file of the stream is read by one task; two batches keep all cores at work.
    cores = spark.sparkContext.defaultParallelism
    derived.event_calls(spark, sf_dir).repartition(3 * cores).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(CALL_RAW).option("maxFilesPerTrigger", 2 * cores).parquet(f"{base}/in")
    start_ledger_stream(stream, *derived.dimensions(spark), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    seen = spark.read.parquet(f"{base}/out/metrics").agg(*[F.sum(c).alias(c) for c in ("calls", "unread", "truncated")])
    broken = spark.read.parquet(f"{base}/out/broken")
    return broken.select("call_seq", "session", "request_parse_error", "tap_truncated", *[
        seen.select(c).scalar().alias(c) for c in ("calls", "unread", "truncated")])


# --- Totals ---------------------------------------------------------------------------------

_DAY_TOTALS = f"""
dt AS (SELECT CAST(day AS VARCHAR) AS ledger_day, CAST(sum(calls) AS BIGINT) AS calls,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 AS cost_usd,
  CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
  count(*) FILTER (cached_tokens IS NULL) AS cache_unavailable_sessions, count(*) AS sessions,
  CAST(sum(CAST(round(mean_prefix_stable_ratio * 1e4) AS BIGINT)) AS DOUBLE) / 1e4
    / nullif(CAST(count(mean_prefix_stable_ratio) AS DOUBLE), 0) AS mean_raw
  FROM report GROUP BY day)
SELECT * EXCLUDE (mean_raw), {rounded('mean_raw', 4)} AS mean_prefix_stable_ratio FROM dt"""


@query("day_totals", report_ctes("day, session") + "," + _DAY_TOTALS)
def day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = sessions.session_report(stored(spark, sf_dir).ledger, ("ledger_day", "session"))
    return sessions.day_totals(report, ("ledger_day",)).withColumn(
        "ledger_day", F.col("ledger_day").cast("string"))


_TENTHS = "CAST(round({0} * 10) AS BIGINT)"
_WEIGHTED = f"sum({_TENTHS.format('mean_step_cost_tok_eq')} * calls)"
_SAVING = f"sum({_TENTHS.format('mean_step_saving_tok_eq')} * calls)"


@query("streamed_day_totals", report_ctes("day, session") + "," + _DAY_TOTALS)
def streamed_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the day totals, kept by a stream of several batches over the ledger."""
    from ..streaming.live import day_totals_of, start_day_totals

    base = f"{staging_root(spark)}/tallyspark/day-totals-{uuid.uuid4().hex}"
    ledger = stored(spark, sf_dir).ledger
    cores = spark.sparkContext.defaultParallelism
    ledger.repartition(6 * cores).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 2 * cores).parquet(f"{base}/in")
    start_day_totals(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    versions = spark.read.parquet(f"{base}/out")
    last = versions.agg(F.max("version").alias("version"))
    return day_totals_of(versions.join(last, "version")).withColumn("ledger_day", F.col("ledger_day").cast("string"))


@query("report_totals", report_ctes("session") + f"""
SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 AS cost_usd,
  CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
  count(*) FILTER (cached_tokens IS NULL) AS cache_unknown_sessions,
  (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM linked) AS models,
  CAST(sum(quality_exact) AS BIGINT) AS quality_exact,
  CAST(sum(quality_estimated) AS BIGINT) AS quality_estimated,
  CAST(sum(quality_unavailable) AS BIGINT) AS quality_unavailable,
  CAST(sum(prefix_mutations) AS BIGINT) AS prefix_mutations,
  CAST(sum({_TENTHS.format('prefix_mutation_cost_tok_eq')}) AS DOUBLE) / 10.0 AS prefix_mutation_cost_tok_eq,
  (SELECT string_agg(cause || ':' || n, ',' ORDER BY n DESC, cause) FROM
     (SELECT 'tools' AS cause, count(*) FILTER (d_tools) AS n FROM linked UNION ALL
      SELECT 'system', count(*) FILTER (d_sys) FROM linked UNION ALL
      SELECT 'model', count(*) FILTER (d_model) FROM linked) WHERE n > 0) AS causes,
  CAST({_WEIGHTED} AS DOUBLE) / 10.0 / CAST(sum(calls) FILTER (mean_step_cost_tok_eq IS NOT NULL) AS DOUBLE)
    AS step_cost_tok_eq,
  CAST({_SAVING} AS DOUBLE) / 10.0 / CAST(sum(calls) FILTER (mean_step_cost_tok_eq IS NOT NULL) AS DOUBLE)
    AS step_saving_tok_eq,
  (CAST({_SAVING} AS DOUBLE) / CAST({_WEIGHTED} AS DOUBLE) - 1) * 100 AS premium_pct,
  CAST(sum(cache_miss_unexplained) AS BIGINT) AS cache_miss_unexplained FROM report""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = sessions.report_totals(sessions.session_report(stored(spark, sf_dir).ledger))
    return totals.withColumns({
        "models": F.array_join("models", ","),
        "causes": F.array_join(
            F.transform("mutation_causes",
                        lambda c: F.concat(c["cause"], F.lit(":"), c["count"].cast("string"))), ","),
    }).drop("mutation_causes")


_SESSION_COSTS = f"""costs AS (SELECT session,
  CAST(sum({_TENTHS.format('mean_step_cost_tok_eq')} * calls) AS BIGINT) AS cost_tenths
  FROM report WHERE mean_step_cost_tok_eq IS NOT NULL GROUP BY session)"""


@query("session_costs", report_ctes("day, session") + f", {_SESSION_COSTS} SELECT * FROM costs")
def session_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_costs(stored(spark, sf_dir).ledger)


_MEASURED = f"""ms AS (SELECT CAST({_WEIGHTED} AS DOUBLE) / 10.0
  / CAST(sum(calls) FILTER (mean_step_cost_tok_eq IS NOT NULL) AS DOUBLE) AS raw FROM report),
measured AS (SELECT {rounded('raw', 1)} AS step_cost_tok_eq FROM ms)"""


@query("measured_step_cost", report_ctes("session") + f", {_MEASURED} SELECT * FROM measured")
def measured_step_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.measured_step_cost(sessions.step_means(stored(spark, sf_dir).ledger))


@query("trace_shapes", f"""WITH {CALLS}, {LINKS} SELECT session, count(*) AS n_calls,
  arg_min(CASE WHEN parsed THEN 2 ELSE 0 END, seq) AS n_messages_first,
  arg_max(CASE WHEN parsed THEN 2 ELSE 0 END, seq) AS n_messages_last
  FROM linked WHERE CAST(day AS VARCHAR) = '2024-01-15' GROUP BY session""")
def trace_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir)
    report = sessions.session_report(ledgers.day_range(t.ledger, "2024-01-15", "2024-01-15"))
    return sessions.trace_shapes(report, t.traces, "2024-01-15")


_LABELS = """lb AS (SELECT session, 's' || CASE WHEN length(CAST(n AS VARCHAR)) >= 3 THEN CAST(n AS VARCHAR)
  ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS label FROM
  (SELECT session, row_number() OVER (ORDER BY session) AS n FROM
    (SELECT DISTINCT session FROM linked WHERE CAST(day AS VARCHAR) = '2024-01-15')))"""


@query("advisor_ratio_lists", f"""WITH {CALLS}, {LINKS}, {_LABELS} SELECT label AS session, CAST(0 AS BIGINT) AS part,
  string_agg(CASE WHEN ratio IS NULL THEN '-' ELSE CAST(CAST(round(ratio * 1e6) AS BIGINT) AS VARCHAR) END, ',' ORDER BY seq) AS ratios
  FROM linked JOIN lb USING (session) WHERE CAST(day AS VARCHAR) = '2024-01-15' GROUP BY label""")
def advisor_ratio_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir)
    report = sessions.session_report(ledgers.day_range(t.ledger, "2024-01-15", "2024-01-15"))
    lists = privacy.advisor_tables(report, t.traces, "2024-01-15")[2]
    millionths = lambda r: F.round(r * 1e6).cast("bigint").cast("string")
    return lists.select("session", "part", F.array_join(
        F.transform("prefix_ratios", lambda r: F.coalesce(millionths(r), F.lit("-"))), ",").alias("ratios"))


@query("session_positions", f"WITH {CALLS} SELECT seq AS call_seq, "
       "row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS pos FROM c")
def session_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).ledger.select("session", "call_seq")
    return with_position(rows, ["session"], "call_seq").select("call_seq", "pos")


@query("ledger_day_range", f"""WITH {CALLS} SELECT CAST(day AS VARCHAR) AS ledger_day, count(*) AS calls,
  CAST(sum(CASE WHEN used AND NOT second THEN p ELSE 0 END) AS BIGINT) AS prompt_tokens
  FROM step WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY day""")
def ledger_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append to a day-partitioned store, then read a range of days back."""

    path = f"{staging_root(spark)}/tallyspark/store-{uuid.uuid4().hex}"
    ledgers.write_ledger(stored(spark, sf_dir).ledger, path)
    rows = ledgers.day_range(ledgers.read_ledger(spark, path), "2024-01-10", "2024-01-20")
    return rows.groupBy(F.col("ledger_day").cast("string").alias("ledger_day")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("usage_tokens.prompt_tokens"), F.lit(0)).alias("prompt_tokens"))


_TRAJECTORY_SQL = """SELECT 'c' || conv_id AS task_id, CAST(count(*) AS INTEGER) AS n_steps,
  string_agg(CASE WHEN role = 'system' THEN 'system' WHEN turn % 3 = 2 THEN 'tool' WHEN role = 'user' THEN 'user' ELSE 'assistant' END, ',' ORDER BY turn) AS roles,
  CAST(count(*) FILTER (role <> 'system' AND turn % 3 = 2) AS INTEGER) AS n_observations,
  CASE WHEN conv_id % 4 = 0 THEN 'exit_ERROR' ELSE 'submitted' END AS exit_status,
  conv_id % 5 = 0 AS empty_patch, conv_id % 4 = 0 AS error FROM conversations GROUP BY conv_id"""


# --- Files ------------------------------------------------------------------------------------


#: Rows whose small files share a folder, about.
ROWS_PER_FOLDER = 10_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"


def _write_files(lines: DataFrame, order: str, path: str, *folders: str) -> None:
    """JSON lines in their order, one file per value of the folder columns, beside broken lines."""
    lines.repartition(*folders).sortWithinPartitions(*folders, order).select("value", *folders).write.partitionBy(
        *folders).text(path)


#: Name of a file whose name is unknown, as Spark's writers have it.
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _write_small_files(lines: DataFrame, order: str, path: str, folders: int) -> None:
    """``value`` lines in their order into one file per ``name``, dealt over folders.

    Files are written straight to their place: a folder, a checksum and a move per file would take
    most of the time where there is a file per session.  A repeated task writes the same files.
    """
    name = F.coalesce("name", F.lit(_NO_NAME))
    rows = lines.select("value", order, name.alias("name"), F.pmod(F.xxhash64(name), F.lit(folders)).alias("folder"))

    def write(batches):
        from urllib.parse import quote

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        made, at, out = set(), None, None
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{root}/folder={row['folder']}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                if at != row["name"]:
                    if out is not None:
                        out.close()
                    at, out = row["name"], system.open_output_stream(f"{folder}/{quote(row['name'], safe='')}.txt")
                out.write(((row["value"] or "") + "\n").encode())
            yield batch.select(["name"])
        if out is not None:
            out.close()

    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, folders)
    rows.repartition(tasks, "name").sortWithinPartitions("name", order).mapInArrow(write, "name STRING").write.format(
        "noop").mode("overwrite").save()


@query("ledger_json_scan", f"""WITH {CALLS},
n AS (SELECT *, row_number() OVER (ORDER BY k % 3, CAST(day AS VARCHAR), seq) AS place FROM step)
SELECT seq AS call_id, place, session, CASE WHEN used AND NOT second THEN p END AS prompt_tokens,
  CAST(k * 2 AS DOUBLE) AS latency_ms FROM n""")
def ledger_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as JSON lines in nested folders with broken lines between, read back in line order."""
    path = _folder(spark, "ledger-json")
    rows = stored(spark, sf_dir).ledger.withColumn("part", F.floor(F.col("latency_ms") / 2).cast("bigint") % 3)
    good = F.to_json(F.struct(F.col("call_seq").cast("string").alias("path"), "session", "usage", "latency_ms"))
    # A call's number rides along as text; the reader must number the lines by itself.
    lines = rows.select(
        "part", F.concat(F.lit("d"), F.col("ledger_day").cast("string")).alias("day"), "call_seq",
        F.explode(F.array(good, F.concat(F.lit('{"broken": '), F.col("call_seq").cast("string")), F.lit("[1, 2]"))).alias("value"))
    _write_files(lines, "call_seq", path, "part", "day")
    # Staged, as the ranking looks at its rows twice and a line costs more to parse than to keep.
    read = stage(ledgers.read_ledger_json(spark, path).select("call_seq", "path", "session", "usage_tokens", "latency_ms"), "read")
    return global_rank(read, ["call_seq"], "place").select(
        F.col("path").cast("bigint").alias("call_id"), "place", "session", "usage_tokens.prompt_tokens", "latency_ms")


@query("trace_scan", f"""WITH {TURNS}, b AS (SELECT conv_id, t, CAST(n_messages AS INTEGER) AS n_messages, roles FROM ccalls)
SELECT 's' || conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS place, n_messages, roles FROM b""")
def trace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events as JSON lines, a file per session in folders of sessions, read back in line order."""
    path = _folder(spark, "trace-json")
    traces = stored(spark, sf_dir, "named").traces
    number = F.substring("session", 2, 20).cast("bigint")
    lines = traces.select(
        F.concat(F.lit("s"), number.cast("string")).alias("name"), "call_seq",
        F.to_json(F.struct("ts", "status", "n_messages", "roles", "message_sha256", "message_bytes")).alias("value"))
    _write_small_files(lines, "call_seq", path, 1 + traces.count() // ROWS_PER_FOLDER)
    read = ledgers.text_lines(spark, path).select("file", "line", F.from_json("value", TRACE_JSON).alias("t"))
    session = ledgers.stem(F.col("file"))
    return with_position(read.select(session.alias("session"), "line", "t.*"), ["session"], "line", "place").select(
        "session", (F.col("place") + 1).alias("place"), "n_messages", F.array_join("roles", ",").alias("roles"))


@query("trajectory_files", f"{_TRAJECTORY_SQL}")
def trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per file, read as whole files."""
    path = _folder(spark, "trajectories")
    documents = _trajectory_documents(spark, sf_dir, "swe-agent")
    lines = documents.select(F.col("document").alias("value"), F.get_json_object("document", "$.task_id").alias("name"), F.lit(0).alias("at"))
    _write_small_files(lines, "at", path, 1 + derived.table(spark, sf_dir, "conversations").count() // ROWS_PER_FOLDER)
    return _shape_rows(trajectories.load_trajectories(spark, path, "swe-agent"))


#: Profile files in a folder, about.
PROFILES_PER_FOLDER = 2_000


@query("profile_registration", """WITH p AS (SELECT p_partkey AS id, p_size AS size FROM part)
SELECT 'm' || id AS accountant_model, '2025-01-' || lpad(CAST(1 + id % 28 AS VARCHAR), 2, '0') AS price_date,
  CASE WHEN id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS dialect,
  CAST(size AS DOUBLE) AS input_per_1m, CAST(size AS DOUBLE) / 4 AS cached_input_per_1m, CAST(size AS DOUBLE) * 2 AS output_per_1m,
  CASE WHEN id % 3 = 0 THEN CAST(size AS DOUBLE) / 2 END AS cache_creation_per_1m,
  id % 2 = 0 AS cached_shown, CASE WHEN id % 2 = 0 THEN 'prompt_tokens_details/cached_tokens' END AS cached_path FROM p""")
def profile_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML profile per part, read through the data source and registered beside the built-in tables."""
    path = _folder(spark, "profiles")
    number, size = F.col("p_partkey"), F.col("p_size").cast("double")
    day = F.concat(F.lit("2025-01-"), F.lpad((1 + number % 28).cast("string"), 2, "0"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\n"))
    doc = F.concat(
        field("name", F.concat(F.lit("b"), number.cast("string"))),
        F.when(number % 2 != 0, field("dialect", F.lit("anthropic"))).otherwise(F.lit("")),
        field("base_url", F.lit("http://backend.invalid/")),
        field("accountant_model", F.concat(F.lit("m"), number.cast("string"))), field("price_date", F.concat(F.lit("'"), day, F.lit("'"))),
        F.lit("prices_per_1m:\n"), field("  input", size.cast("string")), field("  cached_input", (size / 4).cast("string")),
        field("  output", (size * 2).cast("string")),
        F.when(number % 3 == 0, field("  cache_creation", (size / 2).cast("string"))).otherwise(F.lit("")),
        F.when(number % 2 == 0, F.lit(
            "cache_schema:\n  cached_tokens:\n    surfaces: true\n    path: [prompt_tokens_details, cached_tokens]\n")).otherwise(F.lit("cache_schema: {}\n")))
    part = derived.table(spark, sf_dir, "part")
    # Folders of some thousand files, so nobody lists all files at once; a folder is written by one task.
    folders = 1 + part.count() // PROFILES_PER_FOLDER
    parts = part.select(doc.alias("value"), number.alias("number"), F.pmod(F.xxhash64(number), F.lit(folders)).alias("folder"))
    tasks = max(spark.sparkContext.defaultParallelism, folders)

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{root}/{row['folder']}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/b{row['number']}.yaml") as f:
                    f.write(row["value"].encode())
            yield batch.select(["number"])

    parts.repartition(tasks, "folder").mapInArrow(write, "number BIGINT").write.format("noop").mode("overwrite").save()
    found, prices, schemas = dimensions.register_profiles(
        dimensions.read_profiles(spark, path), builtin_prices(spark), builtin_cache_schemas(spark))
    cached = schemas.filter("category = 'cached_tokens'").select(
        "accountant_model", F.col("surfaces").alias("cached_shown"), F.array_join("path", "/").alias("cached_path"))
    return found.join(prices.drop("notes"), ["price_date", "accountant_model"]).join(cached, "accountant_model").drop("name")


@query("ordered_report", report_ctes("session") + " SELECT row_number() OVER (ORDER BY session) AS place, session, calls, cost_usd FROM report")
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report in the order that its table is shown in."""
    report = sessions.session_report(stored(spark, sf_dir).ledger)
    return ledgers.ordered_report(report).select("place", "session", "calls", "cost_usd")


@query("safe_sessions", """WITH s AS (SELECT doc_id, text, substr(text, 1 + doc_id % 5, 1 + doc_id % 90) AS header FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(header, '[A-Za-z0-9._-]{1,64}') THEN header
  ELSE 'hdr-' || substr(sha256(header), 1, 10) END AS session FROM s WHERE header IS NOT NULL""")
def safe_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session ids that are no file names become hashes."""
    header = F.expr("substring(text, CAST(1 + doc_id % 5 AS INT), CAST(1 + doc_id % 90 AS INT))")
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", header.alias("header")).filter(F.col("header").isNotNull())
    return docs.select("doc_id", safe_session(F.col("header")).alias("session"))


# --- Experiments ----------------------------------------------------------------------------

_OUTCOMES = """
o AS (SELECT 't' || l_orderkey AS task,
  CASE l_linenumber % 4 WHEN 0 THEN 'control' WHEN 1 THEN 'candidate' WHEN 2 THEN 'aa_sham'
       ELSE 'raw_trajectory' END AS arm, l_returnflag <> 'R' AS resolved,
  'u' || ((l_orderkey + l_linenumber % 4) % 150) AS session,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 1000000000000
   + CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 + CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS line_no
  FROM lineitem),
last AS (SELECT task, arm, arg_max(resolved, line_no) AS resolved, arg_max(session, line_no) AS session
  FROM o GROUP BY task, arm)
"""


@query("last_outcomes", f"WITH {_OUTCOMES} SELECT task, arm, resolved, session FROM last")
def last_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.last_outcomes(derived.outcome_rows(spark, sf_dir)).drop("rep")


#: Lines of an outcome file, about.
OUTCOMES_PER_FILE = 500_000


@query("outcome_scan", f"WITH {_OUTCOMES} SELECT task, arm, 0 AS rep, resolved, session FROM o")
def outcome_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome lines in several files, with numbers and texts for truth values, read back."""
    path = f"{staging_root(spark)}/tallyspark/outcomes-{uuid.uuid4().hex}"
    rows = derived.outcome_rows(spark, sf_dir)
    truth = F.when(F.pmod("line_no", F.lit(2)) == 0, F.when(F.col("resolved"), F.lit("1")).otherwise(F.lit("0"))).otherwise(
        F.col("resolved").cast("string"))
    line = F.concat(
        F.lit('{"resolved": '), truth, F.lit(', "rep": 0, '), F.substring(F.to_json(F.struct("task", "arm", "session")), 2, 1_000))
    # Three files, and more of them the more lines there are.
    files = 3 + rows.count() // OUTCOMES_PER_FILE
    rows.repartition(files).select(line.alias("value")).write.text(path)
    return outcomes.load_outcomes(spark, path).drop("line_no")


_PAIRED = f"""pairs AS (SELECT b.arm, a.resolved AS a_ok, b.resolved AS b_ok, ca.cost_tenths AS ca, cb.cost_tenths AS cb
  FROM last b JOIN last a ON a.task = b.task AND a.arm = 'control' AND b.arm <> 'control'
  LEFT JOIN costs ca ON ca.session = a.session LEFT JOIN costs cb ON cb.session = b.session),
n AS (SELECT arm, count(*) AS pairs, count(*) FILTER (b_ok AND NOT a_ok) AS help,
  count(*) FILTER (a_ok AND NOT b_ok) AS harm, count(*) FILTER (a_ok = b_ok) AS nulls,
  count(cb - ca) AS cost_pairs,
  CAST(sum(cb - ca) AS DOUBLE) / 10.0 / nullif(CAST(count(cb - ca) AS DOUBLE), 0) AS delta_raw,
  CAST(count(*) FILTER (a_ok <> b_ok) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate_raw FROM pairs GROUP BY arm),
r AS (SELECT *, {rounded('rate_raw', 4)} AS rate, {rounded('delta_raw', 1)} AS delta,
  least(1.0, 2 * list_sum(list_transform(range(0, least(help, harm) + 1),
    lambda i: exp(lgamma(help + harm + 1) - lgamma(i + 1) - lgamma(help + harm - i + 1) - (help + harm) * ln(2))))) AS p
  FROM n)
SELECT arm AS arm_b, pairs, help, harm, nulls AS "null", rate AS discordant_rate,
  round(p, 5) AS p_value, delta AS cost_delta_tok_eq, cost_pairs, arm = 'aa_sham' AS is_floor,
  CASE WHEN arm <> 'aa_sham' AND rate <= (SELECT rate FROM r WHERE arm = 'aa_sham') THEN 'WITHIN_NOISE'
       WHEN p > 0.05 THEN CASE WHEN pairs >= 60 THEN 'NOT_SUPPORTED' ELSE 'UNDERPOWERED' END
       WHEN help > harm THEN 'SUPPORTED' ELSE 'SUPPORTED_NEGATIVE' END AS verdict,
  TRUE AS raw_baseline_present,
  (SELECT min(line_no) FROM o WHERE o.arm = r.arm) AS arm_order FROM r"""


@query("paired_analysis", report_ctes("day, session") + f", {_SESSION_COSTS}, {_OUTCOMES}, {_PAIRED}")
def paired_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = sessions.session_costs(stored(spark, sf_dir).ledger)
    rows = experiment.paired_analysis(derived.outcome_rows(spark, sf_dir), "control", costs)
    return rows.drop("arm_a").withColumn("p_value", F.round("p_value", 5))


_PLAN_SPEC = experiment.ExperimentSpec("orders", [], ["control", "candidate"], reps=1, seed="s1")


def _plan_sql() -> str:
    """The four-cell shuffle, one swap per step."""
    steps = ["p0 AS (SELECT o_orderkey, 't' || o_orderkey AS task, "
             "['control', 'candidate', 'raw_trajectory', 'aa_sham'] AS cells FROM orders)"]
    for n, i in enumerate((3, 2, 1)):
        draw = (f"CAST(CAST('0x' || substr(sha256('s1|orders|' || task || '|{i}'), 1, 16) AS UBIGINT)"
                f" % {i + 1} AS INTEGER)")
        steps.append(f"q{n + 1} AS (SELECT *, {draw} AS j FROM p{n})")
        steps.append(
            f"p{n + 1} AS (SELECT o_orderkey, task, list_transform(range(0, 4), lambda x: "
            f"CASE WHEN x = {i} THEN cells[j + 1] WHEN x = j THEN cells[{i + 1}] ELSE cells[x + 1] END)"
            f" AS cells FROM q{n + 1})")
    return ("WITH " + ", ".join(steps) + " SELECT task, cells[x + 1] AS arm, 0 AS rep, x AS \"order\", "
            "task || '::' || cells[x + 1] || '::0' AS run_id FROM p3, (SELECT unnest(range(0, 4)) AS x)")


@query("experiment_plan", _plan_sql())
def experiment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = derived.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("task"),
        F.col("o_orderkey").alias("task_position"))
    # One small source file, but hashing per task: spread it before the blocks are expanded.
    tasks = tasks.repartition(spark.sparkContext.defaultParallelism)
    return experiment.plan_for_tasks(tasks, _PLAN_SPEC).drop("task_position").withColumn(
        "order", F.col("order").cast("bigint"))


@query("plan_summary", """SELECT 'orders' AS name, 's1' AS seed, count(*) AS tasks,
  'control,candidate,raw_trajectory,aa_sham' AS arms, 1 AS reps, count(*) * 4 AS total_runs,
  TRUE AS sham_included, TRUE AS raw_baseline_included FROM orders""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = experiment_plan(spark, sf_dir)
    return experiment.plan_summary(plan, _PLAN_SPEC).withColumn("arms", F.array_join("arms", ","))


@query("required_pairs_by_supplier", """WITH s AS (SELECT l_suppkey,
  CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate,
  CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS effect FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(CASE WHEN rate > 0 AND rate <= 1 AND effect > 0 AND effect < 1 AND effect <> 0.5
  THEN ceil(pow((1.959964 * 0.5 + 0.841621 * sqrt(effect * (1 - effect))) / abs(effect - 0.5), 2) / rate)
  ELSE 0 END AS BIGINT) AS pairs FROM s""")
def required_pairs_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.count_if(c).cast("double") / F.count(F.lit(1)).cast("double")
    grid = derived.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        share(F.col("l_returnflag") == "R").alias("rate"),
        share(F.col("l_linestatus") == "O").alias("effect"))
    return grid.select("l_suppkey", stats.required_pairs(F.col("rate"), F.col("effect")).alias("pairs"))


# --- Acceptance and probing -----------------------------------------------------------------

@query("operating_points", """WITH tr AS (SELECT source AS task_id, lang AS patch_id, d.doc_id, quality = 1 AS passed
  FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT task_id, patch_id, count(*) AS n, count(*) FILTER (passed) AS k, max(doc_id) AS last,
  task_id NOT LIKE '%7' AS available, patch_id = 'de' AS blank FROM tr GROUP BY 1, 2),
x AS (SELECT *, available AND NOT blank AS real, CAST(k AS DOUBLE) / n AS p, CAST(n AS DOUBLE) AS m FROM g),
y AS (SELECT *, 1 + 3.8416 / m AS den, (p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) AS mid,
  1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * m)) / m) / (1 + 3.8416 / m) AS half FROM x)
SELECT task_id, patch_id, CASE WHEN available THEN n ELSE 0 END AS n_trials,
  CASE WHEN real THEN k ELSE 0 END AS n_pass, round(CASE WHEN real THEN p ELSE 0 END, 9) AS point,
  round(CASE WHEN real THEN greatest(0, mid - half) ELSE 0 END, 9) AS ci_low,
  round(CASE WHEN real THEN least(1, mid + half) ELSE 0 END, 9) AS ci_high,
  CASE WHEN NOT available THEN 'ACCEPTANCE_UNAVAILABLE' WHEN blank THEN 'empty_patch'
       ELSE 'doc ' || last END AS detail, available FROM y""")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = derived.trial_rows(spark, sf_dir)
    commands = trials.select("task_id").distinct().select(
        "task_id", F.lit("D2").alias("kind_key"), F.lit("run").alias("cmd"), F.lit("test").alias("kind"),
        (~F.endswith("task_id", F.lit("7"))).alias("credible"))
    points = acceptance.operating_points(trials, commands)
    return points.select("task_id", "patch_id", "n_trials", "n_pass",
                         *[F.round(c, 9).alias(c) for c in ("point", "ci_low", "ci_high")],
                         "detail", "available")


@query("cache_schema_inference", f"""WITH {CALLS},
a AS (SELECT 'u' || user_id || '-' || dialect AS backend, row_number() OVER (PARTITION BY user_id, dialect ORDER BY seq) AS attempt,
  used, second FROM step),
b AS (SELECT backend, coalesce(bool_or(attempt >= 2 AND used AND NOT second), FALSE) AS yes FROM a GROUP BY backend)
SELECT backend, 'cached_tokens' AS category, yes AS surfaces,
  CASE WHEN yes THEN 'prompt_tokens_details.cached_tokens' END AS path FROM b
UNION ALL SELECT backend, 'cache_creation_tokens', FALSE, NULL FROM b
UNION ALL SELECT backend, 'reasoning_tokens', yes, CASE WHEN yes THEN 'completion_tokens_details.reasoning_tokens' END FROM b""")
def cache_schema_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).ledger.select(
        F.concat_ws("-", "session", "dialect").alias("backend"), "call_seq", "usage")
    attempts = with_position(rows, ["backend"], "call_seq").select(
        "backend", (F.col("pos") + 1).alias("attempt"), "usage")
    return probing.infer_cache_schema(attempts).withColumn("path", F.array_join("path", "."))


# --- Skills ---------------------------------------------------------------------------------

_SIGNATURES = [
    ("click-view", ["click", "view"], 2), ("view", ["view"], 3), ("error-pair", ["error", "error"], 2),
    ("triple", ["view", "click", "view"], 6), ("signup-view", ["signup", "view"], 4),
    ("buy", ["purchase"], 1),
]


def _match_sql() -> str:
    library = ", ".join(f"('{n}', '{'>'.join(s)}', {len(s)}, {k}, '{i}')"
                        for i, (n, s, k) in enumerate(_SIGNATURES))
    return f"""WITH a AS (SELECT 'u' || user_id AS session, event_id AS action_seq, event_type AS x0,
  lag(event_type, 1) OVER s AS x1, lag(event_type, 2) OVER s AS x2 FROM events
  WINDOW s AS (PARTITION BY user_id ORDER BY event_id)),
lib(name, sig, n, steps, pos) AS (VALUES {library}),
hits AS (SELECT session, action_seq, name, steps, row_number() OVER (PARTITION BY action_seq ORDER BY steps DESC, pos) AS rank
  FROM a JOIN lib ON sig = CASE n WHEN 1 THEN x0 WHEN 2 THEN x1 || '>' || x0 ELSE x2 || '>' || x1 || '>' || x0 END)
SELECT session, action_seq, CAST(rank AS INTEGER) AS rank, name, steps AS steps_replaced FROM hits WHERE rank <= 3"""


@query("skill_matches", _match_sql())
def skill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.local import local_table
    from ..schemas import SKILLS

    library = local_table(
        spark, [(n, "", s, k, "", [], "", str(i)) for i, (n, s, k) in enumerate(_SIGNATURES)], SKILLS)
    return skills.match_skills(derived.action_rows(spark, sf_dir), library)


def _document_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill library out of documents: the text is the body, the number sets the steps."""
    d = derived.table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("description"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>"))
        .otherwise(F.array("source", "lang")).alias("signature"),
        (F.col("doc_id") % 12).cast("int").alias("steps_replaced"), F.col("text").alias("body"),
        F.array().cast("array<string>").alias("preconditions"), "source",
        F.col("doc_id").cast("string").alias("file_order"))


_SKILL_CTES = f"""sk AS (SELECT 'd' || doc_id AS name, lang, source, doc_id % 5 <> 0 AS keyed,
  CAST(doc_id % 12 AS INTEGER) AS steps, length(text) // 4 AS body FROM documents),
s1 AS (SELECT *, {dbl(1.25)} * CAST(body AS DOUBLE) + {dbl(0.1)} * CAST(body AS DOUBLE) * {dbl(40.0)} AS hold_raw FROM sk),
s2 AS (SELECT *, {rounded('hold_raw', 1)} AS hold FROM s1),
gates AS (SELECT *, concat_ws('|',
  CASE WHEN body > 500 THEN 'body ' || body || ' tok > 500 (break-even rises past anything observed)' END,
  CASE WHEN steps < 1 THEN 'replaces ' || steps || ' steps — nothing to amortize' END,
  CASE WHEN NOT keyed THEN 'no trigger signature — nothing to key on' END) AS failures FROM s2)"""


@query("skill_prices", report_ctes("session") + f""", {_MEASURED}, {_SKILL_CTES},
s3 AS (SELECT *, (hold / nullif(step_cost_tok_eq, 0) + {dbl(economics.DEFAULT_HARM_RATE * economics.DEFAULT_HARM_STEPS)})
  / {dbl(0.135)} AS be_raw FROM gates, measured),
s4 AS (SELECT *, {rounded('be_raw', 2)} AS be FROM s3)
SELECT name, body AS body_tokens, steps AS steps_replaced, greatest(steps - 1, 0) AS net_steps_saved,
  step_cost_tok_eq, hold AS hold_cost_tok_eq, be AS break_even_steps,
  CASE WHEN be IS NULL THEN 'UNPRICED' WHEN greatest(steps - 1, 0) >= be THEN 'PAYS' ELSE 'CANNOT_PAY' END AS verdict,
  failures AS gate_failures,
  name || ': ' || lang || ' [when: ' || CASE WHEN keyed THEN source || ' → ' || lang ELSE '' END || ']' AS card FROM s4""")
def skill_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = sessions.measured_step_cost(sessions.step_means(stored(spark, sf_dir).ledger))
    return skills.price_skills(_document_skills(spark, sf_dir), step).select(
        "name", "body_tokens", "steps_replaced", "net_steps_saved", "step_cost_tok_eq",
        "hold_cost_tok_eq", "break_even_steps", "verdict",
        F.array_join("gate_failures", "|").alias("gate_failures"), "card")


@query("skill_gate_failures", f"""WITH {_SKILL_CTES}
SELECT name || ': ' || f AS failure FROM (SELECT name, unnest(string_split(failures, '|')) AS f FROM gates WHERE failures <> '')
UNION ALL SELECT 'library holds ' || count(*) || ' skills > 50 (shadowing territory)' FROM documents HAVING count(*) > 50""")
def skill_gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.library_failures(_document_skills(spark, sf_dir))


# --- Message transforms ---------------------------------------------------------------------

_MESSAGES = """
ms AS (SELECT conv_id, CAST(turn AS INTEGER) AS pos, role, text AS body, text AS rest, FALSE AS two FROM conversations
  UNION ALL SELECT doc_id % 50, CAST(100 + doc_id // 50 AS INTEGER), 'tool',
    CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || lang ELSE text END, lang, doc_id % 2 = 0 FROM documents),
mz AS (SELECT *, role = 'tool' AND length(body) > 0 AS obs FROM ms)
"""


def _texts(table: DataFrame) -> DataFrame:
    return table.select("conv_id", "pos", F.sha2(msg.flatten(F.col("blocks")).cast("binary"), 256).alias("digest"),
                        F.length(msg.flatten(F.col("blocks"))).alias("chars"), F.col("flag"))


def _cap_sql(over: str, cut: str) -> str:
    return f"""WITH {_MESSAGES}, y AS (SELECT *, obs AND ({over}) AS flag FROM mz),
z AS (SELECT *, CASE WHEN flag THEN {cut} || CASE WHEN two THEN chr(10) ELSE '' END ELSE body END AS out FROM y)
SELECT conv_id, pos, sha256(out) AS digest, CAST(length(out) AS INTEGER) AS chars, flag FROM z"""


@query("admission_cap_tokens", _cap_sql(
    "length(body) > 3200", "substr(body, 1, 3200) || chr(10) || '[admission-cap: truncated to 800 tokens]'"))
def admission_cap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = transforms.admission_cap(derived.tool_messages(spark, sf_dir))
    return _texts(capped.withColumnRenamed("capped", "flag"))


@query("admission_cap_lines", _cap_sql(
    "len(string_split(body, chr(10))) > 5",
    "array_to_string(string_split(body, chr(10))[1:5], chr(10)) || chr(10) || '[admission-cap: truncated to 5 lines]'"))
def admission_cap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = transforms.admission_cap(derived.tool_messages(spark, sf_dir), "lines", cap_lines=5)
    return _texts(capped.withColumnRenamed("capped", "flag"))


@query("admission_stats", f"""WITH {_MESSAGES} SELECT conv_id, count(*) FILTER (obs AND length(body) > 3200) AS obs_capped
  FROM mz GROUP BY conv_id""")
def admission_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.admission_stats(transforms.admission_cap(derived.tool_messages(spark, sf_dir)))


_MASK_PLAN = """mp AS (SELECT conv_id, CAST(sum(greatest(1, length(body) // 4)) AS BIGINT) AS total,
  min(pos) FILTER (obs AND greatest(1, length(body) // 4) >= 300) AS first_pos FROM mz GROUP BY conv_id)"""


@query("masking_plan", f"""WITH {_MESSAGES}, {_MASK_PLAN} SELECT conv_id, total AS total_tokens_est, 2000 AS threshold,
  CASE WHEN total > 2000 THEN first_pos END AS elided_index FROM mp""")
def masking_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.masking_plan(derived.tool_messages(spark, sf_dir), 2000, 300)


@query("masking", f"""WITH {_MESSAGES}, {_MASK_PLAN}, y AS (SELECT mz.*, coalesce(total > 2000 AND pos = first_pos, FALSE) AS flag
  FROM mz JOIN mp USING (conv_id)),
z AS (SELECT *, CASE WHEN flag THEN '{msg.STUB}' || CASE WHEN two THEN chr(10) ELSE '' END ELSE body END AS out FROM y)
SELECT conv_id, pos, sha256(out) AS digest, CAST(length(out) AS INTEGER) AS chars, flag FROM z""")
def masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = transforms.masking(derived.tool_messages(spark, sf_dir), 2000, 300)
    return _texts(masked.withColumnRenamed("elided", "flag"))


# --- Trajectories ---------------------------------------------------------------------------

def _trajectory_documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    c = derived.table(spark, sf_dir, "conversations")
    tool = (F.col("role") != "system") & (F.col("turn") % 3 == 2)
    text = F.when(tool, F.concat(F.lit("OBSERVATION:\n"), F.col("text"))).otherwise(F.col("text"))
    exit_ = F.when(F.col("conv_id") % 4 == 0, F.lit("exit_ERROR")).otherwise(F.lit("submitted"))
    patch = F.when(F.col("conv_id") % 5 == 0, F.lit(" \n ")).otherwise(F.lit("diff --git"))
    task = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("task_id")
    if kind == "swe-agent":
        block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
        step = F.struct("turn", F.struct(F.when(tool, F.lit("tool")).otherwise(F.col("role")).alias("role"),
                                         block.alias("content")).alias("m"))
        rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
        doc = F.struct(task, F.col("s.m").alias("history"),
                       F.struct(exit_.alias("exit_status"), patch.alias("submission")).alias("info"))
    else:
        kind_key = F.when(tool, F.lit("run"))
        step = F.struct("turn", F.struct(
            kind_key.alias("observation"), F.when(~tool, F.lit("message")).alias("action"),
            F.when(F.col("role") == "assistant", F.lit("agent")).otherwise(F.col("role")).alias("source"),
            text.alias("content")).alias("m"))
        rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
        doc = F.struct(F.struct(task, exit_.alias("exit_status"), patch.alias("submission")).alias("metadata"),
                       F.col("s.m").alias("events"))
    return rows.select(F.to_json(doc).alias("document"))


def _shapes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _shape_rows(trajectories.ADAPTERS[kind](_trajectory_documents(spark, sf_dir, kind)))


def _shape_rows(parsed: DataFrame) -> DataFrame:
    from ..functions.trajectory import is_error

    s = shape(F.col("task_id"), F.col("steps"), F.col("exit_status"), F.col("submitted_patch"))
    return parsed.select(s.alias("s"), is_error(F.col("exit_status")).alias("error")).select(
        "s.task_id", "s.n_steps", F.array_join("s.roles", ",").alias("roles"), "s.n_observations",
        "s.exit_status", "s.empty_patch", "error")


@query("swe_agent_trajectories", _TRAJECTORY_SQL)
def swe_agent_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, "swe-agent")


@query("openhands_trajectories", _TRAJECTORY_SQL)
def openhands_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, "openhands")


_STEP_ROLE = "CASE WHEN role <> 'system' AND turn % 3 = 2 THEN 'tool' WHEN role IN ('system', 'user') THEN role ELSE 'assistant' END"


@query("trajectory_table_functions", f"""WITH s AS (SELECT 'c' || conv_id AS task_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS step,
  {_STEP_ROLE} AS role, text FROM conversations)
SELECT task_id, source, step, role, length(text) + CASE WHEN role = 'tool' THEN 13 ELSE 0 END AS chars, role = 'tool' AS is_observation
FROM s, (VALUES ('swe-agent'), ('openhands')) v(source)""")
def trajectory_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of events that are rows of a table, by SQL calls of two adapters."""
    trajectories.register_table_functions(spark)
    c = derived.table(spark, sf_dir, "conversations")
    tool = (F.col("role") != "system") & (F.col("turn") % 3 == 2)
    text = F.when(tool, F.concat(F.lit("OBSERVATION:\n"), F.col("text"))).otherwise(F.col("text"))
    task = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("task_id")
    block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    first = F.to_json(F.struct(F.when(tool, F.lit("tool")).otherwise(F.col("role")).alias("role"), block.alias("content")))
    second = F.to_json(F.struct(
        F.when(tool, F.lit("run")).alias("observation"),
        F.when(F.col("role") == "assistant", F.lit("agent")).otherwise(F.col("role")).alias("source"), text.alias("content")))
    steps = spark.sql(
        """SELECT * FROM swe_agent_steps(TABLE({first}) PARTITION BY task_id ORDER BY turn)
        UNION ALL SELECT * FROM openhands_steps(TABLE({second}) PARTITION BY task_id ORDER BY turn)""",
        first=c.select(task, "turn", first.alias("event")), second=c.select(task, "turn", second.alias("event")))
    return steps.select("task_id", "source", "step", "role", F.length("text").cast("bigint").alias("chars"), "is_observation")


@query("canonical_requests", f"""WITH {TURNS} SELECT seq AS call_seq, sha256(canon) AS digest,
  CAST(length(canon) AS INTEGER) AS chars FROM ccalls""")
def canonical_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.conversation_calls(spark, sf_dir)
    text = canonical_json(F.try_variant_get(F.try_parse_json("request_body"), "$.messages", "variant"))
    return raw.select("call_seq", text.alias("t")).select(
        "call_seq", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), F.length("t").alias("chars"))


# --- Sharing --------------------------------------------------------------------------------

_SALT = bytes(range(32))
_FIRST_SEEN = """fs AS (SELECT session, 's' || CASE WHEN length(CAST(n AS VARCHAR)) >= 3 THEN CAST(n AS VARCHAR)
  ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS label FROM
  (SELECT session, row_number() OVER (ORDER BY min(day), min(seq)) AS n FROM c GROUP BY session))"""


@query("shared_ledger", f"""WITH {CALLS}, {_FIRST_SEEN} SELECT strftime(step.ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS ts,
  label AS session, CASE dialect WHEN 'local' THEN 'other' ELSE dialect END AS dialect,
  CASE WHEN second THEN '/v1/messages' WHEN first THEN '/v1/chat/completions' ELSE 'other' END AS path,
  CASE WHEN model IS NOT NULL THEN 'model-' || substr(sha256(model), 1, 8) END AS model,
  CASE WHEN used AND NOT second THEN p END AS prompt_tokens,
  CASE WHEN second AND shown THEN hit END AS read_tokens,
  CASE WHEN has_cost THEN uncached END AS uncached,
  CASE WHEN used AND NOT has_cost THEN 'no_profile' END AS cost_error,
  CASE WHEN NOT parsed THEN 'JSONDecodeError' END AS request_parse_error
  FROM step JOIN fs USING (session)""")
def shared_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir)
    shared = privacy.anonymize(t.ledger, t.traces, "2024-01-01", "2024-12-31", salt=_SALT).ledger
    return shared.select(
        "ts", "session", "dialect", "path", "model", "usage.prompt_tokens",
        F.col("usage.cache_read_input_tokens").alias("read_tokens"),
        F.col("cost.native_tokens.uncached_prompt_tokens").alias("uncached"), "cost_error",
        "request_parse_error")


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in _SALT.ljust(64, b"\0")).hex()


@query("shared_traces", f"""WITH {TURNS},
fs AS (SELECT conv_id, 's' || CASE WHEN length(CAST(n AS VARCHAR)) >= 3 THEN CAST(n AS VARCHAR)
  ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS label FROM
  (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS n FROM conversations WHERE turn = 0)),
h AS (SELECT conv_id, t, pos, role, strlen(canon) AS bytes, substr(sha256(unhex('{_pad(0x5C)}') ||
  unhex(sha256(unhex('{_pad(0x36)}') || encode(substr(sha256(canon), 1, 16))))), 1, 16) AS mac FROM cmsgs)
SELECT label AS session, '2024-02-0' || (t + 1) || 'T00:00:00.000+00:00' AS ts, count(*) AS n_messages,
  string_agg(role, ',' ORDER BY pos) AS roles, string_agg(mac, ',' ORDER BY pos) AS macs,
  CAST(sum(bytes) AS BIGINT) AS bytes FROM h JOIN fs USING (conv_id) GROUP BY label, t""")
def shared_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "named")
    shared = privacy.anonymize(t.ledger, t.traces, "2024-01-01", "2024-12-31", salt=_SALT).traces
    return shared.select(
        "session", "ts", F.col("n_messages").cast("bigint").alias("n_messages"),
        F.array_join("roles", ",").alias("roles"), F.array_join("message_hmac", ",").alias("macs"),
        F.aggregate("message_bytes", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("bytes"))


@query("shared_dataset_in_order", f"""WITH {CALLS}, {_FIRST_SEEN},
r AS (SELECT CAST(day AS VARCHAR) AS ledger_day, row_number() OVER (PARTITION BY day ORDER BY seq) - 1 AS "row", seq, label AS session,
  CASE WHEN used AND NOT second THEN p END AS prompt_tokens FROM step JOIN fs USING (session))
SELECT ledger_day, "row", session, prompt_tokens, ledger_day = (SELECT min(ledger_day) FROM r) AND "row" = 0 AS is_sample FROM r""")
def shared_dataset_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written dataset: a repeated run leaves one version, and rows come back in call order."""
    t = stored(spark, sf_dir)
    path = _folder(spark, "submission")
    submission = privacy.anonymize(t.ledger, t.traces, "2024-01-01", "2024-12-31", salt=_SALT, staged=True)
    for _ in range(2):
        privacy.write_submission(submission, path)
    ledger, _, manifest = privacy.read_submission(spark, path)
    sample = privacy.sample_row(privacy.Submission(ledger, ledger, ledger, manifest)).select(
        F.col("ledger_day").alias("first_day"), F.col("row").alias("first_row"))
    is_sample = (F.col("ledger_day") == F.col("first_day")) & (F.col("row") == F.col("first_row"))
    return ledger.join(F.broadcast(sample), is_sample, "left").select(
        F.col("ledger_day").cast("string").alias("ledger_day"), "row", "session", "usage.prompt_tokens",
        F.col("first_day").isNotNull().alias("is_sample"))


@query("submission_manifest", f"""WITH {CALLS} SELECT 'hash-only' AS tier, 2 AS schema, 'pseudonymized' AS model_names,
  count(*) AS calls, count(DISTINCT session) AS sessions,
  CAST(sum(CASE WHEN used AND NOT second THEN p ELSE 0 END) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN used AND NOT second THEN k ELSE 0 END) AS BIGINT) AS completion_tokens,
  (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT 'model-' || substr(sha256(model), 1, 8) AS m FROM c WHERE model IS NOT NULL)) AS models,
  count(DISTINCT day) AS ledger_days FROM step""")
def submission_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir)
    row = privacy.anonymize(t.ledger, t.traces, "2024-01-01", "2024-12-31", salt=_SALT).manifest
    return row.select("tier", "schema", "model_names", "calls", "sessions", "prompt_tokens", "completion_tokens",
                      F.array_join("models", ",").alias("models"),
                      F.size("ledger_days").cast("bigint").alias("ledger_days"))


@query("session_dictionary", f"""WITH {CALLS} SELECT session, 's' || CASE WHEN length(CAST(n AS VARCHAR)) >= 3
  THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS label
  FROM (SELECT session, row_number() OVER (ORDER BY session) AS n FROM (SELECT DISTINCT session FROM c))""")
def session_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.session_dictionary(stored(spark, sf_dir).ledger)
