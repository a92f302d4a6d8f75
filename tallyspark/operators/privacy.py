"""Sharing a ledger and its traces: allowlist projection, pseudonyms, manifest."""

from __future__ import annotations

import secrets
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import disclosure as d
from ..functions.text import hmac_sha256_hex, ledger_day
from ..functions.usage import parse_usage
from ..plans.ordered import with_position
from ..plans.ranking import global_rank
from ..plans.staging import stage
from ..sources.ledgers import day_range, trace_day_range
from .sessions import session_key, trace_ratio_lists, trace_shapes

TIER = "hash-only"  # fixed value
SCHEMA_VERSION = 2  # fixed value


@dataclass
class Submission:
    ledger: DataFrame
    traces: DataFrame
    sessions: DataFrame  # the private dictionary; do not share
    manifest: DataFrame


def _label(rank):
    digits = rank.cast("string")
    return F.concat(F.lit("s"), F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0")))


def session_dictionary(sessions: DataFrame) -> DataFrame:
    """(session, label) in the sorted order of session ids."""
    # Staged, as the ranking looks at its rows twice and a report is dear.
    keys = stage(sessions.select("session").distinct(), "keys")
    return global_rank(keys, ["session"]).select("session", _label(F.col("rank")).alias("label"))


def advisor_tables(report: DataFrame, traces: DataFrame, day: str) -> tuple[DataFrame, ...]:
    """What an outside advisor may see of a day: session rows, trace shapes and ratio lists,
    all under dictionary labels."""
    labels = session_dictionary(report)

    def relabel(table: DataFrame) -> DataFrame:
        rest = [c for c in table.columns if c != "session"]
        return table.join(labels, "session").select(F.col("label").alias("session"), *rest)

    return (
        relabel(report), relabel(trace_shapes(report, traces, day)),
        relabel(trace_ratio_lists(report, traces, day)),
    )


def first_seen_dictionary(ledger: DataFrame, traces: DataFrame) -> DataFrame:
    """(session, label) in first-seen order: ledger days and rows first, then trace-only
    sessions by name."""
    seen = ledger.select(
        session_key(F.col("session")).alias("session"), F.lit(0).alias("_kind"),
        F.col("ledger_day").alias("_day"), F.col("call_seq").alias("_seq"),
    ).unionByName(
        traces.select(
            "session", F.lit(1).alias("_kind"), F.lit(None).cast("date").alias("_day"),
            F.lit(0).cast("bigint").alias("_seq"),
        )
    )
    first = seen.groupBy("session").agg(F.min(F.struct("_kind", "_day", "_seq")).alias("_f")).select(
        "session", "_f._kind", "_f._day", "_f._seq"
    )
    return global_rank(first, ["_kind", "_day", "_seq", "session"]).select(
        "session", _label(F.col("rank")).alias("label")
    )


def project_ledger(ledger: DataFrame, dictionary: DataFrame, include_model_names: bool = False) -> DataFrame:
    """Ledger rows through the closed schema; a string above the bound fails the job.

    ``row`` is the call's place in its day, which keeps the order without the call numbers.
    """
    model = F.col("model") if include_model_names else d.pseudonym(F.col("model"))
    placed = with_position(
        ledger.withColumn("_day", F.coalesce("ledger_day", F.lit("0001-01-01").cast("date"))), ["_day"], "call_seq", "row")
    rows = placed.withColumn("session", session_key(F.col("session"))).join(dictionary, "session")
    out = rows.select(
        "ledger_day", "row", "ts", F.col("label").alias("session"),
        d.closed(F.col("dialect"), d.DIALECTS).alias("dialect"),
        d.closed(F.col("path"), d.PATHS).alias("path"),
        "status", "latency_ms", model.alias("model"),
        d.clean_usage(F.col("usage_tokens")).alias("usage"),
        F.coalesce("gateway_injected", F.lit(False)).alias("gateway_injected"),
        "prefix_stable_ratio",
        d.clean_cost(F.col("cost")).alias("cost"),
        "cost_quality",
        d.error_enum(F.col("cost_error")).alias("cost_error"),
        F.coalesce("tap_truncated", F.lit(False)).alias("tap_truncated"),
        "request_parse_error",
    )
    strings = {c: F.col(c) for c in ("ts", "model", "cost_quality", "request_parse_error")}
    strings["cache_status"] = F.col("cost.cache_status")
    return out.filter(d.refuse_long_strings(strings, "ledger"))


def project_traces(traces: DataFrame, dictionary: DataFrame, salt: bytes) -> DataFrame:
    """Trace rows with message hashes re-keyed under the submission's salt; ``row`` is the event's
    place in its session."""
    # A column of its own, so the text is parsed once and not once per field.
    placed = with_position(traces, ["session"], "call_seq", "row").withColumn("_usage", parse_usage(F.col("usage")))
    out = placed.join(dictionary, "session").select(
        F.col("label").alias("session"), "row", "ts", "status", "n_messages",
        F.transform(F.coalesce("roles", F.array().cast("array<string>")),
                    lambda r: F.coalesce(F.when(r.isin(*d.ROLES), r), F.lit("other"))).alias("roles"),
        F.transform(F.coalesce("message_sha256", F.array().cast("array<string>")),
                    lambda h: hmac_sha256_hex(salt, h, 16)).alias("message_hmac"),
        F.filter(F.coalesce("message_bytes", F.array().cast("array<bigint>")),
                 lambda b: b.isNotNull()).alias("message_bytes"),
        "prefix_stable_ratio",
        d.clean_usage(F.col("_usage")).alias("usage"),
    )
    return out.filter(d.refuse_long_strings({"ts": F.col("ts")}, "trace"))


def manifest(ledger: DataFrame, dictionary: DataFrame, tool_version: str,
             include_model_names: bool = False) -> DataFrame:
    """One row that describes a projected ledger; tokens count first-dialect fields only."""
    zero = F.lit(0).cast("bigint")
    n = dictionary.agg(F.count(F.lit(1)).alias("sessions")).scalar()
    sums = ledger.agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("usage.prompt_tokens"), zero).alias("prompt_tokens"),
        F.coalesce(F.sum("usage.completion_tokens"), zero).alias("completion_tokens"),
        F.sort_array(F.collect_set("model")).alias("models"),
        F.sort_array(F.collect_set(F.col("ledger_day").cast("string"))).alias("ledger_days"),
    )
    row = sums.withColumn("sessions", n).select(
        F.lit(TIER).alias("tier"), F.lit(SCHEMA_VERSION).alias("schema"),
        F.lit("raw" if include_model_names else "pseudonymized").alias("model_names"),
        F.lit(tool_version).alias("tool_version"),
        "calls", "sessions", "prompt_tokens", "completion_tokens", "models", "ledger_days",
    )
    canonical = F.to_json(F.parse_json(F.to_json(F.struct(*row.columns))))
    return row.withColumn("submission_id", F.substring(F.sha2(canonical.cast("binary"), 256), 1, 10))


def anonymize(ledger: DataFrame, traces: DataFrame, day_from: str, day_to: str,
              include_model_names: bool = False, salt: bytes | None = None,
              tool_version: str = "0.1.0", staged: bool = False) -> Submission:
    """Everything in the window through the allowlist.

    Ledgers are selected by their day, traces by the day written in ``ts``.  The salt is
    drawn once per run and never stored.  With ``staged`` the projected tables are written once, for
    callers that read them several times, as every :func:`write_submission` does.
    """
    salt = secrets.token_bytes(32) if salt is None else salt
    rows = day_range(ledger, day_from, day_to)
    events = trace_day_range(traces, day_from, day_to)
    dictionary = first_seen_dictionary(rows, events)
    shared, shared_events = project_ledger(rows, dictionary, include_model_names), project_traces(events, dictionary, salt)
    if staged:
        shared, shared_events = stage(shared, "shared"), stage(shared_events, "shared-events")
    return Submission(
        shared, shared_events, dictionary,
        manifest(shared, dictionary, tool_version, include_model_names),
    )


def sample_row(submission: Submission) -> DataFrame:
    """The preview row: the first ledger row of the first day, in file order."""
    return submission.ledger.filter("row = 0").orderBy(F.asc_nulls_last("ledger_day")).limit(1)


def write_submission(submission: Submission, path: str) -> None:
    """One version of the dataset: ``ledger/`` by day, ``traces/`` by trace day, then ``manifest/``.

    Every run writes its tables into folders of its own, and its manifest, which names them, is
    the last and only thing that readers look for.  A run that fails leaves no manifest, and one that
    is repeated replaces the manifest, so readers see one whole version at any time.
    """
    version = f"run-{uuid.uuid4().hex}"
    # Rows lie in call order inside each day and session.
    submission.ledger.repartitionByRange("ledger_day", "row").sortWithinPartitions("ledger_day", "row").write.partitionBy(
        "ledger_day").parquet(f"{path}/ledger/version={version}")
    submission.traces.withColumn("trace_day", ledger_day(F.col("ts"))).repartitionByRange(
        "trace_day", "session", "row").sortWithinPartitions("trace_day", "session", "row").write.partitionBy(
        "trace_day").parquet(f"{path}/traces/version={version}")
    submission.manifest.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, traces and manifest of the version that the manifest names."""
    found = spark.read.json(f"{path}/manifest")
    version = found.select("version").first()[0]  # one row
    return (
        spark.read.parquet(f"{path}/ledger/version={version}"), spark.read.parquet(f"{path}/traces/version={version}"),
        found.drop("version"))
