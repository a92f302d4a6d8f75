"""Ledger and trace tables: JSON-lines input, Parquet storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ledger_day
from ..functions.usage import parse_usage
from ..plans.local import columns_of
from ..plans.ranking import global_rank
from ..schemas import LEDGER, LEDGER_JSON, TRACE, TRACE_JSON
from .lines import stem, text_lines


def _json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of JSON-lines files with their ``file`` and ``line``; lines that are not JSON objects are skipped.

    A field of another type than expected is NULL, the rest of its line is kept.
    """
    lines = text_lines(spark, path)
    whole = F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()
    return lines.withColumn("_r", F.when(whole, F.from_json("value", ddl))).filter(
        F.col("_r").isNotNull()).select("_r.*", F.col("file").alias("_file"), F.col("line").alias("_line"))


def read_ledger_json(spark: SparkSession, path: str) -> DataFrame:
    """Day files ``YYYY-MM-DD.jsonl`` as a ledger; the day is the file stem.

    ``call_seq`` is taken from the line when present, else from the order of the day files and
    of the lines in them.
    """
    rows = _json_lines(spark, path, LEDGER_JSON)
    return rows.withColumns(
        {
            "call_seq": F.coalesce("call_seq", "_line"),
            "ledger_day": stem(F.col("_file")).try_cast("date"),
            "usage_tokens": parse_usage(F.col("usage")),
        }
    ).select(*columns_of(LEDGER))


def read_trace_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-session trace files; the session is the file stem, ``call_seq`` the line's place."""
    rows = _json_lines(spark, path, TRACE_JSON)
    return rows.withColumns({"session": stem(F.col("_file")), "call_seq": F.col("_line")}).select(*columns_of(TRACE))


def day_range(ledger: DataFrame, day_from: str, day_to: str) -> DataFrame:
    """``day_from <= ledger_day <= day_to``; a partition filter on a stored ledger."""
    return ledger.filter(F.col("ledger_day").between(F.to_date(F.lit(day_from)), F.to_date(F.lit(day_to))))


def trace_day_range(traces: DataFrame, day_from: str, day_to: str) -> DataFrame:
    kept = traces.filter(F.substring("ts", 1, 10).between(day_from, day_to))
    if "trace_day" in traces.columns:  # stored traces: read only the days that can match
        kept = kept.filter(F.col("trace_day").between(
            F.date_sub(F.to_date(F.lit(day_from)), 1), F.date_add(F.to_date(F.lit(day_to)), 1)) | F.col("trace_day").isNull())
    return kept


def write_ledger(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, one partition folder per local day."""
    ledger.write.partitionBy("ledger_day").mode(mode).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def write_trace(trace: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day; session stays a column, as one folder per session would not scale."""
    trace.withColumn("trace_day", ledger_day(F.col("ts"))).write.partitionBy("trace_day").mode(
        mode
    ).parquet(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{TRACE}, trace_day DATE").parquet(path)


def ordered_report(report: DataFrame) -> DataFrame:
    """The report in the order of its sessions, each with its one-based ``place``."""
    return global_rank(report, ["session"], "place")


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in the order of the sessions."""
    ordered = report.orderBy("session") if "session" in report.columns else report
    ordered.write.mode(mode).option("ignoreNullFields", "false").json(path)
