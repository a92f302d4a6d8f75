"""Harness trajectory documents to one common table.

Each reader is a ``DataFrame(document STRING) -> trajectories`` function; add one to
``ADAPTERS`` to support another format.

Events that are rows of a table already, one per step, go through table functions
(:func:`register_table_functions`)::

    SELECT * FROM swe_agent_steps(TABLE(events) PARTITION BY task_id ORDER BY turn)

Spark brings a trajectory's events together in order, and a step is given out for each event as it
comes, so a trajectory of any length needs no memory.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trajectory import OBSERVATION_MARK

# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SWE_DDL = (
    "task_id STRING, history ARRAY<STRUCT<role: STRING, content: VARIANT>>, "
    "info STRUCT<exit_status: STRING, submission: STRING, model_stats: STRUCT<tokens_sent: DOUBLE, "
    "tokens_received: DOUBLE, api_calls: DOUBLE, instance_cost: DOUBLE>>"
)
_OPEN_DDL = (
    "task_id STRING, events ARRAY<VARIANT>, metadata STRUCT<task_id: STRING, exit_status: STRING, "
    "submission: STRING, usage: MAP<STRING, DOUBLE>>"
)


def content_text(content: Column) -> Column:
    """A string as it is; a list as its text blocks joined by newlines."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.filter(
        F.transform(
            blocks,
            lambda b: F.when(
                F.startswith(F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")), F.lit("STRING")),
                F.try_variant_get(b, "$.text", "string"),
            ),
        ),
        lambda t: t.isNotNull(),
    )
    plain = F.try_variant_get(content, "$", "string")
    return F.coalesce(F.when(blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(plain), F.lit(""))


def _task(*ids: Column) -> Column:
    return F.coalesce(*[F.nullif(i, F.lit("")) for i in ids], F.lit("unknown"))


def parse_swe_agent(documents: DataFrame) -> DataFrame:
    doc = F.from_json("document", _SWE_DDL)
    parsed = documents.select(doc.alias("d"))
    d = F.col("d")

    def step(m: Column) -> Column:
        role = F.coalesce(m["role"], F.lit("unknown"))
        text = content_text(m["content"])
        return F.struct(
            role.alias("role"), text.alias("text"),
            ((role == "tool") & F.contains(text, F.lit(OBSERVATION_MARK))).alias("is_observation"),
        )

    stats = d["info"]["model_stats"]
    return parsed.select(
        _task(d["task_id"]).alias("task_id"), F.lit("swe-agent").alias("source"),
        d["info"]["exit_status"].alias("exit_status"),
        F.coalesce(d["info"]["submission"], F.lit("")).alias("submitted_patch"),
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in
                      ("prompt_tokens", "completion_tokens", "api_calls", "instance_cost")]),
            F.array(stats["tokens_sent"], stats["tokens_received"], stats["api_calls"],
                    stats["instance_cost"]),
        ).alias("usage"),
        F.coalesce(F.transform(d["history"], step), _no_steps()).alias("steps"),
    )


def parse_openhands(documents: DataFrame) -> DataFrame:
    doc = F.from_json("document", _OPEN_DDL)
    parsed = documents.select(doc.alias("d"))
    d = F.col("d")

    def step(e: Column) -> Column:
        text = F.coalesce(F.try_variant_get(e, "$.content", "string"), F.lit(""))
        source = F.try_variant_get(e, "$.source", "string")
        # A key counts when present, even with a null value.
        observed = F.array_contains(F.json_object_keys(F.to_json(e)), "observation")
        role = (
            F.when(observed, F.lit("tool"))
            .when(source.isin("user", "system"), source)
            .otherwise(F.lit("assistant"))
        )
        return F.struct(
            role.alias("role"), text.alias("text"),
            (observed & F.contains(text, F.lit(OBSERVATION_MARK))).alias("is_observation"),
        )

    meta = d["metadata"]
    return parsed.select(
        _task(meta["task_id"], d["task_id"]).alias("task_id"), F.lit("openhands").alias("source"),
        meta["exit_status"].alias("exit_status"),
        F.coalesce(meta["submission"], F.lit("")).alias("submitted_patch"),
        F.coalesce(meta["usage"], F.map_from_arrays(F.array().cast("array<string>"),
                                                    F.array().cast("array<double>"))).alias("usage"),
        F.coalesce(F.transform(d["events"], step), _no_steps()).alias("steps"),
    )


def _no_steps() -> Column:
    return F.array().cast("array<struct<role: string, text: string, is_observation: boolean>>")


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "swe-agent": parse_swe_agent,
    "openhands": parse_openhands,
}


def load_trajectories(spark: SparkSession, path: str, kind: str,
                      task_id: str | None = None) -> DataFrame:
    """Whole-file documents of one kind; a non-empty ``task_id`` overrides the documents'."""
    documents = spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))
    parsed = ADAPTERS[kind](documents)
    return parsed.withColumn("task_id", F.lit(task_id)) if task_id else parsed


def explode_steps(trajectories: DataFrame) -> DataFrame:
    return trajectories.select(
        "task_id", "source", F.posexplode("steps").alias("step", "s")
    ).select("task_id", "source", "step", "s.*")


# Table functions

STEPS = "task_id STRING, source STRING, step INT, role STRING, text STRING, is_observation BOOLEAN"


def _event(text: str | None) -> dict:
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _plain_text(content) -> str:
    """As :func:`content_text`."""
    if isinstance(content, list):
        return "\n".join(b["text"] for b in content if isinstance(b, dict) and isinstance(b.get("text"), str))
    return content if isinstance(content, str) else ""


class _Steps:
    """Numbers the events of one trajectory; needs columns ``task_id`` and ``event`` (JSON text)."""

    source = ""

    def __init__(self):
        self.at = 0

    def read(self, event: dict) -> tuple[str, str, bool]:
        raise NotImplementedError

    def eval(self, row) -> Iterator[tuple]:
        role, text, observed = self.read(_event(row["event"]))
        yield row["task_id"] or "unknown", self.source, self.at, role, text, observed and OBSERVATION_MARK in text
        self.at += 1


class SweAgentSteps(_Steps):
    source = "swe-agent"

    def read(self, event: dict) -> tuple[str, str, bool]:
        role = event.get("role") or "unknown"
        return str(role), _plain_text(event.get("content")), role == "tool"


class OpenHandsSteps(_Steps):
    source = "openhands"

    def read(self, event: dict) -> tuple[str, str, bool]:
        observed, source = "observation" in event, event.get("source")
        role = "tool" if observed else source if source in ("user", "system") else "assistant"
        return role, _plain_text(event.get("content")), observed


TABLE_FUNCTIONS = {"swe_agent_steps": SweAgentSteps, "openhands_steps": OpenHandsSteps}


def register_table_functions(spark: SparkSession) -> None:
    """Make the adapters callable from SQL."""
    for name, steps in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(steps, returnType=STEPS))
