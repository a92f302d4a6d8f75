"""Metering a live stream of raw calls.

One stateful operator keeps, per chain key, what the batch job looks up in earlier rows: the
open sessions, each session's last messages and segments, and its last observed prompt size.
The chain key is the session id of a call that has one, else its first message.  On ordered
input the rows equal the batch job's, with one limit: a call without an id does not continue a
session that was opened with one.

State lives in RocksDB and a session's entries expire after ``ttl_ms`` without a call.  (The
batch job has no such bound.)  The stream never drops a call: unreadable bodies give rows with
NULL usage.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import pricing
from ..functions.rounding import from_units, py_round, to_units
from ..functions.text import ledger_day
from ..functions.usage import call_tokens
from ..operators.calls import parse_calls
from ..operators.ledger import AuditTables, price_calls
from ..operators.prefix import mutation
from ..operators.sessions import RATIO_DIGITS, call_facts, session_key
from ..plans.local import columns_of, local_table
from ..schemas import LEDGER, TRACE

# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
METRICS = "calls BIGINT, unread BIGINT, truncated BIGINT"
DAY_MS = 24 * 60 * 60 * 1000

_PASSED = (
    "call_seq BIGINT, ts STRING, dialect STRING, path STRING, status INT, latency_ms DOUBLE, "
    "gateway_injected BOOLEAN, tap_truncated BOOLEAN, request_sha_before STRING, "
    "request_sha_after STRING, request_parse_error STRING, usage STRING, model STRING, "
    "n_messages INT, roles ARRAY<STRING>, message_sha256 ARRAY<STRING>, message_bytes ARRAY<BIGINT>"
)
_SEGMENTS = "tools_key STRING, system_key STRING, request_model STRING, tool_names ARRAY<STRING>"
_OUT = (
    "session STRING, prefix_stable_ratio DOUBLE, had_previous BOOLEAN, prev_tools STRING, prev_system STRING, "
    "prev_model STRING, prev_names ARRAY<STRING>, prev_prompt BIGINT, payload STRING"
)
_SESSION = (
    "canonical STRING, end_key STRING, seq BIGINT, tools STRING, system STRING, model STRING, "
    "tool_names ARRAY<STRING>, prompt BIGINT"
)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _value(x):
    """Arrow gives NaN or None for a missing value."""
    return None if x is None or (isinstance(x, float) and x != x) else x


class SessionTracker(StatefulProcessor):
    """Sessions of one chain key."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "k STRING"
        self.sessions = handle.getMapState("sessions", key, _SESSION, self.ttl_ms)
        self.ends = handle.getMapState(
            "ends", key, "sessions ARRAY<STRING>, seqs ARRAY<BIGINT>", self.ttl_ms
        )

    def _session(self, name: str):
        """A session as it stands; read from the state once per batch and key."""
        if name not in self.seen:
            self.seen[name] = self.sessions.getValue((name,)) if self.sessions.containsKey((name,)) else None
        return self.seen[name]

    def _ending(self, key: str) -> tuple[list[str], list[int]]:
        """Sessions listed at a prefix, with their last calls; read once per batch and key."""
        if key not in self.listed:
            self.listed[key] = tuple(map(list, self.ends.getValue((key,)))) if self.ends.containsKey((key,)) else ([], [])
            self.stored[key] = bool(self.listed[key][0])
        return self.listed[key]

    def _open_at(self, key: str):
        """The most recent live session that ended at this prefix; forget outdated ones."""
        names, seqs = self._ending(key)
        while names:
            known = self._session(names[-1])
            if known is not None and known[1] == key and known[2] == seqs[-1]:
                return seqs[-1], names[-1]
            names.pop()
            seqs.pop()
            self.moved.add(key)
        return None

    def _chain(self, keys: list[str]):
        found = [hit for hit in map(self._open_at, keys) if hit is not None]
        return max(found)[1] if found else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch holds a bounded part of a key; its rows are put in call order.
        batch = pd.concat(list(rows)).sort_values("call_seq")
        # The state is asked and told once per batch, not once per call.
        self.seen, self.listed, self.stored, self.used, self.moved = {}, {}, {}, set(), set()
        out = [self._one(r) for r in batch.to_dict("records")]
        for name in sorted(self.used):
            self.sessions.updateValue((name,), self.seen[name])
        for end in sorted(self.moved):
            if self.listed[end][0]:
                self.ends.updateValue((end,), self.listed[end])
            elif self.stored[end]:
                self.ends.removeKey((end,))
        yield pd.DataFrame(out, columns=[
            "session", "prefix_stable_ratio", "had_previous", "prev_tools", "prev_system", "prev_model",
            "prev_names", "prev_prompt", "payload"])

    def _move_end(self, session: str, before, key: str, seq: int) -> None:
        """A session is listed at the one prefix that it ends with, so lists hold live sessions only."""
        if before is not None and before[1] is not None:
            names, seqs = self._ending(before[1])
            for i in reversed([i for i, n in enumerate(names) if n == session]):
                del names[i], seqs[i]
            self.moved.add(before[1])
        names, seqs = self._ending(key)
        names.append(session)
        seqs.append(seq)
        self.moved.add(key)

    def _one(self, r: dict) -> tuple:
        """The call's session and what the session looked like before it."""
        seq, keys = int(r["call_seq"]), [str(k) for k in r["keys"]]
        session = _value(r["header"]) or (self._chain(keys) if keys else None) or r["auto_id"]
        before = self._session(session)
        canonical, end_key, end_seq, *earlier, prompt = before or (None,) * 8
        ratio = None
        if keys:
            if canonical:
                ratio = _shared(canonical[:-1], r["canonical"]) / (len(canonical) - 1)
            # A key of calls with an id holds that session alone, which is never looked up by a prefix.
            if not _value(r["header"]):
                self._move_end(session, before, keys[-1], seq)
            canonical, end_key, end_seq = r["canonical"], keys[-1], seq
        seen = _value(r["observed_prompt"])
        now = [_value(r[c]) for c in ("tools_key", "system_key", "request_model")]
        names = [str(t) for t in r["tool_names"]]
        self.seen[session] = (canonical, end_key, end_seq, *now, names, int(seen) if seen else prompt)
        self.used.add(session)
        return (session, ratio, before is not None, *earlier, prompt, r["payload"])

    def close(self) -> None:
        pass


def track_sessions(raw_stream: DataFrame, ttl_ms: int = 30 * DAY_MS) -> DataFrame:
    """``call_raw`` stream -> parsed rows with session, ratio and mutation."""
    calls = parse_calls(raw_stream, keep_text=True)
    keys = F.transform("prefix_keys", lambda k: F.lower(F.hex(k)))
    own = F.coalesce(
        F.concat(F.lit("id:"), F.col("header")),
        F.concat(F.lit("first:"), F.try_element_at(keys, F.lit(1))),
        F.concat(F.lit("seed:"), F.col("auto_id")),
    )
    keyed = calls.select(
        own.alias("chain_key"), "call_seq", "header", "auto_id", keys.alias("keys"), "canonical",
        "tools_key", "system_key", "request_model", "tool_names",
        F.nullif(F.col("usage_tokens")["prompt_tokens"], F.lit(0)).alias("observed_prompt"),
        F.to_json(F.struct(*columns_of(_PASSED), *columns_of(_SEGMENTS))).alias("payload"),
    )
    tracked = keyed.groupBy("chain_key").transformWithStateInPandas(
        statefulProcessor=SessionTracker(ttl_ms), outputStructType=StructType.fromDDL(_OUT),
        outputMode="Append", timeMode="ProcessingTime",
    )
    previous = F.struct(
        F.col("prev_tools").alias("tools"), F.col("prev_system").alias("system"), F.col("prev_model").alias("model"),
        F.col("prev_names").alias("tool_names"))
    linked = tracked.select(
        F.from_json("payload", f"{_PASSED}, {_SEGMENTS}").alias("p"), "session", "prefix_stable_ratio",
        F.when(F.col("had_previous"), previous).alias("prev_segments"), F.col("prev_prompt").alias("prev_prompt_tokens"),
    ).select("p.*", "session", "prefix_stable_ratio", "prev_segments", "prev_prompt_tokens")
    return linked.withColumn("prefix_mutation", mutation()).select(
        *columns_of(_PASSED), "session", "prefix_stable_ratio", "prefix_mutation")


def price_stream(tracked: DataFrame, profiles: DataFrame, prices: DataFrame,
                 cache_schemas: DataFrame) -> AuditTables:
    """Ledger and trace rows of tracked calls (stream or micro-batch)."""
    from ..functions.usage import parse_usage

    rows = tracked.withColumn("usage_tokens", parse_usage(F.col("usage")))
    ledger = price_calls(rows, profiles, prices, cache_schemas).withColumns(
        {
            "ledger_day": ledger_day(F.col("ts")),
            "cache_miss_unexplained": pricing.unexplained_miss(F.col("prefix_mutation"), F.col("cost")),
        }
    )
    return AuditTables(ledger.select(*columns_of(LEDGER)), tracked.select(*columns_of(TRACE)))


def running_totals(ledger_stream: DataFrame, late: str | None = None) -> DataFrame:
    """Day and session sums for update mode.

    With ``late`` (for example ``"2 days"``) a watermark on the call time bounds the state.
    """
    prompt, completion = call_tokens(F.col("cost")["native_tokens"], F.col("usage_tokens"))
    rows = ledger_stream.withColumn("call_time", F.col("ts").try_cast("timestamp"))
    day = F.col("ledger_day")
    keys = [day, session_key(F.col("session")).alias("session")]
    if late is not None:
        rows = rows.withWatermark("call_time", late)
        keys = [F.window("call_time", "1 day").alias("day_window"), *keys]
    cost = F.col("cost")
    # Rows of older ledgers have no status of their own.
    status = F.coalesce(
        F.nullif(cost["cache_status"], F.lit("")), pricing.cache_status(cost["observed_flags"], cost["imputed_flags"]))
    known = cost.isNotNull() & (status != "unavailable")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"),
        F.sum(F.when(known, F.coalesce(cost["native_tokens"]["cached_tokens"], F.lit(0)))).alias(
            "cached_tokens"
        ),
        from_units(F.sum(F.coalesce(to_units(cost["list_cost_usd"], 8), F.lit(0))), 8).alias("cost_usd"),
    )


_FIGURES = ("calls", "prompt_tokens", "completion_tokens", "known_cached", "cache_known_calls", "usd_units", "ratio_units", "ratio_calls")
_CHANGES = "ledger_day STRING, session STRING, " + ", ".join(f"{side}_{f} STRING" for side in ("old", "new") for f in _FIGURES)


#: Every so many batches the whole state is written, so a look-up reads no more batches than that.
WHOLE_EVERY = 16


def session_changes(batch: DataFrame, batch_id: int, state: str, ttl_ms: int | None = None) -> DataFrame:
    """The former and the new totals of every session and day that a batch touches.

    The state is a table of totals by day: ``state/batch_id=<batch>`` has the sessions that the batch
    touched, and at every ``WHOLE_EVERY``-th batch all of them.  A batch reads those before it, of the
    days that it touches, and replaces its own folder when it is repeated.  Totals that no batch has
    touched for ``ttl_ms`` are forgotten.
    """
    spark = batch.sparkSession
    keys, whole = ["ledger_day", "session"], batch_id > 0 and batch_id % WHOLE_EVERY == 0
    facts = call_facts(batch, keys).withColumn("ledger_day", F.coalesce(F.col("ledger_day").cast("string"), F.lit("")))
    # Sums of ratios pass 64 bits.
    added = facts.groupBy(*keys).agg(*[F.sum(F.col(f).cast("decimal(28,0)")).cast("decimal(38,0)").alias(f"_a_{f}") for f in _FIGURES])
    first = max(batch_id - 1, 0) // WHOLE_EVERY * WHOLE_EVERY
    folders = [f"{state}/batch_id={b}" for b in range(first, batch_id)]
    fields = ", ".join(f"new_{f} DECIMAL(38,0)" for f in _FIGURES)
    schema = f"session STRING, {', '.join(f'old_{f} DECIMAL(38,0)' for f in _FIGURES)}, {fields}, at BIGINT, day STRING, batch_id INT"
    now = int(time.time() * 1000)
    if folders:
        former = spark.read.schema(schema).option("basePath", state).parquet(*folders)
        if not whole:
            days = added.select(F.concat(F.lit("d"), F.col("ledger_day")).alias("day")).distinct()
            former = former.join(F.broadcast(days), "day", "left_semi")
        former = former.groupBy(F.substring("day", 2, 20).alias("ledger_day"), "session").agg(
            F.max_by(F.struct(*[F.col(f"new_{f}").alias(f"old_{f}") for f in _FIGURES], "at"), "batch_id").alias("_o")
        ).select(*keys, "_o.*")
        if ttl_ms:
            former = former.filter(F.col("at") > now - ttl_ms)
        joined = added.join(former, keys, "full" if whole else "left")
    else:
        joined = added.select("*", *[F.lit(None).cast("decimal(38,0)").alias(f"old_{f}") for f in _FIGURES], F.lit(now).alias("at"))
    touched = F.col("_a_calls").isNotNull()
    zero = F.lit(0).cast("decimal(38,0)")
    totals = {f"new_{f}": (F.coalesce(f"old_{f}", zero) + F.coalesce(f"_a_{f}", zero)).cast("decimal(38,0)") for f in _FIGURES}
    joined.select(
        "session", *[f"old_{f}" for f in _FIGURES], *[v.alias(k) for k, v in totals.items()],
        F.when(touched, F.lit(now)).otherwise(F.col("at")).cast("bigint").alias("at"),
        F.concat(F.lit("d"), F.col("ledger_day")).alias("day"),
    ).write.partitionBy("day").mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
    written = spark.read.schema(schema).option("basePath", state).parquet(f"{state}/batch_id={batch_id}")
    # Sessions that a whole table only carries on have not changed.
    changed = written.filter(F.col("at") == now) if whole else written
    return changed.select(
        F.substring("day", 2, 20).alias("ledger_day"), "session",
        *[F.col(f"{side}_{f}").cast("string").alias(f"{side}_{f}") for side in ("old", "new") for f in _FIGURES])


def day_changes(changes: DataFrame) -> DataFrame:
    """What a batch's session totals add to their days: the new row counts, the former is taken back."""
    parts = []
    for side, sign in (("new", 1), ("old", -1)):
        n = {f: F.col(f"{side}_{f}").cast("decimal(38,0)") for f in _FIGURES}
        known = n["cache_known_calls"] > 0
        usd = to_units(py_round(from_units(n["usd_units"].cast("bigint"), 8), 6), 6)
        mean = from_units(n["ratio_units"], RATIO_DIGITS) / F.nullif(n["ratio_calls"].cast("double"), F.lit(0.0))
        amounts = {
            "calls": n["calls"], "prompt_tokens": n["prompt_tokens"], "completion_tokens": n["completion_tokens"], "usd_units": usd,
            "cached_tokens": F.when(known, n["known_cached"]).otherwise(0), "cache_known_sessions": F.when(known, 1).otherwise(0),
            "sessions": F.lit(1), "ratio_units": F.coalesce(to_units(py_round(mean, 4), 4), F.lit(0)),
            "ratio_sessions": F.when(n["ratio_calls"] > 0, 1).otherwise(0),
        }
        parts.append(changes.filter(F.col(f"{side}_calls").isNotNull()).select(
            "ledger_day", *[(F.lit(sign) * v).cast("bigint").alias(k) for k, v in amounts.items()]))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("ledger_day").agg(*[F.sum(c).alias(c) for c in both.columns[1:]])


def day_totals_of(sums: DataFrame) -> DataFrame:
    """The columns of :func:`~tallyspark.operators.sessions.day_totals` from the running sums of days."""
    mean = from_units(F.col("ratio_units"), 4) / F.nullif(F.col("ratio_sessions").cast("double"), F.lit(0.0))
    return sums.select(
        F.nullif("ledger_day", F.lit("")).cast("date").alias("ledger_day"), "calls", "prompt_tokens", "completion_tokens",
        from_units(F.col("usd_units"), 6).alias("cost_usd"),
        F.when(F.col("cache_known_sessions") > 0, F.col("cached_tokens")).alias("cached_tokens"),
        (F.col("sessions") - F.col("cache_known_sessions")).alias("cache_unavailable_sessions"), "sessions",
        py_round(mean, 4).alias("mean_prefix_stable_ratio"),
    )


def start_day_totals(ledger_stream: DataFrame, out: str, checkpoint: str, ttl_ms: int | None = None, **trigger):
    """Keep ``out/version=<batch>``: the running sums of all days after each batch.

    The first state is the sessions' totals, a table beside the checkpoint; the second the days' sums,
    one small row per day, taken from the version before.  A repeated batch replaces its own version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        added = day_changes(session_changes(batch, batch_id, f"{checkpoint}/session_totals", ttl_ms))
        if batch_id:
            added = added.unionByName(batch.sparkSession.read.parquet(f"{out}/version={batch_id - 1}"))
        sums = added.groupBy("ledger_day").agg(*[F.sum(c).alias(c) for c in added.columns[1:]])
        sums.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return (
        ledger_stream.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def start_ledger_stream(raw_stream: DataFrame, profiles: DataFrame, prices: DataFrame,
                        cache_schemas: DataFrame, out: str, checkpoint: str,
                        ttl_ms: int = 30 * DAY_MS, **trigger):
    """Write ``out/ledger``, ``out/traces``, ``out/broken`` and ``out/metrics``.

    Each micro-batch owns one folder per table, so a repeated batch replaces its own rows and
    nothing else.  No call is dropped: one with an unreadable request or a truncated response is in the
    ledger, and in ``broken`` besides, for whoever repairs the sender.  ``metrics`` holds what was
    observed while the ledger was written: calls, broken and truncated ones.
    """
    spark = raw_stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Expiry needs no batches of its own, and an available-now run could not end with them.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    tracked = track_sessions(raw_stream, ttl_ms)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        tables = price_stream(batch, profiles, prices, cache_schemas)
        unread, cut = F.col("request_parse_error").isNotNull(), F.coalesce("tap_truncated", F.lit(False))
        seen = Observation()
        tables.ledger.observe(
            seen, F.count(F.lit(1)).alias("calls"), F.count_if(unread).alias("unread"), F.count_if(cut).alias("truncated"),
        ).write.mode("overwrite").parquet(f"{out}/ledger/batch_id={batch_id}")
        tables.ledger.filter(unread | cut).select(
            "call_seq", "session", "ts", "path", "status", "request_parse_error", "tap_truncated"
        ).write.mode("overwrite").parquet(f"{out}/broken/batch_id={batch_id}")
        counts = seen.get
        local_table(batch.sparkSession, [tuple(counts[c] for c in ("calls", "unread", "truncated"))], METRICS).write.mode(
            "overwrite").parquet(f"{out}/metrics/batch_id={batch_id}")
        tables.traces.write.mode("overwrite").parquet(f"{out}/traces/batch_id={batch_id}")
        batch.unpersist()

    return (
        tracked.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
