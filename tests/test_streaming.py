"""The stream over ordered files equals the batch job."""
from pyspark.sql import functions as F

from conftest import SF_DIR
from tallyspark.operators.ledger import build_ledger
from tallyspark.schemas import CALL_RAW
from tallyspark.sources import derived
from tallyspark.streaming.live import price_stream, running_totals, start_ledger_stream


def test_stream_equals_batch(spark, tmp_path):
    """Named calls with mutations, and chained conversations, over three micro-batches."""
    shift = 10**13
    events = derived.event_calls(spark, SF_DIR).filter(F.col("call_seq") < 300)
    raw = events.unionByName(
        derived.conversation_calls(spark, SF_DIR).withColumn("call_seq", F.col("call_seq") + shift)
    )
    cuts = [-1, 150, shift + 2 * 2**32, 10**15]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = raw.filter((F.col("call_seq") > low) & (F.col("call_seq") <= high))
        part.coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(CALL_RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    dims = derived.dimensions(spark)
    query = start_ledger_stream(stream, *dims, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(240) and query.exception() is None

    batch = build_ledger(raw, *dims)
    for name, want in (("ledger", batch.ledger), ("traces", batch.traces)):
        got = spark.read.parquet(str(tmp_path / f"out/{name}"))
        assert got.select("batch_id").distinct().count() == 3
        got = got.select(*want.columns)
        assert got.count() == want.count() == raw.count()
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_running_totals(spark, tmp_path):
    from tallyspark.checks.queries import stored

    ledger = stored(spark, SF_DIR).ledger
    path = str(tmp_path / "l")
    ledger.write.parquet(path)
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 2).parquet(path)
    query = running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(
        availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.table("totals")
    want = running_totals(ledger)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert running_totals(stream, "2 days").isStreaming
    assert price_stream  # the same pricing serves both paths


def test_an_expired_session_opens_anew(spark, tmp_path):
    """A call that extends a conversation continues it, unless the conversation's state has expired."""
    import json

    def raw(seq, texts):
        body = json.dumps({"model": "m", "messages": [{"role": "user", "content": t} for t in texts]})
        return (seq, "2024-01-01T00:00:00.000+00:00", "openai", "/v1/chat/completions", 200, 1.0, body, None, False, None, False, None, None, False)

    for i, texts in enumerate((["a"], ["a", "b"], ["a", "b", "c"])):
        spark.createDataFrame([raw(i, texts)], CALL_RAW).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    found = {}
    for ttl in (1, 10**9):
        stream = spark.readStream.schema(CALL_RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        out = str(tmp_path / f"out{ttl}")
        query = start_ledger_stream(stream, *derived.dimensions(spark), out, str(tmp_path / f"cp{ttl}"), ttl)
        assert query.awaitTermination(240) and query.exception() is None
        found[ttl] = spark.read.parquet(f"{out}/ledger").orderBy("call_seq").collect()
    assert len({r.session for r in found[10**9]}) == 1 and [r.prefix_stable_ratio for r in found[10**9]] == [None, 1.0, 1.0]
    assert len({r.session for r in found[1]}) == 3 and [r.prefix_stable_ratio for r in found[1]] == [None] * 3


def test_a_repeated_batch_of_day_totals_changes_nothing(spark):
    from tallyspark.streaming.live import _CHANGES, day_changes, day_totals_of

    names = [c.split()[0] for c in _CHANGES.split(", ")]

    def change(day, session, old, new):
        return dict(zip(names, [day, session, *(old or [None] * 8), *map(str, new)], strict=True))

    #            calls, prompt, completion, cached, known calls, usd, ratio, ratio calls
    first = [1, 10, 2, 0, 0, 150, 500_000_000_000, 1]
    second = [3, 30, 6, 4, 2, 149, 2_000_000_000_000, 3]
    rows = [change("2024-01-01", "a", None, first), change("2024-01-01", "a", list(map(str, first)), second),
            change("2024-01-01", "b", None, [2, 5, 1, 0, 0, 0, 0, 0]), change("", "c", None, [1, 0, 0, 0, 0, 0, 0, 0])]
    got = {str(r.ledger_day): r for r in day_totals_of(day_changes(spark.createDataFrame(rows, _CHANGES))).collect()}
    r = got["2024-01-01"]
    assert (r.calls, r.prompt_tokens, r.completion_tokens, r.cached_tokens, r.cache_unavailable_sessions, r.sessions) == (5, 35, 7, 4, 1, 2)
    assert r.cost_usd == 1e-06 and r.mean_prefix_stable_ratio == 0.6667
    assert (got["None"].cached_tokens, got["None"].sessions, got["None"].mean_prefix_stable_ratio) == (None, 1, None)


def test_the_state_is_asked_once_per_batch_and_key():
    """Calls of a session within a batch do not go to the state store one by one."""
    import pandas as pd

    from tallyspark.streaming.live import SessionTracker

    class Map:
        def __init__(self):
            self.rows, self.asked = {}, 0

        def containsKey(self, key):  # noqa: N802
            self.asked += 1
            return key in self.rows

        def getValue(self, key):  # noqa: N802
            self.asked += 1
            return self.rows[key]

        def updateValue(self, key, value):  # noqa: N802
            self.asked += 1
            self.rows[key] = value

        def removeKey(self, key):  # noqa: N802
            self.asked += 1
            self.rows.pop(key, None)

    def call(seq, header):
        keys = [f"k{i}" for i in range(seq % 50 + 1)]
        return {"call_seq": seq, "header": header, "auto_id": f"auto-{seq}", "keys": keys, "canonical": "[" + "x," * len(keys) + "]",
                "tools_key": None, "system_key": None, "request_model": "m", "tool_names": [], "observed_prompt": 5, "payload": str(seq)}

    for header, most in (("u1", 5), (None, 120)):
        tracker = SessionTracker(1)
        tracker.sessions, tracker.ends = Map(), Map()
        found = []
        for low in (0, 50):
            before = tracker.sessions.asked + tracker.ends.asked
            (out,) = tracker.handleInputRows(("k",), iter([pd.DataFrame([call(s, header) for s in range(low, low + 50)])]), None)
            found += out["session"].tolist()
            assert tracker.sessions.asked + tracker.ends.asked - before <= most
        assert found == (["u1"] * 100 if header else ["auto-0"] * 50 + ["auto-50"] * 50)
        if header is None:  # only the prefix that a live session ends with is kept
            assert tracker.ends.rows == {("k49",): (["auto-0", "auto-50"], [49, 99])}


def test_day_totals_of_many_batches_equal_one(spark, tmp_path, monkeypatch):
    """Sessions return in later batches, also after the whole state was written; forgotten ones count anew."""
    import time

    from pyspark.sql.types import StructType

    from tallyspark.schemas import LEDGER
    from tallyspark.streaming import live

    monkeypatch.setattr(live, "WHOLE_EVERY", 2)
    rows = [(i, f"2024-01-0{1 + i % 2}", f"s{i % 3}" if i != 11 else None, 10 + i, 0.25 + 0.01 * i) for i in range(24)]
    calls = spark.createDataFrame(rows, "call_seq BIGINT, day STRING, session STRING, p BIGINT, prefix_stable_ratio DOUBLE")
    usage = F.from_json(F.concat(F.lit('{"prompt_tokens":'), F.col("p").cast("string"), F.lit(',"completion_tokens":1}')),
                        "prompt_tokens BIGINT, completion_tokens BIGINT")
    day = F.when(F.col("call_seq") != 7, F.col("day").cast("date"))
    typed = calls.select("call_seq", "session", "prefix_stable_ratio", day.alias("ledger_day"), usage.alias("u"))
    fields = {f.name: f.dataType for f in StructType.fromDDL(LEDGER)}
    tokens = fields["usage_tokens"]
    struct = F.struct(*[(F.col(f"u.{f.name}") if f.name in ("prompt_tokens", "completion_tokens") else F.lit(None)).cast(f.dataType).alias(f.name) for f in tokens])
    ledger = typed.withColumn("usage_tokens", struct).select(*[
        (F.col(c) if c in ("call_seq", "session", "prefix_stable_ratio", "ledger_day", "usage_tokens") else F.lit(None)).cast(t).alias(c)
        for c, t in fields.items()])

    def totals(batches, out, ttl=None):
        sums = None
        for n, part in enumerate(batches):
            for _ in range(2):  # a repeated batch replaces itself
                changes = live.session_changes(part, n, str(tmp_path / out), ttl)
                changes = spark.createDataFrame(changes.collect(), changes.schema)
            if ttl:
                time.sleep(0.2)
            sums = live.day_changes(changes) if sums is None else sums.unionByName(live.day_changes(changes))
        sums = sums.groupBy("ledger_day").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]])
        return sorted(map(str, live.day_totals_of(sums).collect()))

    parts = [ledger.filter((F.col("call_seq") >= 4 * n) & (F.col("call_seq") < 4 * n + 4)) for n in range(6)]
    once = totals([ledger], "once")
    assert len(once) == 3 and totals(parts, "many") == once
    assert totals(parts, "short", 100) != once
