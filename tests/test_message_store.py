"""Common prefixes of rewritten messages, from block digests, against the texts themselves."""
import json
import os
import random

from tallyspark.operators import calls as calls_module
from tallyspark.operators.calls import BLOCK_CHARS, message_store, parse_calls
from tallyspark.operators.ledger import build_ledger
from tallyspark.operators import prefix
from tallyspark.plans.staging import stage
from tallyspark.schemas import CALL_RAW
from tallyspark.sources.derived import dimensions


def raw(seq, session, messages):
    body = json.dumps({"model": "m", "messages": messages}, ensure_ascii=False)
    return (seq, "2024-01-01T00:00:00.000+00:00", "openai", "/v1/chat/completions", 200, 1.0, body, None, False, session, False, None, None, False)


def open_form(messages):
    return json.dumps(messages, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def scenario():
    rng = random.Random(31)
    rows, want, last = [], {}, {}
    for seq in range(160):
        session = f"s{rng.randrange(12)}"
        before = last.get(session)
        messages = [dict(m) for m in before] if before else [{"role": "system", "content": rng.choice("xyzü日") * rng.choice([3, BLOCK_CHARS - 40, BLOCK_CHARS, 3 * BLOCK_CHARS])}]
        kind = rng.random()
        if kind < 0.4 or len(messages) < 2:
            messages.append({"role": "user", "content": "".join(rng.choice("ab𝔘é ") for _ in range(rng.choice([0, 5, BLOCK_CHARS, 2500])))})
        elif kind < 0.9:
            at = rng.randrange(len(messages))
            text = messages[at]["content"]
            cut = rng.randrange(len(text) + 1)
            # Cut short, changed in the middle, or changed exactly at a block's edge.
            messages[at]["content"] = rng.choice([text[:cut], text[:cut] + "#" + text[cut + 1 :], text[: BLOCK_CHARS - 12] + "#"])
        else:
            messages = messages[: rng.randrange(1, len(messages))]
        rows.append(raw(seq, session, messages))
        if before is not None:
            a, b = open_form(before)[:-1], open_form(messages)
            want[seq] = len(os.path.commonprefix([a, b])) / len(a)
        else:
            want[seq] = None
        last[session] = messages
    return rows, want


def check(spark):
    rows, want = scenario()
    built = build_ledger(spark.createDataFrame(rows, CALL_RAW), *dimensions(spark))
    got = {r.call_seq: r.prefix_stable_ratio for r in built.ledger.collect()}
    assert got == want


def test_ratios_of_long_and_rewritten_messages(spark):
    check(spark)


def test_many_rewritten_messages_use_the_whole_store(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BROADCAST_BLOCKS", 0)
    check(spark)


def test_no_join_carries_bodies(spark):
    rows, _ = scenario()
    built = build_ledger(stage(spark.createDataFrame(rows, CALL_RAW), "raw"), *dimensions(spark))
    plan = built.ledger._jdf.queryExecution().toString()
    assert "request_body" not in plan and "message_texts" not in plan


def test_each_block_is_stored_once(spark):
    long = "z" * (2 * BLOCK_CHARS)
    rows = [raw(i, "s", [{"role": "user", "content": long}, {"role": "user", "content": str(i % 3)}]) for i in range(30)]
    parsed = stage(parse_calls(spark.createDataFrame(rows, CALL_RAW).repartition(4)), "t")
    store = message_store(parsed).collect()
    assert len(store) == 3 + 3
    assert sorted(len(r.block) for r in store)[-2:] == [BLOCK_CHARS] * 2


def test_messages_that_are_no_list_are_no_parse_error(spark):
    bodies = ['{"model": "m", "messages": "text"}', '{"model": "m", "messages": {"a": 1}}', '{"model": "m", "messages": [1, {"role": "user"}]}', '{"model": ']
    rows = [(i, *raw(i, "s", [])[1:6], b, *raw(i, "s", [])[7:]) for i, b in enumerate(bodies)]
    got = {r.call_seq: (r.request_parse_error, r.n_messages, r.roles) for r in parse_calls(spark.createDataFrame(rows, CALL_RAW)).collect()}
    assert got[0][:2] == got[1][:2] == (None, 0)
    assert got[2] == (None, 2, ["user"])
    assert got[3][0] == calls_module.PARSE_ERROR
