"""Session chaining against a literal sequential model."""
import json
import random

from tallyspark.operators.calls import parse_calls
from tallyspark.operators import chaining
from tallyspark.operators.chaining import _split_hot, chain_sessions
from tallyspark.operators.ledger import assign_sessions
from tallyspark.plans.staging import stage
from tallyspark.schemas import CALL_RAW


def raw_rows(calls):
    """(seq, header, messages) -> call_raw rows."""
    return [
        (seq, "2024-01-01T00:00:00.000+00:00", "openai", "/v1/chat/completions", 200, 1.0,
         json.dumps({"model": "m", "messages": messages}), None, False, header, False, None, None, False)
        for seq, header, messages in calls
    ]


def sequential(calls):
    """The rule read literally: most recently used session whose last list is a prefix."""
    last, out, roots = {}, {}, {}
    for seq, header, messages in calls:
        session = header
        if session is None:
            for s in reversed(list(last)):
                if messages[: len(last[s])] == last[s]:
                    session = s
                    break
            else:
                session = roots.setdefault(json.dumps(messages), f"new-{json.dumps(messages)}")
        last.pop(session, None)
        last[session] = messages
        out[seq] = session
    return out


def scenario(rng, tag, n, headers):
    """Random growing, forking and repeating conversations over one small alphabet."""
    calls, seen = [], []
    for _ in range(n):
        kind = rng.random()
        if seen and kind < 0.45:
            m = rng.choice(seen) + [rng.choice("abc") for _ in range(rng.randint(1, 2))]
        elif seen and kind < 0.65:
            m = list(rng.choice(seen))
        elif seen and kind < 0.75:
            base = rng.choice(seen)
            m = base[: rng.randint(1, len(base))]
        else:
            m = [f"{tag}-root{rng.randrange(2)}"] + [rng.choice("ab") for _ in range(rng.randint(0, 6))]
        seen.append(m)
        header = f"{tag}-{rng.choice('XY')}" if rng.random() < headers else None
        calls.append((header, m))
    return calls


def check(spark, scenarios, hot_rows, fn):
    rng = random.Random(5)
    pools = {tag: list(calls) for tag, calls in scenarios.items()}
    order, seq = [], 0
    while any(pools.values()):
        tag = rng.choice([t for t, p in pools.items() if p])
        header, messages = pools[tag].pop(0)
        order.append((seq, header, [{"role": "user", "content": m} for m in messages]))
        seq += 1
    want = sequential(order)
    calls = stage(parse_calls(spark.createDataFrame(raw_rows(order), CALL_RAW)), "t")
    got = {r.call_seq: r.session for r in fn(calls, hot_rows).collect()}
    # Opened sessions are named by content on both sides, so names map one to one.
    pairs = {(want[s], got[s]) for s in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for a, b in pairs:
        assert b.startswith("auto-") if a.startswith("new-") else a == b
    return order, got


def test_random_sequences_equal_the_sequential_scan(spark):
    rng = random.Random(11)
    scenarios = {f"q{i}": scenario(rng, f"q{i}", 30, 0.0 if i % 2 else 0.25) for i in range(120)}
    order, got = check(spark, scenarios, 9, assign_sessions)
    assert len(got) == len(order)


def test_long_lists_beyond_the_component_depth(spark):
    rng = random.Random(12)
    scenarios = {}
    for i in range(40):
        shared = [f"q{i}-root", "s1", "s2", "s3", "s4", "s5"]
        scenarios[f"q{i}"] = [(h, shared + m[1:]) for h, m in scenario(rng, f"q{i}", 25, 0.1)]
    check(spark, scenarios, 10**6, assign_sessions)


def test_copies_and_growing_conversations_are_one_scan_event(spark):
    copies = [(None, ["same"])] * 50
    growing = [(None, ["g"] + ["t"] * i) for i in range(50)]
    _, got = check(spark, {"a": copies, "b": growing}, 8, chain_sessions)
    assert len(set(got.values())) == 2


def test_a_shared_first_message_is_cut_below_it(spark):
    rng = random.Random(13)
    calls = []
    for i in range(300):
        calls.append((None, ["sys"] + [f"u{rng.randrange(12)}"] + ["t"] * rng.randrange(5)))
        if rng.random() < 0.1:
            calls.append((None, ["sys"]))
    check(spark, {"a": calls}, 40, assign_sessions)


def parts(spark, order, hot_rows):
    """Calls per component after the cuts."""
    calls = stage(parse_calls(spark.createDataFrame(raw_rows(order), CALL_RAW)), "t")
    narrow = calls.select("call_seq", "header", "n_messages", "prefix_keys", "auto_id")
    placed, *_ = _split_hot(narrow, hot_rows)
    return [r["count"] for r in placed.groupBy("component").count().collect()]


def one_root(rng, n, named, below=60):
    """A shared first message, many conversations below it, and a share of calls with an id."""
    calls, open_lists = [], [["sys"]]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.06:
            m = ["sys"]
        elif kind < 0.5:
            m = rng.choice(open_lists[-40:]) + [f"t{rng.randrange(3)}"]
        else:
            m = ["sys", f"u{rng.randrange(below)}"] + [f"t{rng.randrange(2)}" for _ in range(rng.randrange(3))]
        open_lists.append(m)
        calls.append((f"id{rng.randrange(5)}" if rng.random() < named else None, m))
    return calls


def test_one_call_with_an_id_does_not_stop_the_cuts(spark):
    rng = random.Random(14)
    calls = [(None, ["sys"] + [f"u{rng.randrange(300)}"] + ["t"] * rng.randrange(4)) for _ in range(2000)]
    for at in (300, 900, 1500):
        calls[at] = (None, ["sys"])
    for at in (301, 1000):  # right after a call of the shared message, and elsewhere
        mixed = list(calls)
        mixed[at] = ("me", mixed[at][1])
        order, _ = check(spark, {"a": mixed}, 20, assign_sessions)
        assert max(parts(spark, order, 20)) <= 40


def test_mixed_components_equal_the_sequential_scan(spark):
    for seed, named in ((21, 0.02), (22, 0.1), (23, 0.4)):
        rng = random.Random(seed)
        scenarios = {f"q{i}": [(h and f"q{i}-{h}", [f"q{i}"] + m) for h, m in one_root(rng, 150, named, 8)] for i in range(4)}
        # Ids that move between components leave their old one.
        scenarios["z"] = [(h and f"q0-{h}", ["z"] + m) for h, m in one_root(rng, 80, 0.3, 8)]
        check(spark, scenarios, 12, assign_sessions)


def test_a_long_wait_at_the_root_is_followed_to_its_end(spark, monkeypatch):
    monkeypatch.setattr(chaining, "FIRST_EVENTS", 3)
    calls = [(None, ["sys"]), ("me", ["sys", "a"])]
    calls += [(None, ["sys", "a"] + ["t"] * i) for i in range(1, 60)]
    calls += [(None, ["sys", "b"]), (None, ["sys", "b", "c"])] + [(None, ["sys", f"u{i}"]) for i in range(40)]
    check(spark, {"a": calls}, 10, assign_sessions)
