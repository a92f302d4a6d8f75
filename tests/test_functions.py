import hashlib
import hmac
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import economics, stats, text
from tallyspark.functions.rounding import from_units, py_round, to_units
from tallyspark.functions.usage import parse_usage, sse_payloads, tool_names, with_usage
from tallyspark.functions.pricing import effective_cost_h1


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_is_pythons(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.uniform(-1e4, 1e4), round(rng.uniform(0, 100), 3), rng.randint(0, 9999) / 20,
                          rng.randint(0, 9999) / 8]) for _ in range(4000)] + [2.675, 0.15, 0.25, 1e300, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    for n in (1, 2, 4, 6, 8):
        got = [r[0] for r in df.select(py_round(F.col("x"), n)).collect()]
        assert got == [round(v, n) for v in values]
    assert one(spark, from_units(to_units(F.lit(0.0204), 8), 8))[0] == 0.0204


def exact_mcnemar(a, b):
    tail = sum(math.comb(a + b, i) for i in range(min(a, b) + 1))
    return min(1.0, float(Fraction(2 * tail, 2 ** (a + b))))


def test_mcnemar_is_exact_and_does_not_overflow(spark):
    cases = [(10, 0), (5, 5), (3, 0), (2, 0), (480, 600), (900, 1100), (3000, 3100), (1500, 500)]
    df = spark.createDataFrame(cases, "a INT, b INT")
    for r in df.select("a", "b", stats.mcnemar_exact(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(exact_mcnemar(r.a, r.b), rel=1e-9)
    assert one(spark, stats.mcnemar_exact(F.lit(0), F.lit(0)))[0] is None
    huge = one(spark, stats.mcnemar_exact(F.lit(500_000_000), F.lit(500_100_000)))[0]
    assert huge == pytest.approx(math.erfc(100_000 / math.sqrt(1_000_100_000) / math.sqrt(2)), rel=1e-3)


def test_intervals_and_planning(spark):
    w = one(spark, stats.wilson_interval(F.lit(0), F.lit(10)), stats.wilson_interval(F.lit(10), F.lit(10)),
            stats.wilson_interval(F.lit(0), F.lit(0)))
    assert w[0].point == 0.0 and w[0].ci_low == 0.0 and 0 < w[0].ci_high < 1
    assert w[1].point == 1.0 and 0 < w[1].ci_low < 1 and w[1].ci_high == 1.0
    assert tuple(w[2]) == (0.0, 0.0, 1.0)
    r = one(spark, stats.required_pairs(), stats.required_pairs(effect=0.70),
            stats.required_pairs(0.10), stats.required_pairs(effect=0.5), stats.required_pairs(power=0.9))
    # Fixed value: the published break-even body size, 650 tokens.
    assert r[0] == 650 and r[1] < 650 < r[2] and r[3] == 0 and r[4] > 650


def test_verdict_order(spark):
    def verdict(p, rate, pairs, a, b, floor=None):
        lit = lambda v, t: F.lit(v).cast(t)
        return one(spark, stats.paired_verdict(lit(p, "double"), lit(rate, "double"), lit(pairs, "int"),
                                               lit(a, "int"), lit(b, "int"), lit(floor, "double")))[0]
    assert verdict(None, 0.0, 3, 0, 0) == "UNDERPOWERED"
    assert verdict(0.01, 0.2, 100, 20, 0, 0.2) == "WITHIN_NOISE"
    assert verdict(0.2, 0.3, 59, 9, 9, 0.1) == "UNDERPOWERED"
    assert verdict(0.2, 0.3, 60, 9, 9, 0.1) == "NOT_SUPPORTED"
    assert verdict(0.01, 0.3, 60, 15, 3) == "SUPPORTED"
    assert verdict(0.01, 0.3, 60, 3, 15) == "SUPPORTED_NEGATIVE"


def test_text_functions(spark):
    pairs = [("abc", "abd"), ("", "x"), ("same", "same"), ("a😀b", "a😀c"), ("x" * 5000 + "1", "x" * 5000 + "2")]
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    assert [r[0] for r in df.select(text.common_prefix_len(F.col("a"), F.col("b"))).collect()] == [2, 0, 4, 2, 5000]
    for salt in (b"k", bytes(range(32)), b"z" * 80):
        assert one(spark, text.hmac_sha256_hex(salt, F.lit("aabb")))[0] == hmac.new(salt, b"aabb", "sha256").hexdigest()
    ids = ["ok-1.A_b", "../../../evil", "a" * 65, "with\n", ""]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "s STRING").select(text.safe_session(F.col("s"))).collect()]
    assert got[0] == "ok-1.A_b"
    assert got[1:] == ["hdr-" + hashlib.sha256(i.encode()).hexdigest()[:10] for i in ids[1:]]
    canon = one(spark, text.canonical_json(F.parse_json(F.lit('{"b":1,"a":"é\\n"}'))))[0]
    assert canon == '{"a":"é\\n","b":1}'


def responses(spark, rows):
    df = spark.createDataFrame(rows, "dialect STRING, response_body STRING, response_is_sse BOOLEAN")
    return [r[0] for r in with_usage(df).select("_res").collect()]


def test_usage_from_bodies_and_streams(spark):
    sse = ('data: {"model":"m1"}\r\n\r\ndata: broken{\n\ndata: {"usage":{"prompt_tokens":1}}\n'
           'data: {"usage":{}}\ndata: {"model":"m2","usage":{"prompt_tokens":100,"completion_tokens":10}}\n\ndata: [DONE]\n')
    second = ('data: {"type":"message_start","message":{"model":"c","usage":{"input_tokens":50,"output_tokens":1}}}\n\n'
              'data: {"type":"message_delta","usage":{"output_tokens":7}}\n\ndata: {"type":"message_delta","usage":{}}\n')
    got = responses(spark, [
        ("openai", '{"model":"b","usage":{"prompt_tokens":5}}', False), ("openai", sse, True),
        ("anthropic", second, True), ("openai", "{broken", False), ("openai", None, False),
        ("openai", "data: [DONE]\n", True), ("openai", '{"usage":null,"model":"x"}', False),
    ])
    assert got[0].model == "b" and got[0].usage == '{"prompt_tokens":5}'
    assert got[1].model == "m2" and "100" in got[1].usage
    assert got[2].model == "c" and sorted(got[2].usage.strip("{}").split(",")) == ['"input_tokens":50', '"output_tokens":7']
    assert got[3].usage is None and got[4].usage is None and got[5].usage is None
    assert got[6].usage is None and got[6].model == "x"
    assert one(spark, sse_payloads(F.lit("data:  a \n\nevent: x\ndata:[DONE]\ndata: b")))[0] == ["a", "b"]


def test_tool_names(spark):
    tools = '[{"function":{"name":"read"}},{"name":"grep"},{"function":{}, "name":"ls"},{"function":{"x":1},"name":"no"},5]'
    assert one(spark, tool_names(F.parse_json(F.lit(tools))))[0] == ["read", "grep", "ls"]
    assert one(spark, tool_names(F.lit(None).cast("variant")))[0] == []


def test_h1_weights(spark):
    usage = F.lit('{"prompt_tokens":7000,"completion_tokens":900,"prompt_tokens_details":{"cached_tokens":3000}}')
    r = one(spark, effective_cost_h1(parse_usage(usage)), effective_cost_h1(parse_usage(F.lit('{"prompt_tokens":1}'))),
            effective_cost_h1(parse_usage(usage), (1.0, 0.0, 0.0)))
    assert r[0] == pytest.approx(4000 + 0.1 * 3000 + 5 * 900) and r[1] is None and r[2] == 4000.0


def test_skill_economics(spark):
    L = F.lit
    r = one(spark, economics.hold_cost(L(500), 40), economics.break_even_steps(L(200), L(10000.0)),
            economics.break_even_steps(L(2000), L(10000.0)), economics.break_even_steps(L(500), L(0.0)),
            economics.net_steps_saved(L(1)), economics.net_steps_saved(L(6)))
    # Fixed value: the published hold cost of 500 tokens over 40 turns.
    assert r[0] == 2625.0 and r[1] < r[2] and r[3] is None and (r[4], r[5]) == (0, 5)
