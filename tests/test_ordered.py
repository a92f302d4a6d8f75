"""Hot-key-safe ordered operations against plain windows."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators.sessions import compounding_growth
from tallyspark.plans.ordered import tag_chunks, with_position, with_previous
from tallyspark.plans.ranking import global_rank
from tallyspark.schemas import LEDGER
from tallyspark.plans.local import columns_of


def table(spark):
    rng = random.Random(1)
    rows, seqs = [], rng.sample(range(5000), 400)
    for s in seqs:
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        rows.append((key, s, rng.choice([None, rng.randrange(1000)])))
    return spark.createDataFrame(rows, "key STRING, seq BIGINT, v INT")


def test_previous_non_null_value_crosses_chunks(spark):
    df = table(spark)
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("key", "seq", "v", F.last("v", True).over(w).alias("p")).collect()
    got = with_previous(df, ["key"], "seq", {"p": F.col("v")}, hot_rows=7).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_positions_cross_chunks(spark):
    df = table(spark)
    w = Window.partitionBy("key").orderBy("seq")
    want = {(r.key, r.seq): r.p for r in df.select("key", "seq", (F.row_number().over(w) - 1).alias("p")).collect()}
    got = {(r.key, r.seq): r.pos for r in with_position(df, ["key"], "seq", hot_rows=7).collect()}
    assert got == want


def test_a_hot_key_is_cut_into_chunks_of_about_the_bound(spark):
    sizes = (
        tag_chunks(table(spark), ["key"], "seq", 20).filter("key = 'hot'").groupBy("_chunk").count().collect()
    )
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 60


def test_compounding_is_the_same_for_any_chunk_size(spark):
    df = table(spark).select(
        F.col("seq").alias("call_seq"), F.col("key").alias("session"),
        F.struct(F.col("v").cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens")).alias("n"),
    )
    ledger = df.select(
        "call_seq", "session",
        F.from_json(F.to_json(F.struct(F.col("n").alias("native_tokens"))), LEDGER.split("cost STRUCT", 1)[1].join(["STRUCT", ""]).split(", cost_quality")[0]).alias("cost"),
        F.from_json(F.lit("{}"), "prompt_tokens BIGINT, completion_tokens BIGINT, input_tokens BIGINT, output_tokens BIGINT, cache_read_input_tokens BIGINT, cache_creation_input_tokens BIGINT").alias("usage_tokens"),
    )
    assert "cost" in columns_of(LEDGER)
    series = {}
    for r in df.orderBy("call_seq").collect():
        if r.n.prompt_tokens:
            series.setdefault(r.session, []).append(r.n.prompt_tokens)
    want = {
        k: (len(s), float(sum(max(s[i + 1] - s[i], 0) * (len(s) - i - 2) for i in range(len(s) - 1))))
        for k, s in series.items()
    }
    for width in (7, 1000):
        rows = compounding_growth(ledger, hot_rows=width).collect()
        assert {r.session: (r.series_calls, r.carried_growth) for r in rows} == want


def test_global_rank_is_dense_and_ordered(spark):
    keys = spark.range(1000).select(F.format_string("k%05d", (F.col("id") * 7919) % 100003).alias("k"))
    got = [r.k for r in global_rank(keys, ["k"]).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert [r.rank for r in global_rank(keys, ["k"]).orderBy("rank").collect()] == list(range(1, 1001))


def test_chunks_are_even_where_order_values_cluster(spark):
    rows = [("hot", 0)] + [("hot", 10**12 + i) for i in range(3000)] + [("cold", i) for i in range(50)]
    tagged = tag_chunks(spark.createDataFrame(rows, "key STRING, seq BIGINT"), ["key"], "seq", hot_rows=100)
    sizes = tagged.groupBy("key", "_chunk").count().collect()
    assert max(r["count"] for r in sizes if r.key == "hot") <= 200
    assert [r["count"] for r in sizes if r.key == "cold"] == [50]
    ends = tagged.filter("key = 'hot'").groupBy("_chunk").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("_chunk").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_ratio_sums_pass_nine_million_calls(spark):
    from tallyspark.operators.sessions import _total

    rows = spark.range(9_400_000).select(F.lit(10**12).cast("bigint").alias("ratio_units"))
    assert rows.agg(_total("ratio_units")).first()[0] == 9_400_000 * 10**12


def test_without_a_hot_key_the_plan_is_a_plain_window(spark):
    df = table(spark)
    for got in (with_previous(df, ["key"], "seq", {"p": F.col("v")}), with_position(df, ["key"], "seq")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_block_of_ten_thousand_cells_is_shuffled_in_one_pass(spark):
    import hashlib
    import time

    from tallyspark.operators.experiment import shuffled

    def plain(n, key):
        out = list(range(n))
        for i in range(n - 1, 0, -1):
            j = int.from_bytes(hashlib.sha256(f"{key}|{i}".encode()).digest()[:8], "big") % (i + 1)
            out[i], out[j] = out[j], out[i]
        return out

    rows = spark.createDataFrame([(n, f"k{n}") for n in (0, 1, 2, 7, 10_000)], "n INT, key STRING")
    cells = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    start = time.perf_counter()
    got = {r.n: list(r.s) for r in rows.select("n", shuffled(cells, F.col("key")).alias("s")).collect()}
    assert time.perf_counter() - start < 20
    assert got == {n: plain(n, f"k{n}") for n in (0, 1, 2, 7, 10_000)}
