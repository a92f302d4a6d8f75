"""Line-ordered readers, profile files and submission versions."""
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import privacy
from tallyspark.sources import dimensions, ledgers, lines, outcomes


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_files_of_one_name_in_several_folders_are_several_files(spark, tmp_path):
    names = ["a/2026-01-01.jsonl", "b c/2026-01-01.jsonl", "b c/x%20y+z/2026-01-02.jsonl", "é/2026-01-01.jsonl"]
    for n, name in enumerate(names):
        put(f"{tmp_path}/in/{name}", "".join(json.dumps({"path": f"{n}-{i}", "latency_ms": i}) + "\n" + "broken {\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = ledgers.read_ledger_json(spark, f"{tmp_path}/in").orderBy("call_seq").collect()
        found = lines.text_lines(spark, f"{tmp_path}/in")
        assert found.select("line").distinct().count() == found.count() == 2400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = sorted(range(4), key=lambda n: names[n])
    assert [r.path for r in got] == [f"{n}-{i}" for n in order for i in range(300)]
    assert {str(r.ledger_day) for r in got if r.path.startswith("2-")} == {"2026-01-02"}
    assert [lines_of(got, n) for n in range(4)] == [300] * 4


def lines_of(rows, n):
    return sum(r.path.startswith(f"{n}-") for r in rows)


def test_a_missing_path_is_an_empty_table(spark, tmp_path):
    assert ledgers.read_ledger_json(spark, f"{tmp_path}/none").collect() == []
    assert outcomes.load_outcomes(spark, f"{tmp_path}/none").collect() == []


PROFILE = """name: one
base_url: http://a.invalid/
accountant_model: own/model
price_date: '2026-02-03'
api_key_env: SOME_KEY
prices_per_1m: {input: 1, cached_input: 0.25, output: 4}
cache_schema:
  cached_tokens: {surfaces: true, path: [details, hits]}
  reasoning_tokens:
"""


def register(spark, path):
    return dimensions.register_profiles(
        dimensions.read_profiles(spark, path), dimensions.builtin_prices(spark), dimensions.builtin_cache_schemas(spark))


def test_profiles_are_read_and_registered(spark, tmp_path):
    put(f"{tmp_path}/p/one.yaml", PROFILE)
    put(f"{tmp_path}/p/deep/two.yml", "base_url: http://b.invalid\ndialect: anthropic\n")  # named after the file, registers nothing
    put(f"{tmp_path}/p/three.yaml", "base_url: x\naccountant_model: openai/gpt-5-5\nprice_date: 2026-07-15\n")  # names a known model
    put(f"{tmp_path}/p/notes.txt", "not a profile")
    profiles, prices, schemas = register(spark, f"{tmp_path}/p")
    assert {tuple(r) for r in profiles.collect()} == {
        ("openai", "one", "own/model", "2026-02-03"), ("anthropic", "two", None, None), ("openai", "three", "openai/gpt-5-5", "2026-07-15")}
    (price,) = prices.filter("accountant_model = 'own/model'").collect()
    assert (price.input_per_1m, price.cached_input_per_1m, price.output_per_1m, price.cache_creation_per_1m) == (1.0, 0.25, 4.0, None)
    own = {r.category: (r.surfaces, r.path) for r in schemas.filter("accountant_model = 'own/model'").collect()}
    assert own == {"cached_tokens": (True, ["details", "hits"]), "cache_creation_tokens": (False, None), "reasoning_tokens": (False, None)}
    assert prices.count() == 3 and schemas.count() == 9


@pytest.mark.parametrize("name, text, message", [
    ("b", PROFILE, "already registered"),
    ("b", PROFILE.replace("own/model", "openai/gpt-5-5").replace("2026-02-03", "2026-07-15"), "already registered"),
    ("b", PROFILE.replace("own/model", "other").replace(", output: 4", ""), "price output_per_1m is required"),
    ("b", "name: x\n", "base_url"),
])
def test_wrong_profiles_fail(spark, tmp_path, name, text, message):
    put(f"{tmp_path}/p/a.yaml", PROFILE)
    put(f"{tmp_path}/p/{name}.yaml", text)
    with pytest.raises(Exception, match=message):
        for table in register(spark, f"{tmp_path}/p"):
            table.collect()


def test_the_driver_lists_folders_not_their_profiles(spark, tmp_path):
    """Files in folders are listed by tasks, and registering reads each file once."""
    for i in range(300):
        put(f"{tmp_path}/p/f{i % 3}/deep{i % 2}/m{i}.yaml", PROFILE.replace("own/model", f"m{i}").replace("name: one", f"name: n{i}"))
    put(f"{tmp_path}/p/top.yml", "base_url: x\n")
    parts = dimensions.ProfileReader(f"{tmp_path}/p").partitions()
    assert sum(len(p.files) for p in parts) == 1 and sorted(p.folder or "" for p in parts) == [
        "", *(f"{tmp_path}/p/f{i}" for i in range(3))]
    profiles, prices, schemas = register(spark, f"{tmp_path}/p")
    for i in range(300):
        os.remove(f"{tmp_path}/p/f{i % 3}/deep{i % 2}/m{i}.yaml")
    assert {r.name for r in profiles.collect()} == {"top", *(f"n{i}" for i in range(300))}
    assert prices.count() == 302 and schemas.count() == 906


def test_a_folder_without_profiles_is_empty(spark, tmp_path):
    put(f"{tmp_path}/p/readme.md", "x")
    assert dimensions.read_profiles(spark, f"{tmp_path}/p").collect() == []
    assert dimensions.read_profiles(spark, f"{tmp_path}/none").collect() == []


def test_a_failed_run_leaves_the_former_version(spark, tmp_path):
    rows = spark.range(5).select(
        F.to_date(F.lit("2026-01-01")).alias("ledger_day"), F.col("id").alias("row"), F.lit("2026-01-01").alias("ts"), F.lit("s").alias("session"))
    manifest = spark.range(1).select(F.lit("hash-only").alias("tier"))
    path = str(tmp_path / "out")
    privacy.write_submission(privacy.Submission(rows, rows.drop("ledger_day"), rows, manifest), path)
    bad = rows.withColumn("row", F.when(F.col("row") == 3, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("row")))
    with pytest.raises(Exception, match="stop"):
        privacy.write_submission(privacy.Submission(rows, bad.drop("ledger_day"), rows, manifest), path)
    ledger, traces, found = privacy.read_submission(spark, path)
    assert ledger.count() == traces.count() == 5 and found.columns == ["tier"]
    assert privacy.sample_row(privacy.Submission(ledger, traces, ledger, found)).first().row == 0


def test_small_files_hold_their_lines_in_order_in_few_folders(spark, tmp_path):
    from tallyspark.checks.queries import _write_small_files

    rows = spark.range(600).select(
        F.col("id").alias("at"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"),
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("a/"), (F.col("id") % 50).cast("string"))).alias("name"))
    _write_small_files(rows.repartition(7), "at", f"{tmp_path}/out", 3)
    found = [os.path.join(at, f) for at, _, files in os.walk(tmp_path / "out") for f in files]
    assert len(found) == 50 and len(os.listdir(tmp_path / "out")) <= 3
    got = {os.path.basename(f)[:-4]: open(f, encoding="utf-8").read().split() for f in found}
    assert got["a%2F7"] == [f"v{i}" for i in range(7, 600, 50)]
    assert got["__HIVE_DEFAULT_PARTITION__"] == [f"v{i}" for i in range(0, 600, 50)]


def test_files_and_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from tallyspark.checks import queries
    from tallyspark.sources import derived

    spark.range(40).selectExpr(
        "id l_orderkey", "cast(id % 7 as int) l_linenumber", "'N' l_returnflag", "timestamp'2024-01-01' l_shipdate",
        "cast(id as double) l_extendedprice", "1.0D l_quantity").write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    monkeypatch.setattr(queries, "OUTCOMES_PER_FILE", 4)
    monkeypatch.setattr(queries, "staging_root", lambda _: str(tmp_path / "root"))
    assert queries.outcome_scan(spark, f"{tmp_path}/sf").count() == 40
    files = [f for at, _, names in os.walk(tmp_path / "root") for f in names if f.endswith(".txt")]
    assert len(files) == 13
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 4)
    assert derived.spread(spark.range(200)).rdd.getNumPartitions() == 51


def test_a_staged_submission_is_projected_once(spark):
    from tallyspark.schemas import LEDGER, TRACE

    found = {}
    for staged in (False, True):
        s = privacy.anonymize(spark.createDataFrame([], LEDGER), spark.createDataFrame([], TRACE), "2024-01-01", "2024-12-31", salt=b"x" * 32, staged=staged)
        found[staged] = s.ledger.inputFiles(), s.ledger.schema, s.traces.schema, s.manifest.drop("submission_id").first()
        assert ("Window" in s.ledger._jdf.queryExecution().optimizedPlan().toString()) is False or not staged
    assert found[True][3] == found[False][3] and found[True][1].names == found[False][1].names
