from collections import Counter

from tallyspark.llm import sharding

DDL = "doc_id bigint, text string"


def test_a_new_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(3000).withColumnRenamed("id", "doc_id")
    got = sharding.assign_shards(rows, "doc_id", [1.0] * 7, [1.0] * 8).collect()
    assert all(r.grown_shard in (r.shard, 7) for r in got)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 7 and max(counts.values()) < 1.3 * min(counts.values())
    moved = sum(r.grown_shard == 7 for r in got)
    assert 0.08 < moved / 3000 < 0.18


def test_weights_set_the_shares_and_zero_gets_nothing(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    counts = Counter(r.shard for r in sharding.assign_shards(rows, "doc_id", [3.0, 0.0, 1.0]).collect())
    assert 1 not in counts
    assert 2.5 < counts[0] / counts[2] < 3.6


def test_nulls_repeats_and_slots(spark):
    data = [(None, "a"), (None, None), (5, ""), (5, "x"), *[(7, "same")] * 40, (8, "é" * 3)]
    got = sharding.shard_documents(spark.createDataFrame(data, DDL), 4).collect()
    assert len(got) == len(data)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert {r.size for r in got if r.doc_id == 8} == {14}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 5 and r.size == 8} == {(8, 0)}


def test_empty_table_and_clashing_names(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DDL), 4).collect() == []
    rows = spark.createDataFrame([(1, 9, 9)], "doc_id bigint, shard int, slot int")
    (row,) = sharding.number_slots(sharding.assign_shards(rows, "doc_id", [1.0])).collect()
    assert (row.shard, row.slot) == (0, 0)
