import random

import numpy as np
import pytest

from conftest import SF_DIR
from tallyspark.llm import dart_minhash as dm
from tallyspark.llm.queries import QUERIES
from tallyspark.llm.words import WordHashes, words_of

DDL = "doc_id bigint, text string"
RND = random.Random(4)


def text(n, vocabulary=3000):
    return " ".join(f"w{RND.randrange(vocabulary)}" for _ in range(n))


def changed(t, n):
    words = t.split()
    for _ in range(n):
        words[RND.randrange(len(words))] = f"x{RND.randrange(10**6)}"
    return " ".join(words)


def brute(rows, threshold=dm.THRESHOLD):
    """Component of each row, by all pairs of different ids and word sequences."""
    memo = WordHashes()
    sets = [dm.weighted_shingles(memo.of(words_of(t))) for _, t in rows]
    use = [k for k, (i, t) in enumerate(rows) if i is not None and words_of(t)]
    label = {k: rows[k][0] for k in use}
    changing = True
    while changing:
        changing = False
        for a in use:
            for b in use:
                if label[a] < label[b] and (rows[a][0] == rows[b][0] or dm.jaccard(sets[a], sets[b]) >= threshold - 1e-12):
                    label[b] = label[a]
                    changing = True
                elif rows[a][0] == rows[b][0] and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changing = True
    return sorted(str((r[0], label.get(k, r[0]))) for k, r in enumerate(rows))


def test_agreement_of_signatures_is_the_weighted_similarity():
    rng = np.random.default_rng(2)
    z = []
    for _ in range(60):
        ids = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 600))).astype(np.uint64))
        weight = rng.integers(1, 7, len(ids))
        cut = int(rng.integers(0, len(ids) // 2 + 1))
        a = (ids[cut:], weight[cut:])
        b = (ids, np.maximum(1, weight + rng.integers(-1, 2, len(ids))))
        one, two = dm.signatures([a, b])
        j = dm.jaccard(a, b)
        z.append(((one == two).mean() - j) / np.sqrt(max(j * (1 - j), 0.01) / dm.COORDINATES))
    assert abs(np.mean(z)) < 0.5 and np.std(z) < 1.4


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    sets = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), None) for n in (1, 2, 40, 3000)]
    sets = [(h, np.arange(1, len(h) + 1) % 9 + 1) for h, _ in sets]
    whole = dm.signatures([*sets, (np.zeros(0, np.uint64), np.zeros(0, int))])
    assert all((dm.signatures([s])[0] == whole[i]).all() for i, s in enumerate(sets))
    assert (whole[-1] == dm._EMPTY).all() and not (whole[:-1] == dm._EMPTY).any()


def test_groups_against_all_pairs(spark):
    rows = []
    for g in range(12):
        base = text(RND.randrange(30, 200))
        rows += [(len(rows) + k, changed(base, k % 4)) for k in range(8)]
    rows += [(500 + k, text(60)) for k in range(30)]
    RND.shuffle(rows)
    got = dm.near_duplicates(spark.createDataFrame(rows, DDL).repartition(5)).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == brute(rows)


def test_chains_that_the_smallest_id_does_not_reach(spark):
    """b and c are linked, neither is linked with a, and all share buckets."""
    base = text(100).split()
    rows = []
    for k in range(30):
        words = list(base)
        for i in range(k):
            words[(i * 3) % 100] = f"y{i}"
        rows.append((k, " ".join(words)))
    got = dm.near_duplicates(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == brute(rows)


def test_small_tiles_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(dm, "TILE", 3)
    base = text(80)
    rows = [(k, changed(base, RND.randrange(0, 8))) for k in range(40)]
    got = dm.near_duplicates(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == brute(rows)


def test_test_tables_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_dart_minhash"](spark, SF_DIR).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == brute(rows)


def test_odd_rows_and_the_filter(spark):
    base = text(50)
    rows = [(None, base), (5, base), (3, base.upper()), (8, base), (8, base), (8, base), (9, None), (10, ""), (11, "!!"), (12, "!!"),
            (13, "one two"), (14, "One, two"), (15, "word " * 30_000), (16, "word " * 29_000), (3, base.upper())]
    docs = spark.createDataFrame(rows, DDL).selectExpr("doc_id", "text", "'x' AS component_id", "1 AS kept", "2 AS _gone")
    got = dm.near_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == brute(rows)
    left = dm.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [None, 3, 9, 10, 11, 12, 13, 15]))
    empty = spark.createDataFrame([], DDL)
    assert dm.near_duplicates(empty).collect() == [] and dm.drop_near_duplicates(empty).collect() == []


def test_ids_that_repeat_with_different_texts_lose_no_text(spark):
    """Each group of equal or near texts keeps exactly one row, whatever ids its rows share."""
    a, b, c = text(60), text(70), text(80)
    near = changed(c, 1)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, a), (5, near), (2, c.upper() + "!"), (2, None), (2, ""), (7, "!?"), (7, "!?")]
    docs = spark.createDataFrame(rows, DDL).selectExpr("doc_id", "text", "1 AS id", "2 AS hash", "3 AS row", "4 AS node").repartition(4)
    left = sorted(str((r.doc_id, r.text)) for r in dm.drop_near_duplicates(docs).collect())
    assert left == sorted(map(str, [(1, a), (2, b), (2, c.upper() + "!"), (2, None), (2, ""), (7, "!?")]))
    found = {(r.doc_id, r.component_id, r.kept) for r in dm.near_duplicates(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 2, False), (4, 1, False), (5, 2, False)} <= found


def test_rows_of_one_id_and_the_same_words_are_one(spark):
    t = text(40)
    rows = [(8, t), (8, t.upper()), (8, t + " !"), (9, t)]
    left = dm.drop_near_duplicates(spark.createDataFrame(rows, DDL)).collect()
    assert [r.doc_id for r in left] == [8]


@pytest.mark.parametrize("s, least", [(0.8, 0.995), (0.85, 0.9995)])
def test_band_recall(s, least):
    assert 1 - (1 - s**dm.ROWS) ** dm.BANDS >= least
