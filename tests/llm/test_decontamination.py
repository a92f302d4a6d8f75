import random

import numpy as np
import pytest

from conftest import SF_DIR
from tallyspark.llm import decontamination as dc
from tallyspark.llm.queries import QUERIES
from tallyspark.llm.words import words_of

RND = random.Random(11)
VOCABULARY = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]


def say(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        kind, at = RND.randrange(3), RND.randrange(len(words))
        if kind == 0:
            words[at] = RND.choice(VOCABULARY)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, RND.choice(VOCABULARY))
    return words


def best_prefix(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return min(row), row.index(min(row))


def test_bit_parallel_distance_against_the_matrix():
    for _ in range(500):
        a = [RND.randrange(4) for _ in range(RND.randrange(1, 80))]
        b = [RND.randrange(4) for _ in range(RND.randrange(0, 90))]
        assert dc.best_end(a, b) == best_prefix(a, b)


@pytest.mark.parametrize("share, least", [(0.2, 0.95), (0.1, 0.99), (0.0, 1.0)])
def test_recall_at_and_below_the_limit(share, least):
    items = [(i, " ".join(say(RND.randrange(10, 90)))) for i in range(120)]
    matcher = dc.Matcher(items)
    found = total = 0
    for i, text in items:
        words = words_of(text)
        planted = edited(words, int(share * len(words)))
        hits = matcher.search([" ".join(say(30) + planted + say(30))])[0]
        total += 1
        found += i in [h[0] for h in hits]
    assert found / total >= least


def test_every_leak_of_the_test_tables_against_brute_force(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_cgk_decontamination"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    worded = {r.item_id: words_of(r.text) for r in items}
    want = set()
    for r in docs:
        words = words_of(r.text)
        for i, item in worded.items():
            most, known = dc.edits(len(item)), set(item)
            inside = [0]
            for w in words:
                inside.append(inside[-1] + (w in known))
            for s in range(len(words)):
                end = min(len(words), s + len(item) + most)
                # A run within reach has at least so many of the item's words.
                if inside[end] - inside[s] >= len(item) - most and words[s] in known:
                    if best_prefix(item, words[s:end])[0] <= most:
                        want.add((r.doc_id, i))
                        break
    assert want and want == got


def test_nulls_short_items_repeats_and_long_texts(spark):
    item = " ".join(say(20))
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "one two"), (None, item), (6, " ".join(say(12)))], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (3, item.upper().replace(" ", ", ")), (3, item), (None, "x " + item), (5, " ".join(say(40_000)) + " " + item), (6, "one two"), (7, " ".join(say(50)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS leaks", "1 AS _leak")
    got = dc.find_leaks(docs, items)
    assert got.columns == ["doc_id", "text", "_leak", "leaks"]
    found = [(r.doc_id, [x.item_id for x in r.leaks]) for r in got.collect()]
    assert sorted(f for f in found if f[1] and f[0]) == [(3, [1, 2]), (3, [1, 2]), (5, [1, 2]), (6, [5])]
    assert [f for f in found if f[0] is None] == [(None, [1, 2])]
    kept = dc.decontaminate(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7]
    assert dc.find_leaks(docs, items.limit(0)).filter("size(leaks) > 0").count() == 0
    assert dc.find_leaks(docs.limit(0), items).count() == 0


def test_a_benchmark_in_groups_gives_the_same(spark):
    items = [(i, " ".join(say(15))) for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(say(10)) + " " + items[i % 30][1]) for i in range(60)], "doc_id bigint, text string")
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, tuple(r.leaks)) for r in dc.find_leaks(docs, frame).collect()}
    parts = {(r.doc_id, tuple(r.leaks)) for r in dc.find_leaks(docs, frame, group_words=100).collect()}
    assert whole == parts


def test_short_items_are_found_as_whole_lines(spark):
    items = spark.createDataFrame([(1, "Name the capital."), (2, "yes"), (3, "yes"), (4, "!?")], "item_id bigint, text string")
    rows = [(1, "x y\nname, the CAPITAL\nyes\nyes"), (2, "name the capital of it"), (3, "they said yes"), (4, "\n\n!?")]
    got = {r.doc_id: [tuple(x) for x in r.leaks] for r in dc.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert got == {1: [(1, 0, 2, 3), (2, 0, 5, 1), (3, 0, 5, 1)], 2: [], 3: [], 4: []}


def test_items_in_scripts_without_blanks(spark):
    item = "東京の夏は暑くて湿度が高いので人々は山や海へ出かけます"
    edited = item.replace("湿度", "気温")
    items = spark.createDataFrame([(1, item), (2, "ประเทศไทยมีเมืองหลวงชื่อกรุงเทพมหานคร")], "item_id bigint, text string")
    rows = [(1, "前置き。" + item + "。終わり"), (2, "前置き" + edited + "終わり"), (3, "東京は大きい。山や海は遠い。"), (4, "ก ประเทศไทยมีเมืองหลวงชื่อกรุงเทพมหานคร ข")]
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in dc.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [2]}


def test_the_buckets_find_the_items_of_windows():
    """Recall of the look-up by sampled keys alone, at the limit of edits."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(10, 60)))) for i in range(120)]
    matcher = dc.Matcher(items)
    found = 0
    for k, (_, text) in enumerate(items):
        item = text.split()
        for at in rnd.sample(range(len(item)), dc.edits(len(item))):
            item[at] = "other"
        encoded = np.array([matcher.vocabulary.get(w, 0) for w in item], np.int64)
        start, which = matcher.candidates(np.append(encoded, 0))
        found += any(w == k and s <= dc.edits(len(item)) for s, w in zip(start.tolist(), which.tolist(), strict=True))
    assert found >= 0.95 * len(items)
