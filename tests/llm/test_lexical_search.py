import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    """Every item against every document, by the formula."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in wanted.items():
        scored = []
        for i, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in query if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


WORDS = st.lists(st.sampled_from("a b c d e f g h Äß 日本 x9".split()), max_size=12).map(" ".join)


@given(st.lists(WORDS, min_size=1, max_size=40), st.lists(WORDS, min_size=1, max_size=3), st.integers(1, 6), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_intervals_find_what_a_full_reading_finds(texts, queries, k, size):
    """Blocks of any size, small lists and many ties, without Spark."""
    docs = [Counter(terms(t)) for t in texts]
    vocabulary = {t: n for n, t in enumerate(sorted({t for c in docs for t in c} | {t for q in queries for t in terms(q)}))}
    impact = lambda c, t: (10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 3 * sum(c.values())))
    for q in queries:
        wanted = np.array(sorted({vocabulary[t] for t in terms(q)}), np.int64)
        weights = wanted % 3 + 1
        best = ls.Best(k)
        for at in range(0, len(docs), size):
            block = docs[at : at + size]
            postings = [(d, vocabulary[t], impact(c, t)) for d, c in enumerate(block) for t in c]
            columns = [np.array(x, np.int64) for x in zip(*postings, strict=True)] if postings else [np.zeros(0, np.int64)] * 3
            found, scores = ls.Lists(*columns, len(block), len(vocabulary)).best(wanted, weights, k, best.floor)
            best.add(scores, found + at, np.ones(len(found), np.int64))
        names = {n: t for t, n in vocabulary.items()}
        want = [(sum(w * impact(c, names[t]) for t, w in zip(wanted.tolist(), weights.tolist(), strict=True) if names[t] in c), -i) for i, c in enumerate(docs)]
        want = sorted((x for x in want if x[0] > 0), reverse=True)[:k]
        assert list(zip(best.scores.tolist(), (-best.ids).tolist(), strict=True)) == want


def rows(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=repr)


def test_odd_rows_equal_brute_force(spark):
    docs = [(1, "The cat, the CAT"), (2, None), (3, ""), (None, "the cat"), (4, "the cat"), (4, "the cat"), (5, "dog " * 30_000 + "cat"),
            (6, "!?"), (7, "Ünïcode ÜNÏCODE 日本語 cat9"), (8, "the\x00cat"), (-3, "the cat")]
    items = [(1, "CAT the"), (2, None), (3, "日本語 Ünïcode"), (None, "dog"), (1, "dog"), (4, "nothing here"), (5, "the " * 5000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).withColumn("n", F.lit(1)).withColumn("terms", F.lit("x"))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1))
    assert rows(ls.search(d, b, k=4, block_docs=3)) == plain_search(docs, items, 4)
    # Items in several groups.
    assert rows(ls.search(d, b, k=4, group_bytes=9)) == plain_search(docs, items, 4)


def test_ties_beyond_the_last_rank(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    b = spark.createDataFrame([(1, "words")], "item_id bigint, text string")
    got = rows(ls.search(d.union(spark.createDataFrame([(0, "other")], d.schema)), b, k=50, block_docs=16))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 51))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ls.search(none, items).collect() == []
    assert ls.search(some, items.limit(0)).collect() == []
    assert ls.search(some, items).count() == 1
