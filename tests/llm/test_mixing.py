import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyspark.llm import mixing

DDL = "doc_id bigint, text string, lang string, source string"


def levels(docs):
    return {"lang": docs["lang"], "source": docs["source"]}


def corpus(spark, sizes, words=4):
    rows, i = [], 0
    for (lang, source), n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * words), lang, source))
            i += 1
    return spark.createDataFrame(rows, DDL)


def spent(df):
    out = defaultdict(int)
    for r in df.collect():
        out[r.lang, r.source] += r.n_tokens
    return dict(out)


def test_shortage_goes_to_siblings_before_the_parents_siblings(spark):
    docs = corpus(spark, {("en", "a"): 10, ("en", "b"): 300, ("de", "c"): 300})
    got = spent(mixing.mix(docs, levels(docs), {}, 800, max_epochs=1))
    # 400 tokens for each language; source a has only 40 of its 200, b takes the rest.
    assert got == {("en", "a"): 40, ("en", "b"): 360, ("de", "c"): 400}


def test_a_whole_language_that_falls_short_is_made_up_by_the_other(spark):
    docs = corpus(spark, {("en", "a"): 10, ("de", "c"): 300, ("de", "d"): 300})
    got = spent(mixing.mix(docs, levels(docs), {("de", "c"): 3}, 840, max_epochs=2))
    assert got[("en", "a")] == 80  # two epochs
    assert got[("de", "c")] == 572 and got[("de", "d")] == 192  # 570 and 190 end inside a document


def test_water_filling_against_a_literal_rule(spark):
    rnd = random.Random(3)
    for _ in range(3):
        sizes = {(f"l{a}", f"s{a}{b}"): rnd.randrange(1, 60) for a in range(3) for b in range(3)}
        weights = {("l1",): 3, ("l0", "s00"): 5, ("l2", "s21"): 0}
        docs = corpus(spark, sizes, words=1)
        budget = rnd.randrange(50, sum(sizes.values()))

        def fill(children, total):
            left, got, todo = total, {}, dict(children)
            while todo:
                w = sum(x[1] for x in todo.values())
                full = {k: c for k, (c, v) in todo.items() if v and c * w <= left * v}
                if not full:
                    return got | {k: (left * v / w if w else 0) for k, (c, v) in todo.items()}
                got |= full
                left -= sum(full.values())
                todo = {k: x for k, x in todo.items() if k not in full}
            return got

        top = fill({f"l{a}": (sum(n for (x, _), n in sizes.items() if x == f"l{a}"), weights.get((f"l{a}",), 1)) for a in range(3)}, budget)
        got = spent(mixing.mix(docs, levels(docs), weights, budget, max_epochs=1))
        for a in range(3):
            want = fill({s: (n, weights.get((x, s), 1)) for (x, s), n in sizes.items() if x == f"l{a}"}, top[f"l{a}"])
            for s, n in want.items():
                assert abs(got.get((f"l{a}", s), 0) - n) <= 2


def test_epochs_are_whole_and_the_prefix_depends_on_the_seed_only(spark):
    docs = corpus(spark, {("en", "a"): 50})
    first = mixing.mix(docs, levels(docs), {}, 500, max_epochs=4, seed=1)
    again = mixing.mix(docs.repartition(7), levels(docs), {}, 500, max_epochs=4, seed=1)
    other = mixing.mix(docs, levels(docs), {}, 500, max_epochs=4, seed=2)
    key = lambda df: sorted((r.doc_id, r.epoch) for r in df.collect())
    assert key(first) == key(again) != key(other)
    counts = first.groupBy("epoch").agg(F.count("*").alias("n")).collect()
    assert {r.epoch: r.n for r in counts} == {0: 50, 1: 50, 2: 25}


def test_nulls_repeats_empty_and_clashing_names(spark):
    own = ["_whole", "_cut", "_uses", "_key", "_level0", "_order", "_row", "cut", "tokens", "granted"]
    ddl = DDL + ", epoch string, n_tokens string, " + ", ".join(f"{c} int" for c in own)
    rest = ["x", "y", *range(len(own))]
    rows = [(1, None, None, None, *rest), (None, "a b", "en", None, *rest), *[(3, "a b c", "en", "s", *rest)] * 5]
    docs = spark.createDataFrame(rows, ddl)
    got = mixing.mix(docs, levels(docs), {}, 1.0, max_epochs=1)
    assert got.columns == [*DDL.replace(" bigint", "").replace(" string", "").split(", "), *own, "n_tokens", "epoch"]
    got = got.collect()
    assert sorted(str(r.doc_id) for r in got) == ["3"] * 5 + ["None"]
    assert {r.epoch for r in got} == {0} and {tuple(r[c] for c in own) for r in got} == {tuple(range(len(own)))}
    empty = docs.limit(0)
    assert mixing.mix(empty, levels(empty), {}, 1.0).collect() == []
