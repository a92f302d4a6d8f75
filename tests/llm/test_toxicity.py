import numpy as np
import pytest

from conftest import SF_DIR
from tallyspark.llm import toxicity
from tallyspark.llm.queries import CATEGORIES, QUERIES, toxic_labels

DDL = "doc_id bigint, text string"


def make(n=400, seed=5):
    """Documents of invented words; marked words decide two categories, the second in part by the first."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        rude, threat = rng.random() < 0.3, False
        if rude:
            words[3] = f"rude{rng.integers(4)}"
            threat = rng.random() < 0.5
            if threat:
                words[9] = f"threat{rng.integers(4)}"
        docs.append((i, " ".join(words)))
        labels.append((i, int(rude), int(threat)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make()
    held = spark.createDataFrame(docs, DDL)
    known = spark.createDataFrame(labels[:250], "doc_id bigint, rude int, threat int")
    got = {r.doc_id: r for r in toxicity.toxic_scores(held, known, ("rude", "threat")).collect()}
    rest = labels[250:]
    assert np.mean([(got[i].p_rude > 0.5) == bool(r) for i, r, _ in rest]) > 0.97
    assert np.mean([got[i].rejected == bool(t) for i, _, t in rest]) > 0.95


def test_later_models_see_out_of_fold_predictions_of_earlier_ones():
    docs, labels = make()
    memo = toxicity.WordHashes()
    found = [toxicity.document_features(t, memo) for _, t in docs]
    dense = np.array([s for _, s in found])
    y = np.array([[r, t] for _, r, t in labels])
    chain = toxicity.Chain([f for f, _ in found], dense, y, np.arange(len(docs)) % toxicity.FOLDS)
    assert len(chain.models[1].mean) == dense.shape[1] + 1
    # The column of the earlier category counts: threats come only with rude words.
    words = len(chain.models[1].words)
    assert chain.models[1].weights[words + dense.shape[1]] > 0.3


def test_given_labels_of_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = {r.doc_id: r.toxic for r in QUERIES["op2_toxicity_chain"](spark, SF_DIR).collect()}
    assert len(got) == docs.count()
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([got[i] == bool(t) for i, t in marked.items()]) > 0.95


def test_the_sample_is_bounded(spark):
    docs, labels = make()
    known = spark.createDataFrame(labels, "doc_id bigint, rude int, threat int")
    chain = toxicity.fit_chain(spark.createDataFrame(docs, DDL), known, ("rude",), sample=80)
    assert 0 < chain.models[0].rate < 1
    assert len(chain.models[0].words) < 40


def test_nulls_empties_repeats_and_long_texts(spark):
    docs, labels = make(200)
    odd = [(None, None), (1000, ""), (1001, None), (1002, "!!! ???"), (1003, "w1 " * 50_000 + "rude1"), docs[0], docs[0]]
    frame = spark.createDataFrame(docs + odd, DDL).selectExpr("doc_id", "text", "'x' AS p_rude", "1 AS rejected")
    known = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (3, None, 1), (55_555, 1, 1)], "doc_id bigint, rude int, threat int")
    got = toxicity.toxic_scores(frame, known, ("rude",))
    assert sorted(got.columns) == ["doc_id", "p_rude", "rejected", "text"]
    rows = got.collect()
    assert len(rows) == len(docs) + len(odd)
    by = {r.doc_id: r for r in rows}
    assert not by[1000].rejected and not by[1001].rejected and by[1003].rejected


@pytest.mark.parametrize("values", [[], [0, 0, 0], [1, 1]])
def test_without_labels_of_both_kinds_nothing_is_rejected(spark, values):
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(5)], DDL)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, toxic int")
    rows = toxicity.toxic_scores(docs, labels, ("toxic",)).collect()
    assert len(rows) == 5 and {r.p_toxic for r in rows} == {float(values[0]) if values else 0.0}
    assert not any(r.rejected for r in rows)
    assert toxicity.toxic_scores(docs.limit(0), labels, ("toxic",)).collect() == []


def test_registered_categories(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert [(r.low_quality, r.toxic) for r in toxic_labels(labels).orderBy("doc_id").collect()] == [(0, 0), (1, 1)]
    assert CATEGORIES == ("low_quality", "toxic")
