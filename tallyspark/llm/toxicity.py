"""Toxicity by classifier chains over word-presence and shape features.

Categories are predicted one after another.  Each has a linear (logistic) model; a later
model also gets the log-odds of the earlier categories.  In training those come from
out-of-fold predictions: for each of ``FOLDS`` parts, a model of the other parts predicts it, so
a later model sees earlier predictions of the quality it will see on new documents.  The
cut-off of the last category is the one with the best F1 on its own out-of-fold predictions.

Features: up to ``WORDS`` words per model, those with the largest chi-square between presence in
a document and the category among the training documents, and eight numbers on the shape of the
text.  Every word of the whole text is looked at.

The models are fitted on a bounded sample: labelled documents whose hashed id lies below a bound
that lets ``SAMPLE`` of all labels through (all, where there are fewer); one task fits them and
the driver holds only the fitted models, at most a few thousand numbers.  All documents are
scored in one pass without a shuffle.

Nulls: a null or empty text has no words and is scored by its shape; labels with a null id or
category are not trained on; a document with several labels has the largest of each category;
equal texts count once in training.  Without labels of both kinds in a category every document
gets the share of positive ones (0 without labels) and is not toxic.  Input columns named like
an added column are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from .ordering import HASH_BITS, hash60
from .words import WordHashes, words_of

SAMPLE = 20_000
WORDS = 256
FOLDS = 4
RIDGE = 0.1
SLACK = 0.005
_PUNCTUATION = re.compile(r"[^\w\s]+")


def shape(text: str, words: list[str], different: int) -> list[float]:
    """Eight numbers between about 0 and 1 that do not depend on the words themselves."""
    chars, count = max(len(text), 1), max(len(words), 1)
    runs = _PUNCTUATION.findall(text)
    marks = sum(map(len, runs))
    return [
        np.log1p(len(words)) / 10, marks / chars, len(runs) / count, max(map(len, runs), default=0) / (10 + len(runs)),
        sum(map(str.isupper, text.split())) / count, different / count, sum(map(len, words)) / count / 10,
        text.count("\n") / count,
    ]


def document_features(text: str | None, memo: WordHashes) -> tuple[set[int], list[float]]:
    text = text or ""
    words = words_of(text)
    different = set(words)
    return set(map(memo.__getitem__, different)), shape(text, words, len(different))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Linear:
    """A logistic model with ridge penalty, fitted by Newton steps."""

    def __init__(self, rows, ids, dense, labels):
        """rows, ids: the words of each document; dense: further columns; labels: 0 or 1."""
        kinds, at = np.unique(ids, return_inverse=True)
        n, positive = len(labels), labels.sum()
        seen = np.bincount(at, minlength=len(kinds)).astype(float)
        hit = np.bincount(at, weights=labels[rows], minlength=len(kinds))
        expected = seen * positive / max(n, 1)
        spread = expected * (1 - seen / max(n, 1)) * (1 - positive / max(n, 1))
        chi = np.where((seen >= 2) & (spread > 0), (hit - expected) ** 2 / np.where(spread > 0, spread, 1), 0)
        best = np.argsort(-chi, kind="stable")[:WORDS]
        self.words = np.sort(kinds[best[chi[best] > 4]])
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-9
        self.rate = positive / n if n else 0.0
        self.weights = None
        if 0 < positive < n:
            self._fit(self._matrix(rows, ids, dense), labels)

    def _matrix(self, rows, ids, dense) -> np.ndarray:
        known = len(self.words)
        out = np.zeros((len(dense), known + dense.shape[1] + 1))
        if known and len(ids):
            at = np.minimum(np.searchsorted(self.words, ids), known - 1)
            found = self.words[at] == ids
            out[rows[found], at[found]] = 1
        out[:, known:-1] = np.clip((dense - self.mean) / self.scale, -5, 5)
        out[:, -1] = 1
        return out

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(15):
            p = _sigmoid(x @ w)
            slope = x.T @ (y - p) - penalty * w
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def predict(self, rows, ids, dense) -> np.ndarray:
        if self.weights is None:
            return np.full(len(dense), self.rate)
        return _sigmoid(self._matrix(rows, ids, dense) @ self.weights)


def _flat(features: Sequence[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    ids = np.fromiter((i for f in features for i in sorted(f)), np.int64, len(rows))
    return rows, ids


def _pick(rows, ids, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the documents in ``keep``, renumbered."""
    place = np.full(max(rows.max(initial=-1), keep.max(initial=-1)) + 1, -1)
    place[keep] = np.arange(len(keep))
    chosen = place[rows] >= 0
    return place[rows][chosen], ids[chosen]


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The highest cut-off whose F1 is within ``SLACK`` of the best, in the middle of the gap below it.

    Of cut-offs that are about equally good it takes the one that rejects the fewest documents.
    """
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    at = int(np.argmax(f1 >= f1.max() - SLACK))
    below = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[at] + below) / 2, 0.1, 0.9))


class Chain:
    """Models of all categories in order, and the last one's cut-off."""

    def __init__(self, features: Sequence[set[int]], dense: np.ndarray, labels: np.ndarray, part: np.ndarray):
        """labels: documents x categories; part: the fold of each document."""
        rows, ids = _flat(features)
        self.models, self.cut, self.fitted = [], 1.0, False
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            held = np.zeros(len(y))
            for k in range(FOLDS):
                out, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
                if len(out) and len(rest):
                    model = Linear(*_pick(rows, ids, rest), dense[rest], y[rest])
                    held[out] = model.predict(*_pick(rows, ids, out), dense[out])
            self.models.append(Linear(rows, ids, dense, y))
            if c == labels.shape[1] - 1 and 0 < y.sum() < len(y):
                self.cut, self.fitted = best_cut(held, y), True
            dense = np.column_stack([dense, _logit(held)])

    def predict(self, features: Sequence[set[int]], dense: np.ndarray) -> np.ndarray:
        """documents x categories"""
        rows, ids = _flat(features)
        out = []
        for model in self.models:
            out.append(model.predict(rows, ids, dense))
            dense = np.column_stack([dense, _logit(out[-1])])
        return np.column_stack(out)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """Fit on a bounded sample of labelled documents; ``categories`` are 0/1 columns, in order."""
    names = [f"_c{i}" for i in range(len(categories))]
    known = labels.select(labels["doc_id"].alias("_id"), *[labels[c].cast("int").alias(n) for c, n in zip(categories, names, strict=True)]).dropna()
    total = known.count()
    bound = min(1.0, sample / total) if total else 1.0
    below = lambda c: hash60(F.lit("toxicity"), c) < F.lit(int(bound * (1 << HASH_BITS)))
    marked = known.filter(below(F.col("_id"))).groupBy("_id").agg(*[F.max(n).alias(n) for n in names])
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].cast("string").alias("_text")).filter(below(F.col("_id")))
    rows = texts.join(marked.hint("merge"), "_id").select("_text", F.array(*names).alias("_labels"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [document_features(t, memo) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "words": pa.array([sorted(f) for f, _ in found], pa.list_(pa.int64())),
                    "shape": pa.array([s for _, s in found], pa.list_(pa.float64())), "labels": part.column(1),
                })

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            for words, numbers, marks in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = (np.asarray(words.values, np.int64).tobytes(), tuple(numbers.as_py()))
                old = seen.get(key)
                seen[key] = tuple(marks.as_py()) if old is None else tuple(map(max, old, marks.as_py()))
        order = sorted(seen)
        features = [set(np.frombuffer(k[0], np.int64).tolist()) for k in order]
        dense = np.array([k[1] for k in order], float).reshape(len(order), 8)
        marks = np.array([seen[k] for k in order], int).reshape(len(order), len(names))
        chain = Chain(features, dense, marks, np.arange(len(order)) % FOLDS)
        fitted = {"cut": chain.cut, "fitted": chain.fitted, "models": [vars(m) for m in chain.models]}
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fitted)]})

    featured = rows.mapInArrow(featurize, "words array<bigint>, shape array<double>, labels array<int>")
    fitted = pickle.loads(featured.repartition(1).mapInArrow(train, "model binary").first()[0])
    chain = Chain.__new__(Chain)
    chain.cut, chain.fitted, chain.models = fitted["cut"], fitted["fitted"], []
    for state in fitted["models"]:
        model = Linear.__new__(Linear)
        vars(model).update(state)
        chain.models.append(model)
    return chain


def score(docs: DataFrame, chain: Chain, categories: Sequence[str]) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``rejected``."""
    added = [f"p_{c}" for c in categories] + ["rejected"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]
    names, text = [f.name for f in kept], docs["text"].cast("string").alias("_text")
    schema = StructType(list(kept))
    for name in added[:-1]:
        schema = schema.add(name, DoubleType())
    schema = schema.add("rejected", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [document_features(t, memo) for t in part.column(part.num_columns - 1).to_pylist()]
                p = chain.predict([f for f, _ in found], np.array([s for _, s in found], float))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns += [pa.array(p[:, i]) for i in range(p.shape[1])] + [pa.array((p[:, -1] >= chain.cut) & chain.fitted)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.select(*names, text).mapInArrow(run, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit_chain(docs, labels, categories, sample), categories)
