"""Importance resampling: documents drawn towards the distribution of a target text collection.

Features are hashed runs of one to three words.  A bucket's gain is the logarithm of how much
more of the target's features than of the documents' fall into it, so all gains are one array of
``buckets`` integers, and a document's weight is the sum of the array over its features.  The
weight plus Gumbel noise of the id is the score; the highest scores are a draw without
replacement in proportion to the exponential of the weight.

The cutoff is found without sorting the documents (``cutoff``): one aggregation counts the
candidates and sketches the quantiles on both sides of the wanted rank, a second one counts exactly how
many scores lie above the bracket and in it.  If the wanted rank is not in the bracket, the
bracket is widened until it is; only the rows in the bracket are then sorted, by ranges.

Texts are read twice (counts, then weights) and never shuffled; each task sends ``buckets``
counts.  What reaches the driver and the tasks is the array of gains, ``8 * buckets`` bytes.

Nulls and empty texts have no words: 0 features, weight 0, never drawn, as with any document of
fewer than ``least_words`` words.  A null doc_id draws its noise from the text ``null`` and sorts
first.  Equal scores go to the smaller doc_id, then to the smaller hash of the text; equal rows
are documents of their own, and as many of them are drawn as fit.  Without documents the
result is empty, without targets the gains are those of an empty target.  Further columns stay in
``drawn_documents``, whatever their names, and are left out of ``resample``.

Memory: one Arrow batch of texts, and the hashes of ``BLOCK`` bytes of one text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..plans.staging import stage
from .words import plain_words

BUCKETS = 10_000
SEED = 42
#: The share that is drawn, as a fraction, and the words a document needs to be drawn.
SHARE = (5, 100)
LEAST_WORDS = 20
#: The quantile sketch's accuracy: its ranks are off by at most one part in so many.
ACCURACY = 2_000
SCORES = "doc_id bigint, text_hash bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
_FAR = 1 << 62


def feature_hashes(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """Per block of a text: its words, and the CRC-32 of each run of one to three words that ends in it."""
    last, last_pair = [], []
    for words in plain_words(text):
        spaced = [b" " + w for w in words]
        ones = list(map(crc32, words))
        pairs = list(map(crc32, spaced[1 - len(last) :], last + ones))
        threes = list(map(crc32, spaced[2 - len(last) - len(last_pair) :], last_pair + pairs))
        yield len(words), np.array(ones + pairs + threes, np.int64)
        last, last_pair = ones[-1:], pairs[-1:]


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in feature_hashes(text.as_py()):
                    total += np.bincount(hashes % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    parts = texts.select(texts["text"].cast("string").cast("binary").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def bucket_gains(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / document share)) per bucket, with one added to each count."""
    have, want = _counts(docs, buckets).tolist(), _counts(targets, buckets).tolist()
    s_all, t_all = float(sum(have) + buckets), float(sum(want) + buckets)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(have, want, strict=True)
    ], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    key = f"{seed}:{'null' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``SCORES`` of every document."""
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.xxhash64(docs["text"].cast("string")).alias("text_hash"),
        docs["text"].cast("string").cast("binary").alias("text"),
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, n_features, weights = batch.column("doc_id").to_pylist(), [], [], []
            for text in batch.column("text"):
                words = features = weight = 0
                for n, hashes in feature_hashes(text.as_py()):
                    words, features = words + n, features + len(hashes)
                    weight += int(gains[hashes % len(gains)].sum())
                n_words.append(words)
                n_features.append(features)
                weights.append(weight)
            scored = [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)]
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("text_hash"),
                *[pa.array(c, pa.int64()) for c in (n_words, n_features, weights, scored)],
            ], names=["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(weigh, SCORES)


class Cutoff(NamedTuple):
    """The last drawn row: how many are drawn, and its place in the order."""

    drawn: int
    score: int
    doc_id: int | None
    text_hash: int


def bracket(candidates: DataFrame, share: tuple[int, int], accuracy: int = ACCURACY) -> tuple[int, int, int, int] | None:
    """How many are drawn, the bracket's lowest and highest score, and how many lie above it."""
    wanted, half = share[0] / share[1], 2 / accuracy
    while True:
        low, high = 1 - wanted - half, 1 - wanted + half
        found = candidates.agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("score", [min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)], accuracy).alias("q"),
        ).first()
        drawn = found.n * share[0] // share[1]
        if not drawn:
            return None
        least = -_FAR if low <= 0 else found.q[0]
        most = _FAR if high >= 1 else found.q[1]
        exact = candidates.agg(F.count_if(F.col("score") > most).alias("above"), F.count_if(F.col("score") >= least).alias("upto")).first()
        if exact.above < drawn <= exact.upto:
            return drawn, least, most, exact.above
        half *= 4


_ORDER = ["score", "doc_id", "text_hash"]


def _sorting() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("text_hash")]


def cutoff(scored: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, accuracy: int = ACCURACY) -> Cutoff | None:
    """The last drawn row of a staged table of scores; None if none is drawn."""
    candidates = scored.filter(F.col("n_words") >= least_words)
    found = bracket(candidates, share, accuracy)
    if found is None:
        return None
    drawn, least, most, above = found
    inside = candidates.filter(F.col("score").between(least, most)).select(*_ORDER)
    last = global_rank(inside, _sorting(), "place").filter(F.col("place") == drawn - above).first()
    return Cutoff(drawn, last.score, last.doc_id, last.text_hash)


def _against(cut: Cutoff) -> tuple[Column, Column]:
    """Conditions on a row of scores: it comes before the cutoff's row; it equals that row."""
    same_score, same_id = F.col("score") == cut.score, F.col("doc_id").eqNullSafe(F.lit(cut.doc_id).cast("bigint"))
    smaller = F.lit(False) if cut.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") < cut.doc_id)
    before = (F.col("score") > cut.score) | (same_score & (smaller | (same_id & (F.col("text_hash") < cut.text_hash))))
    return before, same_score & same_id & (F.col("text_hash") == cut.text_hash)


def resample(
    docs: DataFrame, targets: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, seed: int = SEED, accuracy: int = ACCURACY,
) -> DataFrame:
    """``SCORES`` of every document and its ``rank`` in the draw, from 1; null if it is not drawn."""
    scored = stage(scores(docs, bucket_gains(docs, targets, buckets), seed), "scores")
    cut = cutoff(scored, share, least_words, accuracy)
    none = F.lit(None).cast("bigint")
    if cut is None:
        return scored.withColumn("rank", none)
    before, equal = _against(cut)
    reached = (F.col("n_words") >= least_words) & (before | equal)
    ranked = global_rank(scored.filter(reached), _sorting(), "place")
    drawn = ranked.select(*scored.columns, F.when(F.col("place") <= cut.drawn, F.col("place")).cast("bigint").alias("rank"))
    return drawn.union(scored.filter(~reached).withColumn("rank", none))


def drawn_documents(
    docs: DataFrame, targets: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, seed: int = SEED, accuracy: int = ACCURACY,
) -> DataFrame:
    """The drawn rows of ``docs``, whole and unordered: each text is weighed again where it lies."""
    gains = bucket_gains(docs, targets, buckets)
    cut = cutoff(stage(scores(docs, gains, seed), "scores"), share, least_words, accuracy)
    if cut is None:
        return docs.limit(0)

    @F.pandas_udf("struct<score bigint, n_words bigint>")
    def weigh(ids, texts):
        import pandas as pd

        out = []
        for i, text in zip(ids, texts, strict=True):
            found = [(n, int(gains[h % len(gains)].sum())) for n, h in feature_hashes(text)]
            out.append((sum(w for _, w in found) + noise(None if i is None or i == "" else int(i), seed), sum(n for n, _ in found)))
        return pd.DataFrame(out, columns=["score", "n_words"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    doc_id, text = F.col("row.doc_id").cast("bigint"), F.col("row.text").cast("string")
    # Ids go as texts, because pandas has no null among integers.
    weighed = rows.select("row", doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"), weigh(F.coalesce(doc_id.cast("string"), F.lit("")), text.cast("binary")).alias("s"))
    weighed = weighed.select("row", "doc_id", "text_hash", "s.*").filter(F.col("n_words") >= least_words)
    before, equal = _against(cut)
    first = weighed.filter(before)
    return first.union(weighed.filter(equal).limit(cut.drawn - first.count())).select("row.*")


__all__ = ["bracket", "bucket_gains", "cutoff", "drawn_documents", "feature_hashes", "noise", "resample", "scores"]
