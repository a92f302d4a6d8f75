"""Ranked lexical search by NRA: impact-sorted lists, read in order, with score intervals.

Terms, document frequencies and lengths come from all documents.  A term's contribution to a
document is its weight times an impact that depends on the term's count and the document's
length only, so the impacts of all lists are on one scale.

``search`` stages one narrow row per document (its length, and the items' terms it holds with
their counts): texts are read once, and nothing is shuffled.  A task then takes the documents of
its part in blocks, sorts each term's list of the block by falling impact, and per item reads its
lists from the front, a level of impact after another.  Of every document seen it keeps the
contributions read so far (the lower end of its score) and the weight of the terms read; what the
other terms can still add is at most their weight times the level, which gives the upper end.
Once an unseen document cannot reach the item's k-th lower end, only documents whose upper end
does are kept, until the lists have ended or every kept document's interval is a point: membership, ties and
scores are then exact.  The k-th score of the task's earlier blocks is a lower bound for the next.

Each task sends k rows per item; they are merged in two steps, first within groups of tasks.

Items are taken in groups of about ``GROUP_BYTES`` of text, by a hash of item_id, one group
after another: a group's terms and weights are what the driver and the tasks hold.

Nulls and empty texts hold no terms: such documents are not counted and never found, such items
find nothing.  Rows of one item_id (a null is an id too) are one item with the terms of all.
Rows of one doc_id are documents of their own; equal scores go by ascending doc_id, nulls first.
Empty tables give an empty result.  Further columns are left out.

Memory: one block of ``BLOCK_DOCS`` documents' lists, k rows per item, one block of a text.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .words import plain_words

RANKS = 50
GROUP_BYTES = 8_000_000
BLOCK_DOCS = 16_384
#: Shares of a block's impacts that are read after each level but the last, which is the rest.
LEVELS = (1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
#: Tasks are merged in so many groups first.
MERGES = 64
_INDEX = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
_FOUND = "item bigint, doc_id bigint, score bigint, part int"


def terms_of(text: bytes | None) -> set[bytes]:
    return set().union(*plain_words(text))


def term_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its length and the counts of the terms in ``vocabulary``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text"):
                n, found = 0, Counter()
                for words in plain_words(text.as_py()):
                    n += len(words)
                    found.update(map(number, words))
                found.pop(None, None)
                lengths.append(n)
                terms.append(list(found))
                counts.append(list(found.values()))
            out = pa.record_batch([
                batch.column("doc_id"), pa.array(lengths, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
            ], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    return stage(rows.mapInArrow(index, _INDEX), "term-index")


def term_weights(index: DataFrame, n_terms: int, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of the vocabulary's terms."""
    weights = np.full(n_terms, math.floor(1000 * math.log(2 * n_docs + 2)), np.int64)
    frequencies = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for row in frequencies.collect():  # at most a row per term of the group's items
        weights[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
    return weights


class Lists:
    """A block's lists: per term, its documents by falling impact, and where each level ends."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((-impacts, terms))
        self.n_docs, self.docs, self.impacts = n_docs, docs[order], impacts[order]
        terms = terms[order]
        falling = np.sort(impacts)[::-1]
        #: Nothing unread after a level has a larger impact than the level's bound; the last is 0.
        self.bounds = sorted({int(falling[int(len(falling) * s)]) for s in LEVELS if len(falling)}, reverse=True) + [0]
        starts = np.searchsorted(terms, np.arange(n_terms))
        self.ends = [starts] + [starts + np.bincount(terms[self.impacts >= b], minlength=n_terms) for b in self.bounds]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the block) of score ``floor`` or more, at least 1, that can be among
        the first k, and their exact scores."""
        some = self.ends[-1][terms] > self.ends[0][terms]
        terms, weights = terms[some].tolist(), weights[some].tolist()
        whole = sum(weights)
        lower, read = np.zeros(self.n_docs, np.int64), np.zeros(self.n_docs, np.int64)
        kept = slot = None  # all documents, until unseen ones cannot get in
        for level, bound in enumerate(self.bounds):
            begins, ends = self.ends[level], self.ends[level + 1]
            for term, weight in zip(terms, weights, strict=True):
                span = slice(begins[term], ends[term])
                docs, impacts = self.docs[span], self.impacts[span]
                if slot is not None:
                    docs = slot[docs]
                    impacts, docs = impacts[docs >= 0], docs[docs >= 0]
                lower[docs] += weight * impacts
                read[docs] += weight
            least = max(floor, 1)
            if len(lower) >= k:
                least = max(least, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            if bound and bound * whole >= least:
                continue
            open_ = bound * (whole - read)
            live = np.flatnonzero(lower + open_ >= least)
            kept = live if kept is None else kept[live]
            lower, read = lower[live], read[live]
            if not open_[live].any():
                break
            slot = np.full(self.n_docs, -1, np.int64)
            slot[kept] = np.arange(len(kept))
        return kept, lower


class Best:
    """The first k documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores = self.ids = self.known = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search_group(docs: DataFrame, items: list[tuple[int | None, set[bytes]]], k: int, block_docs: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in items))))}
    index = term_index(docs, vocabulary)
    total = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words")).first()
    n_docs, words = total.n, total.words
    if not n_docs:
        return None
    weights = term_weights(index, len(vocabulary), n_docs)
    lists = [np.array(sorted(vocabulary[t] for t in terms), np.int64) for _, terms in items]
    # A weight of zero adds nothing to any score.
    held = spark.sparkContext.broadcast([(t[weights[t] > 0], weights[t[weights[t] > 0]]) for t in lists])
    n_terms = len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = [Best(k) for _ in held.value]
        for block in _blocks(batches, block_docs):
            ids = block.column("doc_id").combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            terms, counts = block.column("terms").combine_chunks(), block.column("counts").combine_chunks()
            places = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            tf = counts.flatten().to_numpy().astype(np.int64)
            lengths = block.column("n").to_numpy()
            m = 100 - 50 + (50 * lengths * n_docs) // words
            impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[places])
            block_lists = Lists(places, terms.flatten().to_numpy().astype(np.int64), impacts, len(ids), n_terms)
            for item, (item_terms, item_weights) in zip(best, held.value, strict=True):
                found, scores = block_lists.best(item_terms, item_weights, k, item.floor)
                item.add(scores, ids[found], known[found])
        part = TaskContext.get().partitionId()
        for number, item in enumerate(best):
            if len(item.scores):
                yield pa.record_batch([
                    pa.array(np.full(len(item.scores), number, np.int64)),
                    pa.array(item.ids, pa.int64(), mask=item.known == 0),
                    pa.array(item.scores), pa.array(np.full(len(item.scores), part, np.int32)),
                ], names=["item", "doc_id", "score", "part"])

    found = index.mapInArrow(search, _FOUND)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    for keys in (["item", F.col("part") % MERGES], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = pa.table({"item": pa.array(range(len(items)), pa.int64()), "item_id": pa.array([i for i, _ in items], pa.int64())})
    return found.join(F.broadcast(spark.createDataFrame(names)), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = RANKS, group_bytes: int = GROUP_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of highest score above 0."""
    texts = stage(items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].cast("string").cast("binary").alias("text")), "items")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // group_bytes) or 1
    results = []
    for group in range(groups):
        terms: dict[int | None, set[bytes]] = {}
        for row in texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect():
            terms.setdefault(row.item_id, set()).update(terms_of(row.text))
        listed = sorted(((i, t) for i, t in terms.items() if t), key=lambda x: (x[0] is not None, x[0] or 0))
        found = _search_group(docs, listed, k, block_docs) if listed else None
        if found is not None:
            results.append(stage(found, "ranked") if groups > 1 else found)
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return functools.reduce(DataFrame.union, results)


__all__ = ["Best", "Lists", "search", "term_index", "term_weights", "terms_of"]
