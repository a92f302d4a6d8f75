"""Benchmark items in documents, up to a fifth of their words edited.

Texts are sequences of words (runs of word characters, lower case; letters of scripts that are written
without blanks are words of their own).  An item of n words leaks
into a document if some run of the document is at most ``edits(n) = floor(n / 5)`` word
insertions, deletions and replacements away from it.  An item of fewer than ``LEAST_WORDS`` words,
which stands by chance in many texts, leaks where a whole line has exactly its words.

Search by the CGK embedding.  A random walk reads a window from its first word: step j writes
the current word and moves on if a random bit of (walk, j, word) says so.  Edits shift two walks
against each other until they meet again, so a small edit distance becomes a small Hamming
distance of the written sequences.  Locality-sensitive hashing samples ``COORDINATES`` places of
a walk of ``WALKS``, ``SAMPLES`` times per walk; the sampled key of a window is looked up among those of
all items of its length class, and the items in its bucket are its candidates.  Tests measure the recall at the edit limit (aim: 0.95, and more for
fewer edits).  Candidates are verified by the exact edit distance with a free end.

Windows have the size of the items: places are sampled up to where a walk leaves the shortest
item of a length class.  Windows that cannot hold any item are skipped by an exact test first:
an item cut into ``edits(n) + 1`` pieces keeps one piece whole, so only starts within
``edits(n)`` words of such a place are walked.  Whole texts are searched.

The benchmark goes to every task in groups of about ``GROUP_WORDS`` words, one group after the other
with a staged pass over the documents each.  Documents are not shuffled.

Nulls: a null or empty text has no leaks, a null or wordless item matches nothing.  Equal items are all reported.  Repeated documents are
searched like any other.  An input column named ``leaks`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..plans.staging import stage
from .ordering import hash60
from .words import mix, words_of

WALKS, SAMPLES, COORDINATES = 12, 8, 2
LEAST_WORDS = 5
GROUP_WORDS = 2_000_000
LEAK = "array<struct<item_id:bigint,edits:int,start:int,n_words:int>>"
_TABLE_BITS = 20
#: Letters of scripts without blanks: Thai to Khmer, kana and Han.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_SPLIT = re.compile(f"[{_DENSE}]|[^\\W{_DENSE}]+")


def item_words(text: str | None) -> list[str]:
    """Words as this search sees them."""
    if text and _HAS_DENSE.search(text):
        return _SPLIT.findall(text.lower())
    return words_of(text)


def edits(n: int) -> int:
    return n // 5


def _class(n: int) -> int:
    """The shortest length of the class of ``n``: classes grow by a quarter."""
    low = LEAST_WORDS
    while (up := low + max(1, low // 4)) <= n:
        low = up
    return low


def best_end(item: Sequence[int], text: Sequence[int]) -> tuple[int, int]:
    """The least edit distance of ``item`` to a prefix of ``text``, and that prefix's length.

    Bit-parallel columns of the distance matrix; the first of equally good ends counts.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, distance = full, 0, n
    best = (n, 0)
    for j, w in enumerate(text, 1):
        match = masks.get(w, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if distance < best[0]:
            best = (distance, j)
    return best


class Matcher:
    """The items of one group, ready to be searched for."""

    def __init__(self, items: Sequence[tuple[int, str | None]]):
        worded = [(i, item_words(t)) for i, t in items]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, w in worded:
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(tuple(w), []).append(i)
        worded = [(i, w) for i, w in worded if len(w) >= LEAST_WORDS]
        self.vocabulary: dict[str, int] = {}
        for _, words in worded:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [i for i, _ in worded]
        self.items = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in worded]
        self.lists = [x.tolist() for x in self.items]
        self.keys = mix(np.arange(len(self.vocabulary) + 2, dtype=np.uint64), 7)
        self._pieces()
        self._buckets()

    def _pieces(self) -> None:
        """Hashes of the items' pieces, by piece length, with item and offset."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, item in enumerate(self.items):
            count = edits(len(item)) + 1
            size = len(item) // count
            for p in range(count):
                found.setdefault(size, []).append((self._run(item, size)[p * size], k, p * size))
        self.pieces = {}
        for size, rows in found.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[hashes >> np.uint64(64 - _TABLE_BITS)] = True
            self.pieces[size] = (table, hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def _run(self, words: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of ``size`` words."""
        keys = self.keys[words]
        with np.errstate(over="ignore"):
            out = keys[: len(words) - size + 1].copy()
            for i in range(1, size):
                out *= np.uint64(0x9E3779B97F4A7C15)
                out ^= keys[i : len(words) - size + 1 + i]
            return out * np.uint64(0xD6E8FEB86659FD93)

    def _samples(self, low: int, walk: int) -> np.ndarray:
        """The places sampled from a walk over windows of the class ``low``, sorted per sample."""
        draw = np.random.default_rng([low, walk, 11])
        return np.sort(np.array([draw.choice(int(1.8 * low), COORDINATES, replace=False) for _ in range(SAMPLES)]), axis=1)

    def _walk(self, words: np.ndarray, starts: np.ndarray, low: int, walk: int) -> np.ndarray:
        """starts x SAMPLES keys of the sampled places; ``words`` ends in a closing word."""
        places = self.places[low, walk]
        out = np.full((len(starts), SAMPLES), low, np.uint64)
        at, last = starts.copy(), len(words) - 1
        for step in range(places.max() + 1):
            here = words[at]
            for s in np.flatnonzero((places == step).any(axis=1)).tolist():
                out[:, s] = mix(out[:, s] ^ self.keys[here], s + 1)
            if not step % 64:
                bits = mix(self.keys + np.uint64(step), walk + 101)  # 64 steps' moves of each word
            at = np.minimum(at + (bits[here] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64), last)
        return out

    def _buckets(self) -> None:
        """Sample keys of all items, sorted per class, walk and sample."""
        self.classes: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            self.classes.setdefault(_class(len(item)), []).append(k)
        self.low = np.zeros(len(self.items), np.int64)
        self.buckets = {}
        self.places = {(low, walk): self._samples(low, walk) for low in self.classes for walk in range(WALKS)}
        for low, members in self.classes.items():
            self.low[members] = low
            end = len(self.vocabulary) + 1  # a word that no text has closes the item
            starts, flat = [], []
            for k in members:
                starts.append(len(flat))
                flat += [*self.lists[k], *[end] * 2]
            words = np.array([*flat, end], np.int64)
            for walk in range(WALKS):
                keys = self._walk(words, np.array(starts), low, walk)
                order = np.argsort(keys, axis=0, kind="stable")
                self.buckets[low, walk] = (np.take_along_axis(keys, order, axis=0), np.array(members)[order])

    def _windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and items that the piece test leaves, without repeats."""
        starts, items = [], []
        for size, (table, hashes, item, offset) in self.pieces.items():
            if len(words) < size:
                continue
            runs = self._run(words, size)
            at = np.flatnonzero(table[runs >> np.uint64(64 - _TABLE_BITS)])
            if not len(at):
                continue
            first, last = (np.searchsorted(hashes, runs[at], side) for side in ("left", "right"))
            many = last - first
            at, first, many = at[many > 0], first[many > 0], many[many > 0]
            which = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            starts.append(np.repeat(at, many) - offset[which])
            items.append(item[which])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, item = np.concatenate(starts), np.concatenate(items)
        code = np.unique(start * len(self.items) + item)
        start, item = code // len(self.items), code % len(self.items)
        reach = np.array([edits(len(x)) for x in self.items])[item]
        wide = 2 * reach + 1
        near = np.repeat(start - reach, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        item = np.repeat(item, wide)
        good = (near >= 0) & (near < len(words))
        code = np.unique(near[good] * len(self.items) + item[good])
        return code // len(self.items), code % len(self.items)

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and items whose walks agree in a sample: the buckets of the windows that are left."""
        start, item = self._windows(words)
        found = [np.zeros(0, np.int64)]
        closed = np.append(words, 0)
        for low in self.classes:
            # Each window is walked once, whatever the number of items that it may hold.
            windows = np.unique(start[self.low[item] == low])
            for at in range(0, len(windows), 1 << 16):
                part = windows[at : at + (1 << 16)]
                for walk in range(WALKS):
                    keys, (sorted_keys, members) = self._walk(closed, part, low, walk), self.buckets[low, walk]
                    for s in range(SAMPLES):
                        first, last = (np.searchsorted(sorted_keys[:, s], keys[:, s], side) for side in ("left", "right"))
                        many = last - first
                        which = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        found.append(np.repeat(part, many) * len(self.items) + members[which, s])
        code = np.unique(np.concatenate(found))
        return code // len(self.items), code % len(self.items)

    def search(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (item id, edits, first word, words) of the best place of each item."""
        found: list[dict] = [{} for _ in texts]
        out: list[list[tuple[int, int, int, int]]] = [self._short_lines(t) if self.short and t else [] for t in texts]
        if not self.items:
            return out
        get, flat, bounds = self.vocabulary.get, [], [0]
        for text in texts:
            words = item_words(text)
            flat.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
            flat.append(np.zeros(1, np.int64))  # documents are apart by a word that no item has
            bounds.append(bounds[-1] + len(words) + 1)
        words = np.concatenate(flat)
        start, item = self.candidates(words)
        document = np.searchsorted(bounds, start, "right") - 1
        for s, k, d in zip(start.tolist(), item.tolist(), document.tolist(), strict=True):
            n, most = len(self.lists[k]), edits(len(self.lists[k]))
            end = min(s + n + most, bounds[d + 1] - 1)
            distance, length = best_end(self.lists[k], words[s:end].tolist())
            place = (distance, s - bounds[d], length)
            if distance <= most and (k not in found[d] or place < found[d][k]):
                found[d][k] = place
        for d, hits in enumerate(found):
            out[d] = sorted([*out[d], *((self.ids[k], e, s, n) for k, (e, s, n) in hits.items())])
        return out

    def _short_lines(self, text: str) -> list[tuple[int, int, int, int]]:
        """Short items that are a whole line: the first such line of each."""
        at, found = 0, {}
        for line in text.split("\n"):
            words = item_words(line)
            for i in self.short.get(tuple(words), ()) if len(words) < LEAST_WORDS else ():
                found.setdefault(i, (i, 0, at, len(words)))
            at += len(words)
        return list(found.values())


def _groups(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in groups of about ``most`` words; one group at a time is on the driver."""
    rows = items.select(items["item_id"].cast("bigint").alias("i"), items["text"].cast("string").alias("t")).dropna()
    words = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] // 4
    count = max(1, -(-words // most))
    for g in range(count):
        yield [tuple(r) for r in (rows.filter(hash60(F.col("i"), F.col("t")) % count == g) if count > 1 else rows).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``docs`` with ``leaks``: item, edits, first word and words of the best place, by item id."""
    kept = [f for f in docs.schema.fields if f.name.lower() != "leaks"]
    names = [f.name for f in kept]
    leak = to_arrow_type(StructType.fromDDL(f"leaks {LEAK}")["leaks"].dataType)
    out = docs.select(*names, docs["text"].cast("string").alias("_text"), F.array().cast(LEAK).alias("_leaks"))
    schema = StructType([*kept, *out.schema.fields[-2:]])

    def searcher(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(held.value)
                for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    *rest, text, before = part.columns
                    hits = matcher.search(text.to_pylist())
                    rows = [
                        [*old, *({"item_id": i, "edits": e, "start": s, "n_words": n} for i, e, s, n in new)]
                        for old, new in zip(before.to_pylist(), hits, strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays([*rest, text, pa.array(rows, leak)], names=part.schema.names)
        return run

    held = None
    for group in _groups(items, group_words):
        if held is not None:  # the former group is done with before the next one is sent
            out = stage(out, "searched")
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(group)
        out = out.mapInArrow(searcher(held), schema)
    return out.select(*names, F.array_sort("_leaks").alias("leaks"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without leaks, with their columns."""
    found = find_leaks(docs, items)
    return found.filter(F.size("leaks") == 0).select(*[c for c in found.columns if c != "leaks"])
