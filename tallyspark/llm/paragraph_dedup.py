"""Passages that repeat across documents, by paragraph MinHash banding.

Units.  A paragraph is a line of a text; words are runs of word characters in lower case.
Passages are also copied into the middle of other paragraphs, so each paragraph is cut into
sentences, and sentences of more than ``LONG`` words (and rows of very short ones) at words chosen
by their hash, so that equal passages are cut alike wherever they stand.  Pieces of at least
``SENTENCE`` words with the same words are one class.  Paragraphs of at least ``PARAGRAPH`` words are compared as sets of
five-word shingles: ``BANDS`` bands of ``ROWS`` MinHash values (at similarity 0.8 all but 3 in 1,000
pairs share a band), candidates verified by exact Jaccard similarity of at least ``THRESHOLD``,
classes are the connected components.

Beside these, every run of ``SPAN`` words that stands in two documents is found, whatever lines and
sentences it crosses.  The word stream of a whole document is winnowed: of each ``WINNOW``
neighbouring runs of ``SEED`` words the one with the smallest hash is the seed, so that equal runs of
``SPAN`` words have the same seed.  Neighbouring runs of ``SPAN`` words with one seed make a stretch,
one row for about ten words, and stretches are classes by equality of their words.  Where all
stretches of a seed are alike, as in copies, that settles the seed.  Where a seed has different
stretches, the first occurrence of each is read again, and its runs of ``SPAN`` words are classes by
equality too; all other occurrences of a stretch repeat its first one as a whole.

Documents are known by their ids; only if an id comes with several texts, the pairs of id and text are
numbered in their order, and the numbers stand for the ids until the end.

Nothing expands a bucket into its pairs: members are
verified against the bucket's smallest content, and only buckets that are then still in
several components are compared member by member, in tiles of bounded size that join components
as they find links and write only these.

Spans.  Classes that occur in at least two documents repeat.  The first occurrence (smallest
doc_id, then place) stays, all others go.  Neighbouring units of the same fate, at most ``GAP``
words (or as many characters as these have) apart, make a span; spans of fewer than ``SPAN`` words are left alone.

Nulls: rows with a null id or text, and empty texts, have no spans.  A document is an id with a
text: rows that repeat both are one document, an id with several texts is several documents.  An
empty table gives an empty result.  Further columns, whatever
their names, are kept by ``remove_repeats`` and left out of ``repeated_spans``.
"""

from __future__ import annotations

import gc
import re
import time
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..plans.staging import drop_staged, stage, staging_path
from .batches import consecutive, whole_runs
from .components import components
from .words import WordHashes, mix, shingle_hashes, words_of

THRESHOLD = 0.8
SHINGLE = 5
ROWS, BANDS = 3, 8
PARAGRAPH, SENTENCE, LONG, SPAN, GAP = 20, 6, 16, 20, 5
#: Words of a seed, and seed places of which one at least is taken: SEED + WINNOW - 1 = SPAN.
SEED, WINNOW = 6, 15
#: One word hash in so many marks a cut.
CUT = 8
#: Parts of the hashes whose repeats are looked for one after the other.
SLICES = 4
#: Paragraphs that one side of a tile holds.
TILE = 500
_STOPS = ".!?。！？"
_SENTENCE = re.compile(f"[^{_STOPS}]+[{_STOPS}]*|[{_STOPS}]+")
_WORD = re.compile(r"\w+")
SENTENCE_TYPE = pa.struct([
    ("start", pa.int32()), ("stop", pa.int32()), ("at", pa.int32()), ("words", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])
#: A column per slice of the hashes, so that a search in one slice reads that slice alone.
_SLICED = [f"{kind}_{i}" for kind in ("sentences", "stretches") for i in range(SLICES)]
UNITS = "doc_id bigint, start int, stop int, at int, words int, h bigint, bands array<bigint>" + "".join(
    f", {name} array<struct<start:int,stop:int,at:int,words:int,h:bigint,g:bigint>>" for name in _SLICED)
_UNIT_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("at", pa.int32()), ("words", pa.int32()), ("h", pa.int64()),
    ("bands", pa.list_(pa.int64())), *((name, pa.list_(SENTENCE_TYPE)) for name in _SLICED)])
WINDOWS = "doc_id bigint, start int, stop int, at int, words int, h bigint, g bigint"


def _sentences(text: str, start: int, stop: int, memo: WordHashes) -> Iterator[tuple[int, int, list[str]]]:
    """Character ranges and words of the pieces of a paragraph.

    A sentence of up to ``LONG`` words is a piece.  A longer one is cut behind words with a
    marked hash, and so is a row of sentences that are too short to count by themselves.
    """
    at, held = start, []
    end = start
    for match in _SENTENCE.finditer(text, start, stop):
        words = words_of(text[match.start() : match.end()])
        if len(words) < SENTENCE:
            held += words
            end = match.end()
            if len(held) >= SENTENCE and words and memo[words[-1]] % CUT == 0:
                yield at, end, held
                at, held = end, []
            continue
        if held:
            yield at, end, held
        at, held = match.start(), []
        ends = [m.end() for m in _WORD.finditer(text, *match.span())] if len(words) > LONG else []
        if len(ends) == len(words):
            first = 0
            for i, word in enumerate(words, 1):
                if i - first >= SENTENCE and memo[word] % CUT == 0:
                    yield at, ends[i - 1], words[first:i]
                    at, first = ends[i - 1], i
            words = words[first:]
        elif ends:  # a letter whose lower case ends a word
            for word in _WORD.finditer(text, *match.span()):
                held += words_of(word[0])
                if len(held) >= SENTENCE and memo[held[-1]] % CUT == 0:
                    yield at, word.end(), held
                    at, held = word.end(), []
            words = held
        if words:
            yield at, match.end(), words
        at, held = match.end(), []
        end = at
    if held:
        yield at, end, held


def _slide(values: np.ndarray, size: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each ``size`` neighbouring values."""
    width = 1
    while 2 * width <= size:
        values = least(values[:-width], values[width:])
        width *= 2
    return least(values[: len(values) - size + width], values[size - width :]) if width < size else values


def _runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a document's runs of ``SEED`` words, and the smallest inside each run of ``SPAN`` words."""
    count = len(words) - SEED + 1
    if count < WINNOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = words[:count].copy()
        for i in range(1, SEED):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[i : count + i]
    runs = mix(runs, 31)
    return runs, _slide(runs, WINNOW, np.minimum)


def _span_digests(words: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit value per run of ``SPAN`` words, for the first ``count`` of them."""
    out, mixed = np.zeros(count, np.uint64), mix(words, 41)
    with np.errstate(over="ignore"):
        for i in range(SPAN):
            out = out * np.uint64(0xD1342543DE82EF95) + mixed[i : count + i]
    return mix(out, 43)


def stretches(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, seed and digest of the stretches of documents in a row.

    ``ends``: per word, where its document ends.  Documents of less than ``SPAN`` words have none.
    """
    _, least = _runs(words)
    begins = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= SPAN)
    if not len(begins):
        return begins, begins, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    seeds = least[begins]
    new = np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (begins[1:] != begins[:-1] + 1)])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(begins)))
    with np.errstate(over="ignore"):
        # A stretch is its runs of SPAN words in a row.
        places = (np.arange(len(begins)) - np.repeat(first, runs)).astype(np.uint64)
        each = _span_digests(words, len(least))[begins] ^ mix(places, 47)
        digests = mix(np.add.reduceat(mix(each, 53), first) + runs.astype(np.uint64), 59)
    return begins[first], runs + SPAN - 1, seeds[first], digests


def _digests(hashes: np.ndarray, places) -> np.ndarray:
    """Two 64-bit values per (first word, number of words)."""
    data = memoryview(hashes.tobytes())
    found = b"".join([xxhash.xxh3_128_digest(data[8 * at : 8 * (at + n)]) for at, n in places])
    return np.frombuffer(found, ">i8").astype(np.int64).reshape(-1, 2)


def min_hashes(shingles: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """paragraphs x (BANDS * ROWS) minima over the shingles of each paragraph (none is empty)."""
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    edges = np.column_stack([starts, stops]).ravel()
    padded = np.append(shingles, np.uint64(0))
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            multiplier, offset = mix(np.array([2 * i, 2 * i + 1], np.uint64), 21)
            values = (padded ^ offset) * (multiplier | np.uint64(1))
            out[:, i] = np.minimum.reduceat(values ^ (values >> np.uint64(32)), edges)[::2]
    return out


def _is_plain(text: str) -> bool:
    """Whether lower-casing leaves every letter in its place, whatever stands beside it."""
    return "Σ" not in text and "İ" not in text


def _read(texts: list[str], memo: WordHashes):
    """Word hashes and character ranges of texts joined by line feeds, the first word of each text,
    (start, stop, first word) of its lines with words, and (start, stop, first word, words) of their pieces."""
    words, bases, lines, pieces, before = [], [], [], [], 0
    for text in texts:
        at = 0
        bases.append(len(words))
        while at <= len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            first = len(words)
            for a, b, mine in _sentences(text, at, stop, memo):
                if len(mine) >= SENTENCE:
                    pieces.append((before + a, before + b, len(words), len(mine)))
                words += mine
            if len(words) > first:
                lines.append((before + at, before + stop, first))
            at = stop + 1
        before += len(text) + 1
    return (memo.of(words), word_ranges("\n".join(texts)), np.array(bases, np.int64),
            np.array(lines, np.int64).reshape(-1, 3), np.array(pieces, np.int64).reshape(-1, 4))


def _starts(texts: list[str]) -> np.ndarray:
    """Where each text begins in the texts joined by line feeds."""
    return np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[: len(texts)].astype(np.int64)


def _plain_words(texts: list[str], memo: WordHashes):
    """Word hashes and character ranges of plain texts joined by line feeds, the first word of each text, and the characters."""
    joined = "\n".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ranges, hashes = _ranges(codes), memo.of(_WORD.findall(joined))
    return hashes, ranges, np.searchsorted(ranges[:, 0], _starts(texts)), codes


def _read_plain(texts: list[str], memo: WordHashes):
    """What ``_read`` gives, for plain texts: all texts at once, with a step per sentence, not per word."""
    hashes, ranges, bases, codes = _plain_words(texts, memo)
    if not len(hashes):
        return hashes, ranges, bases, np.zeros((0, 3), np.int64), np.zeros((0, 4), np.int64)
    feeds = np.flatnonzero(codes == 10)
    line_starts, line_stops = np.concatenate([[0], feeds + 1]), np.append(feeds, len(codes))
    line = np.searchsorted(line_starts, ranges[:, 0], "right") - 1
    first = np.flatnonzero(np.diff(line, prepend=-1))
    used = line[first]
    lines = np.column_stack([line_starts[used], line_stops[used], first])

    # A sentence ends behind a row of stops, or with its line.
    stops = np.append(np.isin(codes, [ord(c) for c in _STOPS]), False)
    edges = np.union1d(np.flatnonzero(stops[:-1] & ~stops[1:]) + 1, line_starts)
    segment = np.searchsorted(edges, ranges[:, 0], "right") - 1
    lo = np.flatnonzero(np.diff(segment, prepend=-1))
    of_line = line[lo]
    begins = edges[segment[lo]]
    ends = np.minimum(np.append(edges, len(codes))[segment[lo] + 1], line_stops[of_line])
    marked = hashes % np.uint64(CUT) == 0
    cuts, word_ends = np.flatnonzero(marked).tolist(), ranges[:, 1]
    last = np.append(lo[1:], len(hashes)) - 1
    pieces, held, row, at, near = [], 0, -1, 0, 0
    for w, n, a, b, mine, mark in zip(
            lo.tolist(), (last - lo + 1).tolist(), begins.tolist(), ends.tolist(), of_line.tolist(), marked[last].tolist(), strict=True):
        if mine != row:
            if held >= SENTENCE:
                pieces.append((at, int(line_stops[row]), w - held, held))
            row, held, at = mine, 0, int(line_starts[mine])
        if n < SENTENCE:
            held += n
            if mark and held >= SENTENCE:
                pieces.append((at, b, w + n - held, held))
                at, held = b, 0
            continue
        if held >= SENTENCE:
            pieces.append((at, a, w - held, held))
        at, held, begin = a, 0, w
        if n > LONG:
            near = bisect_left(cuts, w, near)
            while near < len(cuts) and cuts[near] < w + n:
                cut = cuts[near] + 1
                if cut - begin >= SENTENCE:
                    end = int(word_ends[cut - 1])
                    pieces.append((at, end, begin, cut - begin))
                    at, begin = end, cut
                near += 1
        if w + n - begin >= SENTENCE:
            pieces.append((at, b, begin, w + n - begin))
        at = b
    if held >= SENTENCE:
        pieces.append((at, int(line_stops[row]), len(hashes) - held, held))
    return hashes, ranges, bases, lines, np.array(pieces, np.int64).reshape(-1, 4)


def paragraph_units(docs: DataFrame) -> DataFrame:
    """A row per paragraph with words: its place, hash, bands (from ``PARAGRAPH`` words), sentences and
    the stretches that begin in it, by slices of their hashes; ``at`` counts the words of the document before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                texts = list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True))
                plain = [one for one in texts if _is_plain(one[1])]
                yield from units(plain, _read_plain, memo)
                if len(plain) < len(texts):
                    yield from units([one for one in texts if not _is_plain(one[1])], _read, memo)

    def units(docs, read, memo):
        ids, texts = [d for d, _ in docs], [t for _, t in docs]
        hashes, ranges, bases, lines, pieces = read(texts, memo)
        if not len(lines):
            return
        # The places of all texts are in the texts joined by a line feed.
        chars = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        bases = np.append(bases, len(hashes))
        document = np.searchsorted(bases, lines[:, 2], "right") - 1
        rows = list(zip(*(c.tolist() for c in (
            np.array(ids, np.int64)[document], lines[:, 0] - chars[document], lines[:, 1] - chars[document],
            np.diff(np.append(lines[:, 2], len(hashes))), lines[:, 2], lines[:, 2] - bases[document])), strict=True))

        def within_lines(columns, first):
            line, part = np.searchsorted(lines[:, 2], first, "right") - 1, columns[4] % SLICES
            for mine in (np.flatnonzero(part == i) for i in range(SLICES)):
                in_row = np.bincount(line[mine], minlength=len(rows))
                yield pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(in_row)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c[mine]) for c in columns], fields=list(SENTENCE_TYPE)))

        keys = _digests(hashes, pieces[:, 2:].tolist())
        document = np.searchsorted(bases, pieces[:, 2], "right") - 1
        places = pieces[:, 0] - chars[document], pieces[:, 1] - chars[document], pieces[:, 2] - bases[document], pieces[:, 3]
        sentences = within_lines([*(c.astype(np.int32) for c in places), keys[:, 0], keys[:, 1]], pieces[:, 2])
        lengths = np.diff(bases)
        at, many, h, g = stretches(hashes, np.repeat(bases[1:], lengths))
        document = np.searchsorted(bases, at, "right") - 1
        places = ranges[at, 0] - chars[document], ranges[at + many - 1, 1] - chars[document], at - bases[document], many
        sown = within_lines([*(c.astype(np.int32) for c in places), h.view(np.int64), g.view(np.int64)], at)
        contents = _digests(hashes, [(row[4], row[3]) for row in rows])[:, 1]
        bands = [None] * len(rows)
        long = [i for i, row in enumerate(rows) if row[3] >= PARAGRAPH]
        if long:
            starts = np.array([rows[i][4] for i in long])
            stops = starts + np.array([rows[i][3] for i in long]) - SHINGLE + 1
            values = min_hashes(shingle_hashes(hashes, SHINGLE), starts, stops).reshape(len(long), BANDS, ROWS)
            keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(long), 1))
            for r in range(ROWS):
                keys = mix(keys ^ values[:, :, r], r + 1)
            for i, key in zip(long, keys.astype(np.int64).tolist(), strict=True):
                bands[i] = key
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
            pa.array([r[5] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array(contents, pa.int64()),
            pa.array(bands, pa.list_(pa.int64())), *sentences, *sown,
        ], schema=_UNIT_SCHEMA)

    return docs.mapInArrow(run, UNITS)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with an id and a text as (doc_id, text), one number per document in ``doc_id``.

    The number is the id itself, unless an id has several texts; then the second table says which
    id and text (by its hash) a number stands for.
    """
    doc_id, text = docs["doc_id"].cast("bigint"), docs["text"].cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).dropna()
    several = rows.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).filter("low < high")
    if several.limit(1).isEmpty():
        return rows.select("doc_id", "text"), None
    names = stage(global_rank(rows.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "number"), "names")
    return stage(rows.join(names, ["doc_id", "text_hash"]).select(F.col("number").alias("doc_id"), "text"), "numbered"), names


def _set(text: str, memo: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(memo.of(words_of(text)), SHINGLE))


def _sets(texts: list[str], memo: WordHashes) -> list[np.ndarray]:
    """What ``_set`` gives for each text, hashed together."""
    words = [words_of(text) for text in texts]
    hashes = memo.of([w for mine in words for w in mine])
    shingles, out, at = shingle_hashes(hashes, SHINGLE), [], 0
    for mine in words:
        own = shingles[at : at + len(mine) - SHINGLE + 1] if len(mine) >= SHINGLE else shingle_hashes(hashes[at : at + len(mine)], SHINGLE)
        out.append(np.unique(own))
        at += len(mine)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    shared = (a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()
    return shared / (len(a) + len(b) - shared)


def _texts(docs: DataFrame, units: DataFrame, active: DataFrame) -> DataFrame:
    """h and text of one occurrence of each active paragraph."""
    places = (
        units.filter(F.col("words") >= PARAGRAPH).select("h", F.struct("doc_id", "start", "stop").alias("place")).join(active, "h")
        .groupBy("h").agg(F.min("place").alias("place")).select("h", "place.*")
    )
    return docs.join(places, "doc_id").select("h", F.expr("substring(text, start + 1, stop - start)").alias("text")).groupBy("h").agg(F.min("text").alias("text"))


def _stars(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The verified pairs (a, b) as ``u`` and ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                u = part.column("u").to_pylist()
                first = dict(zip(u, part.column("ta"), strict=True))
                pivots = dict(zip(first, _sets([t.as_py() for t in first.values()], memo), strict=True))
                sets = _sets(part.column("tb").to_pylist(), memo)
                keep = [jaccard(pivots[a], b) >= threshold - 1e-12 for a, b in zip(u, sets, strict=True)]
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(texts.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a")
        .select(F.col("a").alias("u"), F.col("b").alias("v"), "ta", "tb").mapInArrow(run, "u bigint, v bigint")
    )


def _across(members: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified links between components that share a bucket."""
    labelled = stage(
        members.join(labels.select(F.col("u").alias("h"), F.col("v").alias("label")), "h", "left")
        .withColumn("label", F.coalesce("label", "h")), "labelled")
    mixed = (
        labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low < high AND n > 2").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    )
    rows = (
        labelled.join(mixed, "key").join(texts, "h")
        .withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                (F.col("chunk") > F.col("other")).cast("int").alias("side"), "h", "label", "pivot", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for (_, i, j), table in consecutive(batches, ["key", "i", "j"]):
            ids, pivots, side = (table.column(c).to_numpy() for c in ("h", "pivot", "side"))
            labels = table.column("label").to_numpy().copy()
            sets = _sets(table.column("text").to_pylist(), memo)
            sizes = np.array([len(s) for s in sets])
            split = 0 if i == j else int((side == 0).sum())
            a, b = [], []
            for row in range(split if split else len(ids)):
                others = np.arange(split if split else row + 1, len(ids))
                # Sets of too different sizes cannot reach the threshold.
                near = np.minimum(sizes[others], sizes[row]) >= threshold * np.maximum(sizes[others], sizes[row]) - 1e-9
                for other in others[near & (labels[others] != labels[row]) & (ids[others] != pivots[row]) & (ids[row] != pivots[row])].tolist():
                    if labels[other] != labels[row] and jaccard(sets[row], sets[other]) >= threshold - 1e-12:
                        a.append(int(ids[row]))
                        b.append(int(ids[other]))
                        labels[labels == labels[other]] = labels[row]
            if a:
                yield pa.RecordBatch.from_pydict({"u": a, "v": b})

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, "u bigint, v bigint")


def _near_paragraphs(docs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """h and label: the class of each paragraph content that has a near-duplicate."""
    banded = units.filter("bands IS NOT NULL").select("h", F.explode("bands").alias("key"))
    keys = banded.groupBy("key").agg(F.min("h").alias("pivot"), F.max("h").alias("top")).filter("pivot < top").select("key", "pivot")
    members = _staged(banded.join(keys, "key").distinct(), "members")
    texts = _staged(_texts(docs, units, members.select("h").distinct()), "texts")
    pairs = members.filter("h <> pivot").select(F.col("pivot").alias("a"), F.col("h").alias("b")).distinct()
    labels = components(stage(_stars(pairs, texts, threshold), "links"))
    labels = components(labels.select("u", "v").union(_across(members, labels, texts, threshold)))
    return labels.select(F.col("u").alias("h"), F.col("v").alias("label")).union(labels.select("v", "v").distinct())


def _word_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text, as ``_sentences`` gives them, and their character ranges."""
    words, places = [], []
    for match in _WORD.finditer(text):
        mine = words_of(match[0])
        words += mine
        places += [match.span()] * len(mine)
    return words, places


#: Which characters are of words, by code point.
_OF_WORDS = np.zeros(0x110000, bool)


def word_ranges(text: str) -> np.ndarray:
    """words x 2: the character ranges of a text's words."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter with a longer lower case
        return np.array(_word_places(text)[1], np.int32).reshape(-1, 2)
    return _ranges(np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32))


def _ranges(codes: np.ndarray) -> np.ndarray:
    if not _OF_WORDS[ord("a")]:
        _OF_WORDS[:] = [chr(c).isalnum() or c == 95 for c in range(0x110000)]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _OF_WORDS[codes]
    edges = np.diff(inside)
    return np.column_stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)]).astype(np.int32)


def _all_words(text: str, memo: WordHashes) -> list[str]:
    """The words of a text in order, as ``paragraph_units`` reads them."""
    if "Σ" not in text:  # its lower case depends on the letters beside it
        return words_of(text)
    return [w for line in text.split("\n") for _, _, mine in _sentences(line, 0, len(line), memo) for w in mine]


def opened_windows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """The runs of ``SPAN`` words of the stretches ``opened`` (doc_id, start, stop, at, words, h).

    Of plain texts, only the characters of the stretches are read; those that overlap are read once.
    """
    places = opened.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "at", "words", "h")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                ids, texts, places = part.column("doc_id").to_numpy(), part.column("text").to_pylist(), part.column("places")
                of = np.repeat(np.arange(len(texts)), places.value_lengths().to_numpy())
                start, stop, at, words, h = (places.flatten().field(i).to_numpy() for i in range(5))
                plain = np.array([_is_plain(t) for t in texts])
                order = np.lexsort((at, of))
                mine = order[plain[of[order]]]
                if len(mine):
                    begins = at[mine] + (of[mine] << 33)
                    new = np.append(True, begins[1:] >= np.maximum.accumulate(begins + words[mine])[:-1])
                    first = np.flatnonzero(new)
                    begin, end = start[mine][first], np.maximum.reduceat(stop[mine], first)
                    read = [texts[i][a:b] for i, a, b in zip(of[mine][first].tolist(), begin.tolist(), end.tolist(), strict=True)]
                    hashes, ranges, bases, _ = _plain_words(read, memo)
                    piece = np.cumsum(new) - 1
                    yield from windows(
                        ids[of[mine]], at[mine], words[mine], h[mine], hashes, ranges, (bases - at[mine][first])[piece], (_starts(read) - begin)[piece])
                for i in np.flatnonzero(~plain).tolist():
                    mine, zeros = np.flatnonzero(of == i), np.zeros((of == i).sum(), np.int64)
                    yield from windows(
                        ids[of[mine]], at[mine], words[mine], h[mine], memo.of(_all_words(texts[i], memo)), word_ranges(texts[i]), zeros, zeros)

    def windows(ids, at, words, h, hashes, ranges, base, chars):
        """``base`` and ``chars``: what a document's places of words and characters are behind in what was read."""
        digests = _span_digests(hashes, len(hashes) - SPAN + 1).view(np.int64)
        runs = words - SPAN + 1
        begins = np.repeat(base + at - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        of = np.repeat(np.arange(len(at)), runs)
        for i in range(0, len(begins), 10_000):
            b, o = begins[i : i + 10_000], of[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[o]), pa.array((ranges[b, 0] - chars[o]).astype(np.int32)), pa.array((ranges[b + SPAN - 1, 1] - chars[o]).astype(np.int32)),
                pa.array((b - base[o]).astype(np.int32)), pa.array(np.full(len(b), SPAN, np.int32)), pa.array(h[o]), pa.array(digests[b]),
            ], names=["doc_id", "start", "stop", "at", "words", "h", "g"])

    return docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(run, WINDOWS)


def _classes(rows: DataFrame) -> DataFrame:
    """h, g, and the ``first`` place and whether it is in several documents (``repeated``)."""
    return rows.groupBy("h", "g").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("high")
    ).select("h", "g", "first", (F.col("first.doc_id") < F.col("high")).alias("repeated"))


def _marked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.filter("repeated").select("h", "g", "first"), ["h", "g"]).select(
        "doc_id", "start", "stop", "at", "words", F.col("first.doc_id").alias("first_doc"),
        (F.struct("doc_id", "at") != F.col("first")).alias("removed"))


def merged(doc_id, removed, start, stop, at, words, origin, span: int) -> pa.RecordBatch:
    """The spans of at least ``span`` words of units sorted by document, fate, start and falling stop.

    A unit begins a span if it lies behind all units of its document and fate before it, by characters and
    by words.  What lies behind them all reaches farther than they do, so the units of the span itself
    decide the same.  Places of different documents and fates are moved apart to be looked at together.
    """
    apart = np.cumsum(np.append(False, (doc_id[1:] != doc_id[:-1]) | (removed[1:] != removed[:-1]))).astype(np.int64) << 33
    begins, ends = at + apart, at + apart + words
    reach, told = np.maximum.accumulate(stop + apart), np.maximum.accumulate(ends)
    new = np.append(True, (start[1:] + apart[1:] > reach[:-1] + 8 * GAP) & (begins[1:] > told[:-1] + GAP))
    first = np.flatnonzero(new)
    # Units overlap; each word counts once.
    own = ends - begins
    own[1:] = np.maximum(0, ends[1:] - np.maximum(begins[1:], told[:-1]))
    count = np.add.reduceat(own, first)
    rows = [doc_id[first], start[first], np.maximum.reduceat(stop, first), count.astype(np.int32), np.minimum.reduceat(origin, first), removed[first] == 1]
    return pa.RecordBatch.from_arrays(
        [pa.array(c[count >= span]) for c in rows], names=["doc_id", "start", "stop", "n_words", "first_doc", "removed"])


def repeated_spans(docs: DataFrame, threshold: float = THRESHOLD, span: int = SPAN) -> DataFrame:
    """doc_id, start and stop (characters), n_words, first_doc and removed of every repeated span."""
    rows, names = _numbered(docs)
    spans = _spans(rows, threshold, span)
    return spans if names is None else _named(spans, names).drop("text_hash")


def _named(spans: DataFrame, names: DataFrame) -> DataFrame:
    """Spans with the ids that the numbers stand for, and the hash of the text."""
    own = names.select(F.col("number").alias("own"), F.col("doc_id").alias("own_id"), "text_hash")
    other = names.select(F.col("number").alias("other"), F.col("doc_id").alias("other_id"))
    return spans.join(own, F.col("doc_id") == F.col("own")).join(other, F.col("first_doc") == F.col("other")).select(
        F.col("own_id").alias("doc_id"), "text_hash", "start", "stop", "n_words", F.col("other_id").alias("first_doc"), "removed")


def _staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``stage``, and collections of the driver's garbage: Spark deletes the shuffle files of the jobs
    before it only when their handles are collected, and here they would pile up.  Spark's listeners hold
    the handles of the last job a moment longer, so a second collection follows."""
    out = stage(df, name, path)
    for wait in (0, 1):
        time.sleep(wait)
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _repeated(slices: list[DataFrame], condition, name: str) -> DataFrame:
    """The rows whose ``h`` meets ``condition`` (an aggregate), staged.

    Two passes: which hashes do, then only their rows; in slices by the hash, whose
    shuffle files follow each other and do not add up.
    """
    found = []
    for part in slices:
        keys = part.groupBy("h").agg(condition.alias("met")).filter("met").select("h")
        found.append(_staged(part.join(keys, "h"), name))
    return reduce(DataFrame.union, found)


def _spans(docs: DataFrame, threshold: float, span: int) -> DataFrame:
    """The repeated spans of numbered documents."""
    units_path = staging_path(docs.sparkSession, "units")
    units = _staged(paragraph_units(docs), "units", units_path)
    paragraphs = units.filter(F.col("words") >= PARAGRAPH).select("doc_id", "start", "stop", "at", "words", "h", F.lit(0).cast("bigint").alias("g"))

    # First, as its shuffle files are the largest.
    near = _staged(_near_paragraphs(docs, units, threshold), "near-paragraphs")

    def slice_of(kind: str, i: int) -> DataFrame:
        return units.select("doc_id", F.explode(f"{kind}_{i}").alias("s")).select("doc_id", "s.*")

    several = F.min("doc_id") < F.max("doc_id")
    sentences = [slice_of("sentences", i).unionByName(paragraphs.filter(F.pmod("h", F.lit(SLICES)) == i)) for i in range(SLICES)]
    found = _repeated(sentences, several, "sentences").select("doc_id", "start", "stop", "at", "words", "h", "g")
    found = _staged(found.unionByName(
        paragraphs.join(near, "h").select("doc_id", "start", "stop", "at", "words", F.col("label").alias("h"), F.lit(-1).cast("bigint").alias("g"))), "found")

    # What repeats inside one document only goes with its class.
    sown = _repeated([slice_of("stretches", i) for i in range(SLICES)], F.count(F.lit(1)) > 1, "stretches").select(*found.columns)
    # All that follows reads what was found in the units; they are the largest table by far.
    drop_staged(docs.sparkSession, units_path)
    classes = _staged(_classes(sown), "stretch-classes")
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    opened = sown.join(classes.join(several, "h").select("h", "g", "first"), ["h", "g"]).filter(F.struct("doc_id", "at") == F.col("first"))
    windows = _staged(opened_windows(docs, opened.select("doc_id", "start", "stop", "at", "words", "h")), "windows")

    # One after the other, so that the shuffle files of these joins do not add up either.
    marked = _staged(_marked(found, _classes(found)).union(_marked(sown, classes)), "marked")
    marked = marked.union(_staged(_marked(windows, _classes(windows)), "marked"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["doc_id", "removed"]):
            yield merged(*(table.column(c).to_numpy() for c in ("doc_id", "removed", "start", "stop", "at", "words", "first_doc")), span)

    return (
        marked.withColumn("removed", F.col("removed").cast("int")).repartition("doc_id")
        .sortWithinPartitions("doc_id", "removed", "start", F.desc("stop"))
        .mapInArrow(merge, "doc_id bigint, start int, stop int, n_words int, first_doc bigint, removed boolean")
    )


def remove_repeats(docs: DataFrame, threshold: float = THRESHOLD, span: int = SPAN) -> DataFrame:
    """``docs`` with the removed spans cut out of ``text``."""
    numbered, names = _numbered(docs)
    spans = stage(_spans(numbered, threshold, span), "spans").filter("removed")
    spans = spans.withColumn("text_hash", F.lit(None).cast("bigint")) if names is None else _named(spans, names)
    cuts = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    # The document is one column beside the keys, so its own columns may have any names.
    text_hash = F.lit(None).cast("bigint") if names is None else F.xxhash64(docs["text"].cast("string"))
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("own_id"), text_hash.alias("own_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    # Pieces between the cuts; spans of a document do not overlap.
    ends = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length(text)))
    begins = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["stop"]))
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(text, b + 1, F.greatest(e - b, F.lit(0))))
    cut = F.when(F.col("cuts").isNull(), text).otherwise(F.concat_ws("", pieces))
    same = (F.col("own_id") == F.col("doc_id")) & F.col("own_hash").eqNullSafe(F.col("text_hash"))
    return rows.join(cuts, same, "left").select(F.col("row").withField("text", cut).alias("row")).select("row.*")
