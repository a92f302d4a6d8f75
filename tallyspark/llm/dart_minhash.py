"""Near-duplicate documents by DartMinHash signatures of weighted shingles.

A document is the weighted set of its five-word shingles, weights being counts.  The plane of
each shingle, weight against rank, is cut into regions (weights 0-1, 1-2, 2-4, ...; ranks in
segments); darts fall into a region as a Poisson process drawn from the hash of (shingle,
region), the same in every document.  A document sees the darts below its weight and keeps, for
each of ``COORDINATES`` coordinates, the dart with the lowest rank.  Two documents agree in a
coordinate with a probability equal to their weighted Jaccard similarity.  Ranks are searched
up to where about ``t ln t + 2 t`` darts are expected, and twice as far while a coordinate is
empty, so a signature costs time in proportion to shingles plus t log t.

Joining.  ``BANDS`` bands of ``ROWS`` coordinates; documents that share a band are candidates (at
similarity 0.8 all but 2 in 1,000 pairs share one, at 0.85 all but 5 in 100,000).  No group is
expanded into its pairs:

1. Documents with the same words are one class and go on as their smallest id.
2. Every member of a band bucket is compared with the bucket's smallest id.
3. In buckets that are then still in several components, members of different components are
   compared in tiles of bounded size.  A tile joins components as it finds links, so members of
   one component are not compared again, and writes only these links.

One byte per coordinate rules out pairs whose estimate is ``SLACK`` (four standard errors) below
the threshold; all others are verified by their exact weighted Jaccard similarity, at least
``THRESHOLD``.

What is linked are contents (sequences of words), numbered in the order of their smallest
doc_id; a row is known by its id and the hash of its text, so an id that comes with several texts
is several documents.

Nulls: rows with a null id, and null, empty or wordless texts, link with nothing and stay.  Texts
of fewer than five words are one shingle.  Rows that repeat an id and its words are one
document, of which one row stays; so is a wordless text that repeats with its id.  An empty table
gives an empty result.  Further columns stay in ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..plans.staging import stage
from .batches import consecutive
from .components import components
from .words import WordHashes, mix, shingle_hashes, words_of

THRESHOLD = 0.8
SHINGLE = 5
ROWS, BANDS = 6, 21
COORDINATES = ROWS * BANDS
SLACK = 0.14
#: Members of a bucket that one side of a tile holds.
TILE = 2000
#: Length of a rank segment.
_SEGMENT = 8.0
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def weighted_shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles' hashes, sorted, and their counts."""
    return np.unique(shingle_hashes(words, size), return_counts=True)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 where either set is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    shared = np.minimum(a[1][at], b[1])[same].sum()
    return shared / (a[1].sum() + b[1].sum() - shared)


def _darts(owner, shingle, low, width, weight, bound, out) -> None:
    """Throw all darts with ranks below ``bound`` (one per document) and keep the earliest.

    owner, shingle, low, width, weight: per region its document, hash, weight interval and the
    element's weight.  out: documents x coordinates, rank in the upper bits, dart in the lower.
    """
    segments = np.ceil(bound[owner] / _SEGMENT).astype(np.int64)
    region = np.repeat(np.arange(len(owner)), segments)
    segment = np.arange(len(region)) - np.repeat(np.cumsum(segments) - segments, segments)
    with np.errstate(over="ignore"):
        state = mix(shingle[region] ^ mix(low[region].astype(np.uint64) * np.uint64(1 << 32) + segment.astype(np.uint64), 3), 5)
    start = segment * _SEGMENT
    end = np.minimum(start + _SEGMENT, bound[owner[region]])
    rank = start.astype(float)
    step = 0
    while len(region):
        step += 1
        draw = mix(state, step)
        rank = rank - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)) / width[region]
        alive = rank < end
        region, state, rank, end, draw = region[alive], state[alive], rank[alive], end[alive], draw[alive]
        dart = mix(draw, 77)
        height = low[region] + (dart >> np.uint64(40)).astype(float) / float(1 << 24) * width[region]
        seen = height < weight[region]
        dart, hit = dart[seen], owner[region[seen]]
        coordinate = (dart & np.uint64(0xFFFF)).astype(np.int64) % COORDINATES
        packed = np.minimum(rank[seen] * float(1 << 28), float(1 << 43)).astype(np.uint64) << np.uint64(20) | (dart >> np.uint64(16) & np.uint64(0xFFFFF))
        np.minimum.at(out, hit * COORDINATES + coordinate, packed)


def signatures(sets: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """documents x COORDINATES earliest darts; a row of ``_EMPTY`` for an empty set."""
    out = np.full(len(sets) * COORDINATES, _EMPTY)
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    if not sizes.sum():
        return out.reshape(len(sets), COORDINATES)
    shingle = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    owner = np.repeat(np.arange(len(sets)), sizes)
    total = np.bincount(owner, weights=weight, minlength=len(sets))
    # Weight regions: 0-1 and then 1-2, 2-4, ...
    regions = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(weight)), regions)
    number = np.arange(len(element)) - np.repeat(np.cumsum(regions) - regions, regions)
    width = np.where(number > 0, np.exp2(np.maximum(number - 1, 0)), 1.0)
    low = np.where(number > 0, width, 0.0)
    expected = COORDINATES * (np.log(COORDINATES) + 2)
    bound = np.where(total > 0, expected / np.maximum(total, 1e-300), 0.0)
    open_docs = total > 0
    while open_docs.any():
        chosen = open_docs[owner[element]]
        e = element[chosen]
        _darts(owner[e], shingle[e], low[chosen], width[chosen], weight[e], bound, out)
        open_docs &= (out.reshape(len(sets), COORDINATES) == _EMPTY).any(axis=1)
        bound = bound * 2
    return out.reshape(len(sets), COORDINATES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """documents x BANDS keys."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        keys = mix(keys ^ rows[:, :, r], r + 1)
    return keys.astype(np.int64)


def _sets(texts: Sequence[str | None], memo: WordHashes) -> tuple[list, list]:
    """Weighted shingles of each text and a digest of its words (None without words)."""
    sets, digests = [], []
    for text in texts:
        hashes = memo.of(words_of(text))
        sets.append(weighted_shingles(hashes))
        digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
    return sets, digests


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, content (digest of the words), bands and sketch (a byte per coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets, digests = _sets(part.column("text").to_pylist(), memo)
                signature = signatures(sets)
                keys = band_keys(signature)
                sketch = mix(signature, 9).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "content": pa.array(digests, pa.binary()),
                    "bands": pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel())),
                    "sketch": pa.array([s.tobytes() for s in sketch], pa.binary()),
                })

    return _plain(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, content binary, bands array<bigint>, sketch binary")


def _plain(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from bytes per coordinate, corrected for bytes that agree by chance."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate is not clearly below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sa", "sb"))
                keep = pa.array(_estimate(a, b) >= threshold - SLACK)
                yield batch.select(["a", "b"]).filter(keep)

    return (
        pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        .select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")
    )


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold, as ``u`` and ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held = WordHashes(), (None, None)
        for batch in batches:
            keep = []
            for a, first, second in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if held[0] != a:
                    held = (a, weighted_shingles(memo.of(words_of(first.as_py()))))
                keep.append(jaccard(held[1], weighted_shingles(memo.of(words_of(second.as_py())))) >= threshold - 1e-12)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "ta", "tb", F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(run, "u bigint, v bigint")
    )


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (``u``, ``v``) between components within the buckets that hold several."""
    labelled = stage(
        members.join(labels.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left")
        .withColumn("label", F.coalesce("label", "id")), "labelled")
    mixed = (
        labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low < high AND n > 2").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    )
    held = sketches.join(texts, "node").select(F.col("node").alias("id"), "sketch", "text")
    rows = (
        labelled.join(mixed, "key").join(held, "id")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                (F.col("chunk") > F.col("other")).cast("int").alias("side"), "id", "label", "pivot", "sketch", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for (_, i, j), table in consecutive(batches, ["key", "i", "j"]):
            ids, pivots, side = (table.column(c).to_numpy() for c in ("id", "pivot", "side"))
            labels, texts, sets = table.column("label").to_numpy().copy(), table.column("text"), {}

            def held(row):
                if row not in sets:
                    sets[row] = weighted_shingles(memo.of(words_of(texts[row].as_py())))
                return sets[row]

            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            split = 0 if i == j else int((side == 0).sum())
            links = []
            for row in range(split if split else len(ids)):
                others = np.arange(split if split else row + 1, len(ids))
                others = others[(labels[others] != labels[row]) & (ids[others] != pivots[row]) & (ids[row] != pivots[row])]
                if not len(others):
                    continue
                for other in others[_estimate(sketch[row], sketch[others]) >= threshold - SLACK].tolist():
                    if labels[other] != labels[row] and jaccard(held(row), held(other)) >= threshold - 1e-12:
                        links.append((int(ids[row]), int(ids[other])))
                        labels[labels == labels[other]] = labels[row]
            if links:
                yield pa.RecordBatch.from_pydict({"u": [u for u, _ in links], "v": [v for _, v in links]})

    return (
        rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        .mapInArrow(run, "u bigint, v bigint")
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id (the smallest linked id) and kept, one row per row of ``docs``."""
    return _labelled(docs, threshold).drop("text_hash")


def _labelled(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_hash, component_id and kept of every row."""
    sketched = stage(sketch_documents(docs), "sketches")
    usable = sketched.filter("content IS NOT NULL AND doc_id IS NOT NULL")
    first = usable.groupBy("content").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    # Numbers rise with the ids, so a component's smallest number has its smallest id.
    classes = stage(global_rank(first.select("content", "first.*"), ["doc_id", "content"], "node"), "classes")
    reps = stage(
        usable.join(classes, ["content", "doc_id", "text_hash"])
        .dropDuplicates(["node"]).select("node", "doc_id", "text_hash", "bands", "sketch"), "reps")
    sketches = reps.select("node", "sketch")

    banded = reps.select(F.col("node").alias("id"), F.explode("bands").alias("key"))
    keys = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).filter("n > 1")
    members = stage(banded.join(keys.select("key", "pivot"), "key"), "members")
    active = members.select(F.col("id").alias("node")).distinct().join(classes, "node").select("node", "doc_id", "text_hash")
    # Merged at every size: a broadcast list of ids would do only for small inputs.
    texts = stage(_plain(docs).join(active.hint("merge"), ["doc_id", "text_hash"]).groupBy("node").agg(F.min("text").alias("text")), "texts")

    stars = members.filter("id > pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(_verified(_likely(stars, sketches, threshold), texts, threshold), "links")
    labels = components(links)
    labels = components(labels.select("u", "v").union(_across(members, labels, sketches, texts, threshold)))

    heads = classes.select(F.col("node").alias("label"), F.col("doc_id").alias("head"))
    joined = labels.select(F.col("u").alias("node"), F.col("v").alias("label")).join(heads, "label").select("node", "head")
    by_content = stage(
        classes.join(joined, "node", "left").select("content", F.coalesce("head", "doc_id").alias("component_id"),
            F.when(F.col("head").isNull(), F.struct("doc_id", "text_hash")).alias("stays")), "contents")
    return (
        sketched.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("content")).alias("content"))
        .join(by_content, "content", "left")
        .select("doc_id", "text_hash", F.coalesce("component_id", "doc_id").alias("component_id"),
                (F.col("component_id").isNull() | F.coalesce(F.struct("doc_id", "text_hash") == F.col("stays"), F.lit(False))).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id."""
    found = stage(_labelled(docs, threshold), "near-duplicates").filter("doc_id IS NOT NULL")
    # The document is one column beside the keys, so its own columns may have any names.
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("hash"),
        F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keys = [F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")]
    gone = found.filter("NOT kept").select(*keys).distinct()
    left = rows.join(gone.hint("merge"), ["id", "hash"], "left_anti")
    repeated = found.filter("kept").groupBy(*keys).count().filter("count > 1").select("id", "hash")
    if not repeated.isEmpty():
        again = stage(repeated, "repeated")
        once = left.join(again, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
        left = left.join(again, ["id", "hash"], "left_anti").unionByName(once)
    return left.select("row.*")
