"""Vector bin packing of examples into sequences, by the dot-product heuristic.

A sequence has three limits at the same time: tokens, segments (pieces of examples, so that
attention masks stay small) and tokens that bear loss.  Packing is bin-centric: into the open sequence goes,
of all pieces that fit, the one whose normalized demands have the largest dot product with the
room left, each dimension weighed by the pieces' mean demand (Panigrahy et al., "Heuristics for
Vector Bin Packing", 2011).

A task reads its part of the examples in order, encodes them and holds a pool of ``pool``
pieces; when the pool is full, a sequence is packed from it and given out.  So nothing is
shuffled, no example waits for another part, and a task that runs again gives the same rows.
Examples longer than a sequence are cut into whole sequences and a rest.  Where no piece fits and
over ``slack`` tokens are free, the longest piece in the pool is cut to fill them; a sequence
that stays shorter (segments or loss are used up, or the part ends) is cut to a power of two,
which needs no padding, and its last pieces go back to the pool.  ``cut=False`` cuts only
examples that no sequence can hold, and leaves padding instead.

An example's ids are those of ``prompt`` (they bear no loss), of ``text``, and the end id.

Nulls: a null text or prompt is empty; a null doc_id stays null.  Repeated rows are examples of
their own.  An empty table gives an empty result.  Further columns are left out, whatever their
names.

Memory: one Arrow batch of texts, ``pool`` pieces, one example's ids, ``OUT_BYTES`` of results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_files import Encoder, vocabulary_text

END_ID = 2
POOL = 1024
SLACK = 16
OUT_BYTES = 8 << 20
_ROW_BITS = 33
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, loss_tokens bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Demand of a free place in the pool: more than any limit.
_NEVER = 1 << 40


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most; sequences are padded to ``tokens``."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass(slots=True)
class Piece:
    """Ids ``start`` to ``start + length`` of an example whose first ``free`` ids bear no loss."""

    doc_id: int | None
    ids: np.ndarray
    free: int
    start: int
    length: int

    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.free))

    def longest(self, tokens: int, loss: int) -> int:
        """Length of the longest leading piece within both limits."""
        return min(self.length, tokens, max(0, self.free - self.start) + loss)

    def split(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.ids, self.free, self.start, length),
            Piece(self.doc_id, self.ids, self.free, self.start + length, self.length - length),
        )


class Packer:
    """Pieces in, sequences out; holds at most ``pool`` pieces and the parts given back."""

    def __init__(self, limits: Limits, pool: int = POOL, slack: int = SLACK, cut: bool = True):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.slack, self.cut, self.target = limits, slack, cut, pool
        self.held: list[Piece | None] = []
        self.free: list[int] = []
        self.count = 0
        self.tokens = np.zeros(0, np.int64)
        self.loss = np.zeros(0, np.int64)
        self.demands = np.zeros((0, 3))

    def _put(self, piece: Piece) -> None:
        if not self.free:
            n = len(self.held)
            more = max(64, n)
            self.held += [None] * more
            self.free = list(range(n + more - 1, n - 1, -1))
            self.tokens = np.concatenate([self.tokens, np.full(more, _NEVER)])
            self.loss = np.concatenate([self.loss, np.zeros(more, np.int64)])
            self.demands = np.concatenate([self.demands, np.zeros((more, 3))])
        at, loss, limits = self.free.pop(), piece.loss(), self.limits
        self.held[at], self.tokens[at], self.loss[at] = piece, piece.length, loss
        self.demands[at] = piece.length / limits.tokens, 1 / limits.segments, loss / limits.loss
        self.count += 1

    def _take(self, at: int) -> Piece:
        piece, self.held[at], self.tokens[at], self.demands[at] = self.held[at], None, _NEVER, 0
        self.free.append(at)
        self.count -= 1
        return piece

    def add(self, doc_id: int | None, ids: np.ndarray, free: int = 0) -> Iterator[list[Piece]]:
        """Take one example; sequences come out while the pool is full."""
        rest = Piece(doc_id, ids, free, 0, len(ids))
        while rest.length > (fits := rest.longest(self.limits.tokens, self.limits.loss)):
            part, rest = rest.split(fits)
            if fits == self.limits.tokens:
                yield [part]
            else:
                self._put(part)
        self._put(rest)
        while self.count >= self.target:
            yield self._sequence()

    def finish(self) -> Iterator[list[Piece]]:
        while self.count:
            yield self._sequence()

    def _best(self, tokens: int, loss: int, room: np.ndarray) -> int | None:
        """The fitting piece of the largest dot product with the room left."""
        fits = (self.tokens <= tokens) & (self.loss <= loss)
        scores = np.where(fits, self.demands @ room, -1.0)
        at = int(scores.argmax())
        return at if fits[at] else None

    def _sequence(self) -> list[Piece]:
        limits = self.limits
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        mean = self.demands.sum(axis=0) / self.count
        out: list[Piece] = []
        while segments and tokens and self.count:
            room = mean * (tokens / limits.tokens, segments / limits.segments, loss / limits.loss)
            at = self._best(tokens, loss, room)
            if at is None:
                break
            piece = self._take(at)
            out.append(piece)
            tokens, segments, loss = tokens - piece.length, segments - 1, loss - piece.loss()
        if not self.cut or tokens <= self.slack:
            return out
        if segments and self.count:
            at = int(np.where(self.tokens < _NEVER, self.tokens, -1).argmax())
            length = self.held[at].longest(tokens, loss)
            if length == tokens:
                part, rest = self._take(at).split(length)
                self._put(rest)
                return [*out, part]
        return self._trimmed(out, limits.tokens - tokens)

    def _trimmed(self, out: list[Piece], length: int) -> list[Piece]:
        """The first pieces, a power of two in length; the others go back."""
        over = length - (1 << (length.bit_length() - 1))
        while over:
            last = out.pop()
            if last.length > over:
                kept, last = last.split(last.length - over)
                out.append(kept)
            self._put(last)
            over -= last.length
        return out


def pack(
    docs: DataFrame, vocabulary_path: str, limits: Limits = Limits(), prompt: str | None = None,
    end_id: int = END_ID, pool: int = POOL, slack: int = SLACK, cut: bool = True,
) -> DataFrame:
    """``PIECES``: where each piece of each example lies; ``ids`` are little-endian uint32.

    ``prompt`` names the column whose ids bear no loss.  A sequence's id holds the task's number
    in its upper bits.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary_text(vocabulary_path))  # one vocabulary file, a few MB
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"),
        (docs[prompt].cast("string") if prompt else F.lit(None).cast("string")).alias("prompt"),
    )
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << _ROW_BITS, 0
        columns: list[list] = [[] for _ in schema]

        def give(sequence: list[Piece]) -> None:
            nonlocal number, size
            offset = 0
            for p in sequence:
                ids = p.ids[p.start : p.start + p.length].astype("<u4").tobytes()
                row = (p.doc_id, p.start, p.length, ids, p.loss(), len(p.ids), number, offset)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                offset, size = offset + p.length, size + len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            size = 0
            for c in columns:
                c.clear()
            return out

        packer, encode = Packer(limits, pool, slack, cut), None
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                encode = encode or Encoder(held.value)
                prompts = [t or "" for t in part.column("prompt").to_pylist()]
                before = encode(prompts) if any(prompts) else [b""] * len(prompts)
                texts = encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, first, second in zip(part.column("doc_id").to_pylist(), before, texts, strict=True):
                    ids = np.append(np.frombuffer(first + second, encode.dtype), encode.dtype.type(end_id))
                    for sequence in packer.add(doc_id, ids, len(first) // encode.dtype.itemsize):
                        give(sequence)
                        if size >= OUT_BYTES:
                            yield flush()
        for sequence in packer.finish():
            give(sequence)
            if size >= OUT_BYTES:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, PIECES)


def padded_length(length: Column, tokens: int = Limits.tokens) -> Column:
    """Tokens of a sequence with its padding: none at a power of two."""
    return F.when(length.bitwiseAND(length - 1) == 0, length).otherwise(F.lit(tokens))


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its ids, and the lengths of its segments, in order.

    A sequence has at most ``Limits.segments`` pieces, so a group is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "loss_tokens", "ids")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id",
        F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("input_ids"),
        F.col("p.length").alias("segment_lengths"),
        F.col("p.loss_tokens").alias("segment_loss_tokens"),
    )


__all__ = ["Limits", "Packer", "Piece", "pack", "padded_length", "sequences"]
