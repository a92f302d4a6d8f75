"""Token ids in Arrow files of equal-length sequences with masks.

``write_tokens`` sorts documents by id into shards, encodes every whole text, appends the end
id, and packs the ids of a shard without gaps into sequences of ``length`` ids.  A shard is two
Arrow files with a footer (random access):

* sequences: ``input_ids`` fixed-size list of uint16 (uint32 for a vocabulary of more than 65,536
  ids), ``mask`` fixed-size list of bits (1: an id, 0: the padding behind the shard's last id),
  ``rows_per_batch`` sequences a batch,
* documents: ``doc_id``, ``start`` (in the shard) and ``n_tokens``.

Every batch but the last is full, so id i of a shard is in batch ``i // (length *
rows_per_batch)``; a memory-mapped batch gives its ids without a copy (``TokenShard.ids``).

Nulls: a null text is empty, its document is the end id alone; a null doc_id sorts first.
Repeated rows are documents of their own.  Equal doc_ids are ordered by a hash of the text.  An
empty table gives no files and an empty result.  Further columns are left out.

Memory: one Arrow batch of texts, one batch of sequences, and at most ``MEMO`` encoded words.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .files import attempt_name, opened, shared_folder

END_ID = 1
LENGTH = 2048
ROWS_PER_BATCH = 256
#: Encoded pieces held by a worker, and the longest piece worth holding.
MEMO, MEMO_CHARS = 200_000, 64
MANIFEST = "shard int, sequences string, documents string, n_docs bigint, n_tokens bigint"
_WORD = re.compile("[^ \t\n\r]+")
_SIMPLE = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
#: Fixed value: the vocabulary's pattern, for lower-case texts of these characters.
_PIECE = re.compile("[a-zà-öø-ÿß]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \\t\\n\\r0-9a-zà-öø-ÿß]+")
_BETWEEN = "0"
_TOGETHER = 256


class Encoder:
    """Whole texts to little-endian ids of ``dtype``.

    The vocabulary's pre-tokenizer cuts a text into runs of letters, single digits and runs of
    marks, and the ids of a text are those of its pieces in a row, so pieces are encoded once and
    kept (the first ``MEMO``).  Texts of ASCII and Latin-1 letters are cut here, by the same
    rule; NFC leaves them as they are.  Other texts are cut at blanks only, across which neither
    NFC nor lower-casing looks, and the library cuts the words.

    New runs of letters go to the vocabulary's BPE model together, with a digit between them that
    shows where each ends; all else goes through the whole tokenizer one by one.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        split = pre_tokenizers.WhitespaceSplit()
        self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = split  # the bytes of ASCII letters are the letters
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        (self.between,) = self._ids(_BETWEEN).tolist()

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _letters(self, encoder, pieces: list[str], out: dict[str, bytes]) -> None:
        width = self.dtype.itemsize
        groups = [pieces[at : at + _TOGETHER] for at in range(0, len(pieces), _TOGETHER)]
        texts = [f" {_BETWEEN} ".join(g) for g in groups]
        for group, found in zip(groups, encoder.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, self.dtype)
            data = ids.tobytes()
            edges = (np.flatnonzero(ids == self.between) * width).tolist()
            for piece, a, b in zip(group, [-width, *edges], [*edges, len(data)], strict=True):
                out[piece] = data[a + width : b]

    def _encode(self, pieces: set[str], cut: bool) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        letters = set(filter(str.isalpha, pieces)) if cut else set()
        plain = set(filter(str.isascii, letters))
        self._letters(self.ascii, list(plain), out)
        self._letters(self.latin, list(letters - plain), out)
        for piece in pieces - letters:
            out[piece] = self._ids(piece).tobytes()
        return out

    def _rows(self, rows: list[list[str]], memo: dict[str, bytes], cut: bool) -> list[bytes]:
        new = self._encode(set().union(*rows).difference(memo), cut)
        held = len(memo)
        memo.update(new)
        out = [b"".join(map(memo.__getitem__, pieces)) for pieces in rows]
        for piece in new:
            if held >= MEMO or len(piece) > MEMO_CHARS:
                del memo[piece]
            else:
                held += 1
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        simple = [_SIMPLE.fullmatch(t) is not None and "<|" not in t for t in texts]
        cut = iter(self._rows([_PIECE.findall(t.lower()) for t, s in zip(texts, simple, strict=True) if s], self.pieces, True))
        rest = iter(self._rows([_WORD.findall(t) for t, s in zip(texts, simple, strict=True) if not s], self.words, False))
        return [next(cut) if s else next(rest) for s in simple]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([
        ("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))
    ], metadata={"length": str(length)})


def _batch(ids: np.ndarray, length: int) -> pa.RecordBatch:
    """Sequences of the ids, the last one padded."""
    rows = -(-len(ids) // length)
    values, mask = np.zeros(rows * length, ids.dtype), np.arange(rows * length) < len(ids)
    values[: len(ids)] = ids
    return pa.record_batch([
        pa.FixedSizeListArray.from_arrays(pa.array(values), length),
        pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
    ], schema=_schema(length, ids.dtype))


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID,
    length: int = LENGTH, rows_per_batch: int = ROWS_PER_BATCH, shards: int | None = None,
) -> DataFrame:
    """Write the files and return one row per shard (``MANIFEST``), shards in doc_id order."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    held = spark.sparkContext.broadcast(vocabulary)  # one vocabulary file, a few MB

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, rest, at, count = None, bytearray(), 0, 0
        system = sequences = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                encode = Encoder(held.value)
                end, width = np.asarray([end_id], encode.dtype).tobytes(), encode.dtype.itemsize
                full = length * rows_per_batch * width
                system, root = opened(folder)
                system.create_dir(root, recursive=True)
                name = attempt_name("tokens")
                sinks = [system.open_output_stream(f"{root}/{name}.{kind}.arrow") for kind in ("seq", "doc")]
                sequences = pa.ipc.new_file(sinks[0], _schema(length, encode.dtype))
                index = pa.ipc.new_file(sinks[1], _DOCS)
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids, starts, sizes = part.column("doc_id").to_pylist(), [], []
                for data in encode([t or "" for t in part.column("text").to_pylist()]):
                    rest += data
                    rest += end
                    starts.append(at)
                    sizes.append(len(data) // width + 1)
                    at += sizes[-1]
                    while len(rest) >= full:
                        sequences.write(_batch(np.frombuffer(bytes(rest[:full]), encode.dtype), length))
                        del rest[:full]
                index.write(pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_DOCS))
                count += len(ids)
        if encode is None:
            return
        if rest:
            sequences.write(_batch(np.frombuffer(bytes(rest), encode.dtype), length))
        for writer in (sequences, index):
            writer.close()
        for sink in sinks:
            sink.close()
        yield pa.RecordBatch.from_pylist([{
            "shard": TaskContext.get().partitionId(), "sequences": f"{folder}/{name}.seq.arrow",
            "documents": f"{folder}/{name}.doc.arrow", "n_docs": count, "n_tokens": at,
        }], schema=pa.schema([("shard", pa.int32()), ("sequences", pa.string()), ("documents", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(shards, *keys) if shards else rows.repartitionByRange(*keys)
    return stage(dealt.sortWithinPartitions(*keys).mapInArrow(write, MANIFEST), "token-manifest")


class TokenShard:
    """Random access to the ids of one shard."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.reader = pa.ipc.open_file(system.open_input_file(path))
        self.length = int(self.reader.schema.metadata[b"length"])
        self.batches = self.reader.num_record_batches
        first = self.reader.get_batch(0)
        self.per_batch = first.num_rows * self.length
        self.held = (0, first)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one sequence, as a view, and its mask."""
        batch = self._get(row * self.length // self.per_batch)
        at = row % (self.per_batch // self.length) * self.length
        ids, mask = (batch.column(c).values.slice(at, self.length) for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def _get(self, number: int) -> pa.RecordBatch:
        if self.held[0] != number:
            self.held = (number, self.reader.get_batch(number))
        return self.held[1]

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``start + count``, a view for each batch they touch."""
        while count:
            batch = self._get(start // self.per_batch)
            at = start % self.per_batch
            view = batch.column(0).values.to_numpy()[at : at + count]
            yield view
            start, count = start + len(view), count - len(view)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(row["sequences"])
                system, path = opened(row["documents"])
                index = pa.ipc.open_file(system.open_input_file(path))
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    crcs = []
                    for start, count in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for view in shard.ids(start, count):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = part.column("start").to_numpy() + row["base"]
                    yield pa.record_batch([part.column("doc_id"), pa.array(starts), part.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One small row per shard: the only rows that meet in one task.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    shards = max(1, manifest.count())
    return based.repartition(shards, "shard").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def vocabulary_text(path: str) -> str:
    """The tokenizer file's content, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_digests(docs: DataFrame, vocabulary_path: str, **options) -> DataFrame:
    """Write all documents as token files and describe each from the files."""
    return read_tokens(write_tokens(docs, vocabulary_text(vocabulary_path), **options))


__all__ = ["Encoder", "TokenShard", "read_tokens", "token_digests", "vocabulary_text", "write_tokens"]
