import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import packing
from tallyspark.llm.packing import Limits, Packer

PATH = public_tokenizers.path("word_bpe_49k.json")


def run(examples, limits, **options):
    packer = Packer(limits, **options)
    out = []
    for number, (length, free) in enumerate(examples):
        out += packer.add(number, np.arange(length), free)
    return out + list(packer.finish())


def check(examples, limits, out):
    """Each id lies in exactly one piece, and no sequence goes beyond a limit."""
    seen = {}
    for sequence in out:
        assert 0 < sum(p.length for p in sequence) <= limits.tokens
        assert len(sequence) <= limits.segments
        assert sum(p.loss() for p in sequence) <= limits.loss
        for p in sequence:
            seen.setdefault(p.doc_id, []).append((p.start, p.length))
    for number, (length, _) in enumerate(examples):
        at = 0
        for start, n in sorted(seen.pop(number)):
            assert start == at and n > 0
            at += n
        assert at == length
    assert not seen


EXAMPLES = st.lists(st.integers(1, 90).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n - 1))), max_size=60)


@given(EXAMPLES, st.integers(1, 40), st.integers(1, 6), st.integers(1, 40), st.booleans())
@settings(max_examples=200, deadline=None)
def test_limits_hold_and_every_id_is_placed_once(examples, tokens, segments, loss, cut):
    limits = Limits(tokens, segments, loss)
    check(examples, limits, run(examples, limits, pool=8, slack=2, cut=cut))


@given(EXAMPLES)
@settings(max_examples=100, deadline=None)
def test_padding_is_the_slack_at_most(examples):
    limits = Limits(32, 4, 24)
    for sequence in run(examples, limits, pool=8, slack=3):
        length = sum(p.length for p in sequence)
        assert length >= 29 or length & (length - 1) == 0


def test_pieces_go_in_by_the_largest_dot_product():
    """The same sequences as a plain reading of the heuristic, one dimension after another."""
    rng = np.random.default_rng(7)
    limits = Limits(100, 6, 70)
    left = [(int(n), int(n * f)) for n, f in zip(rng.integers(1, 60, 40), rng.random(40), strict=True)]
    got = [[(p.doc_id) for p in s] for s in run(left, limits, pool=1000, cut=False)]
    want, alive = [], dict(enumerate(left))
    caps = (limits.tokens, limits.segments, limits.loss)
    while alive:
        need = {i: (n, 1, n - f) for i, (n, f) in alive.items()}
        mean = [sum(v[d] / caps[d] for v in need.values()) for d in range(3)]
        room, out = list(caps), []
        while True:
            fits = {i: v for i, v in need.items() if i in alive and all(v[d] <= room[d] for d in range(3))}
            if not fits:
                break
            best = max(fits, key=lambda i: (round(sum(mean[d] * room[d] / caps[d] * fits[i][d] / caps[d] for d in range(3)), 12), -i))
            del alive[best]
            out.append(best)
            room = [room[d] - need[best][d] for d in range(3)]
        want.append(out)
    # A free place of the pool is never taken twice here, so ties go to the earlier example in both.
    assert got == want


def test_all_limits_bind_at_once():
    # Long prompts with short answers, and answers alone: loss-bound and token-bound pieces share sequences.
    examples = [(90, 80)] * 20 + [(10, 0)] * 200
    limits = Limits(100, 8, 40)
    out = run(examples, limits, cut=False)
    check(examples, limits, out)
    assert len(out) == 65  # the least: a prompt leaves room for one answer, and four answers use up the loss


def test_limits_must_be_positive():
    with pytest.raises(ValueError, match="positive"):
        Packer(Limits(0, 1, 1))


def test_odd_rows_through_spark(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(1, "Hello, world!", "What?"), (None, "no id", None), (2, None, "only a prompt"), (3, "", ""), (4, "word " * 3000, None),
            (5, "again", None), (5, "again", None), (6, "ÄÖ 日本 <|endoftext|> x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, question string")
    docs = docs.withColumns({c: F.lit("x") for c in ("prompt", "ids", "start", "offset", "sequence_id")})
    limits = Limits(256, 3, 200)
    pieces = packing.pack(docs.coalesce(1), PATH, limits, prompt="question").collect()
    plain = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    want = sorted((i or 0, len(plain(q)), tuple(plain(q) + plain(t) + [2])) for i, t, q in rows)
    docs_of = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        docs_of.setdefault(p.doc_id, []).append(p)
    got = []
    for i, parts in docs_of.items():
        at, ids, loss = 0, [], 0
        for p in sorted(parts, key=lambda p: p.start):
            if p.start == 0 and at:  # the repeated row
                got.append((i or 0, at - loss, tuple(ids)))
                at, ids, loss = 0, [], 0
            if i != 5:
                assert p.start == at
            at, loss = at + p.length, loss + p.loss_tokens
            ids += np.frombuffer(p.ids, "<u4").tolist()
        got.append((i or 0, at - loss, tuple(ids)))
    assert sorted(got) == want
    for sequence in packing.sequences(spark.createDataFrame(pieces, packing.PIECES)).collect():
        mine = sorted((p for p in pieces if p.sequence_id == sequence.sequence_id), key=lambda p: p.offset)
        assert [p.offset for p in mine] == [sum(q.length for q in mine[:n]) for n in range(len(mine))]
        assert bytes(sequence.input_ids) == b"".join(bytes(p.ids) for p in mine)
        assert len(mine) <= 3 and sum(p.loss_tokens for p in mine) <= 200 and sum(p.length for p in mine) <= 256


def test_query_on_the_whole_small_table(spark):
    from conftest import SF_DIR
    from tallyspark.llm.queries import QUERIES

    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = QUERIES["op11_vector_packing"](spark, SF_DIR)
    rows = found.collect()
    for r in rows:
        assert r.doc_tokens == len(texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, texts.values()))
    lengths = found.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    total = lengths.agg(F.sum(packing.padded_length(F.col("n"))).alias("padded"), F.sum("n").alias("n")).first()
    assert total.padded <= 1.002 * total.n


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
