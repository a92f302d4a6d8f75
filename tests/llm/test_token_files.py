import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(token_files.vocabulary_text(PATH))


def plain(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'.,sStTàÀßΣ0")), max_size=60), max_size=4))
@settings(max_examples=150, deadline=None)
def test_words_in_a_row_equal_the_whole_text(tokenizer, encoder, texts):
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder(texts)]
    assert got == [plain(tokenizer, t) for t in texts]


def test_special_strings_and_odd_blanks(tokenizer, encoder):
    texts = ["a <|endoftext|> b", "x\x1cy\x0bz w　v", "ΑΣ ΑΣ. İ", "w" * 3000, "0 1 0", "", "don't 'Tis"]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder(texts)] == [plain(tokenizer, t) for t in texts]


def test_round_trip(spark, tokenizer):
    rows = [(5, "Hello, world!"), (None, "no id"), (2, None), (9, ""), (7, "word " * 9000), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(1))
    manifest = token_files.write_tokens(docs, token_files.vocabulary_text(PATH), length=64, rows_per_batch=4, shards=3)
    got = token_files.read_tokens(manifest).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = sorted((i is not None, i or 0, len(plain(tokenizer, t or "")) + 1, crc(plain(tokenizer, t or "") + [1])) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))

    for row in manifest.collect():
        shard = token_files.TokenShard(row.sequences)
        sequence, mask = shard.sequence(0)
        assert len(sequence) == len(mask) == 64
        total = sum(int(shard.sequence(i)[1].sum()) for i in range(-(-row.n_tokens // 64)))
        assert total == row.n_tokens
        (view,) = shard.ids(0, 3)
        assert not view.flags.owndata


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_files.token_digests(docs, PATH).collect() == []
