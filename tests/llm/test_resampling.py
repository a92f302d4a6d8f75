import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import resampling, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    found = WORD.findall((text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" aBzZ09[`{\n")), max_size=80), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_blocks_give_every_run_once(text, block):
    held = words.BLOCK
    words.BLOCK = block
    try:
        parts = list(resampling.feature_hashes(text.encode()))
    finally:
        words.BLOCK = held
    n, found = features(text)
    assert sum(p[0] for p in parts) == n
    assert sorted(h for p in parts for h in p[1].tolist()) == sorted(crc32(f.encode()) for f in found)


def plain_resample(docs, targets, num, den, least, buckets):
    count = lambda texts: Counter(crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(targets)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {}
    for rank, r in enumerate(able[: len(able) * num // den], 1):
        ranks.setdefault(r, []).append(rank)
    out = [(r[0], r[2], r[3], r[4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows]
    return sorted(out, key=repr)


def rows(found):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=repr)


TEXTS = ["the cat sat on the mat", "Benchmark QUESTION about cats", "short", "", None, "日本 Äß 9 [x] y", "a b c d e f g " * 40]


def test_odd_rows_equal_brute_force(spark):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(7, "the cat sat on the mat")] * 5 + [(None, "no id but a cat")] * 2
    targets = ["benchmark question", None, "the cat", ""]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).withColumns({c: F.lit(1) for c in ("score", "rank", "weight")})
    b = spark.createDataFrame([(t,) for t in targets], "text string")
    for share, accuracy in (((1, 3), 2000), ((1, 3), 3), ((1, 1), 100), ((1, 50), 100)):
        got = rows(resampling.resample(d, b, share, 2, 50, accuracy=accuracy))
        assert got == plain_resample(docs, targets, *share, 2, 50)
    drawn = resampling.drawn_documents(d, b, (1, 3), 2, 50)
    want = Counter((i, f, w, s) for i, f, w, s, r in plain_resample(docs, targets, 1, 3, 2, 50) if r)
    assert drawn.columns == d.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({k: n for k, n in _by_id(want).items()})


def _by_id(counts):
    out = Counter()
    for key, n in counts.items():
        out[key[0]] += n
    return out


def test_equal_scores_over_the_cutoff(spark):
    scored = spark.createDataFrame([(i, 0, 20, 1, 5, 100 if i < 900 else 200) for i in range(1000)], resampling.SCORES)
    drawn, least, most, above = resampling.bracket(scored, (1, 2))
    assert drawn == 500 and least <= 100 <= most and above < 500
    assert resampling.cutoff(scored, (1, 2), 20).doc_id == 399
    assert resampling.cutoff(scored, (1, 2000), 20) is None


def test_a_bracket_beside_the_rank_is_widened(spark, monkeypatch):
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("text_hash"), F.lit(30).cast("bigint").alias("n_words"),
                                      F.lit(1).cast("bigint").alias("n_features"), F.lit(0).cast("bigint").alias("weight"), (F.col("id") * 7 % 5003).alias("score"))
    plain = F.percentile_approx
    calls = []

    def off(column, at, accuracy):  # a sketch that is wrong by a tenth of all rows
        calls.append(at)
        return plain(column, [max(0.0, a - 0.1) for a in at], accuracy)

    want = sorted((r.score for r in scored.collect()), reverse=True)[249]
    monkeypatch.setattr(resampling.F, "percentile_approx", off)
    assert resampling.cutoff(scored, (5, 100), 20).score == want
    assert len(calls) > 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).collect() == []
    assert rows(resampling.resample(docs, none)) == plain_resample([(1, "a b"), (2, None)], [], 5, 100, 20, 10_000)
    assert resampling.drawn_documents(docs, none).collect() == []
