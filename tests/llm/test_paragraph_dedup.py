import glob
import random

import numpy as np
import pyarrow as pa
from tallyspark.llm import paragraph_dedup as pd
from tallyspark.llm.batches import whole_runs
from tallyspark.llm.words import WordHashes
from tallyspark.plans.staging import staging_root

DDL = "doc_id bigint, text string"
RND = random.Random(8)


def sentence(n):
    return " ".join(f"w{RND.randrange(5000)}" for _ in range(n)).capitalize() + "."


def passage(n):
    return " ".join(sentence(RND.randrange(7, 14)) for _ in range(n))


def run(spark, rows, **options):
    return pd.repeated_spans(spark.createDataFrame(rows, DDL), **options).collect()


def test_a_passage_inside_other_paragraphs_is_found_and_the_first_stays(spark):
    shared = passage(7)
    rows = [(i, f"{sentence(20)[:-1]} {shared} {sentence(15)}\n{passage(3)}") for i in range(6)] + [(50 + i, passage(12)) for i in range(20)]
    got = run(spark, rows)
    assert {r.doc_id for r in got} == set(range(6))
    assert {r.doc_id for r in got if r.removed} == set(range(1, 6))
    for r in got:
        text = dict(rows)[r.doc_id][r.start : r.stop]
        assert len(set(text.split()) & set(shared.split())) > 0.75 * len(set(shared.split()))
        assert r.first_doc == 0 and r.n_words >= pd.SPAN


def test_near_paragraphs_are_joined_by_bands_and_verified(spark):
    base = [f"v{i}" for i in range(120)]

    def near(k):
        words = list(base)
        for i in range(k):
            words[7 + 25 * i] = f"z{k}{i}"
        return " ".join(words)

    rows = [(0, near(0)), (1, near(1)), (2, near(2)), (3, " ".join(base[:60] + [f"q{i}" for i in range(60)])), (4, passage(6))]
    units = pd.paragraph_units(spark.createDataFrame(rows, DDL))
    labels = {r.h: r.label for r in pd._near_paragraphs(spark.createDataFrame(rows, DDL), units, 0.8).collect()}
    by_doc = {r.doc_id: r.h for r in units.collect()}
    assert len({labels[by_doc[i]] for i in (0, 1, 2)}) == 1
    assert by_doc[3] not in labels and by_doc[4] not in labels


def test_equal_paragraphs_of_very_short_sentences(spark):
    line = " ".join(f"{w}!!" for w in "AN OLD TALE OF TWO TOWNS AND THE ROAD BETWEEN THEM THAT NOBODY TOOK IN ANY OF THE YEARS SINCE".split())
    got = run(spark, [(1, line), (2, "x\n" + line), (3, passage(4))])
    assert {(r.doc_id, r.removed) for r in got} == {(1, False), (2, True)}


def test_repeats_inside_one_document_and_short_lines_stay(spark):
    line = "All rights are reserved by us."
    twice = passage(5)
    rows = [(i, f"{passage(3)}\n{line}") for i in range(10)] + [(90, f"{twice}\n{twice}")]
    assert run(spark, rows) == []


def test_removal_keeps_everything_else(spark):
    shared = passage(6)
    rows = [(1, f"Head. {shared} Tail words.\n{passage(5)}"), (2, f"Other line.\n{shared}\n{passage(5)} End words."), (3, "Alone."), (4, None), (None, shared)]
    docs = spark.createDataFrame(rows, DDL).selectExpr("doc_id", "text", "1 AS start", "2 AS _extra")
    got = {r.doc_id: r for r in pd.remove_repeats(docs).collect()}
    assert got[1].text == rows[0][1] and got[3].text == "Alone." and got[4].text is None and got[None].text == shared
    assert got[2].text.startswith("Other line.") and got[2].text.endswith("End words.")
    assert len(got[2].text) < len(rows[1][1]) - 0.8 * len(shared)
    assert got[2].start == 1 and got[2]._extra == 2


def test_odd_rows(spark):
    shared = passage(6)
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (None, shared), (4, shared), (4, shared), (5, shared + " " + "w " * 60_000)]
    got = run(spark, rows)
    assert {(r.doc_id, r.removed) for r in got} <= {(4, False), (4, True), (5, True)} and any(r.removed for r in got if r.doc_id == 5)
    assert run(spark, [(1, None)]) == []
    assert pd.repeated_spans(spark.createDataFrame([], DDL)).collect() == []


def test_tiles_link_what_the_pivot_does_not_reach(spark, monkeypatch):
    monkeypatch.setattr(pd, "TILE", 4)
    base = [f"v{i}" for i in range(90)]
    rows = []
    for k in range(24):
        words = list(base)
        for i in range(k):
            words[(i * 4) % 90] = f"y{i}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, DDL)
    units = pd.paragraph_units(docs)
    labels = {r.h: r.label for r in pd._near_paragraphs(docs, units, 0.8).collect()}
    h = {r.doc_id: r.h for r in units.collect()}
    sets = [pd._set(t, pd.WordHashes()) for _, t in rows]
    for a in range(24):
        for b in range(a):
            if pd.jaccard(sets[a], sets[b]) >= 0.8:
                assert labels[h[a]] == labels[h[b]]


def covered(got, rows, shared, words):
    """Documents whose spans hold all words of ``shared``."""
    texts = dict(rows)
    return {r.doc_id for r in got if len(set(pd.words_of(texts[r.doc_id][r.start : r.stop])) & set(pd.words_of(shared))) == words}


def test_every_shared_run_of_20_words_is_found_whatever_its_sentences(spark):
    rnd = random.Random(81)

    def prose(count, low, high, tag):
        out = []
        while count > 0:
            n = min(count, rnd.randint(low, high))
            out.append(" ".join(f"{tag}{rnd.randrange(10**6)}" for _ in range(n)) + ".")
            count -= n
        return " ".join(out)

    rows, passages = [], []
    for k, (n, low, high) in enumerate([(n, *s) for n in (20, 25, 40, 55) for s in ((2, 5), (8, 14), (25, 40), (500, 500))] * 8):
        shared = prose(n, low, high, f"p{k}x")
        passages.append((2 * k, shared, len(set(pd.words_of(shared)))))
        rows += [(2 * k + i, prose(60, low, high, "a")[:-1] + " " + shared[:-1] + " " + prose(60, low, high, "b")) for i in (0, 1)]
    got = run(spark, rows)
    assert [k for k, shared, n in passages if not {k, k + 1} <= covered(got, rows, shared, n)] == []
    assert {r.doc_id for r in got if r.removed} == {k + 1 for k, _, _ in passages}


def test_a_passage_in_lines_of_four_words(spark):
    rnd = random.Random(82)
    words = [f"v{rnd.randrange(10**6)}" for _ in range(80)]
    shared = "\n".join(" ".join(words[i : i + 4]) for i in range(0, 80, 4))
    rows = [(i, f"{passage(3)} intro{i}\n{shared}\nend{i} {passage(3)}") for i in range(4)]
    got = run(spark, rows)
    assert covered(got, rows, shared, len(set(words))) == {0, 1, 2, 3}
    assert [(r.doc_id, r.n_words, r.first_doc) for r in sorted(got, key=lambda r: r.doc_id)] == [(i, 80, 0) for i in range(4)]


def test_an_id_with_several_texts_is_several_documents(spark):
    shared, own, other = passage(6), passage(4), passage(6)
    rows = [(1, f"{shared} {own}"), (2, f"{passage(2)} {shared}"), (2, other), (2, other)]
    docs = spark.createDataFrame(rows, DDL).selectExpr("doc_id", "text", "1 AS node", "2 AS row", "3 AS cuts", "4 AS _id", "5 AS _cuts").repartition(3)
    left = pd.remove_repeats(docs)
    assert left.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in left.collect())
    assert [t for i, t in got if i == 1] == [rows[0][1]]
    assert [t for i, t in got if t == other] == [other, other]
    (cut,) = [t for i, t in got if i == 2 and t != other]
    assert cut and len(cut) <= len(rows[1][1]) - 0.9 * len(shared)


def brute_runs(rows, span=pd.SPAN):
    """Word places (doc_id, place) in a run of ``span`` words that an earlier document has; all shared places."""
    words = {i: [w for line in t.split("\n") for w in pd.words_of(line)] for i, t in rows if t}
    holders = {}
    for i, ws in words.items():
        for at in range(len(ws) - span + 1):
            holders.setdefault(tuple(ws[at : at + span]), set()).add(i)
    late, shared = set(), set()
    for i, ws in words.items():
        for at in range(len(ws) - span + 1):
            held = holders[tuple(ws[at : at + span])]
            if len(held) > 1:
                shared |= {(i, at + k) for k in range(span)}
                if min(held) < i:
                    late |= {(i, at + k) for k in range(span)}
    return late, shared


def places(got, rows, removed):
    texts, out = dict(rows), set()
    for r in got:
        if r.removed in removed:
            before = len(pd._word_places(texts[r.doc_id][: r.start])[0])
            out |= {(r.doc_id, before + k) for k in range(len(pd._word_places(texts[r.doc_id][r.start : r.stop])[0]))}
    return out


def test_mixed_copies_against_all_runs(spark):
    """Whole copies, near copies, cut and glued copies: no shared run of 20 words is missed."""
    rnd = random.Random(83)
    bases = [passage(14).split() for _ in range(5)]
    rows = []
    for i in range(70):
        words = list(rnd.choice(bases))
        kind = i % 5
        if kind == 1:
            for _ in range(rnd.randrange(1, 6)):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
        elif kind == 2:
            cut = rnd.randrange(len(words) - 25)
            words = words[cut : cut + rnd.randrange(18, 60)] + passage(3).split()
        elif kind == 3:
            other = rnd.choice(bases)
            words = words[: rnd.randrange(20, len(words))] + other[rnd.randrange(len(other) - 20) :]
        elif kind == 4:
            words = passage(6).split() + words[rnd.randrange(len(words)) :]
        rows.append((i, " ".join(words)))
    rows += [(100, "w " * 200), (101, "x " + "w " * 90), (102, "w " * 21 + "end")]
    got = run(spark, rows)
    late, shared = brute_runs(rows)
    assert not late - places(got, rows, {True})
    assert not shared - places(got, rows, {True, False})


def test_the_small_table_against_all_runs(spark):
    from conftest import SF_DIR
    from tallyspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_paragraph_minhash"](spark, SF_DIR).collect()
    late, shared = brute_runs(rows)
    assert late and not late - places(got, rows, {True})
    assert not shared - places(got, rows, {True, False})
    # What is removed beyond shared runs are repeated pieces and near paragraphs with their gaps.
    assert len(places(got, rows, {True})) <= 1.35 * len(late)


def test_word_ranges_are_those_of_the_words():
    for text in ("", "a", " one, Two_3!\nÄß é́x 日本語。x", "İstanbul x", "ΑΣ ΑΣ. x\u0307y", "no\x00pe 𝔘𝔫 x"):
        words, ranges = pd._word_places(text)
        assert pd.word_ranges(text).tolist() == [list(r) for r in ranges]
        assert len(pd._all_words(text, pd.WordHashes())) == len(words)


def test_plain_texts_are_read_as_one_by_one():
    rnd = random.Random(11)
    words = ["a", "Bc", "d_1", "é", "漢字", "ÉTÉ", "long", "words", "of", "it"]
    between = [" "] * 12 + [". ", "! ", "?", "...", " . ", "\n", "\n\n", ", ", "。", "\t", " ?! \n", "\r\n"]
    for _ in range(300):
        texts = ["".join(rnd.choice(words) + rnd.choice(between) for _ in range(rnd.randrange(120))) for _ in range(rnd.randrange(1, 5))]
        texts += rnd.sample(["", "\n", "...", ". a b", "x" * 50, ".\n.", " \n . a"], 2)
        rnd.shuffle(texts)
        assert all(map(pd._is_plain, texts))
        memo = WordHashes()
        one_by_one, together = pd._read(texts, memo), pd._read_plain(texts, memo)
        for a, b in zip(one_by_one, together, strict=True):
            assert a.tolist() == b.tolist()


def test_letters_that_move_others_are_read_one_by_one(spark):
    shared = " ".join(f"shared{i}" for i in range(30))
    docs = spark.createDataFrame([
        (1, f"İstanbul one. {shared}"), (2, f"ΟΔΟΣ two. {shared}"), (3, f"plain three. {shared}")], "doc_id bigint, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pd.repeated_spans(docs).collect()
    assert {(r.doc_id, r.removed) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(shared in texts[r.doc_id][r.start : r.stop] for r in got)


def test_the_units_do_not_stay_on_disk(spark):
    shared = passage(6)
    rows = [(i, f"{passage(3)} {shared} {passage(3)}") for i in range(4)]

    def folders(name):
        return set(glob.glob(f"{staging_root(spark).removeprefix('file:')}/tallyspark/{name}-*"))

    before = folders("units"), folders("stretches")
    spans = pd.repeated_spans(spark.createDataFrame(rows, DDL))
    assert folders("units") == before[0] and folders("stretches") > before[1]
    for _ in range(2):  # nothing that is left to do reads them
        assert {(r.doc_id, r.removed) for r in spans.collect()} == {(0, False), (1, True), (2, True), (3, True)}


def test_pieces_lie_in_the_slice_of_their_hash(spark):
    units = pd.paragraph_units(spark.createDataFrame([(i, passage(30)) for i in range(3)], DDL)).collect()
    for kind in ("sentences", "stretches"):
        slices = [[s.h for r in units for s in r[f"{kind}_{i}"]] for i in range(pd.SLICES)]
        assert all(slices) and all(h % pd.SLICES == i for i, mine in enumerate(slices) for h in mine)


def spans_one_by_one(rows, span):
    out, current = [], None
    for doc, fate, start, stop, at, words, origin in rows:
        if current and current[:2] == [doc, fate] and (start <= current[3] + 8 * pd.GAP or at <= current[6] + pd.GAP):
            current[3], current[4] = max(current[3], stop), current[4] + max(0, at + words - max(at, current[6]))
            current[5], current[6] = min(current[5], origin), max(current[6], at + words)
        else:
            out += [current] if current else []
            current = [doc, fate, start, stop, words, origin, at + words]
    return [(d, a, b, n, o, bool(f)) for d, f, a, b, n, o, _ in [*out, current] if n >= span]


def test_units_of_many_documents_are_merged_as_one_by_one():
    rnd = random.Random(84)
    rows = []
    for doc in sorted(rnd.sample(range(-50, 10**6), 60)):
        for fate in (0, 1):
            for _ in range(rnd.randrange(25)):
                at, words = rnd.randrange(400), rnd.randrange(6, 40)
                start = 5 * at + rnd.randrange(40)
                rows.append((doc, fate, start, start + 5 * words + rnd.randrange(30), at, words, rnd.randrange(doc - 5, doc + 1)))
    rows.sort(key=lambda r: (r[0], r[1], r[2], -r[3]))
    names = ["doc_id", "removed", "start", "stop", "at", "words", "first_doc"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for size in (1, 7, 100, len(rows)):
        tables = list(whole_runs((whole.slice(i, size) for i in range(0, len(rows), size)), ["doc_id", "removed"]))
        assert sum(t.num_rows for t in tables) == len(rows)
        got = [tuple(r.values()) for t in tables for r in pd.merged(*(t.column(c).to_numpy() for c in names), pd.SPAN).to_pylist()]
        assert got == spans_one_by_one(rows, pd.SPAN)


def test_sets_hashed_together():
    texts = [passage(k) for k in range(1, 6)] + ["", "a b", "a b c d e", "a b c d"]
    together = pd._sets(texts, WordHashes())
    assert all(np.array_equal(mine, pd._set(text, WordHashes())) for mine, text in zip(together, texts, strict=True))


def test_windows_of_opened_stretches_are_those_of_the_whole_text(spark):
    rnd = random.Random(85)
    texts = {i: passage(14) + "\n" + ("ΣΑΣ ΟΔΟΣ. İx " if i % 4 == 0 else "") + passage(9) for i in range(9)}
    opened, wanted = [], set()
    for i, text in texts.items():
        words, ranges = pd._word_places(text)
        digests = pd._span_digests(WordHashes().of(pd._all_words(text, WordHashes())), len(words) - pd.SPAN + 1).view(np.int64).tolist()
        for h in range(rnd.randrange(1, 7)):
            n = rnd.randrange(pd.SPAN, pd.SPAN + 12)
            at = rnd.randrange(len(words) - n)
            opened.append((i, ranges[at][0], ranges[at + n - 1][1], at, n, h))
            wanted |= {(i, ranges[k][0], ranges[k + pd.SPAN - 1][1], k, pd.SPAN, h, digests[k]) for k in range(at, at + n - pd.SPAN + 1)}
    places = spark.createDataFrame(opened, "doc_id bigint, start int, stop int, at int, words int, h bigint")
    got = pd.opened_windows(spark.createDataFrame(list(texts.items()), DDL), places).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
