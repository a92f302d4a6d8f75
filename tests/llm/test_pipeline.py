import corpus_pipeline
from conftest import SF_DIR
from tallyspark.llm import dart_minhash, decontamination
from tallyspark.llm.queries import table
from tallyspark.llm.words import words_of
from tallyspark.plans.staging import stage


def test_stages_in_order_and_their_decisions(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = step(spark, docs, SF_DIR)
        if name != "token_files":
            assert docs.columns == columns
            docs = stage(docs, name)
        seen[f"{name}-out"] = docs
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    toxic = {r.doc_id for r in table(spark, SF_DIR, "labels").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, SF_DIR, "labels").filter("toxic = 0").collect()}
    assert len(toxic & ids["toxicity-out"]) <= 0.1 * len(toxic) and len(clean - ids["toxicity-out"]) <= 0.02 * len(clean)
    kept = {r.doc_id for r in dart_minhash.near_duplicates(seen["near_dedup"]).filter("kept").collect()}
    assert kept == ids["near_dedup-out"]
    found = decontamination.find_leaks(seen["decontamination"], table(spark, SF_DIR, "benchmark")).collect()
    assert {r.doc_id for r in found if not r.leaks} == ids["decontamination-out"]
    assert ids["mixing-out"] <= ids["mixing"] and ids["token_files-out"] == ids["mixing-out"]
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(seen["mixing-out"]) / words(seen["mixing"]) - 1) < 0.6
    assert words_of(None) == []
    whole = corpus_pipeline.run(spark, SF_DIR)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_crc32").collect()))
    assert key(whole) == key(docs)


def test_an_empty_corpus_passes_through(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF_DIR, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
