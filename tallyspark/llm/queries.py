"""The registered queries of this package, with production parameters, and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    dart_minhash, decontamination, embedding_join, html_text, lexical_search, mixing, packing, paragraph_dedup, resampling,
    sharding, token_files, toxicity, zip_archives,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Sharding (6)

SHARDS = 24

_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(x)),
  lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
  lambda a, b: xor(a >> 8, list_extract(t, (xor(a, b) & 255)::BIGINT + 1)))"""
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384::UBIGINT) ELSE {0} >> 1 END"


def _crc_table() -> str:
    """The 256 entries of the reflected CRC-32 polynomial, eight halvings each."""
    inner = "SELECT v AS n, v::UBIGINT AS c FROM range(256) r(v)"
    for _ in range(8):
        inner = f"SELECT n, {_STEP.format('c')} AS c FROM ({inner})"
    return f"SELECT list(c ORDER BY n) AS t FROM ({inner})"


def _winner(shards: int) -> str:
    return f"""(SELECT arg_max(k, s) FROM (SELECT k, ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')
  || '#' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS s FROM range({shards}) r(k)))::INTEGER"""


@query("op6_rendezvous_shards", f"""WITH crc_table AS ({_crc_table()}),
d AS (SELECT doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, strlen(x) + 8 AS size,
  CASE WHEN x = '' THEN 0 ELSE CAST(xor({_CRC}, 4294967295::UBIGINT) AS BIGINT) END AS text_crc32,
  {_winner(SHARDS)} AS shard, {_winner(SHARDS + 1)} AS grown_shard FROM d, crc_table),
o AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || text_crc32 || '|'
  || shard || '|' || grown_shard), 1, 15))::BIGINT AS place FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32, grown_shard) - 1 AS slot FROM o""")
def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


# Mixing (5)

#: Domains of the test corpus' numbered sources; a corpus with a domain column passes that.
DOMAINS = ("web", "books", "forums")
MIX_WEIGHTS: dict[tuple, int] = {
    ("web",): 5, ("books",): 3, ("forums",): 2,
    ("web", "en"): 5, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 1,
    ("books", "en"): 2, ("books", "de"): 3,
    ("web", "en", "src3"): 2, ("web", "de", "src0"): 3,
}
#: Share of all tokens that the mixture of the query has.
MIX_SHARE = 0.75
MIX_EPOCHS = 3


def source_domain(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, r"(\d+)", 1).try_cast("bigint"), F.lit(0))
    picked = F.lit(DOMAINS[0])
    for i, name in enumerate(DOMAINS[1:], 1):
        picked = F.when(number % len(DOMAINS) == i, F.lit(name)).otherwise(picked)
    return picked


def levels(docs: DataFrame) -> dict[str, Column]:
    return {"domain": source_domain(docs["source"]), "lang": docs["lang"], "source": docs["source"]}


def _level_sql(depth: int) -> str:
    """One level of the water-filling over ``nodes``."""
    keys = ", ".join(f"l{i}" for i in range(depth))
    parent = ", ".join(f"l{i}" for i in range(depth - 1)) or "0"
    budget = f"JOIN (SELECT {parent}, granted AS budget FROM g{depth - 1}) USING ({parent})" if depth > 1 else (
        "CROSS JOIN (SELECT least(sum(tokens) * {e}, max(wanted)) AS budget FROM leaves, wanted)".format(e=MIX_EPOCHS))
    return f"""a{depth} AS (SELECT {keys}, concat_ws('/', {keys}) AS path, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS cap
  FROM leaves GROUP BY {keys}),
b{depth} AS (SELECT a{depth}.*, coalesce(w, 1)::HUGEINT AS w, budget FROM a{depth} LEFT JOIN given USING (path) {budget}),
c{depth} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, path
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
  sum(w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, path ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM b{depth}),
d{depth} AS (SELECT *, bool_and(cap * ws <= (budget - bef) * w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, path
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isfull FROM c{depth}),
e{depth} AS (SELECT *, budget - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS rest,
  CASE WHEN isfull THEN 0 ELSE w END AS ow FROM d{depth}),
f{depth} AS (SELECT *, nullif(sum(ow) OVER (PARTITION BY {parent}), 0) AS aw,
  sum(ow) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw FROM e{depth}),
g{depth} AS (SELECT {keys}, CASE WHEN isfull THEN cap ELSE least(coalesce(rest * cw // aw - rest * (cw - ow) // aw, 0), cap) END AS granted FROM f{depth})"""


def _mix_sql() -> str:
    given = ", ".join(f"('{'/'.join(k)}', {w})" for k, w in MIX_WEIGHTS.items())
    domain = "CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % {n} {w} ELSE '{d}' END".format(
        n=len(DOMAINS), d=DOMAINS[0], w=" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(DOMAINS) if i))
    order = "('0x' || substr(md5('0|' || {e} || '|' || k), 1, 15))::BIGINT"
    return f"""WITH t AS (SELECT doc_id, coalesce({domain}, '(none)') AS l0, coalesce(lang, '(none)') AS l1, coalesce(source, '(none)') AS l2,
  lang, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')), 0)::BIGINT AS n_tokens,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k FROM documents),
leaves AS (SELECT l0, l1, l2, sum(n_tokens)::HUGEINT AS tokens FROM t GROUP BY ALL),
wanted AS (SELECT floor(sum(tokens)::DOUBLE * {MIX_SHARE})::HUGEINT AS wanted FROM leaves),
given(path, w) AS (VALUES {given}),
{", ".join(_level_sql(i) for i in (1, 2, 3))},
plan AS (SELECT *, granted // nullif(tokens, 0) AS whole FROM leaves JOIN g3 USING (l0, l1, l2)),
p AS (SELECT t.*, coalesce(whole, 0)::BIGINT AS whole, granted - coalesce(whole, 0) * tokens AS part FROM t JOIN plan USING (l0, l1, l2)),
q AS (SELECT *, {order.format(e="whole")} AS place FROM p),
r AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY place, k GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM q)
SELECT doc_id, l0 AS domain, lang, source, n_tokens, CAST(unnest(range(whole + CASE WHEN bef < part THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM r"""


@query("op5_mix_sources", _mix_sql())
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, levels(docs), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    return mixed.select("doc_id", source_domain(F.col("source")).alias("domain"), "lang", "source", "n_tokens", "epoch")


# Token files (9)


def vocabulary() -> str:
    """Where the public vocabulary of the query lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_arrow_token_files")
def op9_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), vocabulary())


# Web archives (3)


@query("op3_zip_web_archives", """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f""")
def op3_zip_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_archives.archive_digests(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Main text (1)


@query("op1_html_main_text")
def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


# Toxicity (2)

#: The chain's order; the last category decides.
CATEGORIES = ("low_quality", "toxic")


def toxic_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


@query("op2_toxicity_chain")
def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxic_scores(docs.select("doc_id", "text"), toxic_labels(labels), CATEGORIES)
    return scored.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("rejected").alias("toxic"))


# Benchmark decontamination (10)


@query("op10_cgk_decontamination")
def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


# Embedding near-duplicates (7)


@query("op7_epsilon_grid_join", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT vec_id, x FROM e WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND list_dot_product(x, x) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (WITH RECURSIVE reach(u, v) AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u) SELECT * FROM reach),
c AS (SELECT u, min(v) AS least FROM r GROUP BY u), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM e LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id""")
def op7_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link_vectors(table(spark, sf_dir, "embeddings"))


# MinHash near-duplicates (4)


@query("op4_dart_minhash")
def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Substring dedup (8)


@query("op8_paragraph_minhash")
def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Packing (11)


@query("op11_vector_packing")
def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


# Ranked lexical search (12)

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op12_nra_search", f"""WITH w AS (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM d),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest({_terms_sql('text')}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // l))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {lexical_search.RANKS}""")
def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Importance resampling (13)


def _runs_sql(name: str) -> str:
    """Per text of ``name`` (id, words): its features, one row each."""
    return f"""SELECT id, unnest(list_concat(words, list_concat(
  list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
  list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])))) AS feature FROM {name}"""


_RESAMPLE_SQL = f"""WITH crc_table AS ({_crc_table()}),
d AS (SELECT doc_id AS id, coalesce({_terms_sql('text')}, []) AS words FROM documents),
b AS (SELECT item_id AS id, coalesce({_terms_sql('text')}, []) AS words FROM benchmark),
df AS ({_runs_sql('d')}), bf AS ({_runs_sql('b')}),
u AS (SELECT feature, feature AS x, hex(encode(feature)) AS h FROM (SELECT feature FROM df UNION SELECT feature FROM bf)),
k AS (SELECT feature, (xor({_CRC}, 4294967295::UBIGINT) % {resampling.BUCKETS})::BIGINT AS bucket FROM u, crc_table),
n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
  FROM (SELECT 's' AS side, feature FROM df UNION ALL SELECT 't', feature FROM bf) JOIN k USING (feature) GROUP BY bucket),
a AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {resampling.BUCKETS})) / ((s + 1)::DOUBLE * (t_all + {resampling.BUCKETS}))))::BIGINT AS gain FROM n, a),
w AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN k USING (feature) JOIN g USING (bucket) GROUP BY id),
x AS (SELECT d.id AS doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {resampling.SHARE[0]} * count(*) // {resampling.SHARE[1]} FROM r) THEN rank END AS rank
FROM x LEFT JOIN r USING (doc_id)"""


@query("op13_importance_resampling", _RESAMPLE_SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
