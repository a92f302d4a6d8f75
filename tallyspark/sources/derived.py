"""Reference-shaped inputs derived from the driver's Parquet tables.

None of those tables is a call log, so the rules here (integers and plain text only) build
one.  They exist to exercise the operators on data that grows with the tables; the meaning of
the numbers is invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import CALL_RAW
from .dimensions import builtin_cache_schemas, builtin_prices, profiles

SHIPPED_PROFILES = [
    ("openai", "first", "openai/gpt-5-5", "2026-07-15"),
    ("anthropic", "second", "anthropic/claude-cache", "2026-07-15"),
    ("local", "unpriced", None, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a source table that one task turns into wide call bodies.
ROWS_PER_TASK = 250_000


def spread(rows: DataFrame) -> DataFrame:
    """A source table over all cores, and over more tasks the longer it is.

    The tables are one file each, often one row group, so a scan alone is one task; narrow rows are
    dealt out before the bodies are built from them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, 1 + rows.count() // ROWS_PER_TASK))


def dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, prices and cache schemas used by every derived ledger."""
    return profiles(spark, SHIPPED_PROFILES), builtin_prices(spark), builtin_cache_schemas(spark)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _json(**fields: Column) -> Column:
    parts: list[Column] = []
    for name, value in fields.items():
        parts += [F.lit(("{" if not parts else ",") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``call_raw`` with one call per event; the session id is the user.

    The event type sets the wire form: click and view are first-dialect JSON and stream,
    purchase and signup second-dialect JSON and stream, error is a failed call without a
    body (odd k) or an unpriced backend (even k).
    """
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")).withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("bigint"),
            "p": F.floor(F.col("value") * 100).cast("bigint"),
        }
    )
    k, p, kind = F.col("k"), F.col("p"), F.col("event_type")
    cached = F.expr("p * k div 100")
    created = F.least(F.expr("p * (k % 7) div 100"), p - cached)
    e = e.withColumns({"cached": cached, "created": created})
    s = lambda c: F.col(c).cast("string")
    shown = k % 10 != 0

    first = _json(
        prompt_tokens=s("p"), completion_tokens=s("k"),
        prompt_tokens_details=_json(cached_tokens=s("cached")),
        completion_tokens_details=_json(reasoning_tokens=F.expr("cast(k div 2 as string)")),
    )
    reads = F.when(
        shown,
        F.concat(F.lit(',"cache_read_input_tokens":'), s("cached"),
                 F.lit(',"cache_creation_input_tokens":'), s("created")),
    ).otherwise(F.lit(""))
    fresh = F.when(shown, p - F.col("cached") - F.col("created")).otherwise(p).cast("string")
    second_in = F.concat(F.lit('{"input_tokens":'), fresh, reads)
    second = F.concat(second_in, F.lit(',"output_tokens":'), s("k"), F.lit("}"))
    model = _quoted(F.concat(F.lit("m"), (k % 4).cast("string")))
    data = lambda c: F.concat(F.lit("data: "), c, F.lit("\n\n"))
    end = F.lit("data: [DONE]\n\n")

    body = (
        F.when(kind == "click", _json(model=model, usage=first))
        .when(kind == "view", F.concat(
            data(_json(model=model, choices=F.lit("[]"))), F.lit("data: not json\n\n"),
            data(_json(model=model, usage=first)), data(_json(usage=F.lit("{}"))), end))
        .when(kind == "purchase", _json(model=model, usage=second))
        .when(kind == "signup", F.concat(
            data(_json(type=F.lit('"message_start"'),
                       message=_json(model=model, usage=F.concat(second_in, F.lit("}"))))),
            data(_json(type=F.lit('"message_delta"'), usage=_json(output_tokens=s("k")))), end))
        .when(k % 2 == 0, _json(model=model, usage=first))
    )
    tools = F.when(
        k % 5 == 0, F.lit('[{"function":{"name":"read"}},{"function":{"name":"grep"}}]')
    ).otherwise(F.lit('[{"function":{"name":"read"}}]'))
    system = F.when(k % 3 == 0, F.lit('"careful"')).otherwise(F.lit("null"))
    messages = F.concat(
        F.lit('[{"role":"system","content":"S'), (F.col("user_id") % 7).cast("string"),
        F.lit('"},{"role":"user","content":"'), F.repeat(F.lit("ab"), (k % 4).cast("int")),
        F.lit("x"), s("k"), F.lit('"}]'),
    )
    request = F.when(k % 11 == 0, F.lit('{"model": broken')).otherwise(
        _json(model=model, messages=messages, tools=tools, system=system)
    )
    return e.select(
        F.col("event_id").alias("call_seq"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00")).alias("ts"),
        F.when(kind.isin("click", "view"), F.lit("openai"))
        .when(kind.isin("purchase", "signup"), F.lit("anthropic"))
        .otherwise(F.lit("local")).alias("dialect"),
        F.when(kind.isin("purchase", "signup"), F.lit("/v1/messages"))
        .when(kind == "error", F.lit("/v1/other"))
        .otherwise(F.lit("/v1/chat/completions")).alias("path"),
        F.when(kind == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
        (F.col("k") * 2).cast("double").alias("latency_ms"),
        request.alias("request_body"),
        body.alias("response_body"),
        kind.isin("view", "signup").alias("response_is_sse"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_header"),
        (k % 6 == 0).alias("injected"),
        F.lit(None).cast("string").alias("request_sha_before"),
        F.lit(None).cast("string").alias("request_sha_after"),
        ((kind == "error") & (k % 2 == 1)).alias("truncated"),
    ).to(StructType.fromDDL(CALL_RAW))


def conversation_calls(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """``call_raw`` with one call per turn: the request holds the turns up to it.

    Turn ``t`` of conversation ``c`` has ``call_seq = t * 2**32 + c``, so conversations
    interleave.  Every third conversation rewrites its first message from turn 4 on.  Without
    ``named`` the calls carry no session id.
    """
    c = table(spark, sf_dir, "conversations")
    history = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    calls = history.select("conv_id", "turns", F.explode(F.col("turns")["turn"]).alias("t"))
    kept = F.filter("turns", lambda m: m["turn"] <= F.col("t"))
    rewritten = (F.col("conv_id") % 3 == 0) & (F.col("t") >= 4)
    message = lambda m, i: F.struct(
        m["role"].alias("role"),
        F.when(rewritten & (i == 0), F.concat(m["text"], F.lit(" (edited)"))).otherwise(m["text"])
        .alias("content"),
    )
    texts = F.transform(kept, message)
    usage = _json(
        prompt_tokens=F.aggregate(
            kept, F.lit(0).cast("bigint"), lambda a, m: a + F.floor(F.length(m["text"]) / 4)
        ).cast("string"),
        completion_tokens=F.lit("1"),
    )
    return calls.select(
        (F.col("t") * F.lit(1 << 32) + F.col("conv_id")).alias("call_seq"),
        F.concat(F.lit("2024-02-0"), (F.col("t") + 1).cast("string"), F.lit("T00:00:00.000+00:00"))
        .alias("ts"),
        F.lit("openai").alias("dialect"),
        F.lit("/v1/chat/completions").alias("path"),
        F.lit(200).alias("status"),
        F.lit(1.0).alias("latency_ms"),
        F.to_json(F.struct(F.lit("m").alias("model"), texts.alias("messages"))).alias("request_body"),
        _json(model=F.lit('"m"'), usage=usage).alias("response_body"),
        F.lit(False).alias("response_is_sse"),
        (F.concat(F.lit("c"), F.col("conv_id").cast("string")) if named
         else F.lit(None).cast("string")).alias("session_header"),
        F.lit(False).alias("injected"),
        F.lit(None).cast("string").alias("request_sha_before"),
        F.lit(None).cast("string").alias("request_sha_after"),
        F.lit(False).alias("truncated"),
    ).to(StructType.fromDDL(CALL_RAW))


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows: conversations, with the documents of the same number as tool output.

    Document ``d`` becomes position ``100 + d // n`` of conversation ``d % n`` over the
    ``n = 50`` first numbers; even documents are a list of two text blocks.
    """
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("int").alias("pos"), "role",
        F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("blocks"),
        F.lit(True).alias("content_is_string"),
    )
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    d = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 50).alias("conv_id"),
        F.expr("cast(100 + doc_id div 50 as int)").alias("pos"),
        F.lit("tool").alias("role"),
        F.when(F.col("doc_id") % 2 == 0, F.array(block(F.col("text")), block(F.col("lang"))))
        .otherwise(F.array(block(F.col("text")))).alias("blocks"),
        (F.col("doc_id") % 2 == 1).alias("content_is_string"),
    )
    return c.unionByName(d)


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes from order lines; equal (order, arm) lines exercise the last-wins rule."""
    arm = F.element_at(
        F.array(*[F.lit(a) for a in ("control", "candidate", "aa_sham", "raw_trajectory")]),
        (F.col("l_linenumber") % 4 + 1).cast("int"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("task"),
        arm.alias("arm"),
        F.lit(0).alias("rep"),
        (F.col("l_returnflag") != "R").alias("resolved"),
        # Each arm of a task ran in a session of its own.
        F.concat(F.lit("u"), ((F.col("l_orderkey") + F.col("l_linenumber") % 4) % 150).cast("string")).alias("session"),
        (F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * F.lit(10**12)
         + F.round(F.col("l_extendedprice") * 100).cast("bigint") * 1000
         + F.col("l_quantity").cast("bigint") * 10 + F.col("l_linenumber")).alias("line_no"),
    )


def action_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"),
        F.col("event_id").alias("action_seq"),
        F.col("event_type").alias("action"),
    )


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance trials: the labelled documents of a source are trials of one patch per
    language, passed when the quality label is 1."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("source").alias("task_id"), F.col("lang").alias("patch_id"),
        F.when(F.col("lang") == "de", F.lit("  \n")).otherwise(F.lit("diff")).alias("patch"),
        F.col("doc_id").cast("int").alias("trial"),
        (F.col("quality") == 1).alias("passed"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("detail"),
    )
