"""SQL building blocks of the comparison queries."""

from __future__ import annotations


def dbl(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def rounded(column: str, digits: int) -> str:
    """``column`` (a DOUBLE column name) rounded the way Python rounds binary doubles."""
    s, x = dbl(float(10**digits)), column
    p = f"({x}*{s})"
    head = f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    err = f"(({head}*{s}-{p})+({x}-{head})*{s})"
    near = f"round_even({p},0)"
    return (
        f"(CASE WHEN abs({p}-{near})=0.5 AND {err}<>0 THEN {p}+0.5*sign({err}) ELSE {near} END/{s})"
    )


# Calls derived from events, in plain integers (the rules of ``sources.derived.event_calls``).
CALLS = """
e0 AS (SELECT event_id AS seq, ts, user_id, event_type AS kind,
              CAST(floor(value * 100) AS BIGINT) AS p, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
e1 AS (SELECT *, p * k // 100 AS hit FROM e0),
e2 AS (SELECT *, least(p * (k % 7) // 100, p - hit) AS made FROM e1),
c AS (SELECT seq, ts, 'u' || user_id AS session, CAST(ts AS DATE) AS day, user_id, kind, p, k,
             CASE WHEN kind IN ('click', 'view') THEN 'openai'
                  WHEN kind IN ('purchase', 'signup') THEN 'anthropic' ELSE 'local' END AS dialect,
             NOT (kind = 'error' AND k % 2 = 1) AS used,
             k % 11 <> 0 AS parsed,
             kind IN ('purchase', 'signup') AS second,
             kind IN ('click', 'view') AS first,
             k % 10 <> 0 AS shown, hit, made,
             CASE WHEN kind IN ('purchase', 'signup') AND k % 10 <> 0 THEN hit ELSE 0 END AS cached,
             CASE WHEN kind IN ('purchase', 'signup')
                  THEN CASE WHEN k % 10 <> 0 THEN made ELSE 0 END END AS created,
             CASE WHEN NOT (kind = 'error' AND k % 2 = 1) OR k % 11 <> 0
                  THEN 'm' || (k % 4) END AS model
      FROM e2),
priced AS (SELECT *, first OR second AS has_cost,
                  p - cached - coalesce(created, 0) AS uncached,
                  CASE WHEN second THEN (p - cached - coalesce(created, 0)) * 300 + cached * 30
                                        + coalesce(created, 0) * 375 + k * 1500
                       WHEN first THEN p * 125 + k * 1000 END AS usd8,
                  CASE WHEN first OR second THEN
                    CAST(1.0 AS DOUBLE) * CAST(greatest(p - cached - coalesce(created, 0), 0) AS DOUBLE)
                    + CAST(0.1 AS DOUBLE) * CAST(cached AS DOUBLE)
                    + CAST(1.25 AS DOUBLE) * CAST(coalesce(created, 0) AS DOUBLE)
                    + CAST(5.0 AS DOUBLE) * CAST(k AS DOUBLE) END AS step_raw
           FROM c),
step AS (SELECT *, {step} AS step_cost FROM priced)
""".replace("{step}", rounded("step_raw", 1))

# Prefix links of those calls: the previous call, and the last prompt size seen before.
LINKS = """
segs AS (SELECT *,
   CASE WHEN parsed THEN CASE WHEN k % 5 = 0 THEN 'rg' ELSE 'r' END END AS tools,
   CASE WHEN parsed AND k % 3 = 0 THEN 'careful' END AS sys,
   CASE WHEN parsed THEN 'm' || (k % 4) END AS req_model,
   CASE WHEN parsed THEN '[{"content":"S' || (user_id % 7) || '","role":"system"},{"content":"'
        || repeat('ab', CAST(k % 4 AS INTEGER)) || 'x' || k || '","role":"user"}]' END AS canon,
   CASE WHEN used AND NOT second AND p <> 0 THEN p END AS seen_prompt FROM step),
w AS (SELECT *,
   row_number() OVER s AS n, lag(tools) OVER s AS p_tools, lag(sys) OVER s AS p_sys,
   lag(req_model) OVER s AS p_model,
   last_value(seen_prompt IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_prompt,
   last_value(canon IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_canon
   FROM segs WINDOW s AS (PARTITION BY session ORDER BY seq)),
m AS (SELECT *,
   n > 1 AND tools IS DISTINCT FROM p_tools AS d_tools,
   n > 1 AND sys IS DISTINCT FROM p_sys AS d_sys,
   n > 1 AND req_model IS DISTINCT FROM p_model AS d_model,
   CAST(1.15 AS DOUBLE) * CAST(p_prompt AS DOUBLE) AS mut_raw,
   length(p_canon) - 1 AS base_len,
   CASE WHEN canon IS NOT NULL AND p_canon IS NOT NULL THEN
     len(list_filter(range(1, least(length(p_canon) - 1, length(canon)) + 1),
         lambda i: substr(p_canon, 1, i) = substr(canon, 1, i))) END AS lcp
   FROM w),
linked AS (SELECT *, d_tools OR d_sys OR d_model AS mutated, {mut} AS mut_cost,
   CAST(lcp AS DOUBLE) / CAST(base_len AS DOUBLE) AS ratio FROM m)
""".replace("{mut}", rounded("mut_raw", 1))

# Per-session accounting on top of both, keyed by {key}.
REPORT = """
series AS (SELECT {key}, seq, p, row_number() OVER s - 1 AS i, lag(p) OVER s AS before,
             count(*) OVER (PARTITION BY {key}) AS n
           FROM linked WHERE used AND p <> 0 WINDOW s AS (PARTITION BY {key} ORDER BY seq)),
growth AS (SELECT {key}, max(n) AS n,
             CAST(coalesce(sum(greatest(p - before, 0) * (n - 1 - i)), 0) AS DOUBLE) AS carried
           FROM series GROUP BY {key}),
sums AS (SELECT {key}, count(*) AS calls,
    CAST(sum(CASE WHEN used THEN p ELSE 0 END) AS BIGINT) AS prompt_tokens,
    CAST(sum(CASE WHEN used THEN k ELSE 0 END) AS BIGINT) AS completion_tokens,
    CAST(sum(CASE WHEN second THEN cached ELSE 0 END) AS BIGINT) AS known_cached,
    count(*) FILTER (second) AS cache_known_calls,
    CAST(sum(CASE WHEN second THEN p ELSE 0 END) AS BIGINT) AS cache_known_prompt,
    count(*) FILTER (first) AS cache_unavailable_calls,
    CAST(sum(coalesce(usd8, 0)) AS DOUBLE) / 1e8 AS usd_raw,
    count(*) FILTER (second AND shown) AS quality_exact,
    count(*) FILTER (first OR (second AND NOT shown)) AS quality_estimated,
    count(*) FILTER (NOT has_cost) AS quality_unavailable,
    count(*) FILTER (mutated) AS prefix_mutations,
    CAST(sum(CASE WHEN mutated AND mut_cost IS NOT NULL
                  THEN CAST(round(mut_cost * 10) AS BIGINT) ELSE 0 END) AS DOUBLE) / 10.0
      AS prefix_mutation_cost_tok_eq,
    count(*) FILTER (d_tools) AS cause_tools, count(*) FILTER (d_sys) AS cause_system,
    count(*) FILTER (d_model) AS cause_model,
    count(*) FILTER (NOT mutated AND second AND shown AND cached = 0) AS cache_miss_unexplained,
    count(*) FILTER (k % 6 = 0) AS injected,
    CAST(sum(CAST(round_even(ratio * 1e12, 0) AS BIGINT)) AS DOUBLE) / 1e12
      / nullif(CAST(count(ratio) AS DOUBLE), 0) AS ratio_raw,
    coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models,
    CAST(sum(CAST(round(step_cost * 10) AS BIGINT)) AS DOUBLE) / 10.0
      / nullif(CAST(count(step_cost) AS DOUBLE), 0) AS step_mean_raw
  FROM linked GROUP BY {key}),
r1 AS (SELECT sums.*, coalesce(growth.n, 0) AS n, growth.carried,
          CASE WHEN cache_known_calls > 0
               THEN CAST(known_cached AS DOUBLE) / nullif(CAST(cache_known_prompt AS DOUBLE), 0) END AS frac_raw,
          {mean} AS mean_step
       FROM sums LEFT JOIN growth USING ({key})),
r2 AS (SELECT *, mean_step + CAST(0.1 AS DOUBLE) * carried / CAST(greatest(n - 1, 1) AS DOUBLE) AS save_raw
       FROM r1),
report AS (SELECT {key}, calls, prompt_tokens, completion_tokens,
    CASE WHEN cache_known_calls > 0 THEN known_cached END AS cached_tokens,
    {frac} AS cached_fraction, cache_known_calls, cache_known_prompt, cache_unavailable_calls,
    {usd} AS cost_usd, quality_exact, quality_estimated, quality_unavailable, prefix_mutations,
    prefix_mutation_cost_tok_eq, cause_tools, cause_system, cause_model, cache_miss_unexplained,
    injected, {ratio} AS mean_prefix_stable_ratio, models, mean_step AS mean_step_cost_tok_eq,
    CASE WHEN n > 1 AND mean_step IS NOT NULL THEN {save} ELSE mean_step END AS mean_step_saving_tok_eq
  FROM r2)
"""


def report_ctes(key: str) -> str:
    text = REPORT
    for name, column, digits in (
        ("mean", "step_mean_raw", 1), ("frac", "frac_raw", 4), ("usd", "usd_raw", 6),
        ("ratio", "ratio_raw", 4), ("save", "save_raw", 1),
    ):
        text = text.replace("{" + name + "}", rounded(column, digits))
    return f"WITH {CALLS}, {LINKS}, {text.replace('{key}', key)}"


# Conversation calls as message lists: one row per call with its canonical texts.
TURNS = """
t AS (SELECT conv_id, turn, role, text FROM conversations),
msgs AS (SELECT a.conv_id, a.turn AS t, b.turn AS pos, b.role,
    CASE WHEN a.conv_id % 3 = 0 AND a.turn >= 4 AND b.turn = 0 THEN b.text || ' (edited)' ELSE b.text END AS text
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <= a.turn),
cmsgs AS (SELECT *, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}' AS canon FROM msgs),
ccalls AS (SELECT conv_id, t, t * 4294967296 + conv_id AS seq, count(*) AS n_messages,
    string_agg(role, ',' ORDER BY pos) AS roles,
    string_agg(substr(sha256(canon), 1, 16), ',' ORDER BY pos) AS hashes,
    string_agg(CAST(strlen(canon) AS VARCHAR), ',' ORDER BY pos) AS bytes,
    '[' || string_agg(canon, ',' ORDER BY pos) || ']' AS canon
    FROM cmsgs GROUP BY conv_id, t)
"""
