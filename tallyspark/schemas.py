"""Table contracts, as DDL."""

from __future__ import annotations

from .functions.pricing import COST_TYPE
from .functions.usage import USAGE_DDL

CALL_RAW = (
    "call_seq BIGINT, ts STRING, dialect STRING, path STRING, status INT, latency_ms DOUBLE, "
    "request_body STRING, response_body STRING, response_is_sse BOOLEAN, session_header STRING, "
    "injected BOOLEAN, request_sha_before STRING, request_sha_after STRING, truncated BOOLEAN"
)

MUTATION_TYPE = (
    "STRUCT<segments: ARRAY<STRING>, tools_added: ARRAY<STRING>, tools_removed: ARRAY<STRING>, "
    "cost_tok_eq: DOUBLE, cost_basis: STRING>"
)

# Stored ledger.  ``usage`` is the provider's JSON text, ``usage_tokens`` its typed fields.
LEDGER = (
    "call_seq BIGINT, ts STRING, ledger_day DATE, session STRING, dialect STRING, path STRING, "
    "status INT, model STRING, latency_ms DOUBLE, usage STRING, "
    f"usage_tokens STRUCT<{USAGE_DDL}>, "
    "gateway_injected BOOLEAN, prefix_stable_ratio DOUBLE, "
    f"prefix_mutation {MUTATION_TYPE}, cache_miss_unexplained BOOLEAN, cost {COST_TYPE}, "
    "cost_quality STRING, cost_error STRING, request_parse_error STRING, tap_truncated BOOLEAN, "
    "request_sha_before STRING, request_sha_after STRING"
)

# A ledger line as JSON: the day comes from the file, the typed usage from its text.
LEDGER_JSON = (
    LEDGER.replace("ledger_day DATE, ", "").replace(f"usage_tokens STRUCT<{USAGE_DDL}>, ", "")
)

TRACE_JSON = (
    "ts STRING, status INT, model STRING, n_messages INT, roles ARRAY<STRING>, "
    "message_sha256 ARRAY<STRING>, message_bytes ARRAY<BIGINT>, prefix_stable_ratio DOUBLE, "
    "usage STRING"
)
TRACE = f"session STRING, call_seq BIGINT, {TRACE_JSON}"

PRICE_SHEET = (
    "price_date STRING, accountant_model STRING, input_per_1m DOUBLE, cached_input_per_1m DOUBLE, "
    "output_per_1m DOUBLE, cache_creation_per_1m DOUBLE, notes STRING"
)
CACHE_SCHEMA = "accountant_model STRING, category STRING, surfaces BOOLEAN, path ARRAY<STRING>"
PROFILES = "dialect STRING, name STRING, accountant_model STRING, price_date STRING"

OUTCOMES = "task STRING, arm STRING, rep INT, resolved BOOLEAN, session STRING, line_no BIGINT"
PLAN = "task STRING, arm STRING, rep INT, `order` INT, run_id STRING"
SKILLS = (
    "name STRING, description STRING, signature ARRAY<STRING>, steps_replaced INT, body STRING, "
    "preconditions ARRAY<STRING>, source STRING, file_order STRING"
)
COMMAND_SETS = "task_id STRING, kind_key STRING, cmd STRING, kind STRING, credible BOOLEAN"
TRIALS = (
    "task_id STRING, patch_id STRING, patch STRING, trial INT, passed BOOLEAN, detail STRING"
)
MESSAGES = (
    "conv_id BIGINT, pos INT, role STRING, blocks ARRAY<STRUCT<type: STRING, text: STRING>>, "
    "content_is_string BOOLEAN"
)
