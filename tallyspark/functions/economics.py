"""What carrying a skill costs and when it can pay, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import py_round

# Cache multipliers, published paired rates, session horizon.
CACHE_WRITE_MULTIPLIER = 1.25
CACHE_READ_MULTIPLIER = 0.10
DEFAULT_HELP_RATE = 0.135
DEFAULT_HARM_RATE = 0.084
DEFAULT_HARM_STEPS = 3.0
DEFAULT_REMAINING_TURNS = 40

# Gates.
GATES = {
    "max_body_tokens": 500,
    "max_presented_per_task": 3,
    "max_active_skills": 50,
    "min_steps_replaced": 1,
}


def estimate_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def hold_cost(body_tokens: Column, remaining_turns: int = DEFAULT_REMAINING_TURNS) -> Column:
    """Written once, re-read on every later turn."""
    size = body_tokens.cast("double")
    return py_round(
        F.lit(CACHE_WRITE_MULTIPLIER) * size
        + F.lit(CACHE_READ_MULTIPLIER) * size * F.lit(float(remaining_turns)),
        1,
    )


def break_even_steps(body_tokens: Column, step_cost: Column,
                     remaining_turns: int = DEFAULT_REMAINING_TURNS,
                     help_rate: float = DEFAULT_HELP_RATE,
                     harm_rate: float = DEFAULT_HARM_RATE,
                     harm_steps: float = DEFAULT_HARM_STEPS) -> Column:
    """Steps to save when the skill helps; NULL when a step has no (or a zero) price."""
    if not help_rate:
        return F.lit(None).cast("double")
    held = hold_cost(body_tokens, remaining_turns) / F.nullif(step_cost, F.lit(0.0))
    return py_round((held + F.lit(harm_rate * harm_steps)) / F.lit(help_rate), 2)


def net_steps_saved(steps_replaced: Column) -> Column:
    """Invoking the skill is a step itself."""
    return F.greatest(steps_replaced - 1, F.lit(0))


def skill_verdict(break_even: Column, saved: Column) -> Column:
    return (
        F.when(break_even.isNull(), F.lit("UNPRICED"))
        .when(saved >= break_even, F.lit("PAYS"))
        .otherwise(F.lit("CANNOT_PAY"))
    )


def gate_failures(body_tokens: Column, steps_replaced: Column, signature: Column) -> Column:
    """ARRAY<STRING> with one text per violated gate."""
    size, fewest = GATES["max_body_tokens"], GATES["min_steps_replaced"]
    checks = F.array(
        F.when(
            body_tokens > size,
            F.format_string(
                f"body %d tok > {size} (break-even rises past anything observed)", body_tokens
            ),
        ),
        F.when(
            steps_replaced < fewest,
            F.format_string("replaces %d steps — nothing to amortize", steps_replaced),
        ),
        F.when(
            F.coalesce(F.size(signature), F.lit(0)) <= 0,
            F.lit("no trigger signature — nothing to key on"),
        ),
    )
    return F.filter(checks, lambda c: c.isNotNull())


def roster_card(name: Column, description: Column, signature: Column) -> Column:
    """The short entry that sits in the prompt; the body is not in it."""
    return F.concat(
        name, F.lit(": "), F.coalesce(description, F.lit("")), F.lit(" [when: "),
        F.array_join(signature, " → "), F.lit("]"),
    )
