"""Paired statistics and intervals as column expressions."""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .rounding import py_round

# The published paired split used for planning.
PUBLISHED_DISCORDANT_RATE = 0.219
PUBLISHED_SPLIT = 0.135 / 0.219
MIN_PAIRS_FOR_A_NEGATIVE = 60


def wilson_interval(passed: Column, trials: Column, z: float = 1.96) -> Column:
    """STRUCT<point, ci_low, ci_high>, clamped to [0, 1]; (0, 0, 1) without trials."""
    n = trials.cast("double")
    p = passed.cast("double") / F.nullif(n, F.lit(0.0))
    denom = F.lit(1.0) + F.lit(z * z) / n
    center = (p + F.lit(z * z) / (F.lit(2.0) * n)) / denom
    half = (
        F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(z * z) / (F.lit(4.0) * n)) / n)
    ) / denom
    return F.when(
        trials == 0,
        F.struct(F.lit(0.0).alias("point"), F.lit(0.0).alias("ci_low"), F.lit(1.0).alias("ci_high")),
    ).otherwise(
        F.struct(
            p.alias("point"),
            F.greatest(F.lit(0.0), center - half).alias("ci_low"),
            F.least(F.lit(1.0), center + half).alias("ci_high"),
        )
    )


# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _stirling_error(x: float) -> float:
    """ln(x!) minus Stirling's formula."""
    if x < 32:
        return math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x


def _half_tail(k: int, n: int) -> float:
    """P(X <= k) of Binomial(n, 1/2), to a relative error of about 1e-11.

    The term at k in a log form that neither overflows nor cancels, and the terms below it,
    summed in blocks until they no longer count.
    """
    if k == 0:
        return math.exp(-n * math.log(2))
    d = (2 * k - n) / n
    deviance = n / 2 * ((d + 1) * math.log1p(d) + (1 - d) * math.log1p(-d))
    term = math.exp(
        _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - deviance
        + 0.5 * math.log(n / (2 * math.pi * k * (n - k))))
    total, last, at = 1.0, 1.0, k
    while at > 0 and last > 1e-18 * total:
        i = np.arange(at, max(0, at - 4096), -1, dtype=float)
        terms = last * np.cumprod(i / (n - i + 1))
        total, last, at = total + float(terms.sum()), float(terms[-1]), at - len(i)
    return term * total


@F.pandas_udf(DoubleType())
def _two_sided(helped: pd.Series, harmed: pd.Series) -> pd.Series:
    # One row per experiment arm.
    pairs = zip(helped.tolist(), harmed.tolist(), strict=True)
    return pd.Series([
        None if a != a or b != b or not a + b else min(1.0, 2 * _half_tail(int(min(a, b)), int(a + b))) for a, b in pairs
    ], dtype=float)


def mcnemar_exact(helped: Column, harmed: Column) -> Column:
    """Two-sided exact McNemar p-value; NULL without discordant pairs.

    Twice the lower tail of Binomial(n, 1/2) at min(helped, harmed), by one form for all sizes.
    """
    return _two_sided(helped.cast("bigint"), harmed.cast("bigint"))


def discordant_rate(helped: Column, harmed: Column, pairs: Column) -> Column:
    share = (helped + harmed).cast("double") / F.nullif(pairs.cast("double"), F.lit(0.0))
    return py_round(share, 4)


def paired_verdict(p_value: Column, rate: Column, pairs: Column, helped: Column, harmed: Column,
                   floor_rate: Column | None = None, alpha: float = 0.05) -> Column:
    """UNDERPOWERED / WITHIN_NOISE / NOT_SUPPORTED / SUPPORTED / SUPPORTED_NEGATIVE.

    The order matters: no p-value, then the noise floor, then significance, then direction.
    """
    verdict = F.when(p_value.isNull(), F.lit("UNDERPOWERED"))
    if floor_rate is not None:
        verdict = verdict.when(
            floor_rate.isNotNull() & (F.coalesce(rate, F.lit(0.0)) <= floor_rate),
            F.lit("WITHIN_NOISE"),
        )
    return (
        verdict.when(
            p_value > alpha,
            F.when(pairs >= MIN_PAIRS_FOR_A_NEGATIVE, F.lit("NOT_SUPPORTED")).otherwise(
                F.lit("UNDERPOWERED")
            ),
        )
        .when(helped > harmed, F.lit("SUPPORTED"))
        .otherwise(F.lit("SUPPORTED_NEGATIVE"))
    )


def required_pairs(rate: Column | float = PUBLISHED_DISCORDANT_RATE,
                   effect: Column | float = PUBLISHED_SPLIT,
                   power: float = 0.80, alpha: float = 0.05) -> Column:
    """Paired runs needed to see a discordant split of ``effect``; 0 outside its domain.

    ``power`` and ``alpha`` are honoured (normal quantiles to six decimals).
    """
    rate = F.lit(rate) if not isinstance(rate, Column) else rate
    effect = F.lit(effect) if not isinstance(effect, Column) else effect
    z_alpha = round(NormalDist().inv_cdf(1 - alpha / 2), 6)
    z_power = round(NormalDist().inv_cdf(power), 6)
    delta = F.abs(effect - 0.5)
    spread = F.lit(z_alpha * 0.5) + F.lit(z_power) * F.sqrt(effect * (F.lit(1.0) - effect))
    discordant = F.pow(spread / F.nullif(delta, F.lit(0.0)), F.lit(2.0))
    inside = (rate > 0) & (rate <= 1) & (effect > 0) & (effect < 1) & (delta > 0)
    return F.when(inside, F.ceil(discordant / F.nullif(rate, F.lit(0.0)))).otherwise(
        F.lit(0)
    ).cast("bigint")
