"""Decimal rounding that agrees with Python's ``round`` on binary doubles.

Spark's ``round`` is half-up and ``bround`` is half-even on the *printed* decimal, so both
disagree with Python when a value such as ``2.675`` is not exactly a tie in binary.  The
expressions below find the exact remainder of ``x * 10**n`` by an error-free product, which
makes the tie test exact (for up to 8 digits) while staying inside whole-stage codegen.  They
name their argument several times: give nested roundings a column of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled_nearest(x: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    product = x * scale
    # A float holds 24 bits, so its product with the scale and that of the rest are exact.
    head = x.cast("float").cast("double")
    error = (head * scale - product) + (x - head) * scale
    nearest = F.rint(product)
    inexact_tie = (F.abs(product - nearest) == F.lit(0.5)) & (error != F.lit(0.0))
    return F.when(inexact_tie, product + F.lit(0.5) * F.signum(error)).otherwise(nearest)


def py_round(x: Column, digits: int) -> Column:
    """``round(x, digits)`` as a double."""
    return _scaled_nearest(x.cast("double"), digits) / F.lit(float(10**digits))


def to_units(x: Column, digits: int) -> Column:
    """``x`` as a BIGINT count of ``10**-digits``.

    Sums of such counts are exact and do not depend on how rows are partitioned.
    """
    return _scaled_nearest(x.cast("double"), digits).cast("bigint")


def from_units(units: Column, digits: int) -> Column:
    """The double nearest to ``units * 10**-digits``."""
    return units.cast("double") / F.lit(float(10**digits))
