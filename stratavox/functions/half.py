"""Half-precision rounding of doubles, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

#: The first double that rounds to infinity, and the spacing of subnormals.
OVERFLOW, SUBNORMAL = 65520.0, 2.0**-24


def round_half(x) -> Column:
    """The nearest IEEE half, ties to even, as a double; too large values become infinite."""
    x = col(x)
    size = F.abs(x)
    ulp = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.when(size > 0, size))) - 10.0), F.lit(SUBNORMAL))
    rounded = F.rint(F.try_divide(x, ulp)) * ulp
    infinite = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x.isNull() | F.isnan(x) | (size == 0), x).when(size >= OVERFLOW, infinite).otherwise(rounded)
