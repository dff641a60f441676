"""Small statistical expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.schema import Z_EXACT, Z_ROUNDED


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rate(condition: Column) -> Column:
    """Mean of an indicator, as double."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def wilson(k: Column, n: Column, percent: bool = False) -> tuple[Column, Column]:
    """Wilson interval of k of n: rounded z clipped to [0, 1], or exact z in percent, unclipped."""
    z = Z_EXACT if percent else Z_ROUNDED
    n, p = n.cast("double"), share(k, n)
    centre = F.try_divide(p + z * z / 2 / n, 1 + z * z / n)
    half = F.try_divide(z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n), 1 + z * z / n)
    if percent:
        return 100 * (centre - half), 100 * (centre + half)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def kappa(observed: Column, expected: Column) -> Column:
    """(po - pe) / (1 - pe); null where pe is 1."""
    return F.when(F.abs(1 - expected) < 1e-12, None).otherwise(F.try_divide(observed - expected, 1 - expected))


def smd(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column) -> Column:
    """Standardised mean difference with population variances; 0 where the pooled deviation is 0."""
    sd = F.sqrt((var_a + var_b) / 2)
    return F.when(sd == 0, 0.0).otherwise(F.try_divide(mean_a - mean_b, sd))


def odds_ratio(beta: float, se: float, scale: float = 1.0, z: float = Z_EXACT) -> dict[str, float]:
    return {"or": math.exp(beta * scale), "lo": math.exp((beta - z * se) * scale), "hi": math.exp((beta + z * se) * scale)}


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def half_up(value: Column, digits: int) -> Column:
    """Rounded half up on the decimal form of a double, as text."""
    return F.format_string(f"%.{digits}f", F.round(value.cast("decimal(38,12)"), digits).cast("double"))
