"""The normal distribution's cumulative function and its inverse as columns, by published rational approximations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's coefficients for the inverse, within 1.2e-9 of it. Numerator and denominator, centre and tail.
CENTRE = ((-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239), (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0))
TAIL = ((-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0))
EDGE = 0.02425
# Hart's coefficients for the cumulative function, in double precision.
UPPER = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def polynomial(coefficients: Sequence[float], x):
    """The polynomial with these coefficients, highest power first, of a column or a text of SQL."""
    if isinstance(x, str):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The normal score of a probability between 0 and 1."""
    q = p - 0.5
    low = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(TAIL[0], low) / polynomial(TAIL[1], low)
    return F.when(p < EDGE, tail).when(p > 1 - EDGE, -tail).otherwise(q * polynomial(CENTRE[0], q * q) / polynomial(CENTRE[1], q * q))


def normal_quantile_sql(p: str) -> str:
    """`normal_quantile` as a text of SQL."""
    low, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    tail = f"{polynomial(TAIL[0], low)} / {polynomial(TAIL[1], low)}"
    return f"CASE WHEN {p} < {EDGE} THEN {tail} WHEN {p} > {1 - EDGE} THEN -({tail}) ELSE {q} * {polynomial(CENTRE[0], f'({q} * {q})')} / {polynomial(CENTRE[1], f'({q} * {q})')} END"


def normal_cdf(x: Column) -> Column:
    """The probability of a value up to x."""
    a = F.abs(x)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + k / far
    above = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, polynomial(UPPER, a) / polynomial(LOWER, a)).otherwise(1 / far / 2.506628274631)
    return F.when(x > 0, 1 - above).otherwise(above)
