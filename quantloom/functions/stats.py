"""Column expressions for distributions and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantile at 0.95.
Z95 = 1.6448536269514715


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) * 0.3989422804014327


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the polynomial 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = normal_pdf(x) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


# P. J. Acklam's rational approximation of the standard normal quantile.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile (relative error below 1.2e-9)."""
    side = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(side))
    tail = _horner(t, TAIL_TOP) / _horner(t, TAIL_BOTTOM)
    q = p - 0.5
    centre = q * _horner(q * q, CENTRE_TOP) / _horner(q * q, CENTRE_BOTTOM)
    return F.when(side >= 0.02425, centre).when(p < 0.5, tail).otherwise(-tail)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def pareto_cdf(excess: Column, shape: Column, scale: Column) -> Column:
    """Generalised Pareto distribution of an excess: 0 below zero, 1 beyond the end that a negative shape has."""
    inside = 1 + shape * excess / scale
    tail = F.when(F.abs(shape) < 1e-9, F.exp(-excess / scale)).when(inside > 0, F.pow(inside, -1 / F.nullif(shape, F.lit(0.0)))).otherwise(0.0)
    return F.when(excess <= 0, 0.0).otherwise(1 - tail)


def joined_exceedance(z: Column, threshold: Column, shape: Column, scale: Column) -> Column:
    """Chance to exceed z under a normal body up to a threshold and a generalised Pareto tail above it, which has the
    normal's mass there, so that the two meet; null where the tail is not known."""
    tail = (1 - normal_cdf(threshold)) * (1 - pareto_cdf(z - threshold, shape, scale))
    return F.when(shape.isNotNull() & scale.isNotNull(), F.when(z < threshold, 1 - normal_cdf(z)).otherwise(tail))
