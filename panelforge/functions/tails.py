"""Tail probabilities of the F and t distributions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps by which the gamma function's argument is raised before its series is used.
_RAISE = 10
_LN_2PI = 1.8378770664093453
_TINY = 1e-300


def _correction(z: Column) -> Column:
    """The end of the series of log gamma, to 1e-15 from 10 on."""
    s = 1 / (z * z)
    return (1 / z) * (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188))))


def log_gamma(z: Column) -> Column:
    """Natural logarithm of the gamma function, z above 0."""
    up = z + _RAISE
    lowered = sum((F.log(z + i) for i in range(1, _RAISE)), F.log(z))
    return (up - 0.5) * F.log(up) - up + _LN_2PI / 2 + _correction(up) - lowered


def _log_gamma_rise(a: Column, b: Column) -> Column:
    """log gamma(a + b) - log gamma(a), without the loss of digits that the difference has for large a."""
    up = a + _RAISE
    lowered = sum((F.log1p(b / (a + i)) for i in range(_RAISE)), F.lit(0.0))
    return (up - 0.5) * F.log1p(b / up) + b * F.log(up + b) - b + _correction(up + b) - _correction(up) - lowered


def _beta_fraction(a: Column, b: Column, x: Column, least: int = 60) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forwards; it needs steps with the root of a + b."""
    steps = (F.lit(2 * least) + F.ceil(8 * F.sqrt(a + b))).cast("int")
    away = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(state: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        part = F.when(i % 2 == 0, even).otherwise(odd)
        low, high = 1 / away(1 + part * state["low"]), away(1 + part / state["high"])
        return F.struct(low.alias("low"), high.alias("high"), (state["value"] * low * high).alias("value"))

    begin = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(1.0).alias("value"))
    return 1 / F.aggregate(F.sequence(F.lit(1), steps), begin, step)["value"]


def beta_tail(a: Column, b: Column, odds: Column) -> Column:
    """The regularised incomplete beta function of x = 1 / (1 + odds): I(x; a, b). odds is 0 or more."""
    x, rest = 1 / (1 + odds), odds / (1 + odds)
    log_front = b * F.log(odds) - (a + b) * F.log1p(odds) + _log_gamma_rise(a, b) - log_gamma(b)
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side only
    p, q, at = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, rest).otherwise(x)
    part = F.exp(log_front) / p * _beta_fraction(p, q, at)
    return F.when(odds == 0, 1.0).when(swap, 1 - part).otherwise(part)


def f_tail(f: Column, between: Column, within: Column) -> Column:
    """P(F >= f) with the degrees of freedom; null where f or a degree is unknown or no positive number."""
    ok = (f >= 0) & (between > 0) & (within > 0)
    return F.when(ok, beta_tail(within.cast("double") / 2, between.cast("double") / 2, f * between / within))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided P(|T| >= |t|); null where t is unknown or df is not positive."""
    return F.when((df > 0) & t.isNotNull(), beta_tail(df.cast("double") / 2, F.lit(0.5), t * t / df))
