"""Scalar functions with the semantics of a statistics language: floored division, half-even rounding, infinities."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def div(x: Column, y: Column) -> Column:
    """Division of doubles; by zero gives an infinity or NaN, in any ANSI mode."""
    x, y = x.cast("double"), y.cast("double")
    at_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def mod(x: Column, y: Column) -> Column:
    """The remainder of the floored quotient: it has the divisor's sign; null at zero. Exact for whole numbers of any size."""
    r = F.try_mod(x, y)
    return F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def idiv(x: Column, y: Column) -> Column:
    """The floored quotient; null at zero. Exact for whole numbers of any size."""
    whole = F.typeof(x).isin(*_WHOLE) & F.typeof(y).isin(*_WHOLE)
    a, b = x.cast("long"), F.nullif(y.cast("long"), F.lit(0))
    down = F.when((F.try_mod(a, b) != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)
    return F.when(whole, F.call_function("div", a, b) - down).otherwise(F.when(y != 0, F.floor(x.cast("double") / F.nullif(y, F.lit(0)))))


def round(x: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def signif(x: Column, digits: int = 6) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(F.nullif(x, F.lit(0))))))
    return F.when(x == 0, x.cast("double")).otherwise(F.rint(x * scale) / scale)


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def log(x: Column, base: float = math.e) -> Column:
    """NaN below zero, minus infinity at zero."""
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x) / F.lit(1.0 if base == math.e else math.log(base)))


def expm1(x: Column) -> Column:
    return F.expm1(x)


def log1p(x: Column) -> Column:
    return F.when(x < -1, F.lit(float("nan"))).when(x == -1, F.lit(float("-inf"))).otherwise(F.log1p(x))


def cospi(x: Column) -> Column:
    return F.cos(F.pi() * F.try_mod(x.cast("double"), F.lit(2.0)))


def sinpi(x: Column) -> Column:
    return F.sin(F.pi() * F.try_mod(x.cast("double"), F.lit(2.0)))


def tanpi(x: Column) -> Column:
    return F.tan(F.pi() * F.try_mod(x.cast("double"), F.lit(1.0)))


#: Coefficients of the asymptotic series of ln gamma, digamma and trigamma, from the Bernoulli numbers.
_LN_GAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
_TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
#: Arguments are raised by so much before a series.
_UP = 12


def _series(coefficients: tuple, w: Column) -> Column:
    out = F.lit(0.0)
    for k in reversed(coefficients):
        out = F.lit(k) + w * out
    return out


def _raised(x: Column, term, combine) -> Column:
    out = term(x)
    for k in range(1, _UP):
        out = combine(out, term(x + k))
    return out


def _pole(x: Column) -> Column:
    return (x <= 0) & (x == F.floor(x))


def lgamma(x: Column) -> Column:
    """ln |gamma(x)|; infinite at 0, -1, ...; by the series at x + 12 and, below a half, by reflection."""
    x = x.cast("double")

    def above(v: Column) -> Column:
        z = v + _UP
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + _series(_LN_GAMMA, 1 / (z * z)) / z - F.ln(_raised(v, lambda a: a, lambda a, b: a * b))

    large = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + _series(_LN_GAMMA, 1 / (x * x)) / x
    below = math.log(math.pi) - F.ln(F.abs(sinpi(x))) - above(1 - x)
    return F.when(_pole(x), F.lit(float("inf"))).when(x >= 1e6, large).when(x < 0.5, below).otherwise(above(x))


def gamma(x: Column) -> Column:
    """NaN at 0, -1, ...; exact for whole numbers up to 21."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & (x >= 1) & (x <= 21)
    sign = F.when((x < 0) & (F.pmod(F.floor(x), F.lit(2)) == 1), -1.0).otherwise(1.0)
    return F.when(_pole(x), F.lit(float("nan"))).when(whole, F.factorial(F.when(whole, x - 1).cast("int")).cast("double")).otherwise(sign * F.exp(lgamma(x)))


def digamma(x: Column) -> Column:
    """NaN at 0, -1, ...; below a half by reflection."""
    x = x.cast("double")

    def above(v: Column) -> Column:
        z = v + _UP
        return F.ln(z) - 0.5 / z + _series(_DIGAMMA, 1 / (z * z)) / (z * z) - _raised(v, lambda a: 1 / a, lambda a, b: a + b)

    return F.when(_pole(x), F.lit(float("nan"))).when(x < 0.5, above(1 - x) - math.pi / tanpi(x)).otherwise(above(x))


def trigamma(x: Column) -> Column:
    """Infinite at 0, -1, ...; below a half by reflection."""
    x = x.cast("double")

    def above(v: Column) -> Column:
        z = v + _UP
        return 1 / z + 0.5 / (z * z) + _series(_TRIGAMMA, 1 / (z * z)) / (z * z * z) + _raised(v, lambda a: 1 / (a * a), lambda a, b: a + b)

    return F.when(_pole(x), F.lit(float("inf"))).when(x < 0.5, math.pi**2 / F.pow(sinpi(x), F.lit(2.0)) - above(1 - x)).otherwise(above(x))


def _whole_pairs(f: Callable, x: pd.Series, y: pd.Series) -> pd.Series:
    missing = x.isna() | y.isna()
    return pd.Series(f(x.fillna(0).to_numpy(np.int64), y.fillna(0).to_numpy(np.int64)), dtype="Int64").mask(missing)


@F.pandas_udf(LongType())
def gcd(x: pd.Series, y: pd.Series) -> pd.Series:
    return _whole_pairs(np.gcd, x, y)


@F.pandas_udf(LongType())
def lcm(x: pd.Series, y: pd.Series) -> pd.Series:
    return _whole_pairs(np.lcm, x, y)


def get_group_unaware_fns() -> tuple[str, ...]:
    """The functions of this module: each looks at one row, so it is built once whatever the grouping."""
    return tuple(k for k, f in globals().items() if callable(f) and not k.startswith("_") and getattr(f, "__module__", None) == __name__ and k != "get_group_unaware_fns")
