"""Null-safe column expressions that features, rules and metrics share. None of them raises under ANSI mode."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def as_micros(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods, floored, also for negative differences (not a calendar difference)."""
    return F.floor((as_micros(later) - as_micros(earlier)) / F.lit(86_400_000_000)).cast("double")


def signed_log1p(x: Column) -> Column:
    x = F.coalesce(x, F.lit(0.0))
    return F.signum(x) * F.log1p(F.abs(x))


def safe_ratio(n: Column, d: Column) -> Column:
    """n over |d|, zero where d is zero."""
    return F.when(F.abs(d) > 0, n / F.greatest(F.abs(d), F.lit(TINY))).otherwise(F.lit(0.0))


def nullable_ratio(n: Column, d: Column) -> Column:
    """n over |d|, null where d is null or zero."""
    return F.when(F.abs(d) > 0, n / F.greatest(F.abs(d), F.lit(TINY)))


def safe_change(new: Column, old: Column) -> Column:
    """(new - old) over |old|; where old is zero, 1 if new is positive, else 0."""
    return F.when(F.abs(old) > 0, (new - old) / F.greatest(F.abs(old), F.lit(TINY))).otherwise((new > 0).cast("double"))


def activity_ratio(new: Column, old: Column) -> Column:
    return F.when(F.abs(old) > 0, new / F.greatest(F.abs(old), F.lit(TINY))).otherwise((new > 0).cast("double"))


def clipped(x: Column, low: float, high: float) -> Column:
    """Within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def month_of(day: Column) -> Column:
    return F.trunc(day.cast("date"), "month")


def months_apart(later: Column, earlier: Column) -> Column:
    """Calendar months between two dates."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


#: Coefficients of Lanczos' approximation of the gamma function (g = 7).
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for positive x."""
    z = x - 1
    series = sum((F.lit(c) / (z + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def upper_gamma(a: Column, x: Column, terms: int = 400) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for positive a; 1 at and below x = 0.

    Below a + 1 by the power series of its complement, above by the continued fraction, summed from its far end.
    """
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    steps = F.sequence(F.lit(1), F.lit(terms))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (a + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(steps, F.struct((1 / a).alias("term"), (1 / a).alias("total")), add)["total"]
    # x + 1 - a - 1(1 - a) / (x + 3 - a - 2(2 - a) / (x + 5 - a - ...)).
    below = F.aggregate(F.reverse(steps), F.lit(0.0), lambda further, n: n * (n - a) / (x + 2 * n + 1 - a - further))
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(1 - front * series, F.lit(0.0))).otherwise(front / (x + 1 - a - below))


def chi_square_tail(value: Column, freedom: Column) -> Column:
    """The chance of a chi-square value as large or larger; null without a degree of freedom."""
    return F.when(freedom > 0, upper_gamma(freedom.cast("double") / 2, value / 2))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of two columns as an aggregate; null where one of them is constant (``corr`` raises there)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
