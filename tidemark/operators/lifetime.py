"""BG/NBD and Gamma-Gamma: how often customers buy, whether they still do and what they spend, as column expressions.

Log-likelihoods of all trial parameters of a round are sums of one aggregation by trial; only these sums come to the
driver, so the table may be of any size. Trials are an array literal, so all rounds share one compiled plan. Parameters are
searched on the log scale by pattern search: one step up or down in one or two of them, halved when nothing improves (likelihoods have ridges across two).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import astuple, dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import LANCZOS, log_gamma
from tidemark.functions.storage import keep
from tidemark.functions.sums import summed

@dataclass(frozen=True)
class BgNbd:
    r: float
    alpha: float
    a: float
    b: float


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    v: float


def _visits_part(r: Column, alpha: Column, a: Column, b: Column) -> Column:
    """The terms of the BG/NBD log-likelihood that depend on the row."""
    x, recency, age = F.col("frequency").cast("double"), F.col("recency"), F.col("age")
    going = -(r + x) * F.log(alpha + age)
    gone = F.log(a) - F.log(F.greatest(b + x - 1, F.lit(1e-12))) - (r + x) * F.log(alpha + recency)
    top = F.greatest(going, gone)
    both = top + F.log(F.exp(going - top) + F.exp(gone - top))
    return log_gamma(r + x) + log_gamma(b + x) - log_gamma(a + b + x) + F.when(x > 0, both).otherwise(going)


def _visits_constant(m: BgNbd) -> float:
    return m.r * math.log(m.alpha) - math.lgamma(m.r) + math.lgamma(m.a + m.b) - math.lgamma(m.b)


def log_likelihood(m: BgNbd) -> Column:
    return _visits_part(*map(F.lit, astuple(m))) + _visits_constant(m)


def _spend_part(p: Column, q: Column, v: Column) -> Column:
    """The terms of the Gamma-Gamma log-likelihood that depend on the row; ``monetary`` is the mean of a purchase."""
    x, mean = F.col("frequency").cast("double"), F.col("monetary")
    return log_gamma(p * x + q) - log_gamma(p * x) + (p * x - 1) * F.log(mean) + p * x * F.log(x) - (p * x + q) * F.log(x * mean + v)


def _spend_constant(g: GammaGamma) -> float:
    return g.q * math.log(g.v) - math.lgamma(g.q)


def spend_log_likelihood(g: GammaGamma) -> Column:
    return _spend_part(*map(F.lit, astuple(g))) + _spend_constant(g)


def _search(counts: DataFrame, row_part: Callable[..., Column], constant: Callable[[list[float]], float], at: list[float], rounds: int, least_step: float) -> list[float]:
    """The log parameters with the largest sum of ``n * row_part`` over ``counts``, per row, plus ``constant``."""
    step, wide = 0.5, len(at)  # larger first steps can run off along a ridge
    size = counts.agg(F.sum("n")).first()[0] or 1
    for _ in range(rounds):
        moves = [m for m in product((-1, 0, 1), repeat=wide) if sum(map(abs, m)) in (1, 2)]
        trials = [at] + [[v + step * s for v, s in zip(at, m, strict=True)] for m in moves]
        rows = counts.select("*", F.posexplode(F.lit([[math.exp(v) for v in t] for t in trials])).alias("trial", "value"))
        part = row_part(*[F.col("value")[i] for i in range(wide)])
        sums = {r["trial"]: r["total"] for r in rows.groupBy("trial").agg(F.sum(F.col("n") * part).alias("total")).collect()}
        worth = [(sums.get(i) or 0.0) / size + constant(t) for i, t in enumerate(trials)]
        best = max(range(len(trials)), key=lambda i: -math.inf if math.isnan(worth[i]) else worth[i])
        if best == 0:
            step /= 2
            if step < least_step:
                break
        at = trials[best]
    return at


def fit_bgnbd(rfm: DataFrame, penalty: float = 0.01, rounds: int = 40, least_step: float = 0.05) -> BgNbd:
    """Maximum penalised likelihood over ``rfm`` (frequency, recency, age in days)."""
    counts = rfm.groupBy("frequency", "recency", "age").agg(F.count("*").alias("n")).persist()

    def constant(at: list[float]) -> float:
        m = BgNbd(*map(math.exp, at))
        return _visits_constant(m) - penalty * (m.r**2 + m.a**2 + m.b**2)

    try:
        mean = counts.agg(F.sum(F.col("n") * F.col("age")) / F.sum("n")).first()[0]
        return BgNbd(*map(math.exp, _search(counts, _visits_part, constant, [0.0, math.log(max(mean or 1.0, 1.0)), 0.0, 0.0], rounds, least_step)))
    finally:
        counts.unpersist()


def fit_gamma_gamma(rfm: DataFrame, penalty: float = 0.01, rounds: int = 60, least_step: float = 0.02, least_rows: int = 50) -> GammaGamma | None:
    """Maximum penalised likelihood over the rows of ``rfm`` with repeat purchases and a positive mean; None for under ``least_rows``."""
    counts = rfm.where((F.col("frequency") > 0) & (F.col("monetary") > 0)).groupBy("frequency", "monetary").agg(F.count("*").alias("n")).persist()

    def constant(at: list[float]) -> float:
        g = GammaGamma(*map(math.exp, at))
        return _spend_constant(g) - penalty * (g.p**2 + g.q**2)

    try:
        size, mean = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("monetary")) / F.sum("n")).first()
        if (size or 0) < least_rows:
            return None
        return GammaGamma(*map(math.exp, _search(counts, _spend_part, constant, [0.0, math.log(2.0), math.log(mean)], rounds, least_step)))
    finally:
        counts.unpersist()


def p_alive(m: BgNbd) -> Column:
    """Probability that the account still buys; 1 without repeat purchases."""
    x = F.col("frequency").cast("double")
    odds = m.a / F.greatest(m.b + x - 1, F.lit(1e-12)) * F.pow((m.alpha + F.col("age")) / (m.alpha + F.col("recency")), m.r + x)
    return F.when(x > 0, 1 / (1 + odds)).otherwise(1.0)


def expected_purchases(m: BgNbd, days: float) -> Column:
    """Purchases expected in the next ``days``, given the account's history.

    The hypergeometric function is Euler's transform of the published form, whose terms shrink like powers of
    days / (alpha + age + days); as many terms are summed as double precision needs.
    """
    a = m.a if abs(m.a - 1) > 1e-6 else m.a + 1e-6
    x, age = F.col("frequency").cast("double"), F.col("age").cast("double")
    z = days / (m.alpha + age + days)
    low = a + m.b + x - 1

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * (a + m.b - 1 - m.r + n) * (a - 1 + n) / ((low + n) * (n + 1)) * z
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    terms = F.sequence(F.lit(0), F.ceil(F.lit(-36.0) / F.log(z)).cast("int") + 20)
    series = F.aggregate(terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), add)["total"]
    return low / (a - 1) * (1 - F.pow(1 - z, F.lit(a - 1)) * series) * p_alive(m)


def expected_spend(g: GammaGamma) -> Column:
    """Mean value expected of an account's purchase; needs ``frequency`` above zero."""
    x = F.col("frequency").cast("double")
    return g.p * (g.v + x * F.col("monetary")) / F.greatest(g.p * x + g.q - 1, F.lit(1e-12))


def expected_revenue(rfm: DataFrame, m: BgNbd, g: GammaGamma | None, days: int) -> DataFrame:
    """acc_id, purchases, spend, predicted_clv: purchases times spend; without repeat purchases or a spend model the mean of all accounts."""
    mean = rfm.agg(F.coalesce(F.avg("monetary"), F.lit(0.0)).alias("__mean"))
    spend = F.col("__mean") if g is None else F.when(F.col("frequency") > 0, expected_spend(g)).otherwise(F.col("__mean"))
    rows = rfm.join(F.broadcast(mean)).select("acc_id", expected_purchases(m, days).alias("purchases"), spend.alias("spend"))
    return rows.withColumn("predicted_clv", F.greatest(F.col("purchases") * F.col("spend"), F.lit(0.0)))


# Several penalties at once.

#: Penalties tried together: nine from 0.0001 to 1, evenly on the log scale.
PENALTIES = [10 ** (i / 2 - 4) for i in range(9)]
#: Width of the differences that give the slopes, on the log scale.
_H = 1e-4


def _np_log_gamma(x: np.ndarray) -> np.ndarray:
    z = x - 1
    series = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(series)


def likelihoods(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sums of n x BG/NBD log-likelihood over rows (frequency, recency, age, n), by point (r, alpha, a, b)."""
    x, recency, age, n = rows.T
    out = np.empty(len(points))
    for k, (r, alpha, a, b) in enumerate(points):
        going = -(r + x) * np.log(alpha + age)
        gone = np.log(a) - np.log(np.maximum(b + x - 1, 1e-12)) - (r + x) * np.log(alpha + recency)
        own = _np_log_gamma(r + x) + _np_log_gamma(b + x) - _np_log_gamma(a + b + x) + np.where(x > 0, np.logaddexp(going, gone), going)
        out[k] = (n * own).sum() + n.sum() * _visits_constant(BgNbd(r, alpha, a, b))
    return out


def fit_together(sums, size: float, mean_age: float, penalties: list[float], steps: int = 80, least_gain: float = 1e-9) -> np.ndarray:
    """Log parameters by penalty; ``sums(points)`` adds ``likelihoods`` over all rows: one pass a step for all penalties.

    Quasi-Newton steps on slopes from differences; a step that makes a fit worse is halved in the next pass.
    """
    k, lam = len(penalties), np.array(penalties)
    moves = np.concatenate([np.zeros((1, 4)), _H * np.eye(4), -_H * np.eye(4)])

    def measured(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        trials = (at[:, None, :] + moves[None]).reshape(-1, 4)
        values = np.exp(np.clip(trials, -12, 12))
        cost = (-sums(values) / size).reshape(k, -1) + lam[:, None] * (values[:, [0, 2, 3]] ** 2).sum(1).reshape(k, -1)
        cost = np.where(np.isfinite(cost), cost, 1e12)
        return cost[:, 0], (cost[:, 1:5] - cost[:, 5:]) / (2 * _H)

    at = np.tile([0.0, math.log(max(mean_age, 1.0)), 0.0, 0.0], (k, 1))
    cost, slope = measured(at)
    inverse = np.tile(0.5 * np.eye(4), (k, 1, 1))
    length, open_ = np.ones(k), np.ones(k, bool)
    for _ in range(steps):
        step = -np.einsum("kij,kj->ki", inverse, slope)
        uphill = (step * slope).sum(1) > 0
        step[uphill], inverse[uphill] = -0.5 * slope[uphill], 0.5 * np.eye(4)
        step *= np.minimum(1.0, 1.5 / np.maximum(np.abs(step).max(1), 1e-12))[:, None] * (length * open_)[:, None]
        new_cost, new_slope = measured(at + step)
        better = open_ & (new_cost <= cost + 1e-4 * (step * slope).sum(1))
        for i in np.flatnonzero(better).tolist():
            s, y = step[i], new_slope[i] - slope[i]
            if s @ y > 1e-14:
                left = np.eye(4) - np.outer(s, y) / (s @ y)
                inverse[i] = left @ inverse[i] @ left.T + np.outer(s, s) / (s @ y)
        gain = cost - new_cost
        at[better], cost[better], slope[better] = (at + step)[better], new_cost[better], new_slope[better]
        length = np.where(better, 1.0, length / 2)
        open_ &= ~((better & (gain < least_gain) & (np.abs(slope).max(1) < 1e-5)) | (length < 1e-6))
        if not open_.any():
            break
    return at


def fit_penalties(train: DataFrame, valid: DataFrame, penalties: list[float] = PENALTIES) -> tuple[list[BgNbd], list[float], int]:
    """A fit for every penalty, the mean log-likelihood of held-out accounts under each, and the place of the best one.

    Both frames have frequency, recency and age; equal rows are counted first. Ties go to the smaller place.
    """
    columns = ["frequency", "recency", "age"]
    counted = [keep(df.groupBy(*columns).agg(F.count("*").alias("n"))) for df in (train, valid)]
    size, mean = counted[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("n") * F.col("age")) / F.sum("n")).first()
    values = [*columns, "n"]
    over = lambda rows: lambda points: summed(rows, values, lambda x: likelihoods(x, points), len(points))
    if not size:
        return [BgNbd(1.0, 1.0, 1.0, 1.0)] * len(penalties), [0.0] * len(penalties), 0
    found = np.exp(np.clip(fit_together(over(counted[0]), size, mean or 1.0, penalties), -12, 12))
    held = counted[1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = over(counted[1])(found) / max(held, 1)
    return [BgNbd(*map(float, p)) for p in found], told.tolist(), int(np.argmax(np.round(told, 9)))
