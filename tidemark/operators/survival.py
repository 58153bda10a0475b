"""Days to an event that not every row has seen: accelerated failure times with normal, logistic or extreme-value errors.

log(days) = features x coefficients + scale x error. A row that was only watched for some days counts with the chance of having
lasted longer. Newton steps on the exact derivatives: the log-likelihood, its gradient and its Hessian are one sum over the
rows, added up in the tasks; steps that don't raise the likelihood are damped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import keep
from tidemark.functions.sums import summed
from tidemark.operators.models import Scaling, fit_scaling, scaled

#: Log-normal, log-logistic and Weibull days.
FAMILIES = ("normal", "logistic", "extreme")
STEPS, LEAST_GAIN, RIDGE = 30, 1e-9, 1e-4
SHORTEST_DAYS, LONGEST_DAYS = 0.5, 3650.0
URGENT_DAYS, BETA = 14, 2.0

_erfc = np.frompyfunc(math.erfc, 1, 1)


def _tail(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(1 - Phi(z)) and phi(z) / (1 - Phi(z)), also far out where the tail itself is no number any more."""
    near = np.minimum(z, 25.0)
    log_tail = np.log(0.5 * _erfc(near / math.sqrt(2)).astype(np.float64))
    far = z > 25
    if far.any():
        big = z[far]
        log_tail[far] = -0.5 * big**2 - np.log(big) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / big**2 + 3 / big**4)
    return log_tail, np.exp(-0.5 * z**2 - 0.5 * math.log(2 * math.pi) - log_tail)


def error_terms(family: str, z: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log density (log of the tail where the event was not seen) of errors, and its first and second derivative."""
    if family == "logistic":
        p, last = 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.logaddexp(0, z)
        return np.where(seen, z - 2 * last, -last), np.where(seen, 1 - 2 * p, -p), np.where(seen, 2.0, 1.0) * -p * (1 - p)
    if family == "extreme":
        e = np.exp(np.minimum(z, 500))
        return np.where(seen, z - e, -e), np.where(seen, 1 - e, -e), -e
    log_tail, hazard = _tail(z)
    return np.where(seen, -0.5 * z**2 - 0.5 * math.log(2 * math.pi), log_tail), np.where(seen, -z, -hazard), np.where(seen, -1.0, -hazard * (hazard - z))


def likelihood_sums(rows: np.ndarray, family: str, at: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and upper triangle of the Hessian; rows are features, log days, seen; ``at``: coefficients, log scale."""
    x, y, seen = np.column_stack([np.ones(len(rows)), rows[:, :-2]]), rows[:, -2], rows[:, -1] > 0.5
    scale = math.exp(at[-1])
    z = np.clip((y - x @ at[:-1]) / scale, -1e4, 1e4)
    value, first, second = error_terms(family, z, seen)
    gradient = np.append(-(x * first[:, None]).sum(0) / scale, -(first * z).sum() - seen.sum())
    hessian = np.zeros((len(at), len(at)))
    hessian[:-1, :-1] = (x * second[:, None]).T @ x / scale**2
    hessian[:-1, -1] = (x * (second * z + first)[:, None]).sum(0) / scale
    hessian[-1, -1] = (second * z**2 + first * z).sum()
    return np.concatenate([[value.sum() - at[-1] * seen.sum()], gradient, hessian[np.triu_indices(len(at))]])


def climb(sums, start: np.ndarray, n_rows: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """The parameters of the largest likelihood (with a small ridge on slopes), and the likelihood a row."""
    p, damp = len(start), 1e-3
    ridge = RIDGE * n_rows * np.array([0.0] + [1.0] * (p - 2) + [0.0])
    worth = lambda parts, at: parts[0] - 0.5 * (ridge * at**2).sum()
    at, parts = start, sums(start)
    for _ in range(steps):
        h = np.zeros((p, p))
        h[np.triu_indices(p)] = parts[1 + p :]
        h = -(h + np.triu(h, 1).T) + np.diag(ridge)
        step = np.linalg.lstsq(h + damp * np.diag(np.abs(np.diag(h)) + 1e-9), parts[1 : 1 + p] - ridge * at, rcond=None)[0]
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        there = sums(at + step)
        gain = worth(there, at + step) - worth(parts, at)
        if gain > 0:
            at, parts, damp = at + step, there, damp / 10
            if gain < LEAST_GAIN * n_rows:
                break
        else:
            damp = max(damp, 1e-3) * 10
            if damp > 1e6:
                break
    return at, parts[0] / max(1, n_rows)


@dataclass(frozen=True)
class Timing:
    """A fitted family: coefficients (intercept first) over scaled features, scale, likelihood a row."""

    family: str
    names: list[str]
    by: Scaling
    beta: list[float]
    scale: float
    likelihood: float
    #: Predicted days are multiplied by this, so that the tuned threshold stands for URGENT_DAYS.
    day_scale: float = 1.0

    def add(self, df: DataFrame, out: str = "expected_days") -> DataFrame:
        """``df`` with the median of the days (at most LONGEST_DAYS); the features stay as they are."""
        standard = [(F.coalesce(c, F.lit(self.by.fill[c])) - self.by.mean[c]) / self.by.scale[c] for c in self.names]
        line = sum((b * x for b, x in zip(self.beta[1:], standard, strict=True)), F.lit(self.beta[0]))
        middle = self.scale * math.log(math.log(2)) if self.family == "extreme" else 0.0
        return df.withColumn(out, F.least(F.exp(F.least(line + middle, F.lit(50.0))) * self.day_scale, F.lit(LONGEST_DAYS)))


def fit_days(train: DataFrame, names: list[str], days: str, observed: str, families: tuple[str, ...] = FAMILIES) -> list[Timing]:
    """One fit a family. Rows without days are left out; without an observed event all scales are one."""
    rows = train.where(F.col(days).isNotNull()).select(*names, F.log(F.greatest(F.col(days).cast("double"), F.lit(SHORTEST_DAYS))).alias("__y"), (F.col(observed) == 1).cast("double").alias("__seen"))
    by = fit_scaling(rows, names)
    ready = keep(scaled(rows, names, by).select(*[F.col(c).cast("double") for c in names], "__y", F.coalesce("__seen", F.lit(0.0)).alias("__seen")))
    facts = ready.agg(F.count("*").alias("n"), F.sum("__seen").alias("seen"), F.avg("__y").alias("m"), F.stddev_pop("__y").alias("s")).first()
    p = len(names) + 2
    start = np.array([facts["m"] or 0.0, *[0.0] * len(names), math.log(max(facts["s"] or 1.0, 0.1))])
    if not facts["seen"]:
        return [Timing(f, names, by, start[:-1].tolist(), 1.0, 0.0) for f in families]
    out = []
    for family in families:
        sums = lambda at, family=family: summed(ready, [*names, "__y", "__seen"], lambda rows: likelihood_sums(rows, family, at), 1 + p + p * (p + 1) // 2)
        at, likelihood = climb(sums, start, facts["n"])
        out.append(Timing(family, names, by, at[:-1].tolist(), math.exp(at[-1]), likelihood))
    return out


def urgent_threshold(rows: DataFrame, days: str, urgent: str) -> tuple[float, float]:
    """The whole number of predicted days at or under which F2 of ``urgent`` is best (ties: the smaller), and that F2.

    Rows are counted by predicted day first: what is summed up in order is a row a day.
    """
    of_day = rows.groupBy(F.greatest(F.ceil(days), F.lit(1)).cast("int").alias("day")).agg(F.count("*").alias("n"), F.count_if(urgent).alias("hit"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # LONGEST_DAYS rows at most
    run = of_day.select("day", F.sum("n").over(upto).alias("flagged"), F.sum("hit").over(upto).alias("hits")).join(F.broadcast(of_day.agg(F.sum("hit").alias("all"))))
    score = F.try_divide((1 + BETA**2) * F.col("hits"), F.col("flagged") + BETA**2 * F.col("all"))
    best = run.select("day", F.coalesce(score, F.lit(0.0)).alias("f2")).orderBy(F.desc("f2"), "day").first()
    return (float(best["day"]), best["f2"]) if best and best["f2"] > 0 else (float(URGENT_DAYS), 0.0)


def choose_timing(train: DataFrame, valid: DataFrame, names: list[str], days: str, observed: str, families: tuple[str, ...] = ("normal", "logistic")) -> Timing:
    """The family with the best F2 of urgent rows in ``valid`` (ties: the larger likelihood), its days scaled to its threshold."""
    best, key = None, None
    urgent = (F.col(observed) == 1) & (F.col(days) <= URGENT_DAYS)
    for fit in fit_days(train, names, days, observed, families):
        threshold, f2 = urgent_threshold(fit.add(valid), "expected_days", urgent)
        if key is None or (f2, fit.likelihood) > key:
            best, key = Timing(fit.family, fit.names, fit.by, fit.beta, fit.scale, fit.likelihood, URGENT_DAYS / threshold), (f2, fit.likelihood)
    return best
