"""Linear quantile regression by distributed pinball fits: all levels at once, one pass over the rows a step.

The pinball loss of a residual r at level q is |r| / 2 + (q - 1/2) r. At every step |r| is replaced by the parabola that
touches it at the current residual (smoothed near zero) and lies above it elsewhere, so that a step is a weighted least-squares
problem and never raises the smoothed loss. The sums of that problem (a matrix of weights and a vector for each level) are
added up in the tasks; only they reach the driver. Smoothing shrinks over the steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import keep
from tidemark.functions.sums import packed, summed_blocks
from tidemark.operators.models import LEVELS, QUANTILE_NAMES, Scaling, fit_scaling, ordered_around_median, scaled

STEPS, LEAST_GAIN, RIDGE = 40, 1e-7, 1e-6
#: Width within which a residual counts as small, of the target's deviation: at the first step and at last.
WIDE, NARROW = 0.5, 1e-3


def pinball(residual: Column, level: float) -> Column:
    return F.greatest(level * residual, (level - 1) * residual)


def pinball_losses(rows: DataFrame, actual: str, names: dict[str, float]) -> DataFrame:
    """level and mean pinball loss of every forecast column, by its level."""
    means = rows.agg(*[F.avg(pinball(F.col(actual) - F.col(c), q)).alias(c) for c, q in names.items()])
    return means.select(F.explode(F.array(*[F.struct(F.lit(q).alias("level"), F.col(c).alias("loss")) for c, q in names.items()])).alias("r")).select("r.level", "r.loss")


def step_sums(rows: np.ndarray, beta: np.ndarray, levels: np.ndarray, width: float) -> np.ndarray:
    """Per level: the upper triangle of X'WX, X'(Wy + q - 1/2) and the pinball loss; rows are features, then the target."""
    x, y = np.column_stack([np.ones(len(rows)), rows[:, :-1]]), rows[:, -1]
    upper = np.triu_indices(x.shape[1])
    out = []
    for b, q in zip(beta, levels, strict=True):
        r = y - x @ b
        w = 0.5 / np.maximum(np.abs(r), width)
        out += [((x * w[:, None]).T @ x)[upper], x.T @ (w * y + q - 0.5), [np.maximum(q * r, (q - 1) * r).sum()]]
    return np.concatenate(out)


def solve_pinball(sums, n_features: int, levels: list[float], n_rows: int, center: float, spread: float, steps: int = STEPS, least_gain: float = LEAST_GAIN) -> np.ndarray:
    """Coefficients (intercept first) by level; ``sums(beta, width)`` adds ``step_sums`` over all rows."""
    p, q = n_features + 1, np.array(levels)
    beta = np.zeros((len(q), p))
    beta[:, 0] = center
    upper, size = np.triu_indices(p), p * (p + 1) // 2 + p + 1
    best, best_loss = beta.copy(), np.full(len(q), np.inf)
    for step in range(steps):
        width = spread * max(NARROW, WIDE * 0.7**step)
        parts = sums(beta, width).reshape(len(q), size)
        loss = parts[:, -1] / max(n_rows, 1)
        gained = best_loss - loss
        better = gained > 0
        best[better], best_loss[better] = beta[better], loss[better]
        if width <= spread * NARROW and gained.max() < least_gain * spread:
            break
        for k in range(len(q)):
            a = np.zeros((p, p))
            a[upper] = parts[k, : len(upper[0])]
            a = a + np.triu(a, 1).T + RIDGE * n_rows * np.diag([0.0] + [1.0] * n_features)
            beta[k] = np.linalg.lstsq(a, parts[k, len(upper[0]) : -1], rcond=None)[0]
    return best


@dataclass(frozen=True)
class QuantileModel:
    """Levels, features with their scaling, and coefficients by level (intercept first)."""

    levels: list[float]
    names: list[str]
    by: Scaling
    beta: list[list[float]]

    def add(self, df: DataFrame, out: list[str]) -> DataFrame:
        """``df`` with one forecast column a level; the features stay as they are."""
        standard = [(F.coalesce(c, F.lit(self.by.fill[c])) - self.by.mean[c]) / self.by.scale[c] for c in self.names]
        line = lambda b: sum((w * x for w, x in zip(b[1:], standard, strict=True)), F.lit(b[0]))
        return df.withColumns({name: line(b) for name, b in zip(out, self.beta, strict=True)})


def fit_quantiles(train: DataFrame, names: list[str], target: str, levels: list[float], steps: int = STEPS) -> QuantileModel:
    """One linear model a level for ``target``; rows without a target are left out. Without rows all forecasts are zero."""
    known = train.where(F.col(target).isNotNull()).select(*names, target)
    by = fit_scaling(known, names)
    facts = known.select(F.col(target).cast("double").alias("__y")).agg(F.count("*").alias("n"), F.avg("__y").alias("m"), F.stddev_pop("__y").alias("s")).first()
    if not facts["n"]:
        return QuantileModel(levels, names, by, [[0.0] * (len(names) + 1) for _ in levels])
    size, q = len(levels) * ((len(names) + 1) * (len(names) + 2) // 2 + len(names) + 2), np.array(levels)

    ready = scaled(known, names, by).select(*[F.col(c).cast("double") for c in names], F.col(target).cast("double").alias("__y"))
    blocks = keep(packed(ready, [*names, "__y"]))

    def sums(beta: np.ndarray, width: float) -> np.ndarray:
        return summed_blocks(blocks, len(names) + 1, lambda rows: step_sums(rows, beta, q, width), size)

    beta = solve_pinball(sums, len(names), levels, facts["n"], facts["m"], facts["s"] or 1.0, steps)
    return QuantileModel(levels, names, by, beta.tolist())


def pinball_guess(names: list[str]):
    """For ``models.quantile_forecast``: quantiles of the log ratio of actual to anchor, linear in features and the anchor."""

    def learn(train: DataFrame, anchor: str, actual: str):
        base = F.log1p(F.greatest(F.col(anchor), F.lit(0.0)))
        with_anchor = lambda df: df.withColumn("__anchor", base)
        ratio = F.log1p(F.greatest(F.col(actual), F.lit(0.0))) - base
        model = fit_quantiles(with_anchor(train).withColumn("__ratio", ratio), [*names, "__anchor"], "__ratio", LEVELS)

        def guess(df: DataFrame) -> DataFrame:
            moved = model.add(with_anchor(df), QUANTILE_NAMES)
            return ordered_around_median(moved.withColumns({c: F.greatest(F.expm1(F.col("__anchor") + F.col(c)), F.lit(0.0)) for c in QUANTILE_NAMES}).drop("__anchor"))

        return guess

    return learn
