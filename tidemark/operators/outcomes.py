"""Realized outcomes: what a run predicted against what happened, a row a metric, or one row with the reason for none.

Every model type has its own horizon. A run is measured when activity reaches the end of the horizon, enough of its
scored accounts are labelled and, for churn, both classes occur. All of it is known only when the plan runs, so the
reasons are expressions and nothing is decided on the driver.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import keep
from tidemark.operators import metrics
from tidemark.operators.features import day

LEAST_ROWS = 20
HORIZON, CREDIT_HORIZONS = 180, (30, 90)


def long_form(row: DataFrame, model: str, horizon: int, names: list[str], reasons: list[tuple[Column, Column]]) -> DataFrame:
    """A one-row frame to model, horizon, metric, value, skipped: the first reason that holds stands for all metrics."""
    why = F.coalesce(*[F.when(F.coalesce(holds, F.lit(True)), text) for holds, text in reasons])
    measured = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    none = F.array(F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")))
    rows = row.select(why.alias("skipped"), F.explode(F.when(why.isNull(), measured).otherwise(none)).alias("m"))
    return rows.select(F.lit(model).alias("model"), F.lit(horizon).alias("horizon"), "m.metric", F.round("m.value", 6).alias("value"), "skipped")


def _not_elapsed(end: date) -> tuple[Column, Column]:
    return F.coalesce(F.col("__last") < day(end), F.lit(True)), F.lit(f"horizon not elapsed: activity is needed through {end}")


def _too_few(n: str = "n") -> tuple[Column, Column]:
    return F.col(n) < LEAST_ROWS, F.concat(F.lit("only "), F.col(n).cast("string"), F.lit(f" scored accounts are labelled, {LEAST_ROWS} are needed"))


CHURN_METRICS = [
    "pr_auc", "roc_auc", "f1", "precision", "recall", "brier", "bss", "ece", "mce", "log_loss", "positive_rate", "n",
    "recall_at_top5pct", "recall_at_top10pct", "recall_at_top20pct", "lift_at_top5pct", "lift_at_top10pct", "lift_at_top20pct",
]


def churn_metrics(df: DataFrame, score: str, label: str, key: str, threshold: float = 0.5) -> DataFrame:
    """All churn metrics in one row. ``df`` (a score and a label a row) is materialised: ranks and bins need it anew."""
    df = keep(df.select(key, score, label))
    placed = metrics.placed(df, [F.col(score).desc(), F.col(key)])
    at_top = []
    for k in (5, 10, 20):
        top = F.when(F.col("__at") <= F.ceil(F.col("__n") * (k / 100)), F.col(label))
        at_top += [F.try_divide(F.sum(top), F.sum(label)).alias(f"recall_at_top{k}pct"), F.try_divide(F.avg(top), F.avg(label)).alias(f"lift_at_top{k}pct")]
    ranked = placed.agg(*at_top, F.count("*").alias("n"), F.avg(label).alias("positive_rate"), F.sum(label).alias("__pos"))
    out = ranked.join(metrics.roc_auc(df, score, label)).join(metrics.pr_auc(df, score, label)).join(metrics.confusion(df, score, label, threshold))
    out = out.join(metrics.brier(df, score, label).withColumnRenamed("skill", "bss")).join(metrics.log_loss(df, score, label)).join(metrics.ece(df, score, label))
    return out


def realized_churn(scored: DataFrame, labels: DataFrame, last: DataFrame, cutoff: date, threshold: float = 0.5, horizon: int = HORIZON) -> DataFrame:
    """``scored`` (acc_id, churn_probability), ``labels`` (acc_id, churned), ``last``: one row with the newest activity."""
    both = scored.where(F.col("churn_probability").isNotNull()).join(labels, "acc_id")
    row = churn_metrics(both, "churn_probability", "churned", "acc_id", threshold).join(last.select(F.col("last").alias("__last")))
    one_class = (F.coalesce(F.col("__pos"), F.lit(0)) == 0) | (F.col("__pos") == F.col("n"))
    return long_form(row, "churn", horizon, CHURN_METRICS, [_not_elapsed(cutoff + timedelta(days=horizon)), _too_few(), (one_class, F.lit("all labels are of one class"))])


CLV_METRICS = ["n", "spearman", "mae", "rmse", "rmsle", "smape", "top_decile_capture", "predicted_total", "realized_total"]


def realized_clv(scored: DataFrame, labels: DataFrame, last: DataFrame, cutoff: date, horizon: int = HORIZON) -> DataFrame:
    """``scored`` (acc_id, predicted_clv), ``labels`` (acc_id, future_revenue)."""
    both = keep(scored.where(F.col("predicted_clv").isNotNull()).select("acc_id", F.col("predicted_clv").alias("p")).join(labels.select("acc_id", F.col("future_revenue").alias("y")), "acc_id"))
    row = metrics.regression_metrics(both, "p", "y").join(metrics.top_capture(both, "p", "y", "acc_id").withColumnRenamed("capture", "top_decile_capture"))
    row = row.join(both.agg(F.sum("p").alias("predicted_total"), F.sum("y").alias("realized_total"))).join(last.select(F.col("last").alias("__last")))
    return long_form(row, "clv", horizon, CLV_METRICS, [_not_elapsed(cutoff + timedelta(days=horizon)), _too_few()])


def realized_credit(scored: DataFrame, labels: DataFrame, last: DataFrame, cutoff: date) -> DataFrame:
    """``scored`` (acc_id and p10, p50, p90 for 30 and 90 days), ``labels`` (acc_id, usage_30d, usage_90d): a block a horizon.

    A horizon whose time has not come, or with too few accounts, has its own reason; the other one is still measured.
    """
    both = keep(scored.join(labels, "acc_id"))
    out = None
    for d in CREDIT_HORIZONS:
        p10, p50, p90, y = (F.col(c) for c in (f"p10_{d}d", f"p50_{d}d", f"p90_{d}d", f"usage_{d}d"))
        size, known = F.abs(p50) + F.abs(y), p10.isNotNull() & p90.isNotNull()
        row = both.where(p50.isNotNull() & y.isNotNull()).agg(
            F.count("*").alias("n"), F.avg(F.abs(p50 - y)).alias("mae"), F.avg(F.when(size > 0, 2 * F.abs(p50 - y) / size).otherwise(0.0)).alias("smape"),
            F.avg(F.greatest(0.5 * (y - p50), -0.5 * (y - p50))).alias("pinball_p50"),
            F.when(F.count_if(known) >= LEAST_ROWS, F.avg(F.when(known, ((y >= p10) & (y <= p90)).cast("int")))).alias("coverage_p10_p90"),
        ).join(last.select(F.col("last").alias("__last")))
        one = long_form(row, "credit", d, ["n", "mae", "smape", "pinball_p50", "coverage_p10_p90"], [_not_elapsed(cutoff + timedelta(days=d)), _too_few()])
        out = one if out is None else out.unionByName(one)
    return out


def urgent_topup(rows: DataFrame, estimated: str, days: str, observed: str, limit: int = 14) -> DataFrame:
    """Precision and recall of the alert that an account must top up within ``limit`` days; censored rows are not urgent."""
    said = F.coalesce(F.col(estimated) <= limit, F.lit(False))
    true = F.coalesce((F.col(observed) == 1) & (F.col(days) <= limit), F.lit(False))
    n = rows.agg(F.count_if(said & true).alias("tp"), F.count_if(said).alias("flagged"), F.count_if(true).alias("actual"))
    return n.select(F.round(F.try_divide("tp", "flagged"), 4).alias("precision"), F.round(F.try_divide("tp", "actual"), 4).alias("recall"), "actual", "flagged")
