"""The leakage suite: whether a model knows more than it may. Every check is a row (check, severity, passed, value).

Fits are Spark ML fits; ranks and correlations are those of ``metrics``. ``rows`` have acc_id, the features, the label and
a ``split`` (train, validation, test).
"""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import numbered_within, union_all
from tidemark.functions.storage import keep
from tidemark.operators import labels, metrics, models
from tidemark.operators.gates import BLOCKER, WARNING

# Fixed limits.
FEATURE_AUC, SHUFFLED_AUC, SUSPECT_DROP, SANE_AUC = 0.90, 0.07, 0.30, 0.97
FEATURE_SPEARMAN, SHUFFLED_SPEARMAN, SANE_SPEARMAN, SHUFFLES = 0.95, 0.10, 0.97, 5
#: Features that may give the label away.
RECENCY_SUSPECTS = ["days_since_last_activity", "days_since_last_usage", "days_since_last_payment", "payment_overdue_ratio"]


def shuffled(df: DataFrame, label: str, seed: int) -> DataFrame:
    """The rows with their labels dealt anew: two orders by hashes, joined place by place."""
    key = lambda salt: F.md5(F.concat_ws(":", F.col("acc_id").cast("string"), F.lit(f"{salt}:{seed}")))
    one = df.withColumn("__all", F.lit(0))
    places = numbered_within(one.drop(label), "__all", [key("row"), F.col("acc_id")], "__at").drop("__all")
    dealt = numbered_within(one.select("acc_id", "__all", label), "__all", [key("label"), F.col("acc_id")], "__at").select("__at", label)
    return places.join(dealt, "__at").drop("__at").select(*df.columns)


def _auc(scored: DataFrame, label: str) -> float:
    return metrics.roc_auc(scored, "probability", label).first()["roc_auc"] or 0.5


def _row(df: DataFrame, check: str, severity: str, passed: bool, value: float) -> DataFrame:
    return df.sparkSession.createDataFrame([(check, severity, bool(passed), float(value))], "check string, severity string, passed boolean, value double")


def lower_bound(values: list[float]) -> float:
    """Mean less two standard errors."""
    return statistics.fmean(values) - 2 * statistics.stdev(values) / len(values) ** 0.5


def feature_auc_scan(valid: DataFrame, names: list[str], label: str) -> DataFrame:
    """feature, auc of every single feature alone (the better of its two directions), all in one pass over counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in names]))
    counts = valid.select(pairs.alias("p"), F.col(label).alias("y")).groupBy("p.column", "p.value").agg(F.count("*").alias("ties"), F.sum("y").alias("hits"))
    ranked = keep(metrics.running(counts, ["column", "value"], ["ties"]))
    first = ranked.groupBy("column").agg(F.min("before_ties").alias("__first"))  # a row a feature
    r = F.sum(F.col("hits") * (F.col("before_ties") - F.col("__first") + (F.col("ties") + 1) / 2))
    sums = ranked.join(F.broadcast(first), "column").groupBy(F.col("column").alias("feature")).agg(r.alias("r"), F.sum("hits").alias("p"), F.sum("ties").alias("n"))
    auc = F.coalesce((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.expr("nullif(p * (n - p), 0)"), F.lit(0.5))
    return sums.select("feature", F.round(F.greatest(auc, 1 - auc), 4).alias("auc"))


def churn_suite(rows: DataFrame, names: list[str], label: str, fit=models.fit_churn, shuffles: int = SHUFFLES) -> DataFrame:
    rows = keep(rows)
    train, valid = rows.where("split = 'train'"), rows.where("split = 'validation'")
    worst = feature_auc_scan(valid, names, label).agg(F.max("auc")).first()[0]
    of_shuffled = [_auc(fit(keep(shuffled(train, label, i)), names, label)(valid), label) - 0.5 for i in range(shuffles)]
    full = _auc(fit(train, names, label)(valid), label)
    rest = [c for c in names if c not in RECENCY_SUSPECTS]
    drop = full - _auc(fit(train, rest, label)(valid), label)
    shared = labels.split_contamination(rows.select("acc_id", "split")).agg(F.sum("shared")).first()[0] or 0
    return union_all([
        _row(rows, "single_feature_auc", BLOCKER, worst <= FEATURE_AUC, worst), _row(rows, "target_shuffle", BLOCKER, lower_bound(of_shuffled) <= SHUFFLED_AUC, lower_bound(of_shuffled)),
        _row(rows, "suspect_drop", BLOCKER, drop <= SUSPECT_DROP, drop), _row(rows, "split_contamination", BLOCKER, shared == 0, shared), _row(rows, "score_sanity", WARNING, full <= SANE_AUC, full),
    ])


def value_suite(rows: DataFrame, names: list[str], label: str, fit=models.fit_value, shuffles: int = SHUFFLES) -> DataFrame:
    rows = keep(rows)
    train, valid = rows.where("split = 'train'"), rows.where("split = 'validation'")
    rho = lambda scored: metrics.regression_metrics(keep(scored), "predicted", label).first()["spearman"] or 0.0
    scan = metrics.spearman_scan(valid, names, label).agg(F.max(F.abs("rho"))).first()[0] or 0.0
    of_shuffled = [rho(fit(keep(shuffled(train, label, i)), names, label)(valid)) for i in range(shuffles)]
    full = abs(rho(fit(train, names, label)(valid)))
    shared = labels.split_contamination(rows.select("acc_id", "split")).agg(F.sum("shared")).first()[0] or 0
    return union_all([
        _row(rows, "split_contamination", BLOCKER, shared == 0, shared), _row(rows, "single_feature_spearman", WARNING, scan <= FEATURE_SPEARMAN, scan),
        _row(rows, "target_shuffle", BLOCKER, lower_bound(of_shuffled) <= SHUFFLED_SPEARMAN, lower_bound(of_shuffled)), _row(rows, "score_sanity", WARNING, full <= SANE_SPEARMAN, full),
    ])
