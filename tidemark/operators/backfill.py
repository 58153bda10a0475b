"""Measuring many runs in one plan: the metrics of ``outcomes`` within run ids of any number and size.

Ranks, places and running sums are taken over one order of (run, score): a run's own ones are those less what its first row has,
so a run that holds a third of all rows is dealt to many partitions, and a thousand small runs share some. What a run has as a
whole is one row a run, joined by its id. Which runs can be measured is decided by expressions; every run has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import running, with_position
from tidemark.functions.scalars import clipped, correlation
from tidemark.functions.storage import keep
from tidemark.operators.metrics import bin_of
from tidemark.operators.outcomes import CHURN_METRICS, CLV_METRICS, LEAST_ROWS


def places_within(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with run_id) with ``at``, the place 1..n within the run, and ``n``."""
    placed = keep(with_position(rows, [F.col("run_id"), *order], "__place"))
    of_run = placed.groupBy("run_id").agg(F.min("__place").alias("__first"), F.count("*").alias("n"))
    return placed.join(of_run, "run_id").withColumn("at", F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def steps_within(rows: DataFrame, value: str, **sums: Column) -> DataFrame:
    """run_id, ``value``, ties, before and, for every further sum, it and ``before_<name>``: the distinct values of each run."""
    counts = rows.groupBy("run_id", value).agg(F.count("*").alias("ties"), *[F.sum(c).alias(n) for n, c in sums.items()])
    names = ["ties", *sums]
    ranked = keep(running(counts, ["run_id", value], names))
    of_run = ranked.groupBy("run_id").agg(*[F.min_by(f"before_{t}", value).alias(f"__{t}") for t in names])
    own = ranked.join(of_run, "run_id").withColumns({f"before_{t}": F.col(f"before_{t}") - F.col(f"__{t}") for t in names})
    return own.drop(*[f"__{t}" for t in names]).withColumnRenamed("before_ties", "before")


def at_top(k: float, value: Column) -> Column:
    return F.when(F.col("at") <= F.ceil(F.col("n") * k), value)


def churn_rows(known: DataFrame, threshold: float) -> DataFrame:
    """One row a run with all churn metrics; ``known``: run_id, acc_id, p, y."""
    p, y = F.col("p"), F.col("y")
    hit, true = p >= threshold, y == 1
    safe, part = clipped(p, 1e-15, 1 - 1e-15), lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    placed = places_within(known, [p.desc(), F.col("acc_id")])
    tops = [c for k in (5, 10, 20) for c in (F.try_divide(F.sum(at_top(k / 100, y)), F.sum(y)).alias(f"recall_at_top{k}pct"), F.try_divide(F.avg(at_top(k / 100, y)), F.avg(y)).alias(f"lift_at_top{k}pct"))]
    sums = placed.groupBy("run_id").agg(
        *tops, F.count("*").alias("n"), F.avg(y).alias("positive_rate"), F.sum(y).alias("__pos"), F.avg(F.pow(p - y, F.lit(2))).alias("brier"), F.var_pop(y).alias("__base"),
        (-F.avg(F.when(true, F.log(safe)).otherwise(F.log(1 - safe)))).alias("log_loss"), F.count_if(hit & true).alias("__tp"), F.count_if(hit & ~true).alias("__fp"), F.count_if(~hit & true).alias("__fn"),
    )
    tp, fp, fn = F.col("__tp"), F.col("__fp"), F.col("__fn")
    sums = sums.withColumns({"bss": 1 - F.try_divide("brier", "__base"), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn)})
    bins = known.groupBy("run_id", bin_of(p).alias("bin")).agg(F.count("*").alias("m"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    errors = bins.groupBy("run_id").agg((F.sum(F.col("gap") * F.col("m")) / F.sum("m")).alias("ece"), F.max("gap").alias("mce"))
    steps = steps_within(known, "p", hits=y).join(sums.select("run_id", F.col("n").alias("__n"), "__pos"), "run_id")
    pairs = F.sum(F.col("hits") * (F.col("before") + (F.col("ties") + 1) / 2)) - F.max("__pos") * (F.max("__pos") + 1) / 2
    caught = F.when(F.col("hits") > 0, F.col("hits") / F.col("__pos") * (F.col("__pos") - F.col("before_hits")) / (F.col("__n") - F.col("before")))
    curves = steps.groupBy("run_id").agg(F.try_divide(pairs, F.max("__pos") * (F.max("__n") - F.max("__pos"))).alias("roc_auc"), F.sum(caught).alias("pr_auc"))
    return sums.join(errors, "run_id").join(curves, "run_id")


def value_rows(known: DataFrame) -> DataFrame:
    """One row a run with all value metrics; ``known``: run_id, acc_id, p, y."""
    p, y = F.col("p"), F.col("y")
    size = F.abs(p) + F.abs(y)
    logs = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(y, F.lit(0.0)))
    placed = places_within(known, [p.desc(), F.col("acc_id")])
    sums = placed.groupBy("run_id").agg(
        F.count("*").alias("n"), F.avg(F.abs(p - y)).alias("mae"), F.sqrt(F.avg(F.pow(p - y, F.lit(2)))).alias("rmse"), F.sqrt(F.avg(logs * logs)).alias("rmsle"),
        F.avg(F.when(size > 0, 2 * F.abs(p - y) / size).otherwise(0.0)).alias("smape"), F.try_divide(F.sum(at_top(0.1, y)), F.sum(y)).alias("top_decile_capture"),
        F.sum("p").alias("predicted_total"), F.sum("y").alias("realized_total"),
    )
    rank = lambda c: steps_within(known, c).select("run_id", c, (F.col("before") + (F.col("ties") + 1) / 2).alias(f"__rank_{c}"))
    ranked = known.join(rank("p"), ["run_id", "p"]).join(rank("y"), ["run_id", "y"])
    return sums.join(ranked.groupBy("run_id").agg(correlation("__rank_p", "__rank_y").alias("spearman")), "run_id")


def measured(rows: DataFrame, runs: DataFrame, last: DataFrame, names: list[str], reasons: list[tuple[Column, Column]]) -> DataFrame:
    """Every run of ``runs`` (run_id, cutoff, horizon) to rows of metric and value, or one row with the reason for none."""
    end = F.date_add("cutoff", F.col("horizon"))
    late = F.coalesce(F.col("__last") < end, F.lit(True)), F.concat(F.lit("horizon not elapsed: activity is needed through "), end.cast("string"))
    n = F.coalesce("n", F.lit(0))
    few = n < LEAST_ROWS, F.concat(F.lit("only "), n.cast("string"), F.lit(f" scored accounts are labelled, {LEAST_ROWS} are needed"))
    why = F.coalesce(*[F.when(F.coalesce(holds, F.lit(True)), text) for holds, text in (late, few, *reasons)])
    every = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    none = F.array(F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")))
    joined = runs.join(rows, "run_id", "left").join(F.broadcast(last.select(F.col("last").alias("__last"))))  # one row
    return joined.select("run_id", why.alias("skipped"), F.explode(F.when(why.isNull(), every).otherwise(none)).alias("m")).select("run_id", "m.metric", F.round("m.value", 6).alias("value"), "skipped")


def backfill_churn(scored: DataFrame, runs: DataFrame, last: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``scored``: run_id, acc_id, p (predicted) and y (0 or 1, what happened after the run's cutoff; null if not labelled)."""
    known = keep(scored.where(F.col("p").isNotNull() & F.col("y").isNotNull()).select("run_id", "acc_id", "p", "y"))
    pos = F.coalesce("__pos", F.lit(0))
    return measured(churn_rows(known, threshold), runs, last, CHURN_METRICS, [((pos == 0) | (pos == F.col("n")), F.lit("all labels are of one class"))])


def backfill_value(scored: DataFrame, runs: DataFrame, last: DataFrame) -> DataFrame:
    """``scored``: run_id, acc_id, p (predicted value) and y (realized value)."""
    known = keep(scored.where(F.col("p").isNotNull() & F.col("y").isNotNull()).select("run_id", "acc_id", "p", "y"))
    return measured(value_rows(known), runs, last, CLV_METRICS, [])


def unmeasured(runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """The runs without any evaluation, which a backfill is for."""
    return runs.join(evaluations.where(F.col("run_id").isNotNull()).select("run_id").distinct(), "run_id", "left_anti")


