"""Reports over scored outputs: counts, matrices, monthly series, filtered and sorted pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import column_quantiles
from tidemark.functions.scalars import month_of
from tidemark.functions.storage import keep
from tidemark.operators.features import day, pit_payments, pit_usage

#: Columns that outputs may be sorted by.
SORTABLE = ["acc_id", "churn_probability", "predicted_clv", "revenue_at_risk", "priority_score", "priority_rank", "days_to_topup", "usage_30d", "stage", "segment", "value_tier"]
PAGE_SIZE, LARGEST_PAGE, EXPORT_ROWS = 8, 200, 20_000


def filled_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows per value, zero for values that do not occur."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def run_scalars(out: DataFrame) -> DataFrame:
    """Six measures of a run in one aggregation."""
    active = F.col("stage").startswith("Active")
    total = lambda value, cond: F.round(F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0)), 2)
    return out.agg(
        F.count("*").alias("total"), F.count("churn_probability").alias("eligible"), total("revenue_at_risk", F.col("stage") == "Active Paid").alias("expected_at_risk"),
        total("predicted_clv", F.col("risk_level").isin("high", "critical")).alias("high_risk_exposure"), total("usage_30d", active).alias("demand_30d"), F.count_if(F.col("days_to_topup") <= 7).alias("topup_due_7d"),
    )


def value_risk_matrix(out: DataFrame) -> DataFrame:
    kept = out.where(F.col("value_tier").isNotNull() & F.col("risk_level").isNotNull())
    zero = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return kept.groupBy("value_tier", "risk_level").agg(F.count("*").alias("n"), zero("predicted_clv").alias("clv"), zero("revenue_at_risk").alias("at_risk"))


def notable_cohorts(out: DataFrame, n: int = 6) -> DataFrame:
    return value_risk_matrix(out).orderBy(F.desc("at_risk"), "value_tier", "risk_level").limit(n)


def dashboard_overview(out: DataFrame) -> DataFrame:
    return value_risk_matrix(out).groupBy("value_tier").agg(F.sum("n").alias("n"), F.round(F.sum("clv"), 2).alias("clv"), F.sum(F.when(F.col("risk_level").isin("high", "critical"), F.col("n")).otherwise(0)).alias("n_at_risk"))


def segment_summary(out: DataFrame) -> DataFrame:
    rows = out.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("predicted_clv"), F.lit(0.0)), 2).alias("clv"), F.round(F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)), 2).alias("at_risk"), F.count_if(F.col("urgency") == "critical").alias("urgent"))
    total = rows.agg(F.sum("n").alias("__all"))
    return rows.join(F.broadcast(total)).select("segment", "n", "clv", "at_risk", "urgent", F.round(F.col("n") * 100.0 / F.col("__all"), 2).alias("percent"))


def outputs_filtered(out: DataFrame, id_part: str | None = None, equal: dict[str, str] | None = None, flags: dict[str, bool] | None = None) -> DataFrame:
    """All the given conditions together; ``id_part`` is a substring of the account."""
    if id_part:
        out = out.where(F.col("acc_id").cast("string").contains(id_part))
    for column, value in {**(equal or {}), **(flags or {})}.items():
        out = out.where(F.col(column) == value)
    return out


def outputs_sorted(out: DataFrame, by: str = "priority_rank", descending: bool = False) -> list[Column]:
    """The order of a listed column, nulls last, ties by account."""
    if by not in SORTABLE:
        raise ValueError(f"not a column to sort by: {by}")
    return [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), F.col("acc_id").asc()]


def outputs_page(out: DataFrame, page: int = 1, size: int = PAGE_SIZE, by: str = "priority_rank", descending: bool = False) -> DataFrame:
    size = max(1, min(size, LARGEST_PAGE))
    return out.orderBy(*outputs_sorted(out, by, descending)).offset((max(1, page) - 1) * size).limit(size)


def page_with_total(out: DataFrame, page: int = 1, size: int = PAGE_SIZE, by: str = "priority_rank", descending: bool = False) -> DataFrame:
    """A page's rows, each with ``total``: how many rows all pages have. A page behind the last one has none."""
    total = out.agg(F.count("*").alias("total"))
    return outputs_page(out, page, size, by, descending).join(F.broadcast(total))  # one row


def monthly_value(payments: DataFrame, cutoff: date) -> DataFrame:
    """Mean revenue of the twelve months before a cutoff (halves round up), that of the last one, and how many they are."""
    months = monthly_revenue(payments, cutoff)
    return months.agg(F.floor(F.avg("revenue") + 0.5).cast("long").alias("avg_monthly_revenue"), F.max_by("revenue", "month").alias("last_month_revenue"), F.count("*").alias("months"))


def outputs_export(out: DataFrame, payments: DataFrame, cutoff: date) -> DataFrame:
    """Scored outputs under the names of the export file, with purchases and revenue before the cutoff."""
    bought = pit_payments(payments, cutoff).groupBy("acc_id").agg(F.count("*").alias("n_purchases"), F.sum("amount").alias("total_revenue"))
    names = {
        "acc_id": "acc_id", "stage": "lifecycle_stage", "sub_stage": "sub_stage", "segment": "segment", "churn_probability": "churn_probability", "risk_level": "churn_risk_level",
        "predicted_clv": "predicted_clv_6m", "value_tier": "customer_value_tier", "revenue_at_risk": "revenue_at_risk", "urgency": "credit_urgency_level", "days_to_topup": "estimated_days_until_topup",
        "usage_30d": "predicted_credit_usage_30d", "usage_90d": "predicted_credit_usage_90d", "days_since_last_activity": "days_since_last_activity", "n_purchases": "n_purchases",
        "total_revenue": "total_revenue", "priority_score": "priority_score", "priority_rank": "priority_rank", "ever_paid": "ever_paid", "usage_trend": "usage_trend", "output_status": "output_status",
    }
    rows = out.withColumn("usage_90d", F.bround(F.col("usage_30d") * 3, 2)).join(bought, "acc_id", "left")
    rows = rows.withColumns({"n_purchases": F.coalesce("n_purchases", F.lit(0)), "total_revenue": F.bround(F.coalesce("total_revenue", F.lit(0.0)), 2)})
    return rows.select(*[F.col(old).alias(new) for old, new in names.items()])


def month_spine(frame: DataFrame, cutoff: date, months: int = 12) -> DataFrame:
    """The months before the cutoff's month."""
    first = F.add_months(F.trunc(day(cutoff), "month"), -months)
    return frame.sparkSession.range(1).select(F.explode(F.sequence(first, F.add_months(first, months - 1), F.expr("interval 1 month"))).alias("month"))


def monthly_revenue(payments: DataFrame, cutoff: date, months: int = 12) -> DataFrame:
    sums = payments.where(F.col("payment_date") < day(cutoff)).groupBy(month_of(F.col("payment_date")).alias("month")).agg(F.sum("amount").alias("revenue"))
    return F.broadcast(month_spine(payments, cutoff, months)).join(sums, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.round(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue"))


def usage_monthly(usage: DataFrame, acc_id: int, cutoff: date, months: int = 12) -> DataFrame:
    """One account's usage by month, channel and source."""
    own = pit_usage(usage, cutoff).where(F.col("acc_id") == acc_id)
    cells = [(c, s) for c in ("sms", "email") for s in ("bc", "api", "otp")]
    sums = own.groupBy(F.col("period").alias("month")).agg(*[F.sum(F.when((F.col("channel") == c) & (F.col("usage_source") == s), F.col("usage"))).alias(f"{c}_{s}") for c, s in cells])
    return F.broadcast(month_spine(usage, cutoff, months)).join(sums, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), *[F.coalesce(f"{c}_{s}", F.lit(0.0)).alias(f"{c}_{s}") for c, s in cells])


def payments_monthly(payments: DataFrame, acc_id: int) -> DataFrame:
    own = payments.where(F.col("acc_id") == acc_id)
    return own.groupBy(F.date_format("payment_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


def customer_payments(payments: DataFrame, per_account: int = 50) -> DataFrame:
    """The newest payments of every account."""
    order = Window.partitionBy("acc_id").orderBy(F.desc("payment_date"), F.desc("payment_uid"))
    return payments.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_account)


def customer_signals(payments: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    """Usage of the last three months against the three before, and revenue of the last six."""
    at = lambda months: F.add_months(F.trunc(day(cutoff), "month"), -months)
    total = lambda low, high: F.coalesce(F.sum(F.when((F.col("period") >= at(low)) & (F.col("period") < at(high)), F.col("usage"))), F.lit(0.0))
    used = pit_usage(usage, cutoff).groupBy("acc_id").agg(total(3, 0).alias("recent"), total(6, 3).alias("prior"))
    paid = pit_payments(payments, cutoff).where(F.col("payment_date") >= at(6)).groupBy("acc_id").agg(F.count("*").alias("n_payments"), F.sum("amount").alias("paid"))
    change = F.when(F.col("prior") > 0, F.round((F.col("recent") - F.col("prior")) * 100 / F.col("prior"), 2))
    return used.join(paid, "acc_id", "full").select("acc_id", F.coalesce("recent", F.lit(0.0)).alias("recent"), F.coalesce("prior", F.lit(0.0)).alias("prior"), change.alias("change_percent"), F.coalesce("n_payments", F.lit(0)).alias("n_payments"), F.round(F.coalesce("paid", F.lit(0.0)), 2).alias("paid"))


def cutoff_suggestion(payments: DataFrame, usage: DataFrame) -> DataFrame:
    """The latest day on which anything happened (months without usage count here) and its month."""
    last = payments.agg(F.max(F.col("payment_date").cast("date")).alias("p")).join(usage.agg(F.max("period").alias("u")))
    return last.select(F.greatest("p", "u").alias("latest")).select("latest", F.trunc("latest", "month").alias("suggested"))


def freshest(activity: DataFrame, source: str = "source_id") -> DataFrame:
    """The source with the latest activity."""
    return activity.groupBy(source).agg(F.max("at").alias("latest")).orderBy(F.desc("latest"), source).limit(1)


def stale(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs still under way that began too long ago."""
    return runs.where(F.col("status").isin("queued", "running") & (F.coalesce("started_at", "created_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def descriptive(payments: DataFrame, spine: DataFrame, cutoff: date) -> DataFrame:
    sums = pit_payments(payments, cutoff).groupBy("acc_id").agg(F.count("*").alias("n_purchases"), F.sum("amount").alias("revenue"), F.avg("amount").alias("mean"))
    return spine.join(sums, "acc_id", "left").select("acc_id", F.coalesce("n_purchases", F.lit(0)).alias("n_purchases"), F.round(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue"), F.round("mean", 6).alias("mean"))


def feature_stats(features: DataFrame, names: list[str]) -> DataFrame:
    """Null and zero rates, moments and quantiles of every feature, from the counts of its distinct values."""
    levels = {f"p{int(q * 100):02d}": q for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}
    features = keep(features.select(*names))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names]))
    moments = features.select(pairs.alias("p")).select("p.*").groupBy("feature").agg(
        F.round(F.avg(F.col("value").isNull().cast("int")), 6).alias("null_rate"), F.round(F.avg(F.coalesce(F.col("value") == 0, F.lit(False)).cast("int")), 6).alias("zero_rate"),
        F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"),
    )
    quantiles = column_quantiles(features, names, list(levels.values())).withColumnRenamed("column", "feature")
    return moments.join(quantiles, "feature", "left").select(*moments.columns, *[F.round(F.get("quantiles", F.lit(i)), 6).alias(n) for i, n in enumerate(levels)])


def pit_stats(payments: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    """What the cutoff kept and left out."""
    at = day(cutoff)
    part = lambda df, c, name: df.agg(F.max(F.when(F.col(c) < at, F.col(c).cast("date"))).alias("latest_kept"), F.count_if(F.col(c) >= at).alias("excluded")).select(F.lit(name).alias("source"), "latest_kept", "excluded")
    return part(payments, "payment_date", "payments").unionByName(part(usage, "period", "usage"))
