"""Point-in-time features: what was known of every account before a cutoff.

One aggregation per source (payments, usage), each by account and so partitioned alike, then joins on the account.
Filters on dates and the columns used reach the scans.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import activity_ratio, clipped, elapsed_days, months_apart, nullable_ratio, safe_change, safe_ratio, signed_log1p

FEATURES = [
    "customer_age_days", "days_since_last_activity", "days_since_last_payment", "days_since_last_usage",
    "payment_count_all", "payment_count_180d", "total_revenue_all", "total_revenue_180d",
    "avg_transaction_value", "payment_interval_mean_days", "payment_overdue_ratio", "payment_amount_cv",
    "usage_total_180d", "usage_recent_90d", "usage_prev_90d", "usage_change_90d_pct", "usage_decay_ratio",
    "usage_slope_6m", "usage_active_months_180d", "usage_consistency_ratio",
    "sms_usage_share", "email_usage_share", "bc_usage_share", "api_usage_share", "otp_usage_share",
    "channel_hhi", "multichannel_flag",
    "credit_added_180d", "credit_balance_proxy", "credit_runway_months", "credit_usage_decel",
]
#: Features that stay null where nothing is known; all others are zero there.
NULLABLE = {
    "customer_age_days", "days_since_last_activity", "days_since_last_payment", "days_since_last_usage",
    "avg_transaction_value", "payment_interval_mean_days", "payment_overdue_ratio", "payment_amount_cv",
}
SLOPE_MONTHS = 6


def day(d: date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def pit_payments(payments: DataFrame, cutoff: date) -> DataFrame:
    return payments.where(F.col("acc_id").isNotNull() & F.col("payment_date").isNotNull() & (F.col("payment_date") < day(cutoff).cast("timestamp_ntz")))


def pit_usage(usage: DataFrame, cutoff: date) -> DataFrame:
    return usage.where(F.col("acc_id").isNotNull() & F.col("period").isNotNull() & (F.col("period") < day(cutoff))).withColumn("usage", F.coalesce("usage", F.lit(0.0)))


def account_spine(customers: DataFrame, payments: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    """Every account that a customer row or anything before the cutoff names."""
    ids = [df.select("acc_id") for df in (customers, pit_payments(payments, cutoff), pit_usage(usage, cutoff))]
    return ids[0].union(ids[1]).union(ids[2]).where(F.col("acc_id").isNotNull()).distinct()


def payment_intervals(payments: DataFrame, cutoff: date) -> DataFrame:
    """Mean of the whole days between neighbouring payments."""
    order = Window.partitionBy("acc_id").orderBy("payment_date", "payment_uid")
    gaps = pit_payments(payments, cutoff).select("acc_id", elapsed_days(F.col("payment_date"), F.lag("payment_date").over(order)).alias("gap"))
    return gaps.groupBy("acc_id").agg(F.avg("gap").alias("payment_interval_mean_days")).where(F.col("payment_interval_mean_days").isNotNull())


def feat_payment(payments: DataFrame, cutoff: date) -> DataFrame:
    """All payment features and the payment side of credit, from one aggregation."""
    order = Window.partitionBy("acc_id").orderBy("payment_date", "payment_uid")
    rows = pit_payments(payments, cutoff).withColumn("gap", elapsed_days(F.col("payment_date"), F.lag("payment_date").over(order)))
    recent = F.col("payment_date") >= day(cutoff - timedelta(days=180)).cast("timestamp_ntz")
    sums = rows.groupBy("acc_id").agg(
        F.count("*").cast("double").alias("payment_count_all"), F.count_if(recent).cast("double").alias("payment_count_180d"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_revenue_all"), F.coalesce(F.sum(F.when(recent, F.col("amount"))), F.lit(0.0)).alias("total_revenue_180d"),
        F.avg("amount").alias("avg_transaction_value"), F.stddev_samp("amount").alias("__std"),
        F.avg("gap").alias("payment_interval_mean_days"), F.max("payment_date").alias("last_payment"), F.min("payment_date").alias("first_payment"),
        F.coalesce(F.sum("credit_add"), F.lit(0.0)).alias("__added"), F.coalesce(F.sum(F.when(recent, F.col("credit_add"))), F.lit(0.0)).alias("credit_added_180d"),
    )
    since = elapsed_days(day(cutoff), F.col("last_payment"))
    return (
        sums.withColumn("days_since_last_payment", since)
        .withColumn("payment_overdue_ratio", nullable_ratio(F.col("days_since_last_payment"), F.col("payment_interval_mean_days")))
        .withColumn("payment_amount_cv", nullable_ratio(F.col("__std"), F.col("avg_transaction_value")))
        .drop("__std")
    )


def month_starts(cutoff: date, days: int) -> int:
    """How many month starts lie in [cutoff - days, cutoff)."""
    at, n = cutoff - timedelta(days=days), 0
    for i in range(days):
        n += (at + timedelta(days=i)).day == 1
    return max(1, n)


def feat_usage(usage: DataFrame, cutoff: date) -> DataFrame:
    """All usage features: windows, trend, shares by channel and source, and the usage side of credit."""
    rows = pit_usage(usage, cutoff)
    since = lambda days: F.col("period") >= day(cutoff - timedelta(days=days))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("usage"))), F.lit(0.0))
    step = SLOPE_MONTHS - months_apart(day(cutoff), F.col("period"))  # 0 for the oldest of the months, 5 for the last
    middle, spread = (SLOPE_MONTHS - 1) / 2, sum((i - (SLOPE_MONTHS - 1) / 2) ** 2 for i in range(SLOPE_MONTHS))
    used = F.sum("usage")
    share = lambda column, value: safe_ratio(total(F.col(column) == value), F.coalesce(used, F.lit(0.0))).alias(f"{value}_usage_share")
    sums = rows.groupBy("acc_id").agg(
        total(since(180)).alias("usage_total_180d"), total(since(90)).alias("usage_recent_90d"), total(since(180) & ~since(90)).alias("usage_prev_90d"),
        (F.coalesce(F.sum(F.when(step >= 0, (step - middle) * F.col("usage"))), F.lit(0.0)) / spread).alias("usage_slope_6m"),
        F.count_distinct(F.when(since(180) & (F.col("usage") > 0), F.col("period"))).cast("double").alias("usage_active_months_180d"),
        F.max(F.when(F.col("usage") > 0, F.col("period"))).alias("last_usage"),
        share("channel", "sms"), share("channel", "email"), share("usage_source", "bc"), share("usage_source", "api"), share("usage_source", "otp"),
        F.coalesce(used, F.lit(0.0)).alias("__used"),
    )
    recent, before = F.col("usage_recent_90d"), F.col("usage_prev_90d")
    return (
        sums.withColumn("days_since_last_usage", elapsed_days(day(cutoff), F.col("last_usage")))
        .withColumn("usage_change_90d_pct", signed_log1p(safe_change(recent, before)))
        .withColumn("usage_decay_ratio", signed_log1p(activity_ratio(recent, before)))
        .withColumn("usage_consistency_ratio", F.col("usage_active_months_180d") / month_starts(cutoff, 180))
        .withColumn("channel_hhi", F.pow("sms_usage_share", F.lit(2)) + F.pow("email_usage_share", F.lit(2)))
        .withColumn("multichannel_flag", ((F.col("sms_usage_share") > 0) & (F.col("email_usage_share") > 0)).cast("double"))
    )


def features_all(customers: DataFrame, payments: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    """acc_id and the 31 features, for every account that any source knows.

    Full joins of the three aggregates have the accounts of ``account_spine``, and no source is read a second time.
    """
    joined = customers.where(F.col("acc_id").isNotNull()).groupBy("acc_id").agg(F.max("join_date").alias("join_date"))
    frame = joined.join(feat_payment(payments, cutoff), "acc_id", "full").join(feat_usage(usage, cutoff), "acc_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    recent, before = zero(F.col("usage_recent_90d")), zero(F.col("usage_prev_90d"))
    burn, balance = recent / 3, zero(F.col("__added")) - zero(F.col("__used"))
    frame = (
        frame.withColumn("customer_age_days", elapsed_days(day(cutoff), F.col("join_date")))
        .withColumn("days_since_last_activity", elapsed_days(day(cutoff), F.greatest(F.col("last_payment"), F.col("last_usage").cast("timestamp_ntz"))))
        .withColumn("credit_balance_proxy", balance)
        .withColumn("credit_runway_months", clipped(F.when(burn > 0, F.col("credit_balance_proxy") / burn).otherwise(F.when(F.col("credit_balance_proxy") > 0, 24.0).otherwise(0.0)), 0.0, 24.0))
        .withColumn("credit_usage_decel", signed_log1p((recent / 3 - before / 3) / (before / 3 + 1e-9)))
    )
    return frame.select("acc_id", *[F.col(c) if c in NULLABLE else zero(F.col(c)).alias(c) for c in FEATURES])


def lifecycle(customers: DataFrame, payments: DataFrame, usage: DataFrame, cutoff: date, window_days: int = 180) -> DataFrame:
    """acc_id, ever_paid, has_activity, active, stage, sub_stage: one aggregation over all that names an account."""
    paid, used = pit_payments(payments, cutoff), pit_usage(usage, cutoff)
    start = day(cutoff - timedelta(days=window_days))
    known = customers.where(F.col("acc_id").isNotNull()).select("acc_id", F.lit(None).cast("date").alias("at"), F.lit(False).alias("paid"))
    known = known.unionByName(paid.select("acc_id", F.col("payment_date").cast("date").alias("at"), F.lit(True).alias("paid")))
    known = known.unionByName(used.select("acc_id", F.when(F.col("usage") > 0, F.col("period")).alias("at"), F.lit(False).alias("paid")))
    off = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    rows = known.groupBy("acc_id").agg(off(F.bool_or("paid"), "ever_paid"), (F.count("at") > 0).alias("has_activity"), off(F.bool_or(F.col("at") >= start), "active"))
    stage = F.when(F.col("active") & F.col("ever_paid"), "Active Paid").when(F.col("active"), "Active Free").when(F.col("has_activity"), "Churned").otherwise("Ghost")
    ever = F.when(F.col("ever_paid"), "Churned Paid").otherwise("Churned Free")
    return rows.withColumn("stage", stage).withColumn("sub_stage", F.when(F.col("stage") == "Churned", ever).otherwise(F.col("stage")))
