"""Labels, eligibility, splits and panels around a cutoff."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import numbered_within
from tidemark.functions.scalars import elapsed_days
from tidemark.functions.storage import keep
from tidemark.operators.features import account_spine, day, lifecycle, pit_payments


def activity_events(payments: DataFrame, usage: DataFrame) -> DataFrame:
    """acc_id, at: every payment and every month with usage."""
    paid = payments.where(F.col("payment_date").isNotNull()).select("acc_id", F.col("payment_date").cast("date").alias("at"))
    return paid.unionByName(usage.where((F.col("usage") > 0) & F.col("period").isNotNull()).select("acc_id", F.col("period").alias("at"))).where(F.col("acc_id").isNotNull())


def _between(column: str, start: date, end: date):
    return (F.col(column) >= day(start)) & (F.col(column) < day(end))


def labels_churn(payments: DataFrame, usage: DataFrame, cutoff: date, horizon: int = 180, window: int = 180) -> DataFrame:
    """Accounts active in the window and paying before the cutoff; churned: 1 if nothing happens within the horizon."""
    seen = activity_events(payments, usage).groupBy("acc_id").agg(
        F.bool_or(_between("at", cutoff - timedelta(days=window), cutoff)).alias("active"), F.bool_or(_between("at", cutoff, cutoff + timedelta(days=horizon))).alias("later")
    )
    paid = pit_payments(payments, cutoff).select("acc_id").distinct()
    return seen.where("active").join(paid, "acc_id", "left_semi").select("acc_id", (~F.col("later")).cast("int").alias("churned"))


def labels_clv(payments: DataFrame, usage: DataFrame, cutoff: date, horizon: int = 180, window: int = 180) -> DataFrame:
    active = activity_events(payments, usage).where(_between("at", cutoff - timedelta(days=window), cutoff)).select("acc_id").distinct()
    future = payments.where(_between("payment_date", cutoff, cutoff + timedelta(days=horizon))).groupBy("acc_id").agg(F.sum("amount").alias("revenue"))
    return active.join(future, "acc_id", "left").select("acc_id", F.coalesce("revenue", F.lit(0.0)).alias("future_revenue"), (F.coalesce("revenue", F.lit(0.0)) > 0).cast("int").alias("purchased"))


def usage_after(usage: DataFrame, cutoff: date) -> DataFrame:
    """acc_id, usage_30d, usage_90d of the accounts with usage in the 90 days from the cutoff on."""
    total = lambda days: F.coalesce(F.sum(F.when(_between("period", cutoff, cutoff + timedelta(days=days)), F.col("usage"))), F.lit(0.0))
    return usage.where(_between("period", cutoff, cutoff + timedelta(days=90))).groupBy("acc_id").agg(total(30).alias("usage_30d"), total(90).alias("usage_90d"))


def with_usage_after(accounts: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    """``accounts`` with usage_30d and usage_90d, zero where there was none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return accounts.join(usage_after(usage, cutoff), "acc_id", "left").select(*accounts.columns, zero("usage_30d"), zero("usage_90d"))


def labels_credit(customers: DataFrame, payments: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    return with_usage_after(account_spine(customers, payments, usage, cutoff), usage, cutoff)


def labels_topup(customers: DataFrame, payments: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    following = payments.where(F.col("payment_date") >= day(cutoff)).groupBy("acc_id").agg(F.min("payment_date").alias("at"))
    rows = account_spine(customers, payments, usage, cutoff).join(following, "acc_id", "left")
    return rows.select("acc_id", elapsed_days(F.col("at"), day(cutoff)).alias("days_to_topup"), F.col("at").isNotNull().cast("int").alias("observed"))


def eligibility(customers: DataFrame, payments: DataFrame, usage: DataFrame, cutoff: date) -> DataFrame:
    """At scoring time: churn for paying active accounts, value and credit for active ones."""
    stage = F.col("stage")
    active = stage.isin("Active Paid", "Active Free").cast("int")
    return lifecycle(customers, payments, usage, cutoff).select("acc_id", "stage", (stage == "Active Paid").cast("int").alias("churn"), active.alias("clv"), active.alias("credit"))


def _dealt(seed: int) -> Column:
    """A fixed shuffle of accounts that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.col("acc_id").cast("string"), F.lit(str(seed))))


def split_stratified(labelled: DataFrame, label: str, seed: int = 42, least: int = 25) -> DataFrame:
    """60/20/20 within every label, to the row, by the order of a hash; under ``least`` rows everything is for training.

    Places are counted by range partitions of (label, hash): no label is sorted in one task.
    """
    placed = keep(numbered_within(labelled, label, [_dealt(seed), F.col("acc_id")], "__at"))
    sizes = placed.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__all"))
    of_label = F.broadcast(sizes.join(F.broadcast(total)))
    at, n = F.col("__at"), F.col("__n")
    split = F.when((F.col("__all") < least) | (at <= F.round(0.6 * n)), "train").when(at <= F.round(0.8 * n), "validation").otherwise("test")
    return placed.join(of_label, F.col(label).eqNullSafe(F.col("__label"))).withColumn("split", split).drop("__at", "__n", "__all", "__label")


def hashed_split(labelled: DataFrame) -> DataFrame:
    """60/20/20 by the last digit of the account, which any engine can repeat."""
    digit = F.pmod("acc_id", F.lit(10))
    return labelled.withColumn("split", F.when(digit < 6, "train").when(digit < 8, "validation").otherwise("test"))


def pooled_panel(newest: DataFrame, older: DataFrame) -> DataFrame:
    """Training rows of the newest cutoff and of older ones, without accounts that are held out at the newest."""
    held = newest.where(F.col("split") != "train").select("acc_id").distinct()
    return newest.where(F.col("split") == "train").drop("split").unionByName(older.join(held, "acc_id", "left_anti"))


def split_contamination(split: DataFrame) -> DataFrame:
    """Per pair of splits, how many accounts stand in both; every pair has a row."""
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    held = split.groupBy("acc_id").agg(F.collect_set("split").alias("in"))
    both = [F.count_if(F.array_contains("in", a) & F.array_contains("in", b)).alias(f"{a}_{b}") for a, b in pairs]
    counts = F.array(*[F.struct(F.lit(f"{a} and {b}").alias("pair"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])
    return held.agg(*both).select(F.explode(counts).alias("r")).select("r.pair", "r.shared")


def backtest_cutoffs(payments: DataFrame, usage: DataFrame, newest: date, step: int = 2, most: int = 6, history: int = 365, horizon: int = 180) -> DataFrame:
    """Month starts every ``step`` months back that have enough history before and a full label window after."""
    span = activity_events(payments, usage).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    back = span.select("first", "last", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("i")).select("first", "last", F.add_months(F.trunc(day(newest), "month"), -step * F.col("i")).alias("cutoff"))
    return back.where((F.date_sub("cutoff", history) >= F.col("first")) & (F.date_add("cutoff", horizon) <= F.col("last"))).select("cutoff")


def stratified_sample(labelled: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows (and one more a label) that keep the shares of the labels: the first hashes of every label."""
    placed = keep(numbered_within(labelled, label, [F.md5(F.col("acc_id").cast("string")), F.col("acc_id")], "__at"))
    sizes = placed.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    of_label = F.broadcast(sizes.join(F.broadcast(sizes.agg(F.sum("__n").alias("__all")))))
    take = F.ceil(F.lit(float(most)) * F.col("__n") / F.col("__all"))
    ranked = placed.join(of_label, F.col(label).eqNullSafe(F.col("__label")))
    return ranked.where((F.col("__at") <= take) | (F.col("__all") <= most)).drop("__n", "__all", "__at", "__label")


def credit_cutoff(payments: DataFrame, usage: DataFrame, newest: date, horizon: int = 90) -> DataFrame:
    """The credit models' cutoff: the month start that leaves a full horizon, if that is later than the common cutoff."""
    last = activity_events(payments, usage).agg(F.max("at").alias("last"))
    own = F.trunc(F.date_sub("last", horizon), "month")
    return last.select(F.when(own > day(newest), own).otherwise(day(newest)).alias("cutoff"))


def cutoff_profiles(customers: DataFrame, payments: DataFrame, usage: DataFrame, cutoffs: list[date], horizon: int = 180, window: int = 180) -> DataFrame:
    """Populations and churn for several cutoffs in one pass: events joined to the (few) cutoffs they matter to."""
    at = payments.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff date")
    events = activity_events(payments, usage).join(F.broadcast(at), F.col("at") < F.date_add("cutoff", horizon))
    paid = payments.select("acc_id", F.col("payment_date").cast("date").alias("on")).join(F.broadcast(at), F.col("on") < F.col("cutoff")).select("acc_id", "cutoff").distinct().withColumn("paid", F.lit(True))
    seen = events.groupBy("cutoff", "acc_id").agg(F.bool_or((F.col("at") < F.col("cutoff")) & (F.col("at") >= F.date_sub("cutoff", window))).alias("active"), F.bool_or(F.col("at") >= F.col("cutoff")).alias("later"))
    known = seen.where("active").join(paid, ["cutoff", "acc_id"], "left")
    return known.groupBy("cutoff").agg(F.count("*").alias("active"), F.count_if("paid").alias("active_paid"), F.count_if(F.col("paid") & ~F.col("later")).alias("churned"))


def rfm_summary(payments: DataFrame, cutoff: date) -> DataFrame:
    """Frequency, recency and age in days and mean repeat value, on daily totals before the cutoff."""
    days = pit_payments(payments, cutoff).groupBy("acc_id", F.col("payment_date").cast("date").alias("on")).agg(F.sum("amount").alias("amount"))
    first = F.min("on").over(Window.partitionBy("acc_id"))
    days = days.withColumn("first", first)
    return days.groupBy("acc_id").agg(
        (F.count("*") - 1).alias("frequency"), F.datediff(F.max("on"), F.min("on")).cast("double").alias("recency"), F.datediff(day(cutoff), F.min("on")).cast("double").alias("age"),
        F.coalesce(F.avg(F.when(F.col("on") > F.col("first"), F.col("amount"))), F.lit(0.0)).alias("monetary"),
    )
