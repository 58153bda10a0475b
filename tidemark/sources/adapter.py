"""Customers, payments and monthly usage read from the star-schema tables of the test data.

Every reader prunes to the columns it needs. ``usage`` joins line items to orders on the order key; both sides are
large, so the join is left to AQE, which splits skewed partitions.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Every third account has a mail credit, every second a mail status, four of five a last access, none a last send."""
    key = F.col("c_custkey")
    start = F.lit("1994-01-01").cast("date")
    return table(spark, folder, "customer").select(
        key.cast("int").alias("acc_id"),
        F.lower("c_mktsegment").alias("status_sms"),
        F.col("c_acctbal").alias("credit_sms"),
        F.when(key % 3 == 0, F.col("c_acctbal") / 2).alias("credit_email"),
        F.date_add(start, (key % 1500).cast("int")).alias("expire_sms"),
        F.when(key % 2 == 0, F.date_add(start, (key % 900).cast("int"))).alias("expire_email"),
        F.when(key % 2 == 1, F.when(key % 10 == 1, "gold").otherwise("paid")).alias("status_email"),
        F.date_add(start, (key % 730).cast("int")).alias("join_date"),
        F.when(key % 5 > 0, F.date_add(start, (key % 1000).cast("int")).cast("timestamp_ntz")).alias("last_access"),
        F.lit(None).cast("timestamp_ntz").alias("last_send"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    added = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("credit_add"))
    orders = table(spark, folder, "orders")
    return orders.join(added, orders["o_orderkey"] == added["l_orderkey"], "left").select(
        F.col("o_custkey").cast("int").alias("acc_id"),
        F.col("o_orderkey").alias("payment_uid"),
        F.col("o_orderdate").alias("payment_date"),
        F.col("o_totalprice").alias("amount"),
        F.coalesce("credit_add", F.lit(0.0)).alias("credit_add"),
        F.when(F.col("o_orderkey") % 2 == 0, "sms").otherwise("email").alias("credit_type"),
    )


def period_of(year: Column, month: Column) -> Column:
    """First day of a month; null where the month does not exist (make_date would raise)."""
    return F.try_to_date(F.format_string("%04d-%02d-01", year, month), "yyyy-MM-dd")


def month_after(day: date) -> date:
    """The first day that no month begun before ``day`` holds."""
    last = day - timedelta(days=1)
    return date(last.year + last.month // 12, last.month % 12 + 1, 1)


def usage(spark: SparkSession, folder: str, before: date | None = None) -> DataFrame:
    """Monthly sums; with ``before`` those of months that begin before it.

    A filter on ``period`` reaches below the aggregation and the join, but no further, as it is a truncated date; ``before``
    is a plain comparison of the ship date, which the scan takes.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", "l_linestatus", "l_returnflag")
    if before is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(month_after(before).isoformat()).cast("timestamp_ntz"))
    owner = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    source = F.when(F.col("l_returnflag") == "A", "bc").when(F.col("l_returnflag") == "N", "api").otherwise("otp")
    rows = lines.join(owner, lines["l_orderkey"] == owner["o_orderkey"]).select(
        F.col("o_custkey").cast("int").alias("acc_id"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("period"),
        F.when(F.col("l_linestatus") == "O", "sms").otherwise("email").alias("channel"), source.alias("usage_source"), "l_quantity",
    )
    sums = rows.groupBy("acc_id", "period", "channel", "usage_source").agg(F.sum("l_quantity").alias("usage"))
    return sums.select("acc_id", F.year("period").alias("year"), F.month("period").alias("month"), "channel", "usage_source", "usage", "period")


#: Columns of the clean tables and the order in which a scan returns them.
SCANS = {
    "customers": (["acc_id", "status_sms", "credit_sms", "credit_email", "expire_sms", "expire_email", "status_email", "join_date", "last_access", "last_send"], ["acc_id"]),
    "payments": (["acc_id", "payment_uid", "payment_date", "amount", "credit_add", "credit_type"], ["acc_id", "payment_date", "payment_uid"]),
    "usage": (["acc_id", "year", "month", "usage", "channel", "usage_source"], ["acc_id", "year", "month", "channel", "usage_source"]),
}


def scan(clean: DataFrame, name: str, source_id: str) -> DataFrame:
    """The rows of one source of a clean table (with source_id), its columns only, in the table's order.

    The filter reaches the scan; in a table partitioned by source only that source's files are read.
    """
    columns, order = SCANS[name]
    return clean.where(F.col("source_id") == source_id).select(*columns).orderBy(*order)
