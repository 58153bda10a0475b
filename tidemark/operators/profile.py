"""The profile of a training set: counts, ranges and distributions of its three clean tables, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import column_quantiles, union_all
from tidemark.functions.storage import keep

LEVELS = [0.25, 0.5, 0.75, 0.9, 0.95]


def _long(row: DataFrame, names: list[str]) -> DataFrame:
    """A one-row frame to metric, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return row.select(F.explode(pairs).alias("r")).select("r.metric", "r.value")


def _day(c: Column) -> Column:
    """A day as days since 1970."""
    return F.unix_date(c.cast("date"))


def profile_report(customers: DataFrame, payments: DataFrame, usage: DataFrame) -> DataFrame:
    """metric, value: row counts, customers by what they did, first and last days (since 1970), quantiles of accounts' totals.

    Accounts are aggregated once a source; quantiles come from ranks over range partitions.
    """
    known = customers.where(F.col("acc_id").isNotNull()).select("acc_id").distinct()
    paying = keep(payments.groupBy("acc_id").agg(F.count("payment_date").alias("payment_count"), F.sum("amount").alias("total_revenue")))
    using = keep(usage.groupBy("acc_id").agg(F.count_distinct("period").alias("usage_months"), F.sum("usage").alias("total_usage")))
    each = known.join(paying, "acc_id", "left").join(using, "acc_id", "left")
    paid, used = F.col("payment_count").isNotNull(), F.col("usage_months").isNotNull()
    did = {
        "customers": F.count("*"), "with_payment": F.count_if(paid), "with_usage": F.count_if(used), "with_any_activity": F.count_if(paid | used), "with_payment_and_usage": F.count_if(paid & used),
        "with_2plus_payments": F.count_if(F.col("payment_count") >= 2), **{f"with_{n}plus_usage_months": F.count_if(F.col("usage_months") >= n) for n in (3, 6, 12)},
    }
    parts = [_long(each.agg(*[v.alias(k) for k, v in did.items()]), list(did))]
    for name, df, column, days in (("customers", customers, "join_date", "join_date"), ("payments", payments, "payment_date", "payment_date"), ("usage", usage, "period", "usage_period")):
        row = df.agg(F.count("*").alias(f"rows_{name}"), F.min(_day(F.col(column))).alias(f"{days}_min"), F.max(_day(F.col(column))).alias(f"{days}_max"))
        parts.append(_long(row, [f"rows_{name}", f"{days}_min", f"{days}_max"]))
    for df, columns in ((paying, ["payment_count", "total_revenue"]), (using, ["usage_months", "total_usage"])):
        found = column_quantiles(df, columns, LEVELS)
        marks = F.array(*[F.struct(F.concat(F.col("column"), F.lit(f"_p{int(q * 100)}")).alias("metric"), F.get("quantiles", F.lit(i)).alias("value")) for i, q in enumerate(LEVELS)])
        parts.append(found.select(F.explode(marks).alias("r")).select("r.metric", "r.value"))
    return union_all(parts)
