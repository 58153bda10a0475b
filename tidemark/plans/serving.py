"""Queries of what is served: pages with totals, scans of one source, monthly value, the whole profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import profile, reports
from tidemark.plans.catalog import CUTOFF, OUT, OUT_COLUMNS, Tables, query
from tidemark.sources import adapter


@query(f"SELECT {OUT}, (SELECT count(*) FROM outputs) AS total FROM outputs ORDER BY predicted_clv DESC NULLS LAST, acc_id LIMIT 20 OFFSET 20")
def outputs_page_total(t: Tables) -> DataFrame:
    """The second page of twenty by value, with the count of all rows."""
    return reports.page_with_total(t.outputs(), 2, 20, "predicted_clv", descending=True).select(*OUT_COLUMNS, "total")


@query("""SELECT CAST(floor(avg(r) + 0.5) AS BIGINT) AS avg_monthly_revenue, round(max(r) FILTER (m = DATE '1995-12-01'), 2) AS last_month_revenue, count(*) AS months FROM (SELECT m, round(coalesce(r, 0), 2) AS r
  FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-01', INTERVAL 1 MONTH)) AS DATE) AS m) LEFT JOIN (SELECT CAST(date_trunc('month', payment_date) AS DATE) AS m, sum(amount) AS r FROM pp GROUP BY 1) USING (m))""")
def monthly_value(t: Tables) -> DataFrame:
    return reports.monthly_value(t.payments, CUTOFF)


def _of_source(df: DataFrame) -> DataFrame:
    """Every fourth account belongs to one of four sources."""
    return df.withColumn("source_id", F.concat(F.lit("s"), (F.col("acc_id") % 4).cast("string")))


@query("SELECT acc_id, payment_uid, payment_date, amount, credit_add, credit_type FROM payments WHERE acc_id % 4 = 2")
def scan_payments(t: Tables) -> DataFrame:
    return adapter.scan(_of_source(t.payments), "payments", "s2")


@query("SELECT acc_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, usage, channel, usage_source FROM (SELECT *, year(period) AS year, month(period) AS month FROM usage) WHERE acc_id % 4 = 2")
def scan_usage(t: Tables) -> DataFrame:
    return adapter.scan(_of_source(t.usage), "usage", "s2")


@query("SELECT acc_id, status_sms, credit_sms, credit_email, expire_sms, expire_email, status_email, join_date, last_access, last_send FROM customers WHERE acc_id % 4 = 2")
def scan_customers(t: Tables) -> DataFrame:
    return adapter.scan(_of_source(t.customers), "customers", "s2")


_QUANTILES = " UNION ALL ".join(
    f"SELECT '{c}_p{int(q * 100)}', quantile_cont(CAST({c} AS DOUBLE), {q}) FROM {source}" for source, columns in (("paying", ("payment_count", "total_revenue")), ("using_", ("usage_months", "total_usage"))) for c in columns for q in profile.LEVELS
)
_DAYS = "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS DOUBLE)"
_ROWS = " UNION ALL ".join(
    f"SELECT 'rows_{name}', count(*)::DOUBLE FROM {name} UNION ALL SELECT '{days}_min', {_DAYS.format(f'min({c})')} FROM {name} UNION ALL SELECT '{days}_max', {_DAYS.format(f'max({c})')} FROM {name}"
    for name, c, days in (("customers", "join_date", "join_date"), ("payments", "payment_date", "payment_date"), ("usage", "period", "usage_period"))
)
_DID = {
    "customers": "true", "with_payment": "payment_count IS NOT NULL", "with_usage": "usage_months IS NOT NULL", "with_any_activity": "payment_count IS NOT NULL OR usage_months IS NOT NULL",
    "with_payment_and_usage": "payment_count IS NOT NULL AND usage_months IS NOT NULL", "with_2plus_payments": "payment_count >= 2", **{f"with_{n}plus_usage_months": f"usage_months >= {n}" for n in (3, 6, 12)},
}


@query(f"""SELECT metric, round(value, 6) AS value FROM (WITH paying AS (SELECT acc_id, count(payment_date) AS payment_count, sum(amount) AS total_revenue FROM payments GROUP BY 1),
  using_ AS (SELECT acc_id, count(DISTINCT period) AS usage_months, sum(usage) AS total_usage FROM usage GROUP BY 1),
  each AS (SELECT * FROM (SELECT DISTINCT acc_id FROM customers WHERE acc_id IS NOT NULL) LEFT JOIN paying USING (acc_id) LEFT JOIN using_ USING (acc_id))
  {" UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({v})::DOUBLE AS value FROM each" for k, v in _DID.items())} UNION ALL {_ROWS} UNION ALL {_QUANTILES})""")
def profile_report(t: Tables) -> DataFrame:
    """Every number of the profile: row counts, who did what, first and last days, quantiles of totals."""
    return profile.profile_report(*t.all)
