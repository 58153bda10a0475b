"""Queries of the analytics core and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import gates, labels, metrics, reports, scoring
from tidemark.sources import adapter

CUTOFF = date(1996, 1, 1)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: What a query adds to BASE, for queries made of others.
TAILS: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that engines that add in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Tables:
    """The three clean tables and what is built from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @cached_property
    def customers(self) -> DataFrame:
        return adapter.customers(self.spark, self.folder)

    @cached_property
    def payments(self) -> DataFrame:
        return adapter.payments(self.spark, self.folder)

    @cached_property
    def usage(self) -> DataFrame:
        return adapter.usage(self.spark, self.folder)

    @property
    def all(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.customers, self.payments, self.usage

    def features(self, cutoff: date = CUTOFF) -> DataFrame:
        return ft.features_all(*self.known(cutoff), cutoff)

    def known(self, cutoff: date) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The tables for what looks back only: usage is cut at the cutoff by the scan."""
        return self.customers, self.payments, adapter.usage(self.spark, self.folder, cutoff)

    def lifecycle(self) -> DataFrame:
        return ft.lifecycle(*self.known(CUTOFF), CUTOFF)

    def scores(self) -> DataFrame:
        return scoring.stand_in_scores(self.features(), self.lifecycle())

    def derived(self) -> DataFrame:
        return scoring.derived(self.scores())

    def outputs(self) -> DataFrame:
        return scoring.with_priority(self.derived())

    def churn(self) -> DataFrame:
        return labels.labels_churn(self.payments, self.usage, CUTOFF)

    def clv(self) -> DataFrame:
        return labels.labels_clv(self.payments, self.usage, CUTOFF)

    def judged(self) -> DataFrame:
        """Scored accounts with their churn label."""
        return self.scores().where(F.col("churn_probability").isNotNull()).join(self.churn(), "acc_id").select("acc_id", F.col("churn_probability").alias("p"), F.col("churned").alias("y"))

    def valued(self) -> DataFrame:
        return self.scores().where(F.col("predicted_clv").isNotNull()).join(self.clv(), "acc_id").select("acc_id", F.col("predicted_clv").alias("p"), F.col("future_revenue").alias("y"))


BASE = """
WITH customers AS (
  SELECT CAST(c_custkey AS INT) AS acc_id, c_acctbal AS credit_sms, lower(c_mktsegment) AS status_sms,
    CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 2 END AS credit_email, DATE '1994-01-01' + CAST(c_custkey % 1500 AS INT) AS expire_sms,
    CASE WHEN c_custkey % 2 = 0 THEN DATE '1994-01-01' + CAST(c_custkey % 900 AS INT) END AS expire_email,
    CASE WHEN c_custkey % 10 = 1 THEN 'gold' WHEN c_custkey % 2 = 1 THEN 'paid' END AS status_email,
    DATE '1994-01-01' + CAST(c_custkey % 730 AS INT) AS join_date,
    CASE WHEN c_custkey % 5 > 0 THEN CAST(DATE '1994-01-01' + CAST(c_custkey % 1000 AS INT) AS TIMESTAMP) END AS last_access, CAST(NULL AS TIMESTAMP) AS last_send
  FROM customer
), payments AS (
  SELECT CAST(o_custkey AS INT) AS acc_id, o_orderkey AS payment_uid, o_orderdate AS payment_date, o_totalprice AS amount,
    coalesce(q, 0) AS credit_add, CASE WHEN o_orderkey % 2 = 0 THEN 'sms' ELSE 'email' END AS credit_type
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
), usage AS (
  SELECT CAST(o_custkey AS INT) AS acc_id, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
    CASE WHEN l_linestatus = 'O' THEN 'sms' ELSE 'email' END AS channel,
    CASE l_returnflag WHEN 'A' THEN 'bc' WHEN 'N' THEN 'api' ELSE 'otp' END AS usage_source,
    sum(l_quantity) AS usage, CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS period
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5
), pp AS (SELECT * FROM payments WHERE payment_date < TIMESTAMP '1996-01-01'),
pu AS (SELECT * FROM usage WHERE period < DATE '1996-01-01'),
spine AS (SELECT acc_id FROM customers UNION SELECT acc_id FROM pp UNION SELECT acc_id FROM pu),
gaps AS (
  SELECT acc_id, date_diff('day', lag(payment_date) OVER (PARTITION BY acc_id ORDER BY payment_date, payment_uid), payment_date) AS gap FROM pp
), interval_mean AS (SELECT acc_id, avg(gap) AS m FROM gaps GROUP BY acc_id HAVING avg(gap) IS NOT NULL),
pay AS (
  SELECT acc_id, count(*) AS n, count(*) FILTER (payment_date >= TIMESTAMP '1995-07-05') AS n180, sum(amount) AS total,
    coalesce(sum(amount) FILTER (payment_date >= TIMESTAMP '1995-07-05'), 0) AS total180, avg(amount) AS mean, stddev_samp(amount) AS sd,
    max(payment_date) AS last_payment, sum(credit_add) AS added,
    coalesce(sum(credit_add) FILTER (payment_date >= TIMESTAMP '1995-07-05'), 0) AS added180 FROM pp GROUP BY acc_id
), use AS (
  SELECT acc_id, coalesce(sum(usage) FILTER (period >= DATE '1995-07-05'), 0) AS u180, coalesce(sum(usage) FILTER (period >= DATE '1995-10-03'), 0) AS u90,
    coalesce(sum(usage) FILTER (period >= DATE '1995-07-05' AND period < DATE '1995-10-03'), 0) AS prev90,
    coalesce(sum((month(period) - 7 - 2.5) * usage) FILTER (period >= DATE '1995-07-01'), 0) / 17.5 AS slope,
    count(DISTINCT period) FILTER (period >= DATE '1995-07-05' AND usage > 0) AS months, max(period) FILTER (usage > 0) AS last_usage, sum(usage) AS used,
    coalesce(sum(usage) FILTER (channel = 'sms'), 0) / sum(usage) AS sms, coalesce(sum(usage) FILTER (channel = 'email'), 0) / sum(usage) AS email,
    coalesce(sum(usage) FILTER (usage_source = 'bc'), 0) / sum(usage) AS bc, coalesce(sum(usage) FILTER (usage_source = 'api'), 0) / sum(usage) AS api,
    coalesce(sum(usage) FILTER (usage_source = 'otp'), 0) / sum(usage) AS otp FROM pu GROUP BY acc_id
), f0 AS (
  SELECT s.acc_id, CAST(date_diff('day', c.join_date, DATE '1996-01-01') AS DOUBLE) AS customer_age_days,
    CAST(date_diff('day', CAST(greatest(last_payment, last_usage) AS DATE), DATE '1996-01-01') AS DOUBLE) AS days_since_last_activity,
    CAST(date_diff('day', CAST(last_payment AS DATE), DATE '1996-01-01') AS DOUBLE) AS days_since_last_payment,
    CAST(date_diff('day', last_usage, DATE '1996-01-01') AS DOUBLE) AS days_since_last_usage,
    CAST(coalesce(n, 0) AS DOUBLE) AS payment_count_all, CAST(coalesce(n180, 0) AS DOUBLE) AS payment_count_180d,
    coalesce(total, 0) AS total_revenue_all, coalesce(total180, 0) AS total_revenue_180d, mean AS avg_transaction_value,
    m AS payment_interval_mean_days, CASE WHEN m > 0 THEN date_diff('day', CAST(last_payment AS DATE), DATE '1996-01-01') / m END AS payment_overdue_ratio,
    CASE WHEN abs(mean) > 0 THEN sd / abs(mean) END AS payment_amount_cv,
    coalesce(u180, 0) AS usage_total_180d, coalesce(u90, 0) AS usage_recent_90d, coalesce(prev90, 0) AS usage_prev_90d,
    coalesce(slope, 0) AS usage_slope_6m, CAST(coalesce(months, 0) AS DOUBLE) AS usage_active_months_180d, coalesce(months, 0) / 5.0 AS usage_consistency_ratio,
    coalesce(sms, 0) AS sms_usage_share, coalesce(email, 0) AS email_usage_share, coalesce(bc, 0) AS bc_usage_share, coalesce(api, 0) AS api_usage_share, coalesce(otp, 0) AS otp_usage_share,
    coalesce(sms * sms + email * email, 0) AS channel_hhi, CASE WHEN sms > 0 AND email > 0 THEN 1.0 ELSE 0.0 END AS multichannel_flag,
    coalesce(added180, 0) AS credit_added_180d, coalesce(added, 0) - coalesce(used, 0) AS credit_balance_proxy
  FROM spine s LEFT JOIN customers c USING (acc_id) LEFT JOIN pay USING (acc_id) LEFT JOIN use USING (acc_id) LEFT JOIN interval_mean USING (acc_id)
), f1 AS (
  SELECT *, CASE WHEN usage_prev_90d > 0 THEN (usage_recent_90d - usage_prev_90d) / usage_prev_90d WHEN usage_recent_90d > 0 THEN 1.0 ELSE 0.0 END AS chg,
    CASE WHEN usage_prev_90d > 0 THEN usage_recent_90d / usage_prev_90d WHEN usage_recent_90d > 0 THEN 1.0 ELSE 0.0 END AS act,
    (usage_recent_90d / 3 - usage_prev_90d / 3) / (usage_prev_90d / 3 + 1e-9) AS dec,
    CASE WHEN usage_recent_90d > 0 THEN credit_balance_proxy / (usage_recent_90d / 3) WHEN credit_balance_proxy > 0 THEN 24.0 ELSE 0.0 END AS run FROM f0
), features AS (
  SELECT * EXCLUDE (chg, act, dec, run), sign(chg) * ln(1 + abs(chg)) AS usage_change_90d_pct, sign(act) * ln(1 + abs(act)) AS usage_decay_ratio,
    greatest(0.0, least(run, 24.0)) AS credit_runway_months, sign(dec) * ln(1 + abs(dec)) AS credit_usage_decel FROM f1
), events_all AS (
  SELECT acc_id, CAST(payment_date AS DATE) AS at, true AS paid FROM payments UNION ALL SELECT acc_id, period, false FROM usage WHERE usage > 0
), lifecycle AS (
  SELECT acc_id, coalesce(ever_paid, false) AS ever_paid, coalesce(active, false) AS active, has AS has_activity,
    CASE WHEN active AND ever_paid THEN 'Active Paid' WHEN active THEN 'Active Free' WHEN has THEN 'Churned' ELSE 'Ghost' END AS stage,
    CASE WHEN active AND ever_paid THEN 'Active Paid' WHEN active THEN 'Active Free' WHEN has AND ever_paid THEN 'Churned Paid' WHEN has THEN 'Churned Free' ELSE 'Ghost' END AS sub_stage
  FROM (SELECT s.acc_id, bool_or(paid) AS ever_paid, bool_or(at >= DATE '1995-07-05') AS active, count(at) > 0 AS has
    FROM spine s LEFT JOIN (SELECT * FROM events_all WHERE at < DATE '1996-01-01') e USING (acc_id) GROUP BY 1)
), churn AS (
  SELECT acc_id, CAST(NOT later AS INT) AS churned FROM (SELECT acc_id, bool_or(at >= DATE '1995-07-05' AND at < DATE '1996-01-01') AS active,
    bool_or(at >= DATE '1996-01-01' AND at < DATE '1996-06-29') AS later FROM events_all GROUP BY 1)
  WHERE active AND acc_id IN (SELECT acc_id FROM pp)
), clv AS (
  SELECT acc_id, coalesce(r, 0) AS future_revenue, CAST(coalesce(r, 0) > 0 AS INT) AS purchased
  FROM (SELECT DISTINCT acc_id FROM events_all WHERE at >= DATE '1995-07-05' AND at < DATE '1996-01-01')
  LEFT JOIN (SELECT acc_id, sum(amount) AS r FROM payments WHERE payment_date >= TIMESTAMP '1996-01-01' AND payment_date < TIMESTAMP '1996-06-29' GROUP BY 1) USING (acc_id)
), raw_scores AS (
  SELECT acc_id, stage, sub_stage, ever_paid, days_since_last_activity, total_revenue_all, customer_age_days, usage_total_180d, usage_change_90d_pct, usage_recent_90d, credit_balance_proxy, total_revenue_180d, payment_count_all,
    1 / (1 + exp(-(coalesce(days_since_last_activity, 365.0) - 60) / 30)) AS p FROM features JOIN lifecycle USING (acc_id)
), scores AS (
  SELECT * EXCLUDE (p), CASE WHEN stage = 'Active Paid' THEN round_even(p, 4) END AS churn_probability,
    CASE WHEN stage LIKE 'Active%' THEN round_even(total_revenue_180d * (1 - p), 2) END AS predicted_clv,
    CASE WHEN stage LIKE 'Active%' THEN round_even(usage_recent_90d / 3, 2) END AS usage_30d, CASE WHEN stage LIKE 'Active%' THEN round_even(1 - p, 4) END AS p_alive FROM raw_scores
), kept AS (
  SELECT * REPLACE (CASE WHEN customer_age_days < 90 THEN NULL ELSE churn_probability END AS churn_probability) FROM scores
), pool AS (
  SELECT acc_id, (rank() OVER (ORDER BY predicted_clv) + (count(*) OVER (PARTITION BY predicted_clv) - 1) / 2.0) / count(*) OVER () AS value_share
  FROM kept WHERE stage LIKE 'Active%' AND predicted_clv > 0
), d0 AS (
  SELECT *, CASE WHEN value_share >= 0.9 THEN 'high' WHEN value_share >= 0.5 THEN 'mid' WHEN value_share IS NOT NULL THEN 'low' ELSE 'none' END AS value_tier,
    CASE WHEN churn_probability >= 0.8 THEN 'critical' WHEN churn_probability >= 0.6 THEN 'high' WHEN churn_probability >= 0.3 THEN 'medium' WHEN churn_probability IS NOT NULL THEN 'low' END AS risk_level,
    round_even(churn_probability * predicted_clv, 2) AS revenue_at_risk,
    CASE WHEN usage_30d > 0 THEN CAST(least(ceil(coalesce(credit_balance_proxy, 0) / (usage_30d / 30)), 365) AS BIGINT) END AS days_to_topup,
    CASE WHEN usage_total_180d <= 0 THEN 'no_usage' WHEN usage_change_90d_pct > 0.10 THEN 'growing' WHEN usage_change_90d_pct < -0.10 THEN 'declining' ELSE 'stable' END AS usage_trend
  FROM kept LEFT JOIN pool USING (acc_id)
), d1 AS (
  SELECT *, CASE WHEN stage LIKE 'Active%' THEN CASE WHEN days_to_topup <= 14 THEN 'critical' WHEN days_to_topup <= 30 THEN 'warning' WHEN days_to_topup <= 90 THEN 'monitor' ELSE 'stable' END END AS urgency,
    stage LIKE 'Active%' AND (coalesce(risk_level IN ('critical', 'high'), false) OR (value_tier IN ('high', 'mid') AND coalesce(p_alive < 0.2, false) AND coalesce(usage_change_90d_pct < -0.10, false))) AS needs_review,
    coalesce(risk_level IN ('critical', 'high'), false) OR coalesce(p_alive < 0.2, false) AS bad, coalesce(risk_level = 'medium', false) OR coalesce(p_alive < 0.5, false) AS warn FROM d0
), d2 AS (
  SELECT * EXCLUDE (bad, warn), CASE WHEN stage = 'Ghost' THEN 'Ghost' WHEN stage = 'Churned' AND ever_paid THEN 'Lapsed' WHEN stage = 'Churned' THEN 'Dormant'
    WHEN value_tier IN ('high', 'mid') AND bad THEN 'High-Value At-Risk' WHEN value_tier IN ('high', 'mid') AND warn THEN 'Mid-Value At-Risk' WHEN value_tier IN ('high', 'mid') THEN 'High-Value Stable'
    WHEN bad THEN 'Low-Value At-Risk' WHEN warn THEN 'Low-Value Watch' WHEN usage_change_90d_pct > 0.10 THEN 'Emerging' ELSE 'Stable' END AS segment FROM d1
), lg AS (SELECT acc_id, ln(1 + greatest(coalesce(revenue_at_risk, 0), 0)) AS l FROM d2),
outputs AS (
  SELECT d2.*, round_even((l - min(l) OVER ()) * 100 / greatest(max(l) OVER () - min(l) OVER (), 1e-9), 2) AS priority_score,
    row_number() OVER (ORDER BY list_position(['High-Value At-Risk', 'Mid-Value At-Risk', 'High-Value Stable', 'Emerging', 'Stable', 'Low-Value Watch', 'Low-Value At-Risk', 'Lapsed', 'Dormant', 'Ghost'], segment),
      coalesce(CASE WHEN segment IN ('High-Value At-Risk', 'Mid-Value At-Risk', 'Low-Value At-Risk', 'Low-Value Watch') THEN revenue_at_risk ELSE predicted_clv END, 0) DESC, acc_id) AS priority_rank
  FROM d2 JOIN lg USING (acc_id)
), judged AS (SELECT acc_id, churn_probability AS p, churned AS y FROM scores JOIN churn USING (acc_id) WHERE churn_probability IS NOT NULL),
valued AS (SELECT acc_id, predicted_clv AS p, future_revenue AS y FROM scores JOIN clv USING (acc_id) WHERE predicted_clv IS NOT NULL)
"""


def _live_features() -> str:
    """The feature part of BASE at a cutoff half a year later, under names that end in _live."""
    part = BASE[BASE.index("pp AS (") : BASE.index("), events_all AS")] + ")"
    for old, new in (("1996-01-01", "1996-07-01"), ("1995-07-05", "1996-01-03"), ("1995-10-03", "1996-04-02"), ("1995-07-01", "1996-01-01#"), ("month(period) - 7", "month(period) - 1")):
        part = part.replace(old, new)
    for name in ("pp", "pu", "spine", "gaps", "interval_mean", "pay", "use", "f0", "f1", "features"):
        part = re.sub(rf"\b{name}\b", f"{name}_live", part)
    return part.replace("#", "")


def query(sql: str | None = None, digits: int = 6):
    """Register a function of ``Tables`` under its name, with the SQL that follows BASE."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(Tables(spark, folder)), digits)
        if sql is not None:
            TAILS[f.__name__] = sql
            SQL[f.__name__] = re.sub(r"\bat\b", '"at"', BASE + sql)  # a keyword of DuckDB
        return f

    return put


def _r(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# Features.


@query(f"SELECT acc_id, {_r(ft.FEATURES)} FROM features")
def features_all(t: Tables) -> DataFrame:
    return t.features()


@query("SELECT acc_id, CAST(n AS DOUBLE) AS payment_count_all, CAST(n180 AS DOUBLE) AS payment_count_180d, round(total, 6) AS total_revenue_all, round(total180, 6) AS total_revenue_180d, round(mean, 6) AS avg_transaction_value FROM pay")
def feat_payment(t: Tables) -> DataFrame:
    return ft.feat_payment(t.payments, CUTOFF).select("acc_id", "payment_count_all", "payment_count_180d", "total_revenue_all", "total_revenue_180d", "avg_transaction_value")


@query("SELECT acc_id, round(u180, 6) AS usage_total_180d, round(u90, 6) AS usage_recent_90d, round(prev90, 6) AS usage_prev_90d, round(slope, 6) AS usage_slope_6m, CAST(months AS DOUBLE) AS usage_active_months_180d FROM use")
def feat_usage(t: Tables) -> DataFrame:
    return ft.feat_usage(t.usage, CUTOFF).select("acc_id", "usage_total_180d", "usage_recent_90d", "usage_prev_90d", "usage_slope_6m", "usage_active_months_180d")


@query("SELECT acc_id, round(sms, 6) AS sms_usage_share, round(email, 6) AS email_usage_share, round(sms * sms + email * email, 6) AS channel_hhi FROM use")
def feat_channel(t: Tables) -> DataFrame:
    return ft.feat_usage(t.usage, CUTOFF).select("acc_id", "sms_usage_share", "email_usage_share", "channel_hhi")


@query("SELECT acc_id, round(bc, 6) AS bc_usage_share, round(api, 6) AS api_usage_share, round(otp, 6) AS otp_usage_share FROM use")
def feat_source(t: Tables) -> DataFrame:
    return ft.feat_usage(t.usage, CUTOFF).select("acc_id", "bc_usage_share", "api_usage_share", "otp_usage_share")


@query("SELECT acc_id, days_since_last_activity FROM features WHERE days_since_last_activity IS NOT NULL")
def feat_activity(t: Tables) -> DataFrame:
    return t.features().select("acc_id", "days_since_last_activity").where(F.col("days_since_last_activity").isNotNull())


@query("SELECT acc_id, round(credit_added_180d, 6) AS credit_added_180d, round(credit_balance_proxy, 6) AS credit_balance_proxy, round(credit_runway_months, 6) AS credit_runway_months, round(credit_usage_decel, 6) AS credit_usage_decel FROM features")
def feat_credit(t: Tables) -> DataFrame:
    return t.features().select("acc_id", "credit_added_180d", "credit_balance_proxy", "credit_runway_months", "credit_usage_decel")


@query("SELECT acc_id, round(m, 6) AS payment_interval_mean_days FROM interval_mean")
def payment_intervals(t: Tables) -> DataFrame:
    return ft.payment_intervals(t.payments, CUTOFF)


@query("SELECT acc_id, round(slope, 6) AS usage_slope_6m FROM use")
def usage_slope_6m(t: Tables) -> DataFrame:
    return ft.feat_usage(t.usage, CUTOFF).select("acc_id", "usage_slope_6m")


@query("SELECT acc_id, payment_uid, amount FROM pp")
def pit_payments(t: Tables) -> DataFrame:
    return ft.pit_payments(t.payments, CUTOFF).select("acc_id", "payment_uid", "amount")


@query("SELECT acc_id, period, channel, usage_source, usage FROM pu")
def pit_usage(t: Tables) -> DataFrame:
    return ft.pit_usage(t.usage, CUTOFF).select("acc_id", "period", "channel", "usage_source", "usage")


@query("SELECT acc_id FROM spine")
def account_spine(t: Tables) -> DataFrame:
    return ft.account_spine(*t.all, CUTOFF)


@query("SELECT acc_id, at FROM events_all")
def activity_events(t: Tables) -> DataFrame:
    return labels.activity_events(t.payments, t.usage)


@query("SELECT acc_id, ever_paid, active, stage FROM lifecycle")
def lifecycle(t: Tables) -> DataFrame:
    return t.lifecycle().select("acc_id", "ever_paid", "active", "stage")


@query("SELECT v.stage, count(l.acc_id) AS n FROM (VALUES ('Active Paid'), ('Active Free'), ('Churned'), ('Ghost')) v(stage) LEFT JOIN lifecycle l USING (stage) GROUP BY 1")
def agg_lifecycle(t: Tables) -> DataFrame:
    return reports.filled_counts(t.lifecycle(), "stage", ["Active Paid", "Active Free", "Churned", "Ghost"])


def unpivoted(table: str = "features", keep: str = "acc_id") -> str:
    """feature, value (and ``keep``) of all features of a table, nulls too."""
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ft.FEATURES)
    return f"(SELECT * FROM (SELECT {keep}, {columns} FROM {table}) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(ft.FEATURES)})))"


@query(
    "SELECT feature, round(avg((value IS NULL)::INT), 6) AS null_rate, round(avg(coalesce(value = 0, false)::INT), 6) AS zero_rate, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, "
    + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    + f" FROM {unpivoted()} GROUP BY feature"
)
def feature_stats(t: Tables) -> DataFrame:
    return reports.feature_stats(t.features(), ft.FEATURES)


@query("SELECT 'payments' AS source, max(CAST(payment_date AS DATE)) FILTER (payment_date < TIMESTAMP '1996-01-01') AS latest_kept, count(*) FILTER (payment_date >= TIMESTAMP '1996-01-01') AS excluded FROM payments UNION ALL SELECT 'usage', max(period) FILTER (period < DATE '1996-01-01'), count(*) FILTER (period >= DATE '1996-01-01') FROM usage")
def pit_stats(t: Tables) -> DataFrame:
    return reports.pit_stats(t.payments, t.usage, CUTOFF)


# Labels and datasets.


@query("SELECT * FROM churn")
def labels_churn(t: Tables) -> DataFrame:
    return t.churn()


@query("SELECT acc_id FROM churn")
def churn_eligible(t: Tables) -> DataFrame:
    return t.churn().select("acc_id")


@query("SELECT acc_id, round(future_revenue, 6) AS future_revenue, purchased FROM clv")
def labels_clv(t: Tables) -> DataFrame:
    return t.clv()


@query("SELECT acc_id, coalesce(sum(usage) FILTER (period >= DATE '1996-01-01' AND period < DATE '1996-01-31'), 0) AS usage_30d, coalesce(sum(usage) FILTER (period >= DATE '1996-01-01' AND period < DATE '1996-03-31'), 0) AS usage_90d FROM spine LEFT JOIN usage USING (acc_id) GROUP BY 1")
def labels_credit(t: Tables) -> DataFrame:
    return labels.labels_credit(*t.all, CUTOFF)


@query("SELECT acc_id, CAST(date_diff('day', DATE '1996-01-01', CAST(at AS DATE)) AS DOUBLE) AS days_to_topup, CAST(at IS NOT NULL AS INT) AS observed FROM spine LEFT JOIN (SELECT acc_id, min(payment_date) AS at FROM payments WHERE payment_date >= TIMESTAMP '1996-01-01' GROUP BY 1) USING (acc_id)")
def labels_topup(t: Tables) -> DataFrame:
    return labels.labels_topup(*t.all, CUTOFF)


@query("SELECT acc_id, stage, CAST(stage = 'Active Paid' AS INT) AS churn, CAST(stage LIKE 'Active%' AS INT) AS clv, CAST(stage LIKE 'Active%' AS INT) AS credit FROM lifecycle")
def eligibility(t: Tables) -> DataFrame:
    return labels.eligibility(*t.all, CUTOFF)


@query("SELECT acc_id, churned, round(usage_total_180d, 6) AS usage_total_180d, round(total_revenue_180d, 6) AS total_revenue_180d FROM features JOIN churn USING (acc_id)")
def dataset_churn(t: Tables) -> DataFrame:
    return t.features().join(t.churn(), "acc_id").select("acc_id", "churned", "usage_total_180d", "total_revenue_180d")


@query("SELECT acc_id, round(future_revenue, 6) AS future_revenue, round(total_revenue_180d, 6) AS total_revenue_180d FROM features JOIN clv USING (acc_id)")
def dataset_clv(t: Tables) -> DataFrame:
    return t.features().join(t.clv(), "acc_id").select("acc_id", "future_revenue", "total_revenue_180d")


@query("SELECT acc_id, CASE WHEN acc_id % 10 < 6 THEN 'train' WHEN acc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, churned FROM churn")
def split_by_account(t: Tables) -> DataFrame:
    return labels.hashed_split(t.churn()).select("acc_id", "split", "churned")


@query("""SELECT acc_id, churned, CASE WHEN total < 25 OR r <= round(0.6 * n) THEN 'train' WHEN r <= round(0.8 * n) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY churned ORDER BY md5(acc_id || ':42'), acc_id) AS r, count(*) OVER (PARTITION BY churned) AS n, count(*) OVER () AS total FROM churn)""")
def split_stratified(t: Tables) -> DataFrame:
    return labels.split_stratified(t.churn(), "churned")


_SPLITS = "CASE WHEN acc_id % 10 < 6 THEN 'train' WHEN acc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM churn"


@query(f"""SELECT pair, (SELECT count(*) FROM (SELECT acc_id, list(split) AS l FROM (SELECT acc_id, {_SPLITS} UNION ALL SELECT acc_id, 'test' FROM churn WHERE acc_id % 7 = 0) GROUP BY 1)
  WHERE list_contains(l, x) AND list_contains(l, y)) AS shared FROM (VALUES ('train and validation', 'train', 'validation'), ('train and test', 'train', 'test'), ('validation and test', 'validation', 'test')) v(pair, x, y)""")
def split_contamination(t: Tables) -> DataFrame:
    """Every seventh account stands in the test split too."""
    rows = labels.hashed_split(t.churn()).select("acc_id", "split")
    return labels.split_contamination(rows.unionByName(rows.where("acc_id % 7 = 0").withColumn("split", F.lit("test"))))


@query("SELECT CAST(greatest(date_trunc('month', max(at) - 90), DATE '1996-01-01') AS DATE) AS cutoff FROM events_all")
def credit_cutoff(t: Tables) -> DataFrame:
    return labels.credit_cutoff(t.payments, t.usage, CUTOFF)


@query("SELECT acc_id, churned FROM (SELECT acc_id, churned FROM churn WHERE acc_id % 10 < 6 UNION ALL SELECT acc_id, purchased FROM clv WHERE acc_id NOT IN (SELECT acc_id FROM churn WHERE acc_id % 10 >= 6))")
def pooled_panel(t: Tables) -> DataFrame:
    return labels.pooled_panel(labels.hashed_split(t.churn()), t.clv().select("acc_id", F.col("purchased").alias("churned")))


@query("SELECT acc_id FROM spine WHERE acc_id NOT IN (SELECT acc_id FROM churn WHERE acc_id % 10 >= 6)")
def anti_held_out(t: Tables) -> DataFrame:
    held = labels.hashed_split(t.churn()).where("split <> 'train'").select("acc_id")
    return ft.account_spine(*t.all, CUTOFF).join(held, "acc_id", "left_anti")


@query("SELECT acc_id, round(total_revenue_180d, 6) AS total_revenue_180d FROM features WHERE acc_id IN (SELECT acc_id FROM churn)")
def semi_active_ids(t: Tables) -> DataFrame:
    return t.features().join(t.churn(), "acc_id", "left_semi").select("acc_id", "total_revenue_180d")


@query("SELECT CAST(c AS DATE) AS cutoff FROM (SELECT unnest([DATE '1997-11-01', DATE '1997-09-01', DATE '1997-07-01', DATE '1997-05-01', DATE '1997-03-01', DATE '1997-01-01']) AS c), (SELECT min(at) AS a, max(at) AS z FROM events_all) WHERE c - 365 >= a AND c + 180 <= z")
def backtest_cutoffs(t: Tables) -> DataFrame:
    return labels.backtest_cutoffs(t.payments, t.usage, date(1998, 1, 1))


@query("""SELECT c AS cutoff, count(*) AS active, count(*) FILTER (paid) AS active_paid, count(*) FILTER (paid AND NOT later) AS churned FROM (
  SELECT c, acc_id, bool_or(at >= c - 180 AND at < c) AS active, bool_or(at >= c) AS later, bool_or(paid AND at < c) AS paid
  FROM (SELECT unnest([DATE '1996-01-01', DATE '1996-04-01', DATE '1996-07-01']) AS c), events_all WHERE at < c + 180 GROUP BY 1, 2) WHERE active GROUP BY 1""")
def cutoff_profiles(t: Tables) -> DataFrame:
    return labels.cutoff_profiles(*t.all, [date(1996, 1, 1), date(1996, 4, 1), date(1996, 7, 1)])


@query("""SELECT c AS cutoff, count(*) FILTER (paid) AS active_paid FROM (
  SELECT c, acc_id, bool_or(at >= c - 180 AND at < c) AS active, bool_or(paid AND at < c) AS paid
  FROM (SELECT unnest([DATE '1996-01-01', DATE '1996-04-01', DATE '1996-07-01']) AS c), events_all WHERE at < c + 180 GROUP BY 1, 2) WHERE active GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def recommended_cutoff(t: Tables) -> DataFrame:
    profiles = labels.cutoff_profiles(*t.all, [date(1996, 1, 1), date(1996, 4, 1), date(1996, 7, 1)])
    return profiles.select("cutoff", "active_paid").orderBy(F.desc("active_paid"), F.desc("cutoff")).limit(1)


@query("""SELECT acc_id, count(*) - 1 AS frequency, CAST(max(d) - min(d) AS DOUBLE) AS recency, CAST(DATE '1996-01-01' - min(d) AS DOUBLE) AS age, round(coalesce(avg(a) FILTER (d > f), 0), 6) AS monetary
  FROM (SELECT acc_id, d, a, min(d) OVER (PARTITION BY acc_id) AS f FROM (SELECT acc_id, CAST(payment_date AS DATE) AS d, sum(amount) AS a FROM pp GROUP BY 1, 2)) GROUP BY 1""")
def rfm_summary(t: Tables) -> DataFrame:
    return labels.rfm_summary(t.payments, CUTOFF)


@query("SELECT acc_id, churned FROM (SELECT *, row_number() OVER (PARTITION BY churned ORDER BY md5(CAST(acc_id AS VARCHAR)), acc_id) AS r, count(*) OVER (PARTITION BY churned) AS n, count(*) OVER () AS total FROM churn) WHERE r <= ceil(50.0 * n / total) OR total <= 50")
def stratified_sample(t: Tables) -> DataFrame:
    return labels.stratified_sample(t.churn(), "churned", 50).select("acc_id", "churned")


# Rules.


@query("SELECT acc_id, value_tier FROM d0")
def value_tier(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "value_tier")


@query("SELECT acc_id, risk_level FROM d0")
def risk_level(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "risk_level")


@query("SELECT acc_id, churn_probability FROM kept")
def abstain(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "churn_probability")


@query("SELECT acc_id, revenue_at_risk FROM d0")
def revenue_at_risk(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "revenue_at_risk")


@query("SELECT acc_id, days_to_topup FROM d0")
def topup_days(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "days_to_topup")


@query("SELECT acc_id, urgency FROM d1")
def urgency(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "urgency")


@query("SELECT acc_id, usage_trend FROM d0")
def usage_trend(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "usage_trend")


@query("SELECT acc_id, needs_review FROM d1")
def needs_review(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "needs_review")


@query("SELECT acc_id, segment FROM d2")
def segments(t: Tables) -> DataFrame:
    return t.derived().select("acc_id", "segment")


@query("SELECT acc_id, priority_score FROM outputs")
def priority_score(t: Tables) -> DataFrame:
    return t.outputs().select("acc_id", "priority_score")


@query("SELECT acc_id, priority_rank FROM outputs")
def priority_rank(t: Tables) -> DataFrame:
    return t.outputs().select("acc_id", "priority_rank")


@query("""SELECT acc_id, round(CASE WHEN n >= 50 AND (payment_count_all >= greatest(f, 2) OR total_revenue_180d >= r) THEN greatest(predicted_clv, b) ELSE predicted_clv END, 6) AS blended
  FROM (SELECT acc_id, payment_count_all, total_revenue_180d, predicted_clv, total_revenue_180d / 2 AS b FROM scores WHERE predicted_clv IS NOT NULL),
  (SELECT quantile_cont(payment_count_all, 0.9) AS f, quantile_cont(total_revenue_180d, 0.9) AS r, count(*) AS n FROM scores WHERE predicted_clv IS NOT NULL)""")
def clv_tail_blend(t: Tables) -> DataFrame:
    rows = t.scores().where(F.col("predicted_clv").isNotNull()).withColumn("other", F.col("total_revenue_180d") / 2)
    return scoring.clv_tail_blend(rows, "payment_count_all", "total_revenue_180d", "predicted_clv", "other").select("acc_id", "blended")


# Reports.


def _enum(column: str, values: list[str]) -> str:
    rows = ", ".join(f"('{v}')" for v in values)
    return f"SELECT v.{column}, count(o.acc_id) AS n FROM (VALUES {rows}) v({column}) LEFT JOIN d1 o USING ({column}) GROUP BY 1"


RISKS, TRENDS, URGENCIES = ["low", "medium", "high", "critical"], ["growing", "stable", "declining", "no_usage"], ["critical", "warning", "monitor", "stable"]


@query(_enum("risk_level", RISKS))
def agg_risk(t: Tables) -> DataFrame:
    return reports.filled_counts(t.derived(), "risk_level", RISKS)


@query(_enum("usage_trend", TRENDS))
def agg_trend(t: Tables) -> DataFrame:
    return reports.filled_counts(t.derived(), "usage_trend", TRENDS)


@query(_enum("urgency", URGENCIES))
def agg_urgency(t: Tables) -> DataFrame:
    return reports.filled_counts(t.derived(), "urgency", URGENCIES)


@query("SELECT count(*) AS total, count(churn_probability) AS eligible, round(coalesce(sum(revenue_at_risk) FILTER (stage = 'Active Paid'), 0), 2) AS expected_at_risk, round(coalesce(sum(predicted_clv) FILTER (risk_level IN ('high', 'critical')), 0), 2) AS high_risk_exposure, round(coalesce(sum(usage_30d) FILTER (stage LIKE 'Active%'), 0), 2) AS demand_30d, count(*) FILTER (days_to_topup <= 7) AS topup_due_7d FROM d1")
def run_scalars(t: Tables) -> DataFrame:
    return reports.run_scalars(t.derived())


MATRIX = "SELECT value_tier, risk_level, count(*) AS n, round(coalesce(sum(predicted_clv), 0), 2) AS clv, round(coalesce(sum(revenue_at_risk), 0), 2) AS at_risk FROM d1 WHERE risk_level IS NOT NULL GROUP BY 1, 2"


@query(MATRIX)
def value_risk_matrix(t: Tables) -> DataFrame:
    return reports.value_risk_matrix(t.derived())


@query(f"SELECT * FROM ({MATRIX}) ORDER BY at_risk DESC, value_tier, risk_level LIMIT 6")
def notable_cohorts(t: Tables) -> DataFrame:
    return reports.notable_cohorts(t.derived())


@query(f"SELECT value_tier, CAST(sum(n) AS BIGINT) AS n, round(sum(clv), 2) AS clv, CAST(sum(CASE WHEN risk_level IN ('high', 'critical') THEN n ELSE 0 END) AS BIGINT) AS n_at_risk FROM ({MATRIX}) GROUP BY 1")
def dashboard_overview(t: Tables) -> DataFrame:
    return reports.dashboard_overview(t.derived())


@query("SELECT segment, count(*) AS n, round(coalesce(sum(predicted_clv), 0), 2) AS clv, round(coalesce(sum(revenue_at_risk), 0), 2) AS at_risk, count(*) FILTER (urgency = 'critical') AS urgent, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM d2 GROUP BY 1")
def segment_summary(t: Tables) -> DataFrame:
    return reports.segment_summary(t.derived())


OUT = "acc_id, segment, churn_probability, predicted_clv, priority_rank"
OUT_COLUMNS = OUT.split(", ")


@query(f"SELECT {OUT} FROM outputs WHERE contains(CAST(acc_id AS VARCHAR), '1') AND value_tier = 'high' AND needs_review = false")
def outputs_filtered(t: Tables) -> DataFrame:
    return reports.outputs_filtered(t.outputs(), "1", {"value_tier": "high"}, {"needs_review": False}).select(*OUT_COLUMNS)


@query(f"SELECT {OUT} FROM outputs ORDER BY churn_probability DESC NULLS LAST, acc_id LIMIT 200")
def outputs_sorted(t: Tables) -> DataFrame:
    return reports.outputs_page(t.outputs(), 1, 200, "churn_probability", descending=True).select(*OUT_COLUMNS)


@query(f"SELECT {OUT} FROM outputs ORDER BY priority_rank, acc_id LIMIT 8 OFFSET 16")
def outputs_page(t: Tables) -> DataFrame:
    return reports.outputs_page(t.outputs(), page=3).select(*OUT_COLUMNS)


@query(f"SELECT {OUT} FROM outputs ORDER BY priority_rank LIMIT 10")
def top_priority(t: Tables) -> DataFrame:
    return reports.outputs_page(t.outputs(), 1, 10).select(*OUT_COLUMNS)


@query("SELECT strftime(m, '%Y-%m') AS month, round(coalesce(r, 0), 2) AS revenue FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-01', INTERVAL 1 MONTH)) AS DATE) AS m) LEFT JOIN (SELECT CAST(date_trunc('month', payment_date) AS DATE) AS m, sum(amount) AS r FROM pp GROUP BY 1) USING (m)")
def monthly_revenue_12m(t: Tables) -> DataFrame:
    return reports.monthly_revenue(t.payments, CUTOFF)


CELLS = [(c, s) for c in ("sms", "email") for s in ("bc", "api", "otp")]


@query("SELECT strftime(m, '%Y-%m') AS month, " + ", ".join(f"coalesce(sum(usage) FILTER (channel = '{c}' AND usage_source = '{s}'), 0) AS {c}_{s}" for c, s in CELLS) + " FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-01', INTERVAL 1 MONTH)) AS DATE) AS m) LEFT JOIN (SELECT * FROM pu WHERE acc_id = 7) ON period = m GROUP BY 1")
def usage_monthly_12m(t: Tables) -> DataFrame:
    return reports.usage_monthly(t.usage, 7, CUTOFF)


@query("SELECT strftime(payment_date, '%Y-%m') AS month, count(*) AS n, round(sum(amount), 2) AS amount FROM payments WHERE acc_id = 7 GROUP BY 1")
def payments_monthly(t: Tables) -> DataFrame:
    return reports.payments_monthly(t.payments, 7)


@query("SELECT acc_id, payment_uid, place FROM (SELECT acc_id, payment_uid, CAST(row_number() OVER (PARTITION BY acc_id ORDER BY payment_date DESC, payment_uid DESC) AS INT) AS place FROM payments) WHERE place <= 5")
def customer_payments(t: Tables) -> DataFrame:
    return reports.customer_payments(t.payments, 5).select("acc_id", "payment_uid", "place")


@query("SELECT acc_id, payment_uid FROM (SELECT acc_id, payment_uid, row_number() OVER (PARTITION BY acc_id ORDER BY payment_date DESC, payment_uid DESC) AS r FROM payments) WHERE r = 1")
def dedup_latest(t: Tables) -> DataFrame:
    return reports.customer_payments(t.payments, 1).select("acc_id", "payment_uid")


@query("""SELECT acc_id, coalesce(a, 0) AS recent, coalesce(b, 0) AS prior, CASE WHEN b > 0 THEN round((a - b) * 100 / b, 2) END AS change_percent, coalesce(n, 0) AS n_payments, round(coalesce(s, 0), 2) AS paid
  FROM (SELECT acc_id, coalesce(sum(usage) FILTER (period >= DATE '1995-10-01'), 0) AS a, coalesce(sum(usage) FILTER (period >= DATE '1995-07-01' AND period < DATE '1995-10-01'), 0) AS b FROM pu GROUP BY 1)
  FULL JOIN (SELECT acc_id, count(*) AS n, sum(amount) AS s FROM pp WHERE payment_date >= TIMESTAMP '1995-07-01' GROUP BY 1) USING (acc_id)""")
def customer_signals(t: Tables) -> DataFrame:
    return reports.customer_signals(t.payments, t.usage, CUTOFF)


@query("SELECT greatest(p, u) AS latest, CAST(date_trunc('month', greatest(p, u)) AS DATE) AS suggested FROM (SELECT max(CAST(payment_date AS DATE)) AS p FROM payments), (SELECT max(period) AS u FROM usage)")
def cutoff_suggestion(t: Tables) -> DataFrame:
    return reports.cutoff_suggestion(t.payments, t.usage)


@query("SELECT acc_id, coalesce(n, 0) AS n_purchases, round(coalesce(total, 0), 2) AS revenue, round(mean, 6) AS mean FROM spine LEFT JOIN pay USING (acc_id)")
def descriptive(t: Tables) -> DataFrame:
    return reports.descriptive(t.payments, ft.account_spine(*t.all, CUTOFF), CUTOFF)


@query("SELECT channel, usage_source, count(*) AS n, round(sum(usage), 2) AS usage FROM usage GROUP BY 1, 2")
def channel_mix(t: Tables) -> DataFrame:
    return t.usage.groupBy("channel", "usage_source").agg(F.count("*").alias("n"), F.round(F.sum("usage"), 2).alias("usage"))


@query("SELECT credit_type, count(*) AS n, round(sum(credit_add), 2) AS added FROM payments GROUP BY 1")
def credit_type_mix(t: Tables) -> DataFrame:
    return t.payments.groupBy("credit_type").agg(F.count("*").alias("n"), F.round(F.sum("credit_add"), 2).alias("added"))


@query("SELECT usage_source AS source_id, max(period) AS latest FROM usage GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def freshest_source(t: Tables) -> DataFrame:
    return reports.freshest(t.usage.select(F.col("usage_source").alias("source_id"), F.col("period").alias("at")))


# Metrics.


@query("SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS roc_auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM judged)")
def roc_auc(t: Tables) -> DataFrame:
    return metrics.roc_auc(t.judged(), "p", "y")


@query("SELECT round(sum(s / tp * ctp / cn), 6) AS pr_auc FROM (SELECT s, sum(s) OVER () AS tp, sum(s) OVER (ORDER BY p DESC) AS ctp, sum(n) OVER (ORDER BY p DESC) AS cn FROM (SELECT p, sum(y) AS s, count(*) AS n FROM judged GROUP BY p))")
def pr_auc(t: Tables) -> DataFrame:
    return metrics.pr_auc(t.judged(), "p", "y")


@query("SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM judged)")
def confusion(t: Tables) -> DataFrame:
    return metrics.confusion(t.judged(), "p", "y")


@query("SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS skill FROM judged")
def brier(t: Tables) -> DataFrame:
    return metrics.brier(t.judged(), "p", "y")


@query("SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END), 6) AS log_loss FROM judged")
def log_loss(t: Tables) -> DataFrame:
    return metrics.log_loss(t.judged(), "p", "y")


_BIN = "least((" + " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in metrics.BINS[1:]) + "), 9)"


@query(f"SELECT {_BIN} AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM judged GROUP BY 1")
def calibration_curve(t: Tables) -> DataFrame:
    return metrics.calibration_curve(t.judged(), "p", "y")


@query(f"SELECT round(sum(abs(a - b) * n) / sum(n), 6) AS ece, round(max(abs(a - b)), 6) AS mce FROM (SELECT count(*) AS n, avg(p) AS a, avg(y) AS b FROM judged GROUP BY {_BIN})")
def ece(t: Tables) -> DataFrame:
    return metrics.ece(t.judged(), "p", "y")


@query("SELECT CAST(tile AS INT) AS tile, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate, round(avg(y) / (SELECT avg(y) FROM judged), 6) AS lift FROM (SELECT y, ntile(10) OVER (ORDER BY p DESC, acc_id) AS tile FROM judged) GROUP BY 1")
def lift_table(t: Tables) -> DataFrame:
    return metrics.lift_table(t.judged(), "p", "y", "acc_id")


@query("""SELECT round(chi2, 6) AS chi2, df, CASE WHEN df = 8 THEN round(exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8 + chi2 * chi2 * chi2 / 48), 6) END AS p_value FROM (
  SELECT sum((o - e) * (o - e) / nullif(n * m * (1 - m), 0)) AS chi2, count(*) - 2 AS df FROM (SELECT count(*) AS n, sum(y) AS o, sum(p) AS e, avg(p) AS m FROM (SELECT p, y, ntile(10) OVER (ORDER BY p, acc_id) AS tile FROM judged) GROUP BY tile))""")
def hosmer_lemeshow(t: Tables) -> DataFrame:
    return metrics.hosmer_lemeshow(t.judged(), "p", "y", "acc_id")


_TOP = "(SELECT * FROM judged QUALIFY row_number() OVER (ORDER BY p DESC, acc_id) <= ceil(count(*) OVER () * 0.1))"


@query(f"SELECT round((SELECT sum(y) FROM {_TOP}) / sum(y), 6) AS recall, round((SELECT avg(y) FROM {_TOP}) / avg(y), 6) AS lift FROM judged")
def recall_at_k(t: Tables) -> DataFrame:
    return metrics.at_k(t.judged(), "p", "y", 0.1, "acc_id")


@query("SELECT round((SELECT sum(y) FROM (SELECT y FROM valued QUALIFY row_number() OVER (ORDER BY p DESC, acc_id) <= ceil(count(*) OVER () * 0.1))) / sum(y), 6) AS capture FROM valued")
def top_decile_capture(t: Tables) -> DataFrame:
    return metrics.top_capture(t.valued(), "p", "y", "acc_id")


@query("SELECT round((SELECT sum(y) FROM (SELECT y FROM valued QUALIFY row_number() OVER (ORDER BY y DESC, acc_id) <= greatest(floor(count(*) OVER () * 0.01), 1))) / sum(y), 6) AS share FROM valued")
def top_share(t: Tables) -> DataFrame:
    return metrics.top_share(t.valued(), "y", "acc_id", 0.01)


@query("""SELECT round(corr(rp, ra), 6) AS spearman, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + greatest(y, 0)), 2))), 6) AS rmsle, round(avg(CASE WHEN abs(p) + abs(y) > 0 THEN 2 * abs(p - y) / (abs(p) + abs(y)) ELSE 0 END), 6) AS smape
  FROM (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ra FROM valued)""")
def clv_metrics(t: Tables) -> DataFrame:
    return metrics.regression_metrics(t.valued(), "p", "y").drop("n")


def _forecast(t: Tables) -> DataFrame:
    rows = t.scores().where(F.col("usage_30d").isNotNull()).join(labels.labels_credit(*t.all, CUTOFF).select("acc_id", F.col("usage_30d").alias("y")), "acc_id")
    return rows.select("acc_id", (F.col("usage_30d") * 0.5).alias("p10"), F.col("usage_30d").alias("p50"), (F.col("usage_30d") * 1.5 + 20).alias("p90"), "y")


_FORECAST = "(SELECT usage_30d * 0.5 AS p10, usage_30d AS p50, usage_30d * 1.5 + 20 AS p90, coalesce(y, 0) AS y FROM scores LEFT JOIN (SELECT acc_id, sum(usage) AS y FROM usage WHERE period >= DATE '1996-01-01' AND period < DATE '1996-01-31' GROUP BY 1) USING (acc_id) WHERE usage_30d IS NOT NULL)"


@query(f"SELECT round(avg(greatest(0.1 * (y - p10), -0.9 * (y - p10))), 6) AS pinball_low, round(avg(greatest(0.5 * (y - p50), -0.5 * (y - p50))), 6) AS pinball_mid, round(avg(greatest(0.9 * (y - p90), -0.1 * (y - p90))), 6) AS pinball_high, round(avg((y >= p10 AND y <= p90)::INT), 6) AS coverage, round(avg((p90 - p10) + 10 * greatest(p10 - y, 0) + 10 * greatest(y - p90, 0)), 6) AS winkler FROM {_FORECAST}", digits=6)
def credit_metrics(t: Tables) -> DataFrame:
    return metrics.interval_metrics(_forecast(t), "p10", "p50", "p90", "y")


@query(f"SELECT round(l[floor(i)::BIGINT + 1] + (i - floor(i)) * (l[ceil(i)::BIGINT + 1] - l[floor(i)::BIGINT + 1]), 4) AS margin FROM (SELECT list_sort(list(greatest(p10 - y, y - p90))) AS l, (count(*) - 1) * least(1.0, 0.8 * (1 + 1 / count(*))) AS i FROM {_FORECAST})", digits=4)
def conformal_margin(t: Tables) -> DataFrame:
    return metrics.conformal_margin(_forecast(t), "p10", "p90", "y")


@query("SELECT acc_id, round(greatest(0.0, least(1.0, coalesce(days_since_last_activity, 180.0) / 180)), 6) AS score FROM features")
def baseline_recency(t: Tables) -> DataFrame:
    return metrics.baseline_recency(t.features())


_SHARE = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / count(*) OVER ()"


@query(f"SELECT acc_id, round(({_SHARE.format('r')} + {_SHARE.format('f')} + {_SHARE.format('m')}) / 3, 6) AS score FROM (SELECT acc_id, coalesce(days_since_last_activity, 180.0) AS r, -payment_count_180d AS f, -total_revenue_180d AS m FROM features)")
def baseline_rfm(t: Tables) -> DataFrame:
    return metrics.baseline_rfm(t.features())


@query("SELECT acc_id, round(total_revenue_180d, 6) AS revenue, round(usage_recent_90d / 3, 6) AS usage_30d, round(usage_total_180d / 6, 6) AS usage_30d_long FROM features")
def baseline_carryover(t: Tables) -> DataFrame:
    return metrics.baseline_carryover(t.features())


@query("""SELECT acc_id, round(m, 4) AS predicted FROM (SELECT acc_id, (x > e[1])::INT + (x > e[2])::INT + (x > e[3])::INT AS b FROM (SELECT acc_id, total_revenue_180d AS x FROM features), (SELECT quantile_cont(total_revenue_180d, [0.25, 0.5, 0.75]) AS e FROM features JOIN clv USING (acc_id) WHERE acc_id % 10 < 6))
  LEFT JOIN (SELECT (x > e[1])::INT + (x > e[2])::INT + (x > e[3])::INT AS b, avg(y) AS m FROM (SELECT total_revenue_180d AS x, future_revenue AS y FROM features JOIN clv USING (acc_id) WHERE acc_id % 10 < 6), (SELECT quantile_cont(total_revenue_180d, [0.25, 0.5, 0.75]) AS e FROM features JOIN clv USING (acc_id) WHERE acc_id % 10 < 6) GROUP BY 1) USING (b)""", digits=4)
def baseline_segment_mean(t: Tables) -> DataFrame:
    rows = t.features().select("acc_id", "total_revenue_180d")
    train = rows.join(t.clv(), "acc_id").where(F.col("acc_id") % 10 < 6)
    return metrics.baseline_segment_mean(train, rows, "total_revenue_180d", "future_revenue")


_F2 = """(SELECT cut, round(coalesce(5.0 * tp / nullif(5.0 * tp + 4.0 * (pos - tp) + fp, 0), 0), 9) AS f FROM (
  SELECT cut, count(*) FILTER (p >= cut AND y = 1) AS tp, count(*) FILTER (p >= cut AND y = 0) AS fp, sum(y) AS pos
  FROM (SELECT DISTINCT unnest(list_transform(quantile_cont(p, [{}]), lambda q: round(q, 4))) AS cut FROM judged), judged GROUP BY cut))""".format(", ".join(str(q / 100) for q in range(2, 99)))


@query(f"SELECT cut, round(f, 6) AS f, round_even(l * 0.5, 2) AS medium, round_even(l, 2) AS high, round_even(l + 0.6 * (1 - l), 2) AS critical FROM (SELECT cut, f, greatest(0.05, least(0.95, cut)) AS l FROM {_F2} ORDER BY f DESC, cut LIMIT 1)")
def f2_threshold(t: Tables) -> DataFrame:
    """The F2 line and the risk bands around it."""
    return metrics.best_threshold(t.judged(), "p", "y").select("cut", "f", scoring.risk_bands(F.col("cut")).alias("b")).select("cut", "f", "b.medium", "b.high", "b.critical")


_PSI = f""", {_live_features()}, edges AS (
  SELECT feature, count(value) AS n, list_distinct(quantile_cont(value, [{", ".join(str(i / 10) for i in range(11))}])) AS e FROM {unpivoted()} GROUP BY feature
), cut AS (
  SELECT feature, CASE WHEN len(e) >= 3 AND n >= 10 THEN list_sort(e)[2:len(e) - 1] END AS inner_edges FROM edges
), bins AS (SELECT feature, unnest(range(0, len(inner_edges) + 1)) AS bin FROM cut WHERE inner_edges IS NOT NULL),
shares AS (
  SELECT side, feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY side, feature) AS share FROM (
    SELECT side, u.feature, len(list_filter(inner_edges, lambda x: x <= value)) AS bin FROM (
      SELECT 'e' AS side, feature, value FROM {unpivoted()} UNION ALL SELECT 'a', feature, value FROM {unpivoted("features_live")}) u JOIN cut USING (feature)
    WHERE value IS NOT NULL AND inner_edges IS NOT NULL) GROUP BY 1, 2, 3
), psi AS (
  SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (
    SELECT feature, bin, coalesce(x.share, 0) + 1e-6 AS e, coalesce(y.share, 0) + 1e-6 AS a FROM bins
    LEFT JOIN (SELECT * FROM shares WHERE side = 'e') x USING (feature, bin) LEFT JOIN (SELECT * FROM shares WHERE side = 'a') y USING (feature, bin)) GROUP BY feature
), drift AS (
  SELECT feature, coalesce(psi, 0) AS psi, CASE WHEN psi IS NULL THEN 'constant' WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'minor' ELSE 'major' END AS status FROM cut LEFT JOIN psi USING (feature)
)"""


@query(_PSI + " SELECT feature, round(psi, 6) AS psi, status FROM drift")
def psi_drift(t: Tables) -> DataFrame:
    return metrics.psi_drift(t.features(), t.features(date(1996, 7, 1)), ft.FEATURES)


@query(_PSI + " SELECT minor, major, round(largest, 6) AS largest, CASE WHEN major >= 2 THEN 'major' WHEN minor + major > 0 THEN 'minor' ELSE 'stable' END AS status FROM (SELECT count(*) FILTER (status = 'minor') AS minor, count(*) FILTER (status = 'major') AS major, max(psi) AS largest FROM drift)")
def overall_drift(t: Tables) -> DataFrame:
    return metrics.overall_drift(metrics.psi_drift(t.features(), t.features(date(1996, 7, 1)), ft.FEATURES))


_RANK = "rank() OVER (PARTITION BY feature ORDER BY {0}) + (count(*) OVER (PARTITION BY feature, {0}) - 1) / 2.0"


@query(f"SELECT feature, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 6) AS rho FROM (SELECT feature, {_RANK.format('value')} AS a, {_RANK.format('churned')} AS b FROM {unpivoted('(SELECT * FROM features JOIN churn USING (acc_id))', 'churned')} WHERE value IS NOT NULL) GROUP BY 1")
def leak_spearman_scan(t: Tables) -> DataFrame:
    return metrics.spearman_scan(t.features().join(t.churn(), "acc_id"), ft.FEATURES, "churned")


@query("SELECT acc_id, p, y FROM judged")
def realized_join(t: Tables) -> DataFrame:
    return t.judged()


# Gates.


def _row(check: str, severity: str, passed: str, value: str, source: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{severity}' AS severity, {passed} AS passed, round(CAST({value} AS DOUBLE), 6) AS value FROM {source}"


@query(_row("customer_acc_id_valid", "blocker", "n = 0", "n", "(SELECT count(*) AS n FROM (SELECT acc_id FROM customers UNION ALL SELECT NULL) WHERE acc_id IS NULL)"))
def gate_ids(t: Tables) -> DataFrame:
    dirty = t.customers.select("acc_id").unionByName(t.spark.createDataFrame([(None,)], "acc_id int"))
    return gates.gate_ids(dirty, "customer")


@query(_row("payment_date_valid", "blocker", "v <= 0.005", "v", "(SELECT 1.0 / (count(*) + 1) AS v FROM payments)"))
def gate_dates(t: Tables) -> DataFrame:
    return gates.gate_dates(t.payments.select("payment_date").unionByName(t.spark.createDataFrame([(None,)], "payment_date timestamp_ntz")), "payment_date")


@query(_row("usage_non_negative", "blocker", "n = 0", "n", "(SELECT 1 AS n)"))
def gate_non_negative(t: Tables) -> DataFrame:
    return gates.gate_non_negative(t.usage.select("usage").unionByName(t.spark.createDataFrame([(-1.0,)], "usage double")), "usage", gates.BLOCKER)


@query(_row("status_sms_allowed", "warning", "n = 0", "n", "(SELECT count(DISTINCT status_sms) AS n FROM customers WHERE status_sms NOT IN ('paid', 'free', 'active', 'inactive', 'trial', 'suspended', ''))"))
def gate_allowed_values(t: Tables) -> DataFrame:
    return gates.gate_allowed_values(t.customers, "status_sms", gates.ALLOWED["status"])


@query(_row("customer_duplicates", "blocker", "n = 0", "n", "(SELECT count(*) * 2 AS n FROM customers WHERE acc_id % 100 = 0)"))
def gate_duplicates(t: Tables) -> DataFrame:
    return gates.gate_duplicates(t.customers.unionByName(t.customers.where(F.col("acc_id") % 100 == 0)))


@query(_row("orphan_activity", "warning", "v <= 0.01", "v", "(SELECT avg((acc_id % 10 = 0)::INT) AS v FROM (SELECT DISTINCT acc_id FROM payments))"))
def gate_orphans(t: Tables) -> DataFrame:
    return gates.gate_orphans(t.customers.where(F.col("acc_id") % 10 != 0), t.payments)


@query(_row("duplicate_usage_sheets", "warning", "n = 0", "n", "(SELECT 1 AS n)"))
def gate_duplicate_sheets(t: Tables) -> DataFrame:
    bc = t.usage.where("channel = 'sms' and usage_source = 'bc'")
    return gates.gate_duplicate_sheets(t.usage.where("not (channel = 'sms' and usage_source = 'api')").unionByName(bc.withColumn("usage_source", F.lit("api"))))


@query(" UNION ALL ".join([_row("row_count", "blocker", "n = (SELECT count(*) FROM spine)", "n", "(SELECT count(*) AS n FROM d1)"), _row("range", "blocker", "n = 0", "n", "(SELECT count(*) AS n FROM d1 WHERE churn_probability NOT BETWEEN 0 AND 1)"), _row("null_rate", "blocker", "v <= 0.01", "v", "(SELECT coalesce(avg((churn_probability IS NULL)::INT), 0) AS v FROM d1 WHERE stage = 'Active Paid')")]))
def gate_output(t: Tables) -> DataFrame:
    return gates.gate_output(t.derived(), ft.account_spine(*t.all, CUTOFF))
