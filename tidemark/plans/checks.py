"""Queries of realized outcomes and of gates, each with rows that pass and rows that fail, and their DuckDB SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import union_all
from tidemark.functions.storage import keep
from tidemark.operators import cleaning, gates, labels, leakage, metrics, models, outcomes
from tidemark.operators.features import FEATURES
from tidemark.plans import catalog
from tidemark.plans.catalog import CUTOFF, Tables, query
from tidemark.sources import adapter

# Realized outcomes.


def last_day(t: Tables) -> DataFrame:
    return labels.activity_events(t.payments, t.usage).agg(F.max("at").alias("last"))


def early(t: Tables) -> DataFrame:
    """As if nothing were known of what came after that day."""
    return t.spark.range(1).select(F.lit("1996-02-15").cast("date").alias("last"))


def _named(rows: dict[str, DataFrame]) -> DataFrame:
    return union_all([df.select(F.lit(name).alias("run"), "*") for name, df in rows.items()])


def _scalar(name: str, column: str) -> str:
    """One number of another query's SQL."""
    return f"(SELECT {column} FROM ({catalog.TAILS[name]}))"


def _top(k: int, what: str) -> str:
    top = f"(SELECT * FROM judged QUALIFY row_number() OVER (ORDER BY p DESC, acc_id) <= ceil(count(*) OVER () * {k / 100}))"
    return f"(SELECT {what}(y) FROM {top}) / (SELECT {what}(y) FROM judged)"


_CHURN = {
    "pr_auc": _scalar("pr_auc", "pr_auc"), "roc_auc": _scalar("roc_auc", "roc_auc"), **{c: _scalar("confusion", c) for c in ("f1", "precision", "recall")},
    "brier": _scalar("brier", "brier"), "bss": _scalar("brier", "skill"), "ece": _scalar("ece", "ece"), "mce": _scalar("ece", "mce"), "log_loss": _scalar("log_loss", "log_loss"),
    "positive_rate": "(SELECT avg(y) FROM judged)", "n": "(SELECT count(*) FROM judged)",
    **{f"recall_at_top{k}pct": _top(k, "sum") for k in (5, 10, 20)}, **{f"lift_at_top{k}pct": _top(k, "avg") for k in (5, 10, 20)},
}


def _measured(run: str, model: str, horizon: int, values: dict[str, str]) -> str:
    row = ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, v in values.items())
    return f"SELECT '{run}' AS run, '{model}' AS model, {horizon} AS horizon, metric, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS skipped FROM (SELECT {row}) UNPIVOT (value FOR metric IN ({', '.join(values)}))"


def _skipped(run: str, model: str, horizon: int, reason: str) -> str:
    return f"SELECT '{run}', '{model}', {horizon}, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), {reason}"


_LATE = "'horizon not elapsed: activity is needed through {}'"
_FEW = "(SELECT 'only ' || count(*) || ' scored accounts are labelled, 20 are needed' FROM {})"


@query(" UNION ALL ".join([_measured("whole", "churn", 180, _CHURN), _skipped("early", "churn", 180, _LATE.format("1996-06-29")), _skipped("few", "churn", 180, _FEW.format("(SELECT * FROM judged ORDER BY acc_id LIMIT 7)")), _skipped("one class", "churn", 180, "'all labels are of one class'")]))
def realized_churn(t: Tables) -> DataFrame:
    # Four runs over the same rows: scores, labels and the last day are computed once.
    scored, churn, last = keep(t.scores().select("acc_id", "churn_probability")), keep(t.churn()), keep(last_day(t))
    known = scored.where(F.col("churn_probability").isNotNull()).join(churn, "acc_id")
    few = known.orderBy("acc_id").limit(7).select("acc_id", "churn_probability")  # a run of seven accounts
    return _named({
        "whole": outcomes.realized_churn(scored, churn, last, CUTOFF), "early": outcomes.realized_churn(scored, churn, early(t), CUTOFF),
        "few": outcomes.realized_churn(few, churn, last, CUTOFF), "one class": outcomes.realized_churn(scored, churn.where("churned = 0"), last, CUTOFF),
    })


_CLV = {
    "n": "(SELECT count(*) FROM valued)", **{c: _scalar("clv_metrics", c) for c in ("spearman", "mae", "rmse", "rmsle", "smape")}, "top_decile_capture": _scalar("top_decile_capture", "capture"),
    "predicted_total": "(SELECT sum(p) FROM valued)", "realized_total": "(SELECT sum(y) FROM valued)",
}


@query(" UNION ALL ".join([_measured("whole", "clv", 180, _CLV), _skipped("early", "clv", 180, _LATE.format("1996-06-29"))]))
def realized_clv(t: Tables) -> DataFrame:
    scored, clv = t.scores().select("acc_id", "predicted_clv"), t.clv()
    return _named({"whole": outcomes.realized_clv(scored, clv, last_day(t), CUTOFF), "early": outcomes.realized_clv(scored, clv, early(t), CUTOFF)})


def forecasts(t: Tables) -> DataFrame:
    """Stand-in forecasts: p10, p50 and p90 for both horizons; one account in five has no interval."""
    rows = t.scores().where(F.col("usage_30d").isNotNull())
    out = [F.col("acc_id")]
    for d, times in ((30, 1.0), (90, 3.0)):
        p50 = F.col("usage_30d") * times
        whole = F.col("acc_id") % 5 > 0
        out += [F.when(whole, p50 * 0.5).alias(f"p10_{d}d"), p50.alias(f"p50_{d}d"), F.when(whole, p50 * 1.5 + 20).alias(f"p90_{d}d")]
    return rows.select(*out)


def _credit(run: str, days: int, times: float, until: str) -> str:
    row = f"""(SELECT x, x * 0.5 AS lo, x * 1.5 + 20 AS hi, y, acc_id % 5 > 0 AS k FROM (SELECT acc_id, usage_30d * {times}::DOUBLE AS x, coalesce(y, 0) AS y FROM scores
      LEFT JOIN (SELECT acc_id, sum(usage) AS y FROM usage WHERE period >= DATE '1996-01-01' AND period < DATE '{until}' GROUP BY 1) USING (acc_id) WHERE usage_30d IS NOT NULL))"""
    return _measured(run, "credit", days, {
        "n": f"(SELECT count(*) FROM {row})", "mae": f"(SELECT avg(abs(x - y)) FROM {row})", "smape": f"(SELECT avg(CASE WHEN abs(x) + abs(y) > 0 THEN 2 * abs(x - y) / (abs(x) + abs(y)) ELSE 0 END) FROM {row})",
        "pinball_p50": f"(SELECT avg(abs(y - x)) / 2 FROM {row})", "coverage_p10_p90": f"(SELECT avg((y >= lo AND y <= hi)::INT) FILTER (k) FROM {row})",
    })


@query(" UNION ALL ".join([_credit("whole", 30, 1.0, "1996-01-31"), _credit("whole", 90, 3.0, "1996-03-31"), _credit("early", 30, 1.0, "1996-01-31"), _skipped("early", "credit", 90, _LATE.format("1996-03-31"))]))
def realized_credit(t: Tables) -> DataFrame:
    scored, credit = forecasts(t), labels.labels_credit(*t.all, CUTOFF)
    return _named({"whole": outcomes.realized_credit(scored, credit, last_day(t), CUTOFF), "early": outcomes.realized_credit(scored, credit, early(t), CUTOFF)})


@query("""SELECT round(tp / nullif(flagged, 0), 4) AS precision, round(tp / nullif(actual, 0), 4) AS recall, actual, flagged FROM (
  SELECT count(*) FILTER (e AND a) AS tp, count(*) FILTER (e) AS flagged, count(*) FILTER (a) AS actual FROM (
    SELECT coalesce(days_to_topup <= 14, false) AS e, coalesce(days <= 14, false) AS a FROM d0
    LEFT JOIN (SELECT acc_id, date_diff('day', DATE '1996-01-01', CAST(min(payment_date) AS DATE)) AS days FROM payments WHERE payment_date >= TIMESTAMP '1996-01-01' GROUP BY 1) USING (acc_id)))""")
def urgent_topup(t: Tables) -> DataFrame:
    """The rule of balance and forecast as the alert, against who topped up."""
    topup = labels.labels_topup(*t.all, CUTOFF).withColumnRenamed("days_to_topup", "days")
    return outcomes.urgent_topup(t.derived().select("acc_id", "days_to_topup").join(topup, "acc_id"), "days_to_topup", "days", "observed")


_DRAWN = " + ".join(f"(u >= {p})::INT" for p in metrics.POISSON)
_BOOT = f""", drawn AS (
  SELECT draw, round(p, 4) AS s, y, (p - y) * (p - y) AS b, -CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END AS l, CASE WHEN draw < 0 THEN 1 ELSE {_DRAWN} END AS w
  FROM (SELECT *, ((h1 + draw * h2) % 2147483647) / 2147483647.0::DOUBLE AS u FROM (
    SELECT p, y, ('0x' || substr(md5(CAST(acc_id AS VARCHAR)), 1, 7))::BIGINT AS h1, ('0x' || substr(md5(CAST(acc_id AS VARCHAR)), 9, 7))::BIGINT AS h2 FROM judged), (SELECT unnest(range(-1, 1000)) AS draw))
), cells AS (SELECT draw, s, sum(w) AS n, sum(w * y) AS p, sum(w * b) AS b, sum(w * l) AS l FROM drawn WHERE w > 0 GROUP BY 1, 2),
sums AS (
  SELECT draw, sum(n) AS n, sum(p) AS p, sum(b) AS b, sum(l) AS l, sum(r) AS r FROM (
    SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY draw ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0) AS r FROM cells) GROUP BY 1
), each AS (
  SELECT draw, unnest(['brier', 'log_loss', 'roc_auc', 'positive_rate']) AS metric, unnest([b / n, l / n, (r - p * (p + 1) / 2.0) / nullif(p * (n - p), 0), p / n]::DOUBLE[]) AS v FROM sums
)"""


@query(_BOOT + " SELECT metric, round(max(v) FILTER (draw < 0), 6) AS value, round(quantile_cont(v, 0.025) FILTER (draw >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (draw >= 0), 6) AS high FROM each GROUP BY 1")
def bootstrap_ci(t: Tables) -> DataFrame:
    return metrics.bootstrap_churn(t.judged(), "p", "y", "acc_id")


# Gates.

_row = catalog._row


def _rows(rows: list[tuple[str, str, bool, float]]) -> str:
    values = ", ".join(f"('{n}', '{s}', {str(p).lower()}, {v}::DOUBLE)" for n, s, p, v in rows)
    return f'SELECT * FROM (VALUES {values}) v("check", severity, passed, value)'


@query(_rows([("customers_exists", "blocker", True, 1), ("customers.acc_id_exists", "blocker", True, 1), ("customers.email_exists", "blocker", False, 0), ("runs_exists", "blocker", False, 0), ("runs.id_exists", "blocker", False, 0)]))
def gate_structure(t: Tables) -> DataFrame:
    return gates.gate_structure({"customers": t.customers, "runs": None}, {"customers": ["acc_id", "email"], "runs": ["id"]}, t.spark)


@query(_rows([("feature_list_equals_contract", "blocker", True, 31), ("snapshot_fields_excluded", "blocker", True, 0), ("feature_list_equals_contract", "blocker", False, 31), ("snapshot_fields_excluded", "blocker", False, 1)]))
def gate_feature_list(t: Tables) -> DataFrame:
    """The features as built, and with the last one replaced by a credit as of the export."""
    good = t.features()
    bad = good.drop(FEATURES[-1]).withColumn("credit_sms", F.lit(0.0))
    return gates.gate_feature_list(good, FEATURES).unionByName(gates.gate_feature_list(bad, FEATURES))


_SOURCES = """(SELECT CAST(r_regionkey AS VARCHAR) AS source_id, CASE r_regionkey WHEN 2 THEN 'importing' ELSE 'ready' END AS import_status,
  CASE r_regionkey WHEN 1 THEN 2 WHEN 3 THEN NULL ELSE 0 END AS warnings FROM region),
  (SELECT acc_id % 5 AS k, count(*) AS customers FROM customers GROUP BY 1) c"""


def _source_checks(kind: str, severity: str, end: str) -> str:
    count = "(SELECT count(*) FROM {} x WHERE x.acc_id % 5 = k AND k <> 4)"
    checks = [
        ("source_ready", "blocker", "import_status = 'ready'", "(import_status = 'ready')::INT"), ("clean_manifest_exists", "blocker", "warnings IS NOT NULL", "(warnings IS NOT NULL)::INT"),
        ("clean_manifest_warnings", "warning", "coalesce(warnings, 0) = 0", "coalesce(warnings, 0)"), ("customers_non_empty", "blocker", "customers > 0", "customers"),
        (f"payments_{end}", severity, "payments > 0", "payments"), (f"usage_{end}", severity, "usage > 0", "usage"),
    ]
    parts = [f"SELECT source_id, 'source_exists' AS \"check\", 'blocker' AS severity, source_id <> 'none' AS passed, (source_id <> 'none')::INT::DOUBLE AS value FROM (SELECT source_id FROM s UNION ALL SELECT 'none')"]
    parts += [f"SELECT source_id, '{n}', '{sev}', {ok}, CAST({v} AS DOUBLE) FROM s" for n, sev, ok, v in checks]
    source = f"""SELECT source_id, import_status, warnings, customers, coalesce(p.n, 0) AS payments, coalesce(u.n, 0) AS usage FROM {_SOURCES}
      LEFT JOIN (SELECT acc_id % 5 AS k, count(*) AS n FROM payments WHERE acc_id % 5 <> 4 GROUP BY 1) p USING (k) LEFT JOIN (SELECT acc_id % 5 AS k, count(*) AS n FROM usage GROUP BY 1) u USING (k) WHERE CAST(k AS VARCHAR) = source_id"""
    return f", s AS ({source}) SELECT '{kind}' AS kind, * FROM ({' UNION ALL '.join(parts)})"


def _sources(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("r_regionkey")
    manifest = F.when(key == 1, '{"warnings": ["month 13", "no date"]}').when(key == 3, F.lit(None)).otherwise('{"warnings": []}')
    listed = adapter.table(t.spark, t.folder, "region").select(key.cast("string").alias("source_id"), F.when(key == 2, "importing").otherwise("ready").alias("import_status"), manifest.alias("clean_manifest"))
    of = lambda df, name: df.groupBy((F.col("acc_id") % 5).cast("string").alias("source_id")).agg(F.count("*").alias(name))
    counts = of(t.customers, "customers").join(of(t.payments.where("acc_id % 5 <> 4"), "payments"), "source_id", "full").join(of(t.usage, "usage"), "source_id", "full")
    return listed.select("source_id").unionByName(t.spark.createDataFrame([("none",)], "source_id string")), listed, counts


@query(_source_checks("train", "blocker", "non_empty"))
def gate_readiness(t: Tables) -> DataFrame:
    """Sources by region: one with warnings, one still importing, one without a manifest, one without payments, one unknown."""
    return gates.gate_sources(*_sources(t), training=True).select(F.lit("train").alias("kind"), "*")


@query(_source_checks("predict", "warning", "optional"))
def gate_predict_readiness(t: Tables) -> DataFrame:
    return gates.gate_sources(*_sources(t), training=False).select(F.lit("predict").alias("kind"), "*")


@query(" UNION ALL ".join(_row(f"{c}_null_rate", "warning", "v <= 0.5", "v", f"(SELECT avg(({c} IS NULL)::INT) AS v FROM customers)") for c in gates.CUSTOMER_COLUMNS))
def gate_null_rates(t: Tables) -> DataFrame:
    return gates.gate_null_rates(t.customers, gates.CUSTOMER_COLUMNS)


def _span(kind: str, day: str, window: int, horizon: int) -> str:
    span = f"(SELECT count(*) AS n, DATE '{day}' - min(at) AS b, max(at) - DATE '{day}' AS a FROM events_all)"
    checks = [
        ("active_window_positive", "blocker", f"{window} > 0", str(window)), ("horizon_days_positive", "blocker", f"{horizon} > 0", str(horizon)), ("activity_exists", "blocker", "n > 0", "n"),
        ("history_before_cutoff", "blocker", f"b > {window}", "b"), ("future_label_window", "blocker", f"a >= {horizon}", "a"), ("history_depth", "warning", "b >= 365", "b"),
    ]
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({_row(*c, span)})" for c in checks)


@query(_span("good", "1996-01-01", 180, 180) + " UNION ALL " + _span("too early", "1992-03-01", 180, 0) + " UNION ALL " + _span("too late", "2000-01-01", 0, 180))
def gate_cutoff(t: Tables) -> DataFrame:
    events = labels.activity_events(t.payments, t.usage)
    of = lambda kind, df: df.select(F.lit(kind).alias("kind"), "*")
    return union_all([of("good", gates.gate_cutoff(events, CUTOFF)), of("too early", gates.gate_cutoff(events, date(1992, 3, 1), horizon=0)), of("too late", gates.gate_cutoff(events, date(2000, 1, 1), window=0))])


_CREDIT_LABELS = "(SELECT acc_id, coalesce(sum(usage) FILTER (period >= DATE '1996-01-01' AND period < DATE '1996-01-31'), 0) AS usage_30d, coalesce(sum(usage) FILTER (period >= DATE '1996-01-01' AND period < DATE '1996-03-31'), 0) AS usage_90d FROM spine LEFT JOIN usage USING (acc_id) GROUP BY 1)"
_TOPUP_LABELS = "(SELECT s.acc_id, (p.acc_id IS NOT NULL)::INT AS observed FROM spine s LEFT JOIN (SELECT DISTINCT acc_id FROM payments WHERE payment_date >= TIMESTAMP '1996-01-01') p USING (acc_id))"


def _label_checks(kind: str, some: str) -> str:
    clv = f"(SELECT count(*) AS n, count(*) FILTER (future_revenue > 0) AS z, coalesce(var_pop(future_revenue), 0) AS v FROM clv WHERE {some})"
    top = f"(SELECT coalesce(sum(y) FILTER (r <= greatest(floor(n * 0.01), 1)) / nullif(sum(y), 0), 0) AS s FROM (SELECT future_revenue AS y, row_number() OVER (ORDER BY future_revenue DESC, acc_id) AS r, count(*) OVER () AS n FROM clv WHERE {some}))"
    credit = "(SELECT " + ", ".join(f"count(*) FILTER (usage_{d}d > 0) AS z{d}, coalesce(var_pop(usage_{d}d), 0) AS v{d}" for d in (30, 90)) + f" FROM {_CREDIT_LABELS} WHERE {some})"
    topup = f"(SELECT coalesce(sum(observed), 0) AS n, coalesce(1 - avg(observed), 1) AS c FROM {_TOPUP_LABELS} WHERE {some})"
    churn = f"(SELECT count(*) AS n, coalesce(sum(churned), 0) AS p, coalesce(avg(churned), 0) AS r FROM churn WHERE {some})"
    parts = [
        _row("churn_eligible", "blocker", "n >= 500", "n", churn), _row("churn_positives", "blocker", "p >= 100", "p", churn), _row("churn_negatives", "blocker", "n - p >= 100", "n - p", churn), _row("churn_rate", "blocker", "r BETWEEN 0.05 AND 0.80", "r", churn),
        _row("clv_eligible", "blocker", "n >= 500", "n", clv), _row("clv_nonzero", "blocker", "z >= 100", "z", clv), _row("clv_variance", "blocker", "v > 0", "round(v, 2)", clv), _row("clv_top_share", "warning", "s <= 0.5", "s", top),
        *[r for d in (30, 90) for r in (_row(f"credit_{d}d_nonzero", "blocker", f"z{d} >= 500", f"z{d}", credit), _row(f"credit_{d}d_variance", "blocker", f"v{d} > 0", f"round(v{d}, 2)", credit))],
        _row("topup_observed", "warning", "n >= 500", "n", topup), _row("topup_censoring", "warning", "c <= 0.9", "c", topup),
    ]
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({p})" for p in parts)


@query(_label_checks("all", "true") + " UNION ALL " + _label_checks("one account", "acc_id = 7"))
def gate_labels(t: Tables) -> DataFrame:
    """All label gates over the whole tables, and over a single account, where most of them fail."""
    churn, clv, credit, topup = t.churn(), t.clv(), labels.labels_credit(*t.all, CUTOFF), labels.labels_topup(*t.all, CUTOFF)

    def of(kind: str, condition: str) -> DataFrame:
        parts = [gates.gate_labels(churn.where(condition)), gates.gate_clv_labels(clv.where(condition)), gates.gate_credit_labels(credit.where(condition)), gates.gate_topup_labels(topup.where(condition))]
        cents = F.when(F.col("check").endswith("variance"), F.round("value", 2)).otherwise(F.col("value"))
        return union_all(parts).select(F.lit(kind).alias("kind"), "check", "severity", "passed", cents.alias("value"))

    return of("all", "true").unionByName(of("one account", "acc_id = 7"))


@query("""SELECT kind, CASE WHEN bool_or(NOT passed AND severity = 'blocker') THEN 'failed' WHEN bool_or(NOT passed) THEN 'warning' ELSE 'passed' END AS status
  FROM (""" + _label_checks("all", "true") + " UNION ALL " + _label_checks("one account", "acc_id = 7") + ") GROUP BY 1")
def gate_status(t: Tables) -> DataFrame:
    rows = gate_labels(t)
    return union_all([gates.status(rows.where(F.col("kind") == k)).select(F.lit(k).alias("kind"), "status") for k in ("all", "one account")])


def _late(kind: str, p: str, u: str) -> str:
    rows = [_row("payments_before_cutoff", "blocker", "n = 0", "n", f"(SELECT count(*) FILTER (payment_date >= TIMESTAMP '1996-01-01') AS n FROM {p})"), _row("usage_before_cutoff", "blocker", "n = 0", "n", f"(SELECT count(*) FILTER (period >= DATE '1996-01-01') AS n FROM {u})")]
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({r})" for r in rows)


@query(_late("cut", "pp", "pu") + " UNION ALL " + _late("uncut", "payments", "usage"))
def gate_leakage(t: Tables) -> DataFrame:
    """What the features read, and the same without its filter."""
    from tidemark.operators import features as ft

    of = lambda kind, df: df.select(F.lit(kind).alias("kind"), "*")
    return of("cut", gates.gate_leakage(ft.pit_payments(t.payments, CUTOFF), ft.pit_usage(t.usage, CUTOFF), CUTOFF)).unionByName(of("uncut", gates.gate_leakage(t.payments, t.usage, CUTOFF)))


_PREPARED = ["usage_total_180d", "total_revenue_180d", "payment_overdue_ratio", "usage_slope_6m", "days_since_last_activity"]


def _prepared(kind: str, fitted: str, train: str) -> str:
    n = lambda w: f"(SELECT count(*) FROM features WHERE {w})"
    other = "acc_id % 5 = 0"
    rows = [
        _row("preprocessor_is_fitted", "blocker", "n > 0", "n", f"(SELECT {n(fitted)} AS n)"), _row("fitted_rows_match_train", "blocker", "a = b", "a", f"(SELECT {n(fitted)} AS a, {n(train)} AS b)"),
        _row("feature_order_preserved", "blocker", "true", "5", "(SELECT 1)"), _row("no_other_split_refit", "blocker", "a <> b OR c = b", "b", f"(SELECT {n(fitted)} AS a, {n(other)} AS b, {n(train)} AS c)"),
    ]
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({r})" for r in rows)


@query(_prepared("fitted on train", "acc_id % 5 <> 0", "acc_id % 5 <> 0") + " UNION ALL " + _prepared("fitted on the other", "acc_id % 5 = 0", "acc_id % 5 <> 0"))
def gate_preprocessing(t: Tables) -> DataFrame:
    rows = t.features().select("acc_id", *_PREPARED)
    train, other = rows.where("acc_id % 5 <> 0"), rows.where("acc_id % 5 = 0")
    of = lambda kind, fitted: models.gate_preprocessing(models.fit_scaling(keep(fitted.select(*_PREPARED)), _PREPARED), train, other, _PREPARED).select(F.lit(kind).alias("kind"), "*")
    return of("fitted on train", train).unionByName(of("fitted on the other", other))


@query("SELECT count(*) AS n, count(DISTINCT acc_id) AS accounts, count(*) FILTER (amount < 0) AS amount_negative, count(*) FILTER (credit_add < 0) AS credit_add_negative, round(avg((acc_id IS NULL)::INT), 6) AS acc_id_missing, round(avg((payment_date IS NULL)::INT), 6) AS payment_date_missing, list_aggregate(list_sort(list(DISTINCT credit_type)), 'string_agg', ',') AS credit_type_values FROM payments")
def quality_stats(t: Tables) -> DataFrame:
    return gates.quality_stats(t.payments, ["amount", "credit_add"], ("payment_date",), ("credit_type",))


@query("SELECT * FROM (VALUES ('users', '', true), ('payments', 'uid,payment_date', false)) v(sheet, missing, complete)")
def gate_required_headers(t: Tables) -> DataFrame:
    sheets = {"users": t.customers.select(F.col("acc_id").alias(" acc_id ")), "payments": t.payments.select("acc_id")}
    required = {"users": ["acc_id"], "payments": ["acc_id", "uid", "payment_date"]}
    missing = {s: cleaning.missing_headers(df, required[s]) for s, df in sheets.items()}
    return t.spark.createDataFrame([(s, ",".join(m), not m) for s, m in missing.items()], "sheet string, missing string, complete boolean")


# Leakage.


@query(f"""SELECT feature, round(greatest(a, 1 - a), 4) AS auc FROM (SELECT feature, coalesce((sum(r) FILTER (churned = 1) - sum(churned) * (sum(churned) + 1) / 2) / nullif(sum(churned) * (count(*) - sum(churned)), 0), 0.5) AS a
  FROM (SELECT feature, churned, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r
    FROM (SELECT feature, churned, coalesce(value, 0) AS value FROM {catalog.unpivoted('(SELECT * FROM features JOIN churn USING (acc_id) WHERE acc_id % 10 IN (6, 7))', 'churned')})) GROUP BY 1)""")
def leak_auc_scan(t: Tables) -> DataFrame:
    rows = labels.hashed_split(t.features().join(t.churn(), "acc_id"))
    return leakage.feature_auc_scan(rows.where("split = 'validation'"), FEATURES, "churned")


@query()
def leak_churn_suite(t: Tables) -> DataFrame:
    rows = labels.hashed_split(t.features().join(t.churn(), "acc_id"))
    return leakage.churn_suite(keep(rows), FEATURES, "churned")


@query()
def leak_value_suite(t: Tables) -> DataFrame:
    rows = labels.hashed_split(t.features().join(t.clv().drop("purchased"), "acc_id"))
    return leakage.value_suite(keep(rows), FEATURES, "future_revenue")
