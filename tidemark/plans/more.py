"""Queries over catalogs, events, exports and fitted lines, registered like those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import quantiles_row
from tidemark.functions.storage import keep
from tidemark.operators import cleaning, gates, labels, lifetime, metrics, models, promotion, reports, scoring
from tidemark.operators.features import FEATURES
from tidemark.plans import guarded_sql
from tidemark.plans.catalog import CUTOFF, Tables, query
from tidemark.sources import adapter, sinks
from tidemark.streaming.monthly import windowed_usage


@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400000000.0 + 25569, 6) AS serial FROM orders")
def excel_serial(t: Tables) -> DataFrame:
    return adapter.table(t.spark, t.folder, "orders").select("o_orderkey", cleaning.excel_serial(F.col("o_orderdate")).alias("serial"))


@query("SELECT o_orderkey, '{\"_excel\":true,\"iso\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z\"' AS start, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def excel_cells(t: Tables) -> DataFrame:
    """Order dates as date cells (up to the serial, whose digits engines print differently) and the days read back from them."""
    cells = adapter.table(t.spark, t.folder, "orders").select("o_orderkey", cleaning.excel_cell(F.col("o_orderdate")).alias("cell"))
    return cells.select("o_orderkey", F.substring_index("cell", ",\"serial", 1).alias("start"), cleaning.clean_day(F.col("cell")).alias("day"))


@query("SELECT channel || '_' || usage_source AS sheet, count(*) AS n FROM usage GROUP BY 1")
def sheet_manifest(t: Tables) -> DataFrame:
    return t.usage.groupBy(F.concat_ws("_", "channel", "usage_source").alias("sheet")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 3 > 0")
def source_dedup_anti(t: Tables) -> DataFrame:
    files = adapter.table(t.spark, t.folder, "nation").select(F.col("n_name").alias("name"), F.col("n_name").cast("binary").alias("content"), "n_nationkey")
    catalog = files.where("n_nationkey % 3 = 0").select(F.sha2("content", 256).alias("checksum"))
    return cleaning.new_sources(files, catalog).select("name")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def runs_catalog(t: Tables) -> DataFrame:
    read = lambda name: adapter.table(t.spark, t.folder, name)
    orders, customer, nation = read("orders"), read("customer"), read("nation")
    runs = orders.select("o_orderkey", "o_custkey")
    return runs.join(customer, runs["o_custkey"] == customer["c_custkey"], "left").join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT 'k' AS metric, round(avg(CAST(props->>'k' AS DOUBLE)), 6) AS mean FROM events")
def backtest_avg(t: Tables) -> DataFrame:
    pairs = adapter.table(t.spark, t.folder, "events").select(F.explode(F.from_json("props", "map<string,double>")).alias("metric", "value"))
    return pairs.where(~F.isnan("value")).groupBy("metric").agg(F.avg("value").alias("mean"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, user_id, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2", digits=4)
def windowed_events(t: Tables) -> DataFrame:
    rows = windowed_usage(adapter.table(t.spark, t.folder, "events"))
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT w AS weight, round(avg(abs(w * p + (1 - w) * x - y)), 6) AS mae FROM (SELECT p, y, total_revenue_180d AS x FROM valued JOIN features USING (acc_id)), (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS w) GROUP BY 1 ORDER BY 2, 1 LIMIT 1")
def best_shrinkage(t: Tables) -> DataFrame:
    rows = t.valued().join(t.features().select("acc_id", "total_revenue_180d"), "acc_id")
    return models.best_shrinkage(rows, "p", "total_revenue_180d", "y")


@query("SELECT round(a, 4) AS at_risk, round(greatest(b, a + 1e-6), 4) AS watch FROM (SELECT greatest(0.10, least(quantile_cont(p_alive, 0.15), 0.30)) AS a, greatest(0.35, least(quantile_cont(p_alive, 0.40), 0.60)) AS b FROM scores WHERE p_alive > 0)")
def alive_cuts(t: Tables) -> DataFrame:
    return models.alive_cuts(t.scores(), "p_alive")


@query()
def churn_model(t: Tables) -> DataFrame:
    """The family with the best average precision out of five folds, over all 31 features, fitted on 60 % of the accounts."""
    rows = keep(labels.split_stratified(t.features().join(t.churn(), "acc_id"), "churned"))
    train = rows.where("split = 'train'")
    best = models.choose_family(train, FEATURES, "churned").first()["family"]
    return models.FAMILIES[best](train, FEATURES, "churned")(rows).select("acc_id", "churned", "split", "probability", F.lit(best).alias("family"))


@query()
def churn_candidates(t: Tables) -> DataFrame:
    """Average precision out of five folds of every family over all 31 features, the best one first."""
    return models.choose_family(keep(t.features().join(t.churn(), "acc_id")), FEATURES, "churned")


@query()
def feature_importance(t: Tables) -> DataFrame:
    """The ten most important features of a forest over all 31."""
    rows = keep(t.features().join(t.churn(), "acc_id"))
    return models.importances(rows, FEATURES, "churned", 10)


@query()
def value_model(t: Tables) -> DataFrame:
    """Tweedie and two-part predictions, learned on 60 % of the accounts."""
    names = FEATURES
    rows = keep(labels.hashed_split(t.features().select("acc_id", *names).join(t.clv(), "acc_id").drop("purchased")))
    train = rows.where("split = 'train'")
    tweedie = models.fit_value(train, names, "future_revenue")(rows)
    hurdle = models.fit_hurdle(train, names, "future_revenue")(rows).select("acc_id", F.col("predicted").alias("two_part"))
    return tweedie.join(hurdle, "acc_id").select("acc_id", "split", "future_revenue", "predicted", "two_part")


@query()
def top_factors(t: Tables) -> DataFrame:
    """The five largest contributions to every account's churn score, by the fitted coefficients."""
    rows = keep(t.features().join(t.churn(), "acc_id"))
    score = models.fit_churn(rows, FEATURES, "churned")
    found = models.top_factors(models.scaled(rows.drop("churned"), FEATURES, score.scaling), FEATURES, score.coefficients)
    return found.select("acc_id", F.explode("factors").alias("f")).select("acc_id", "f.feature", "f.impact")


_STATUS = """(SELECT acc_id, stage, c.churn_probability, predicted_clv, usage_30d, customer_age_days, stage LIKE 'Active%' AS el, stage = 'Active Paid' AS ec,
  stage = 'Active Paid' AND churn_probability IS NOT NULL AND NOT coalesce(customer_age_days < 90, false) AS pc FROM scores c)"""
_STATUS_SQL = f"""SELECT acc_id, CASE WHEN NOT (pc OR (el AND predicted_clv IS NOT NULL) OR (el AND usage_30d IS NOT NULL)) THEN 'insufficient_data'
  WHEN (ec AND NOT pc) OR (el AND predicted_clv IS NULL) OR (el AND usage_30d IS NULL) {{}} THEN 'partial' ELSE 'predicted' END AS output_status,
  nullif(concat_ws('; ', CASE stage WHEN 'Active Free' THEN 'churn: never_paid' WHEN 'Churned' THEN 'churn: already_churned' WHEN 'Ghost' THEN 'churn: no_history' END,
    CASE stage WHEN 'Churned' THEN 'clv: inactive; credit: inactive' WHEN 'Ghost' THEN 'clv: no_history; credit: no_history' END {{}}), '') AS output_notes FROM {_STATUS}"""


@query(_STATUS_SQL.format("", "") + " UNION ALL " + _STATUS_SQL.format("OR ec", ", CASE WHEN ec THEN 'churn: major feature drift, predictions may be unreliable' END"))
def output_status(t: Tables) -> DataFrame:
    """Status and notes of every account, without drift and with drift of the churn model."""
    rows = keep(t.scores())
    return scoring.with_output_status(rows).unionByName(scoring.with_output_status(rows, ("churn",))).select("acc_id", "output_status", "output_notes")


_EXPORT = {
    "acc_id": "acc_id", "lifecycle_stage": "stage", "sub_stage": "sub_stage", "segment": "segment", "churn_probability": "churn_probability", "churn_risk_level": "risk_level", "predicted_clv_6m": "predicted_clv",
    "customer_value_tier": "value_tier", "revenue_at_risk": "revenue_at_risk", "credit_urgency_level": "urgency", "estimated_days_until_topup": "days_to_topup", "predicted_credit_usage_30d": "usage_30d",
    "predicted_credit_usage_90d": "round_even(usage_30d * 3, 2)", "days_since_last_activity": "days_since_last_activity", "n_purchases": "coalesce(n, 0)", "total_revenue": "round_even(coalesce(total, 0), 2)",
    "priority_score": "priority_score", "priority_rank": "priority_rank", "ever_paid": "ever_paid", "usage_trend": "usage_trend", "output_status": "output_status",
}


def _export(t: Tables) -> DataFrame:
    return reports.outputs_export(scoring.with_output_status(t.outputs()), t.payments, CUTOFF)


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _EXPORT.items())} FROM outputs LEFT JOIN pay USING (acc_id) LEFT JOIN ({_STATUS_SQL.format('', '')}) USING (acc_id) ORDER BY priority_rank LIMIT 20000")
def outputs_export(t: Tables) -> DataFrame:
    """The 21 columns of the export file, at most 20,000 rows of them."""
    return _export(t).orderBy("priority_rank", "acc_id").limit(reports.EXPORT_ROWS)


@query("SELECT CAST(place AS INT) AS place, line FROM (SELECT 0 AS place, chr(65279) || 'acc_id,segment,priority_rank' AS line UNION ALL SELECT priority_rank, acc_id || ',' || segment || ',' || priority_rank FROM outputs WHERE priority_rank <= 20000)")
def export_lines(t: Tables) -> DataFrame:
    """The lines of the export file (three of its columns) with BOM and header."""
    return sinks.export_lines(t.outputs(), ["acc_id", "segment", "priority_rank"], [F.col("priority_rank"), F.col("acc_id")])


_VIEWS = {"outputs": lambda t: t.derived().select("acc_id", "segment", "value_tier", "predicted_clv", (F.col("acc_id") % 3).cast("string").alias("prediction_run_id"))}
_GUARDED = "SELECT segment, count(*) AS n, round(sum(predicted_clv), 2) AS clv FROM {} WHERE value_tier IN ('high', 'mid') AND segment <> 'Update' GROUP BY segment"


@query(_GUARDED.format("(SELECT * FROM d2 WHERE acc_id % 3 = 1)"))
def guarded_select(t: Tables) -> DataFrame:
    """A role's query over the outputs of the one run that the caller owns."""
    views = {"outputs": lambda session: Tables(session, t.folder).derived().select(*_VIEWS["outputs"](t).columns[:-1], (F.col("acc_id") % 3).cast("string").alias("prediction_run_id"))}
    return guarded_sql.run_guarded(t.spark, _GUARDED.format("outputs"), "viewer", views, 100, guarded_sql.Scope(run_ids=frozenset({"1"})))


_CREDIT = "(SELECT acc_id, coalesce(sum(usage) FILTER (period >= DATE '1996-01-01' AND period < DATE '1996-01-31'), 0) AS usage_30d, coalesce(sum(usage) FILTER (period >= DATE '1996-01-01' AND period < DATE '1996-03-31'), 0) AS usage_90d FROM spine LEFT JOIN usage USING (acc_id) GROUP BY 1)"
_TOPUP = "(SELECT acc_id, CAST(date_diff('day', DATE '1996-01-01', CAST(min(payment_date) AS DATE)) AS DOUBLE) AS days_to_topup, 1 AS observed FROM payments WHERE payment_date >= TIMESTAMP '1996-01-01' GROUP BY 1)"


@query(f"SELECT acc_id, round(credit_balance_proxy, 6) AS credit_balance_proxy, round(usage_recent_90d, 6) AS usage_recent_90d, usage_30d, usage_90d, days_to_topup, observed FROM features JOIN {_CREDIT} USING (acc_id) LEFT JOIN {_TOPUP} USING (acc_id)")
def dataset_credit(t: Tables) -> DataFrame:
    """Features, usage of both horizons and, where there is one, the next payment."""
    top = labels.labels_topup(*t.all, CUTOFF).where("observed = 1")
    return t.features().select("acc_id", "credit_balance_proxy", "usage_recent_90d").join(labels.labels_credit(*t.all, CUTOFF), "acc_id").join(top, "acc_id", "left")


@query("SELECT acc_id, CASE WHEN acc_id % 3 = 0 THEN 10 + acc_id % 2 ELSE days_to_topup END AS days FROM d0")
def topup_days_model(t: Tables) -> DataFrame:
    """A model's days where it has any (here every third account), else the rule's."""
    model = F.when(F.col("acc_id") % 3 == 0, 10.4 + 0.2 * (F.col("acc_id") % 2))
    return t.scores().select("acc_id", scoring.topup_days(F.col("credit_balance_proxy"), F.col("usage_30d"), model).alias("days"))


TRAINED = [("strong", True, True, 0.8, 0.82, 0.5, 0.5, 0.061), ("weak", True, True, 0.6, 0.6, 0.5, 0.5, 0.01), ("leaky", False, True, 0.9, 0.9, 0.5, 0.5, 0.01), ("off", True, True, 0.9, 0.9, 0.5, 0.5, 0.3)]


@query("SELECT * FROM (VALUES ('strong', true, ''), ('weak', true, ''), ('leaky', false, 'leakage'), ('off', false, 'calibration')) v(name, eligible, reasons)")
def promotion_reasons(t: Tables) -> DataFrame:
    """Which candidates may replace the champion, and why not."""
    head = "name string, leakage_ok boolean, artifact_ok boolean, validation double, test double, baseline_validation double, baseline_test double, calibration_error double"
    tests = [(r[0], c, r[3], 0.5, None) for r in TRAINED for c in "ab"]
    backtests = t.spark.createDataFrame(tests, "name string, cutoff string, value double, baseline double, champion double")
    return promotion.judged(t.spark.createDataFrame(TRAINED, head), backtests, ceiling=0.15, target=0.05).select("name", "eligible", "reasons")


@query("SELECT count(*) AS customers, count(DISTINCT status_sms) AS statuses, round(avg(credit_sms), 4) AS mean_credit FROM customers", digits=4)
def profile_summary(t: Tables) -> DataFrame:
    return t.customers.agg(F.count("*").alias("customers"), F.count_distinct("status_sms").alias("statuses"), F.avg("credit_sms").alias("mean_credit"))


@query("SELECT round(var_pop(future_revenue) / 1e6, 4) AS variance, round(quantile_cont(future_revenue, 0.5), 4) AS p50, round(quantile_cont(future_revenue, 0.9), 4) AS p90 FROM clv", digits=4)
def label_stats(t: Tables) -> DataFrame:
    rows = keep(t.clv().select("future_revenue"))
    levels = quantiles_row(rows, {"p50": ("future_revenue", 0.5), "p90": ("future_revenue", 0.9)})
    return rows.agg((F.var_pop("future_revenue") / 1e6).alias("variance")).join(levels)


@query()
def oof_scores(t: Tables) -> DataFrame:
    """Scores of every account, over all 31 features, by a model that has not seen it: five folds."""
    return models.out_of_fold(keep(t.features().join(t.churn(), "acc_id")), FEATURES, "churned").select("acc_id", "churned", "fold", "probability")


@query()
def calibrated_scores(t: Tables) -> DataFrame:
    """Scores out of fold, calibrated."""
    scored = models.out_of_fold(keep(t.features().join(t.churn(), "acc_id")), FEATURES, "churned")
    return models.calibrated(scored.select("acc_id", "churned", "probability"), "probability", "churned")


@query(" UNION ALL ".join(f"SELECT round(CASE WHEN slope < 0.01 OR n < 2 THEN 1 ELSE least(slope, 20) END, 6) AS slope, round(CASE WHEN slope < 0.01 OR n < 2 THEN 0 ELSE intercept END, 4) AS intercept FROM (SELECT regr_slope(y, {p}) AS slope, regr_intercept(y, {p}) AS intercept, regr_count(y, {p}) AS n FROM valued)" for p in ("p", "-p")))
def magnitude_guarded(t: Tables) -> DataFrame:
    """The calibration line of value, and of the mirrored predictions: one of the two runs against the actual values."""
    rows = t.valued()
    lines = models.magnitude_line(rows, "p", "y").unionByName(models.magnitude_line(rows.withColumn("p", -F.col("p")), "p", "y"))
    return lines.select("slope", F.round("intercept", 4).alias("intercept"))


@query("SELECT * FROM (VALUES ('customers.acc_id_exists', 'blocker', true, 1.0::DOUBLE), ('customers.email_exists', 'blocker', false, 0.0)) v(\"check\", severity, passed, value)")
def gate_columns(t: Tables) -> DataFrame:
    return gates.gate_columns(t.customers, "customers", ["acc_id", "email"])


@query()
def p_alive(t: Tables) -> DataFrame:
    rfm = labels.rfm_summary(t.payments, CUTOFF)
    return rfm.select("acc_id", "frequency", lifetime.p_alive(lifetime.fit_bgnbd(rfm)).alias("p_alive"))


@query("SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey % 3 = 0")
def keyed_merge(t: Tables) -> DataFrame:
    """Rows of a feature set replaced by their key."""
    old = adapter.table(t.spark, t.folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return sinks.merged(old, old.where("id % 3 = 0").withColumn("value", F.lit(0.0)), ["id"])


@query("SELECT acc_id, segment, priority_rank FROM outputs WHERE acc_id = 7")
def output_one(t: Tables) -> DataFrame:
    return t.outputs().where("acc_id = 7").select("acc_id", "segment", "priority_rank")


@query("SELECT acc_id, status_sms, coalesce(credit_sms, 0) AS credit_sms, join_date FROM customers WHERE acc_id = 7")
def customer_profile(t: Tables) -> DataFrame:
    return t.customers.where("acc_id = 7").select("acc_id", "status_sms", F.coalesce("credit_sms", F.lit(0.0)).alias("credit_sms"), "join_date")


@query("SELECT 'stage' AS kind, stage AS value, count(*) AS n FROM d1 GROUP BY 2 UNION ALL SELECT 'risk_level', risk_level, count(*) FROM d1 WHERE risk_level IS NOT NULL GROUP BY 2 UNION ALL SELECT 'usage_trend', usage_trend, count(*) FROM d1 GROUP BY 2 UNION ALL SELECT 'urgency', urgency, count(*) FROM d1 WHERE urgency IS NOT NULL GROUP BY 2")
def run_summary(t: Tables) -> DataFrame:
    """All enum counts of a run from one scan: the four columns are unpivoted and counted together."""
    long = t.derived().select("acc_id", "stage", "risk_level", "usage_trend", "urgency").unpivot(["acc_id"], ["stage", "risk_level", "usage_trend", "urgency"], "kind", "value")
    return long.where(F.col("value").isNotNull()).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("SELECT segment, count(*) AS n, count(*) FILTER (needs_review) AS to_review FROM d2 GROUP BY 1")
def run_insight_signals(t: Tables) -> DataFrame:
    return t.derived().groupBy("segment").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("to_review"))


@query("SELECT round((SELECT avg(y) FROM (SELECT * FROM judged QUALIFY row_number() OVER (ORDER BY p DESC, acc_id) <= ceil(count(*) OVER () * 0.2))) / avg(y), 6) AS lift FROM judged")
def lift_at_k(t: Tables) -> DataFrame:
    return metrics.at_k(t.judged(), "p", "y", 0.2, "acc_id").select("lift")
