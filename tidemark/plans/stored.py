"""Queries over raw sheets, model versions, evaluations, runs and imports, all made of the given tables.

The inputs are expressions that Spark and DuckDB read alike, so one text makes a query's input and its SQL's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import union_all
from tidemark.functions.storage import shared_folder
from tidemark.operators import cleaning, registry, reports
from tidemark.plans import guarded_sql
from tidemark.plans.catalog import Tables, query
from tidemark.sources import adapter

# Cells and sheets.

CELLS = [None, "", "  ", " a b ", "12", " 12.9 ", "-3.7", "1e3", "NaN", "Infinity", "abc", "2024-02-29", "2023-02-29", "45351", "45351.5", "2024-01-05 10:30:00", '{"_excel":true,"iso":"2024-01-05T10:30:00.000Z","serial":45296.4375}', '{"_excel":true,"serial":45351}']
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_CELL = f"""CASE o_orderkey % 7 WHEN 0 THEN ' ' || CAST(o_orderkey % 50000 AS STRING) || '  ' WHEN 1 THEN CAST(o_orderkey % 50000 AS STRING) || '.75' WHEN 2 THEN {_DAY} WHEN 3 THEN '-' || CAST(o_orderkey % 900 AS STRING) || '.5'
  WHEN 4 THEN '{{"_excel":true,"iso":"' || {_DAY} || 'T10:30:00.000Z","serial":' || CAST(30000 + o_orderkey % 9000 AS STRING) || '}}' WHEN 5 THEN '{{"_excel":true,"serial":' || CAST(30000 + o_orderkey % 9000 AS STRING) || '}}' ELSE o_orderpriority END"""
_VALUES = f"(SELECT cell FROM (VALUES {', '.join('(NULL)' if c is None else f"('{c}')" for c in CELLS)}) v(cell) UNION ALL SELECT {_CELL} FROM orders)"
_TEXT = "coalesce(CASE WHEN starts_with(cell, '{\"_excel\"') THEN coalesce(cell->>'iso', cell->>'serial') END, nullif(trim(cell), ''))"
_NUMBER = "CASE WHEN isfinite(TRY_CAST({0} AS DOUBLE)) THEN TRY_CAST({0} AS DOUBLE) END".format(_TEXT)


def orders(t: Tables) -> DataFrame:
    return adapter.table(t.spark, t.folder, "orders")


def _cells(t: Tables) -> DataFrame:
    """Odd cells, and one made of every order."""
    return t.spark.createDataFrame([(c,) for c in CELLS], "cell string").unionByName(orders(t).select(F.expr(_CELL).alias("cell")))


@query(f"SELECT cell, {_TEXT} AS value FROM {_VALUES}")
def clean_string(t: Tables) -> DataFrame:
    return _cells(t).select("cell", cleaning.clean_string(F.col("cell")).alias("value"))


@query(f"SELECT cell, {_NUMBER} AS value FROM {_VALUES}")
def clean_numeric(t: Tables) -> DataFrame:
    return _cells(t).select("cell", cleaning.clean_numeric(F.col("cell")).alias("value"))


@query(f"SELECT cell, CAST(trunc({_NUMBER}) AS BIGINT) AS value FROM {_VALUES}")
def clean_int(t: Tables) -> DataFrame:
    return _cells(t).select("cell", cleaning.clean_int(F.col("cell")).alias("value"))


@query(f"SELECT cell, strftime(coalesce(CASE WHEN abs({_NUMBER}) < 1e7 THEN TIMESTAMP '1899-12-30' + to_microseconds(CAST(round({_NUMBER} * 86400000000) AS BIGINT)) END, CASE WHEN isfinite(TRY_CAST({_TEXT} AS TIMESTAMP)) THEN TRY_CAST({_TEXT} AS TIMESTAMP) END), '%Y-%m-%d %H:%M:%S') AS value FROM {_VALUES}")
def clean_date(t: Tables) -> DataFrame:
    return _cells(t).select("cell", F.date_format(cleaning.clean_date(F.col("cell")), "yyyy-MM-dd HH:mm:ss").alias("value"))


_P, _Q = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE o_orderstatus END", "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE o_orderpriority END"


@query("SELECT o_orderkey % 4 = 3 AS has_p, count(*) AS n FROM orders WHERE o_orderkey % 4 = 3 OR o_orderkey % 3 = 2 GROUP BY 1")
def drop_empty_rows(t: Tables) -> DataFrame:
    left = cleaning.drop_empty_rows(orders(t).select(F.expr(_P).alias("p"), F.expr(_Q).alias("q")))
    return left.groupBy(F.coalesce(F.trim("p") != "", F.lit(False)).alias("has_p")).agg(F.count("*").alias("n"))


PAYMENTS = {
    "acc_id": "CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_custkey AS STRING) || '.9' WHEN 2 THEN 'x' ELSE ' ' || CAST(o_custkey AS STRING) END", "uid": "CAST(o_orderkey AS STRING)",
    "payment_date": f"CASE o_orderkey % 7 WHEN 0 THEN 'soon' WHEN 1 THEN CAST(30000 + o_orderkey % 9000 AS STRING) ELSE {_DAY} END", "amount": "CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END",
    "credit_add": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS STRING) END", "credit_type ": "CASE o_orderkey % 4 WHEN 0 THEN ' SMS ' WHEN 1 THEN 'email' WHEN 2 THEN '' END",
}
USAGE = {
    "acc_id": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END", "year": "CAST(year(o_orderdate) AS STRING)",
    "month": "CASE o_orderkey % 11 WHEN 0 THEN '13' WHEN 1 THEN 'may' ELSE CAST(month(o_orderdate) AS STRING) END", "usage": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 70 AS STRING) END",
}
CELL = '{"_excel":true,"iso":"2024-01-05T10:30:00.000Z","serial":45296.4375}'
USERS = {
    "acc_id": "CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE CAST(c_custkey AS STRING) END", "status (SMS)": "CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE ' ' || c_mktsegment END",
    "user.credit + user.credit_premium": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) END", "credit_email": "CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '7' END",
    "expire": "CAST(30000 + c_custkey % 9000 AS STRING)", "expire_email": "CASE WHEN c_custkey % 2 = 0 THEN 'soon' ELSE '2024-02-29' END", "status (Email)": "CASE WHEN c_custkey % 2 = 0 THEN ' Free ' ELSE 'PAID' END",
    "join_date": "CASE WHEN c_custkey % 6 = 0 THEN 'never' ELSE '2024-01-02' END", "last_access": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '2024-01-05 10:30:00' END", "last_send": f"CASE WHEN c_custkey % 2 = 0 THEN '{CELL}' END",
}


def _raw(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return cleaning.to_payload(df.select(*[F.expr(e).alias(c) for c, e in columns.items()]), "s1")


_PAID = """CAST(o_custkey AS INT) AS acc_id, o_orderkey AS payment_uid, CASE WHEN o_orderkey % 7 = 1 THEN DATE '1899-12-30' + CAST(30000 + o_orderkey % 9000 AS INT) ELSE CAST(o_orderdate AS DATE) END AS payment_date,
  CASE WHEN o_orderkey % 13 > 0 THEN floor(o_totalprice) END AS amount, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS credit_add, CASE o_orderkey % 4 WHEN 0 THEN 'sms' WHEN 1 THEN 'email' END AS credit_type"""


@query(f"SELECT 's1' AS source_id, * REPLACE (strftime(payment_date, '%Y-%m-%d') AS payment_date) FROM (SELECT {_PAID} FROM orders WHERE o_orderkey % 10 NOT IN (0, 2) AND o_orderkey % 7 > 0)")
def clean_payments(t: Tables) -> DataFrame:
    return cleaning.clean_payments(_raw(orders(t), PAYMENTS)).withColumn("payment_date", F.date_format("payment_date", "yyyy-MM-dd"))


_SHEETS = list(cleaning.USAGE_SHEETS)
_USED = "'s1' AS source_id, CAST(o_custkey AS INT) AS acc_id, CAST(year(o_orderdate) AS INT) AS year, CAST(CASE o_orderkey % 11 WHEN 0 THEN 13 WHEN 1 THEN NULL ELSE month(o_orderdate) END AS INT) AS month, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE CAST(o_orderkey % 70 AS DOUBLE) END AS usage"


@query(" UNION ALL ".join(f"SELECT {_USED}, '{c}' AS channel, '{s}' AS usage_source FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 6 = {i}" for i, (c, s) in enumerate(cleaning.USAGE_SHEETS.values())))
def usage_union(t: Tables) -> DataFrame:
    """Every sixth order is a row of a sheet's."""
    return cleaning.usage_union({sheet: _raw(orders(t).where(f"o_orderkey % 6 = {i}"), USAGE) for i, sheet in enumerate(_SHEETS)})


@query(f"SELECT {_USED}, 'sms' AS channel, 'bc' AS usage_source FROM orders WHERE o_orderkey % 9 > 0")
def clean_usage(t: Tables) -> DataFrame:
    return cleaning.clean_usage(_raw(orders(t), USAGE), "SMS_usage (BC)")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 17 > 0 AND o_orderkey % 11 > 1 THEN make_date(year(o_orderdate), month(o_orderdate), 1) END AS period FROM orders")
def usage_period(t: Tables) -> DataFrame:
    """Months 0 and 13 and missing years have no first day."""
    year, month = F.expr("CASE WHEN o_orderkey % 17 > 0 THEN year(o_orderdate) END"), F.expr("CASE o_orderkey % 11 WHEN 0 THEN 13 WHEN 1 THEN 0 ELSE month(o_orderdate) END")
    rows = orders(t).select("o_orderkey", year.alias("y"), month.alias("m"))
    return rows.select("o_orderkey", F.when(F.col("y").isNotNull(), adapter.period_of(F.col("y"), F.col("m"))).alias("period"))


@query(f"""SELECT 's1' AS source_id, CAST(c_custkey AS INT) AS acc_id, CASE WHEN c_custkey % 5 > 0 THEN lower(c_mktsegment) END AS status_sms, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE floor(c_acctbal) END AS credit_sms,
  CASE WHEN c_custkey % 3 = 1 THEN 7.0::DOUBLE ELSE 0 END AS credit_email, DATE '1899-12-30' + CAST(30000 + c_custkey % 9000 AS INT) AS expire_sms, CASE WHEN c_custkey % 2 = 1 THEN DATE '2024-02-29' END AS expire_email,
  CASE WHEN c_custkey % 2 = 0 THEN 'free' ELSE 'paid' END AS status_email, CASE WHEN c_custkey % 6 > 0 THEN DATE '2024-01-02' END AS join_date, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-01-05 10:30:00' END AS last_access,
  CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-05 10:30:00' END AS last_send FROM customer WHERE c_custkey % 9 > 0""")
def clean_customers(t: Tables) -> DataFrame:
    return cleaning.clean_customers(_raw(adapter.table(t.spark, t.folder, "customer"), USERS))


@query("""SELECT 'Backend_payment' AS sheet, count(*) AS raw, count(*) FILTER (o_orderkey % 10 NOT IN (0, 2) AND o_orderkey % 7 > 0) AS clean, count(*) FILTER (o_orderkey % 10 IN (0, 2)) AS no_account, count(*) FILTER (o_orderkey % 10 NOT IN (0, 2) AND o_orderkey % 7 = 0) AS no_date, 0::BIGINT AS odd_months FROM orders
  UNION ALL SELECT 'SMS_usage (BC)', count(*), count(*) FILTER (o_orderkey % 9 > 0), count(*) FILTER (o_orderkey % 9 = 0), 0, count(*) FILTER (o_orderkey % 9 > 0 AND o_orderkey % 11 < 2) FROM orders
  UNION ALL SELECT 'Users+User_profile', count(*), count(*) FILTER (c_custkey % 9 > 0), count(*) FILTER (c_custkey % 9 = 0), 0, 0 FROM customer""")
def clean_manifest(t: Tables) -> DataFrame:
    return cleaning.clean_manifest({"Backend_payment": _raw(orders(t), PAYMENTS), "SMS_usage (BC)": _raw(orders(t), USAGE), "Users+User_profile": _raw(adapter.table(t.spark, t.folder, "customer"), USERS)})


# Runs and imports: an event is a run, an order another one.

_EVENT_RUN = "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'ready' ELSE 'failed' END"
_EVENT_IMPORT = "CASE event_id % 4 WHEN 0 THEN 'importing' WHEN 1 THEN 'cleaning' WHEN 2 THEN 'ready' ELSE 'failed' END"
_NOW = "2024-01-15 12:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(f"SELECT event_id AS id FROM events WHERE event_id % 4 IN (0, 1) AND coalesce(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 3 HOUR END, ts) < TIMESTAMP '{_NOW}' - INTERVAL 120 MINUTE")
def stale_runs(t: Tables) -> DataFrame:
    """A third of the runs began three hours after they were created."""
    created = F.col("ts").cast("timestamp")
    begun = F.when(F.col("event_id") % 3 == 0, created + F.make_dt_interval(hours=F.lit(3)))
    rows = adapter.table(t.spark, t.folder, "events").select(F.col("event_id").alias("id"), F.expr(_EVENT_RUN).alias("status"), begun.alias("started_at"), created.alias("created_at"))
    return reports.stale(rows, _now(), 120).select("id")


@query(f"SELECT event_id AS id FROM events WHERE event_id % 4 IN (0, 1) AND event_id % 5 > 0 AND ts < TIMESTAMP '{_NOW}' - INTERVAL 15 MINUTE")
def stale_imports(t: Tables) -> DataFrame:
    """Every fifth import has been cleaned."""
    created = F.col("ts").cast("timestamp")
    rows = adapter.table(t.spark, t.folder, "events").select(F.col("event_id").alias("id"), F.expr(_EVENT_IMPORT).alias("import_status"), F.when(F.col("event_id") % 5 == 0, created).alias("cleaned_at"), created.alias("created_at"))
    return registry.stale_imports(rows, _now()).select("id")


_STATUS = "CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END"
_RUN = f"CAST(o_orderkey AS STRING) AS run_id, {_STATUS} AS status, {_DAY} AS started_at"


@query(f"""SELECT 'retry' AS what, run_id, CASE WHEN run_id = '12' THEN 'queued' ELSE status END AS status, CASE WHEN run_id <> '12' THEN started_at END AS started_at FROM (SELECT {_RUN} FROM orders)
  UNION ALL SELECT 'delete', * FROM (SELECT {_RUN} FROM orders) WHERE run_id <> '12' UNION ALL SELECT 'protect', * FROM (SELECT {_RUN} FROM orders)""")
def run_changes(t: Tables) -> DataFrame:
    """A failed run and a running one retried, a failed one deleted, a completed one protected."""
    jobs = orders(t).selectExpr("CAST(o_orderkey AS STRING) AS run_id", f"{_STATUS} AS status", f"{_DAY} AS started_at", "CASE WHEN o_orderkey % 3 = 0 THEN 'lost' END AS error")
    after = {"retry": registry.retried(registry.retried(jobs, "12"), "13"), "delete": registry.without_run(jobs, "12", True), "protect": registry.without_run(jobs, "14", True)}
    return union_all([df.select(F.lit(k).alias("what"), "run_id", "status", "started_at") for k, df in after.items()])


# Versions: an order is one, its line items are evaluations.

_TYPE = "CASE o_orderkey % 3 WHEN 0 THEN 'churn' WHEN 1 THEN 'clv' ELSE 'credit' END"
_VERSION = f"{_TYPE} || '-' || substr({_DAY}, 1, 4) || '.' || substr({_DAY}, 6, 2) || '.' || CAST(o_orderkey AS STRING)"
_METRICS = """CASE WHEN o_orderkey % 10 = 0 THEN '{"other": 1}' ELSE '{"pr_auc": 0.' || lpad(CAST(o_orderkey % 997 AS STRING), 3, '0') || '}' END"""
_METRIC = "CASE WHEN o_orderkey % 10 > 0 THEN (o_orderkey % 997) / 1000.0::DOUBLE END"
_V = f"(SELECT {_VERSION} AS version, {_TYPE} AS model_type, {_DAY} AS created_at, {_METRIC} AS metric, o_orderkey FROM orders)"
_CHAMPION = f"(SELECT model_type, arg_min(version, o_orderkey) AS version FROM {_V} WHERE metric IS NOT NULL GROUP BY 1)"
_NEW = f"(SELECT arg_max(version, o_orderkey) FROM {_V} WHERE model_type = 'churn')"
_KIND = "CASE l_linenumber WHEN 1 THEN 'holdout' WHEN 3 THEN 'baseline' ELSE 'backtest' END"


def _versions(t: Tables) -> DataFrame:
    return orders(t).selectExpr(f"{_VERSION} AS version", f"{_TYPE} AS model_type", f"{_DAY} AS created_at", f"{_METRICS} AS metrics", "o_orderkey")


def _aliases(t: Tables) -> DataFrame:
    """The first measured version of every type is its champion."""
    first = _versions(t).where("o_orderkey % 10 > 0").groupBy("model_type").agg(F.min_by("version", "o_orderkey").alias("version"))
    return first.select("model_type", F.lit(registry.CHAMPION).alias("alias"), "version")


def _newest(t: Tables) -> str:
    return _versions(t).where("model_type = 'churn'").agg(F.max_by("version", "o_orderkey")).first()[0]


@query(f"SELECT 'churn-1995.03.' || CAST(count(*) + 1 AS VARCHAR) AS version FROM {_V} WHERE starts_with(version, 'churn-1995.03.')")
def next_version(t: Tables) -> DataFrame:
    return registry.next_version(_versions(t), "churn", "1995.03")


@query(f"SELECT version, created_at, metric FROM {_V} WHERE model_type = 'churn'")
def model_versions(t: Tables) -> DataFrame:
    return registry.model_versions(_versions(t), "churn", "pr_auc")


@query(f"SELECT version, created_at FROM {_V} WHERE model_type = 'clv' ORDER BY created_at DESC, version LIMIT 25")
def newest_versions(t: Tables) -> DataFrame:
    """The newest versions of a type, as a list shows them."""
    return registry.newest_first(_versions(t).where("model_type = 'clv'").select("version", "created_at"), "version").limit(25)


@query(f"SELECT model_type, c.version AS champion, c.metric AS champion_metric, count(*) FILTER (v.metric > c.metric) AS n_better, count(*) AS n FROM {_V} v JOIN (SELECT model_type, version, metric FROM {_V} SEMI JOIN {_CHAMPION} USING (version)) c USING (model_type) GROUP BY ALL")
def model_performance(t: Tables) -> DataFrame:
    return registry.model_performance(_versions(t), _aliases(t), "pr_auc")


@query(f"""SELECT model_type, version, round(holdout, 6) AS holdout, round(backtest, 6) AS backtest, round(baseline, 6) AS baseline, CASE WHEN holdout IS NOT NULL THEN rank() OVER (PARTITION BY model_type ORDER BY holdout DESC NULLS LAST) END AS place FROM {_V}
  LEFT JOIN (SELECT l_orderkey AS o_orderkey, avg(m) FILTER (kind = 'holdout') AS holdout, avg(m) FILTER (kind = 'backtest') AS backtest, avg(m) FILTER (kind = 'baseline') AS baseline
    FROM (SELECT l_orderkey, {_KIND} AS kind, (l_partkey % 997) / 1000.0::DOUBLE AS m FROM lineitem WHERE l_orderkey % 5 > 0) GROUP BY 1) USING (o_orderkey)""")
def candidate_ranking(t: Tables) -> DataFrame:
    """Versions placed by their holdout metric; every fifth has no evaluation."""
    lines = adapter.table(t.spark, t.folder, "lineitem").where("l_orderkey % 5 > 0").selectExpr("_metadata.file_path AS file", "_metadata.row_index AS row", "l_orderkey AS o_orderkey", f"{_KIND} AS kind", """'{"pr_auc": 0.' || lpad(CAST(l_partkey % 997 AS STRING), 3, '0') || '}' AS metrics""")
    evaluations = lines.join(_versions(t).select("o_orderkey", "version"), "o_orderkey").select("version", "kind", "metrics", "file", "row")
    return registry.ranked_candidates(_versions(t).drop("metrics"), evaluations, "pr_auc", order=["file", "row"])


HISTORY = "model_type string, previous string, version string, action string, reason string"


def _promotion(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    champions = _aliases(t).select("version", F.lit(True).alias("serves"))
    versions = _versions(t).join(champions, "version", "left").withColumn("status", F.when(F.col("serves"), "production").otherwise("candidate")).drop("serves")
    return registry.promote(versions, _aliases(t), t.spark.createDataFrame([], HISTORY), "churn", _newest(t), "best")


@query(f"SELECT model_type, 'champion' AS alias, CASE WHEN model_type = 'churn' THEN {_NEW} ELSE version END AS version FROM {_CHAMPION}")
def promote(t: Tables) -> DataFrame:
    """The aliases after the newest churn version took over."""
    return _promotion(t)[1]


@query(f"SELECT v.version, CASE WHEN v.version = {_NEW} THEN 'production' WHEN c.version IS NULL THEN 'candidate' WHEN v.model_type = 'churn' THEN 'archived' ELSE 'production' END AS status FROM {_V} v LEFT JOIN {_CHAMPION} c ON v.version = c.version")
def promoted_versions(t: Tables) -> DataFrame:
    return _promotion(t)[0].select("version", "status")


@query(f"SELECT 'churn' AS model_type, (SELECT version FROM {_CHAMPION} WHERE model_type = 'churn') AS previous, {_NEW} AS version, 'promote' AS action, 'best' AS reason")
def promotion_history(t: Tables) -> DataFrame:
    return _promotion(t)[2]


@query("SELECT what, count(*) - less AS n FROM orders, (VALUES ('kept champion', 0), ('deleted', 1), ('unknown', 0)) w(what, less) GROUP BY what, less")
def delete_version(t: Tables) -> DataFrame:
    """A champion stays, another version goes."""
    champion = _aliases(t).where("model_type = 'churn'").first()["version"]
    left = {"kept champion": champion, "deleted": _newest(t), "unknown": "none"}
    return union_all([registry.deleted(_versions(t), _aliases(t), v).agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, v in left.items()])


@query(f"SELECT version, model_type FROM {_V} WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'new-' || version, model_type FROM {_V} WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 1")
def inserted_versions(t: Tables) -> DataFrame:
    """New rows enter a table of versions unless their key is there."""
    rows = _versions(t).select("version", "model_type", "o_orderkey")
    have = rows.where("o_orderkey % 2 = 0").drop("o_orderkey")
    new = rows.where("o_orderkey % 7 = 0").withColumn("version", F.when(F.col("o_orderkey") % 2 == 0, F.col("version")).otherwise(F.concat(F.lit("new-"), "version"))).drop("o_orderkey")
    return registry.inserted(have, new, "version")


def _evaluations(t: Tables) -> DataFrame:
    """A line item is an evaluation of the run and version of its order; every sixth names no run, every seventh a version that is gone."""
    lines = adapter.table(t.spark, t.folder, "lineitem").where("l_linenumber = 2").selectExpr("l_orderkey AS o_orderkey", "l_partkey")
    rows = lines.join(_versions(t).select("o_orderkey", "version"), "o_orderkey")
    return rows.selectExpr("CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey AS STRING) END AS run_id", "CASE WHEN o_orderkey % 7 > 0 THEN version ELSE 'gone' END AS version", """'{"value": 0.' || lpad(CAST(l_partkey % 997 AS STRING), 3, '0') || '}' AS metrics""")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE o_orderkey % 3 = 2 AND (o_orderkey % 6 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2))")
def unmeasured_runs(t: Tables) -> DataFrame:
    runs = orders(t).selectExpr("CAST(o_orderkey AS STRING) AS run_id", f"{_STATUS} AS status")
    return registry.unmeasured_runs(runs, _evaluations(t))


@query(f"SELECT CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS run_id, CASE WHEN o_orderkey % 7 > 0 THEN version ELSE 'gone' END AS version, CASE WHEN o_orderkey % 7 > 0 THEN model_type END AS model_type, (l_partkey % 997) / 1000.0::DOUBLE AS value FROM lineitem JOIN {_V} ON l_orderkey = o_orderkey WHERE l_linenumber = 2")
def realized_stored(t: Tables) -> DataFrame:
    return registry.realized_stored(_evaluations(t), _versions(t).drop("metrics"))


# Guarded SQL.

_MINE = "(SELECT * FROM d2 WHERE acc_id % 3 = 1)"
#: A statement, and the SQL of how many rows the caller gets; none if it is refused.
STATEMENTS = [
    ("SELECT acc_id FROM outputs -- all", f"least(100, (SELECT count(*) FROM {_MINE}))"), ("SELECT 'Update' AS what, max(acc_id) AS m FROM outputs;", "1"), ("SELECT * FROM outputs", None), ("WITH x AS (SELECT 1) SELECT 1 FROM x", None),
    ("SELECT acc_id FROM payments", None), ("DROP TABLE outputs", None), ("SELECT 1; SELECT 2", None), ("SELECT reflect('java.lang.System', 'exit', '1')", None),
    ("SELECT segment, count(*) AS n FROM outputs WHERE acc_id IN (SELECT acc_id FROM outputs) GROUP BY segment", f"(SELECT count(DISTINCT segment) FROM {_MINE})"),
    ("SELECT o.acc_id FROM outputs o LEFT JOIN outputs p ON o.acc_id = p.acc_id WHERE o.value_tier = 'high'", f"least(100, (SELECT count(*) FROM {_MINE} WHERE value_tier = 'high'))"),
    ("SELECT acc_id FROM outputs WHERE segment = '00000000-0000-0000-0000-000000000009'", None), ("SELECT $$x$$", None),
]


@query(" UNION ALL ".join(f"SELECT {i} AS id, {str(n is not None).lower()} AS allowed, CAST({n or 'NULL'} AS BIGINT) AS n" for i, (_, n) in enumerate(STATEMENTS)))
def guarded_refusals(t: Tables) -> DataFrame:
    """Which of the listed statements may be run over the caller's outputs, and how many rows they give."""
    run = (F.col("acc_id") % 3).cast("string").alias("prediction_run_id")
    # The rows are computed once and written: every statement has a session of its own, which can't see this one's frames.
    path = f"{shared_folder(t.customers)}/outputs-{uuid.uuid4()}"
    t.derived().select("acc_id", "segment", "value_tier", "predicted_clv", run).write.parquet(path)
    views = {"outputs": lambda session: session.read.parquet(path)}
    found = []
    for i, (sql, _) in enumerate(STATEMENTS):
        try:
            rows = guarded_sql.run_guarded(t.spark, sql, "viewer", views, 100, guarded_sql.Scope(run_ids=frozenset({"1"})))
            found.append(rows.agg(F.lit(i).alias("id"), F.lit(True).alias("allowed"), F.count("*").alias("n")).first())
        except guarded_sql.Refused:
            found.append((i, False, None))
    return t.spark.createDataFrame([tuple(r) for r in found], "id int, allowed boolean, n long")
