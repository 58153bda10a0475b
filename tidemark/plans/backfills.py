"""Queries that measure two hundred runs at once, and their DuckDB SQL: a run for every nation and eight versions of its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import backfill, labels
from tidemark.operators.outcomes import CHURN_METRICS, CLV_METRICS
from tidemark.plans.catalog import CUTOFF, Tables, query
from tidemark.sources import adapter

VERSIONS = 8
#: The cutoff of the last version, whose horizon has not come.
LATER = "2030-01-01"


def runs(t: Tables) -> DataFrame:
    """run_id, nation, k, cutoff and horizon of every run."""
    version = F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))).alias("k")
    rows = adapter.table(t.spark, t.folder, "nation").select(F.col("n_nationkey").cast("int").alias("nation"), version)
    cutoff = F.when(F.col("k") == VERSIONS - 1, LATER).otherwise(CUTOFF.isoformat()).cast("date")
    return rows.select((F.col("nation") * VERSIONS + F.col("k")).alias("run_id"), "nation", "k", cutoff.alias("cutoff"), F.lit(180).alias("horizon"))


def of_runs(t: Tables, judged: DataFrame) -> DataFrame:
    """``judged`` (acc_id, p, y) once a run of the account's nation; later versions say less."""
    nation = adapter.table(t.spark, t.folder, "customer").select(F.col("c_custkey").cast("int").alias("acc_id"), F.col("c_nationkey").cast("int").alias("nation"))
    every = judged.join(nation, "acc_id").join(F.broadcast(runs(t).select("run_id", "nation", "k")), "nation")  # VERSIONS rows a nation
    return every.select("run_id", "acc_id", (F.col("p") * (1 - (F.col("k") + 0.37) / 17.3)).alias("p"), "y")


def last_day(t: Tables) -> DataFrame:
    return labels.activity_events(t.payments, t.usage).agg(F.max("at").alias("last"))


def _of_runs(judged: str) -> str:
    return f"""(SELECT CAST(c_nationkey * {VERSIONS} + k AS INT) AS run_id, acc_id, p * (1 - (k + 0.37::DOUBLE) / 17.3::DOUBLE) AS p, y::DOUBLE AS y
      FROM {judged} JOIN customer ON c_custkey = acc_id, (SELECT unnest(range({VERSIONS})) AS k))"""


def _long(rows: str, names: list[str], one_class: str = "") -> str:
    """Rows of metrics by run to one row a metric, or the reason for none."""
    runs_sql = f"(SELECT CAST(n_nationkey * {VERSIONS} + k AS INT) AS run_id, k FROM nation, (SELECT unnest(range({VERSIONS})) AS k))"
    why = f"""CASE WHEN k = {VERSIONS - 1} THEN 'horizon not elapsed: activity is needed through 2030-06-30' WHEN coalesce(n, 0) < 20
      THEN 'only ' || CAST(coalesce(n, 0) AS BIGINT) || ' scored accounts are labelled, 20 are needed' {one_class} END"""
    each = " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value, skipped FROM told WHERE skipped IS NULL" for m in names)
    return f"""SELECT * FROM (WITH told AS (SELECT r.*, {why} AS skipped FROM (SELECT * FROM {runs_sql} LEFT JOIN ({rows}) USING (run_id)) r)
      {each} UNION ALL SELECT run_id, NULL, NULL, skipped FROM told WHERE skipped IS NOT NULL)"""


_J = _of_runs("judged")
_TOPS = ", ".join(
    f"sum(y) FILTER (r <= ceil(m * {k / 100})) / nullif(sum(y), 0) AS recall_at_top{k}pct, avg(y) FILTER (r <= ceil(m * {k / 100})) / nullif(avg(y), 0) AS lift_at_top{k}pct" for k in (5, 10, 20)
)
_PART = "coalesce({0} / nullif({1}, 0), 0)"
_CHURN = f"""
  SELECT * FROM (SELECT run_id, count(*) AS n, avg(y) AS positive_rate, sum(y) AS pos, avg((p - y) * (p - y)) AS brier, 1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0) AS bss,
      -avg(CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) AS log_loss,
      {_PART.format("count(*) FILTER (p >= 0.5 AND y = 1)", "count(*) FILTER (p >= 0.5)")} AS precision, {_PART.format("count(*) FILTER (p >= 0.5 AND y = 1)", "count(*) FILTER (y = 1)")} AS recall,
      {_PART.format("2 * count(*) FILTER (p >= 0.5 AND y = 1)", "(count(*) FILTER (p >= 0.5) + count(*) FILTER (y = 1))")} AS f1, {_TOPS},
      (sum(a) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, acc_id) AS r, count(*) OVER (PARTITION BY run_id) AS m,
      rank() OVER (PARTITION BY run_id ORDER BY p) + (count(*) OVER (PARTITION BY run_id, p) - 1) / 2.0 AS a FROM {_J}) GROUP BY 1)
  JOIN (SELECT run_id, sum(gap * m) / sum(m) AS ece, max(gap) AS mce FROM (SELECT run_id, least(floor(p * 10 + 1e-12), 9) AS b, count(*) AS m, abs(avg(p) - avg(y)) AS gap FROM {_J} GROUP BY 1, 2) GROUP BY 1) USING (run_id)
  JOIN (SELECT run_id, sum(CASE WHEN h > 0 THEN h / nullif(hp, 0) * caught / seen END) AS pr_auc FROM (SELECT run_id, h, sum(h) OVER (PARTITION BY run_id) AS hp, sum(h) OVER w AS caught, sum(c) OVER w AS seen
    FROM (SELECT run_id, p, sum(y) AS h, count(*) AS c FROM {_J} GROUP BY 1, 2) WINDOW w AS (PARTITION BY run_id ORDER BY p DESC)) GROUP BY 1) USING (run_id)"""


@query(_long(_CHURN, CHURN_METRICS, "WHEN pos = 0 OR pos = n THEN 'all labels are of one class'"))
def backfill_churn(t: Tables) -> DataFrame:
    """All churn metrics of two hundred runs, or why a run has none."""
    return backfill.backfill_churn(of_runs(t, t.judged()), runs(t), last_day(t))


_V = _of_runs("valued")
_VALUE = f"""
  SELECT run_id, count(*) AS n, corr(rp, ry) AS spearman, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + greatest(y, 0)), 2))) AS rmsle,
    avg(CASE WHEN abs(p) + abs(y) > 0 THEN 2 * abs(p - y) / (abs(p) + abs(y)) ELSE 0 END) AS smape, sum(y) FILTER (r <= ceil(m * 0.1)) / nullif(sum(y), 0) AS top_decile_capture, sum(p) AS predicted_total, sum(y) AS realized_total
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, acc_id) AS r, count(*) OVER (PARTITION BY run_id) AS m,
    rank() OVER (PARTITION BY run_id ORDER BY p) + (count(*) OVER (PARTITION BY run_id, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY run_id ORDER BY y) + (count(*) OVER (PARTITION BY run_id, y) - 1) / 2.0 AS ry FROM {_V}) GROUP BY 1"""


@query(_long(_VALUE, CLV_METRICS))
def backfill_value(t: Tables) -> DataFrame:
    """All value metrics of two hundred runs, or why a run has none."""
    return backfill.backfill_value(of_runs(t, t.valued()), runs(t), last_day(t))


@query(f"SELECT CAST(n_nationkey * {VERSIONS} + k AS INT) AS run_id, CAST(n_nationkey AS INT) AS nation, CAST(k AS INT) AS k FROM nation, (SELECT unnest(range({VERSIONS})) AS k) WHERE n_nationkey * {VERSIONS} + k NOT IN (SELECT o_orderkey % 200 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'O' AND o_orderkey < 400)")
def runs_to_measure(t: Tables) -> DataFrame:
    """Runs without an evaluation; evaluations are read from some of the orders."""
    found = adapter.table(t.spark, t.folder, "orders").where("o_orderkey % 3 = 0 and o_orderstatus = 'O' and o_orderkey < 400").select((F.col("o_orderkey") % 200).cast("int").alias("run_id"))
    return backfill.unmeasured(runs(t).select("run_id", "nation", "k"), found)
