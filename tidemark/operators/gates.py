"""Validation gates: every check is a row (name, severity, passed, value), one aggregation per table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import day
from tidemark.operators.metrics import top_share

BLOCKER, WARNING = "blocker", "warning"
LARGEST_BAD_DATES, LARGEST_ORPHANS, LARGEST_NULLS = 0.005, 0.01, 0.50
#: Fixed limits of the label gates: rows, non-zero labels, share of the largest percent, share of censored rows.
LEAST_ROWS, LEAST_NONZERO, LARGEST_TOP_SHARE, LARGEST_CENSORED = 500, 100, 0.50, 0.90
#: Customer columns whose null rates are watched, and those that may not be features: they are as of the export.
CUSTOMER_COLUMNS = ["status_sms", "credit_sms", "credit_email", "expire_sms", "expire_email", "status_email", "join_date", "last_access", "last_send"]
SNAPSHOT_COLUMNS = ["credit_sms", "credit_email", "expire_sms", "expire_email", "last_access", "last_send"]
#: Allowed values of the categories.
ALLOWED = {
    "status": ["paid", "free", "active", "inactive", "trial", "suspended", ""],
    "credit_type": ["sms", "email", ""], "channel": ["sms", "email"], "usage_source": ["bc", "api", "otp"],
}


def report(measured: DataFrame, rules: list[tuple[str, str, str, Column]], keep: list[str] | None = None) -> DataFrame:
    """Rows of measures and rules (check, severity, measure, passed) to a row a check; ``keep`` names columns that stay."""
    rows = [F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.coalesce(p, F.lit(False)).alias("passed"), F.col(m).cast("double").alias("value")) for n, s, m, p in rules]
    return measured.select(*(keep or []), F.explode(F.array(*rows)).alias("r")).select(*(keep or []), "r.check", "r.severity", "r.passed", "r.value")


def status(checks: DataFrame) -> DataFrame:
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s)) > 0
    return checks.agg(F.when(bad(BLOCKER), "failed").when(bad(WARNING), "warning").otherwise("passed").alias("status"))


def gate_columns(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """Every required column is there; looked up in the schema, no rows read."""
    rows = [(f"{name}.{c}_exists", BLOCKER, c in df.columns, float(c in df.columns)) for c in required]
    return df.sparkSession.createDataFrame(rows, "check string, severity string, passed boolean, value double")


def gate_structure(tables: dict[str, DataFrame | None], required: dict[str, list[str]], spark: SparkSession) -> DataFrame:
    """Every required table is there, and every required column of it; looked up in the schemas, no rows read."""
    rows = []
    for name, columns in required.items():
        have = tables.get(name)
        rows.append((f"{name}_exists", BLOCKER, have is not None, float(have is not None)))
        rows += [(f"{name}.{c}_exists", BLOCKER, ok := have is not None and c in have.columns, float(ok)) for c in columns]
    return spark.createDataFrame(rows, "check string, severity string, passed boolean, value double")


def gate_feature_list(df: DataFrame, contract: list[str]) -> DataFrame:
    """The features are those of the contract in its order, and none of them is a value as of the export."""
    names = [c for c in df.columns if c != "acc_id"]
    found = [c for c in names if c in SNAPSHOT_COLUMNS]
    rows = [("feature_list_equals_contract", BLOCKER, names == contract, float(len(names))), ("snapshot_fields_excluded", BLOCKER, not found, float(len(found)))]
    return df.sparkSession.createDataFrame(rows, "check string, severity string, passed boolean, value double")


def gate_sources(requested: DataFrame, catalog: DataFrame, counts: DataFrame, training: bool) -> DataFrame:
    """Whether each requested source may be used: a row a source and check; of an unknown source only that it is unknown.

    ``catalog``: source_id, import_status, clean_manifest (JSON with a list ``warnings``). ``counts``: source_id,
    customers, payments, usage. Predicting goes on without payments or usage, training doesn't.
    """
    known = catalog.withColumn("__known", F.lit(True))
    rows = requested.select("source_id").join(known, "source_id", "left").join(counts, "source_id", "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    warnings = F.size(F.coalesce(F.from_json(F.get_json_object("clean_manifest", "$.warnings"), "array<string>"), F.array().cast("array<string>")))
    rows = rows.select(
        "source_id", F.coalesce("__known", F.lit(False)).cast("int").alias("known"), F.coalesce(F.col("import_status") == "ready", F.lit(False)).cast("int").alias("ready"),
        F.col("clean_manifest").isNotNull().cast("int").alias("manifest"), warnings.alias("warnings"), of("customers"), of("payments"), of("usage"),
    )
    severity, end = (BLOCKER, "non_empty") if training else (WARNING, "optional")
    rules = [
        ("source_exists", BLOCKER, "known", F.col("known") == 1), ("source_ready", BLOCKER, "ready", F.col("ready") == 1), ("clean_manifest_exists", BLOCKER, "manifest", F.col("manifest") == 1),
        ("clean_manifest_warnings", WARNING, "warnings", F.col("warnings") == 0), ("customers_non_empty", BLOCKER, "customers", F.col("customers") > 0),
        (f"payments_{end}", severity, "payments", F.col("payments") > 0), (f"usage_{end}", severity, "usage", F.col("usage") > 0),
    ]
    return report(rows, rules, ["source_id", "known"]).where((F.col("known") == 1) | (F.col("check") == "source_exists")).drop("known")


def gate_ids(df: DataFrame, name: str) -> DataFrame:
    return report(df.agg(F.count_if(F.col("acc_id").isNull()).alias("n")), [(f"{name}_acc_id_valid", BLOCKER, "n", F.col("n") == 0)])


def gate_dates(df: DataFrame, column: str) -> DataFrame:
    share = F.coalesce(F.avg(F.col(column).isNull().cast("int")), F.lit(0.0))
    return report(df.agg(share.alias("v")), [(f"{column}_valid", BLOCKER, "v", F.col("v") <= LARGEST_BAD_DATES)])


def gate_non_negative(df: DataFrame, column: str, severity: str) -> DataFrame:
    return report(df.agg(F.count_if(F.col(column) < 0).alias("n")), [(f"{column}_non_negative", severity, "n", F.col("n") == 0)])


def gate_allowed_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    odd = df.select(F.coalesce(column, F.lit("")).alias("v")).where(~F.col("v").isin(allowed)).distinct()
    return report(odd.agg(F.count("*").alias("n")), [(f"{column}_allowed", WARNING, "n", F.col("n") == 0)])


def gate_duplicates(customers: DataFrame) -> DataFrame:
    """Null accounts count as duplicates of each other."""
    many = customers.groupBy("acc_id").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    return report(many, [("customer_duplicates", BLOCKER, "n", F.col("n") == 0)])


def gate_orphans(customers: DataFrame, activity: DataFrame) -> DataFrame:
    ids = activity.select("acc_id").where(F.col("acc_id").isNotNull()).distinct()
    marked = ids.join(customers.select("acc_id").distinct().withColumn("known", F.lit(1)), "acc_id", "left")
    share = marked.agg(F.coalesce(F.avg(F.col("known").isNull().cast("int")), F.lit(0.0)).alias("v"))
    return report(share, [("orphan_activity", WARNING, "v", F.col("v") <= LARGEST_ORPHANS)])


def gate_duplicate_sheets(usage: DataFrame) -> DataFrame:
    """Two sources of a channel with the same rows, counting repeats: compared by counts and order-free hashes."""
    key = F.xxhash64("acc_id", "year", "month", "usage")
    prints = usage.groupBy("channel", "usage_source").agg(F.count("*").alias("n"), F.sum((key % 1_000_003)).alias("a"), F.bit_xor(key).alias("b"))
    same = prints.groupBy("channel", "n", "a", "b").count().where("count > 1").agg(F.count("*").alias("n"))
    return report(same, [("duplicate_usage_sheets", WARNING, "n", F.col("n") == 0)])


def gate_null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    measured = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)).alias(c) for c in columns])
    return report(measured, [(f"{c}_null_rate", WARNING, c, F.col(c) <= LARGEST_NULLS) for c in columns])


def gate_cutoff(events: DataFrame, cutoff: date, window: int = 180, horizon: int = 180, history: int = 365) -> DataFrame:
    """Enough before and after the cutoff; ``events`` are activity_events."""
    span = events.agg(F.count("*").alias("n"), F.datediff(day(cutoff), F.min("at")).alias("before"), F.datediff(F.max("at"), day(cutoff)).alias("after"), F.lit(window).alias("window"), F.lit(horizon).alias("horizon"))
    rules = [
        ("active_window_positive", BLOCKER, "window", F.col("window") > 0), ("horizon_days_positive", BLOCKER, "horizon", F.col("horizon") > 0),
        ("activity_exists", BLOCKER, "n", F.col("n") > 0), ("history_before_cutoff", BLOCKER, "before", F.col("before") > window),
        ("future_label_window", BLOCKER, "after", F.col("after") >= horizon), ("history_depth", WARNING, "before", F.col("before") >= history),
    ]
    return report(span, rules)


def gate_labels(churn: DataFrame, least: int = 500, least_class: int = 100) -> DataFrame:
    counts = churn.agg(F.count("*").alias("n"), F.count_if(F.col("churned") == 1).alias("pos"), F.count_if(F.col("churned") == 0).alias("neg"), F.coalesce(F.avg("churned"), F.lit(0.0)).alias("rate"))
    rules = [
        ("churn_eligible", BLOCKER, "n", F.col("n") >= least), ("churn_positives", BLOCKER, "pos", F.col("pos") >= least_class),
        ("churn_negatives", BLOCKER, "neg", F.col("neg") >= least_class), ("churn_rate", BLOCKER, "rate", F.col("rate").between(0.05, 0.80)),
    ]
    return report(counts, rules)


def gate_clv_labels(clv: DataFrame) -> DataFrame:
    """Enough accounts and revenue to learn from, and not all of it with one percent of them."""
    y = "future_revenue"
    counts = clv.agg(F.count("*").alias("n"), F.count_if(F.col(y) > 0).alias("nonzero"), F.coalesce(F.var_pop(y), F.lit(0.0)).alias("variance"))
    both = counts.join(top_share(clv, y, "acc_id", 0.01).select(F.coalesce("share", F.lit(0.0)).alias("share")))
    return report(both, [
        ("clv_eligible", BLOCKER, "n", F.col("n") >= LEAST_ROWS), ("clv_nonzero", BLOCKER, "nonzero", F.col("nonzero") >= LEAST_NONZERO),
        ("clv_variance", BLOCKER, "variance", F.col("variance") > 0), ("clv_top_share", WARNING, "share", F.col("share") <= LARGEST_TOP_SHARE),
    ])


def gate_credit_labels(credit: DataFrame) -> DataFrame:
    measures = [m for d in (30, 90) for m in (F.count_if(F.col(f"usage_{d}d") > 0).alias(f"nonzero_{d}"), F.coalesce(F.var_pop(f"usage_{d}d"), F.lit(0.0)).alias(f"variance_{d}"))]
    rules = [r for d in (30, 90) for r in ((f"credit_{d}d_nonzero", BLOCKER, f"nonzero_{d}", F.col(f"nonzero_{d}") >= LEAST_ROWS), (f"credit_{d}d_variance", BLOCKER, f"variance_{d}", F.col(f"variance_{d}") > 0))]
    return report(credit.agg(*measures), rules)


def gate_topup_labels(topup: DataFrame) -> DataFrame:
    counts = topup.agg(F.count_if(F.col("observed") == 1).alias("seen"), F.coalesce(1 - F.avg("observed"), F.lit(1.0)).alias("censored"))
    return report(counts, [("topup_observed", WARNING, "seen", F.col("seen") >= LEAST_ROWS), ("topup_censoring", WARNING, "censored", F.col("censored") <= LARGEST_CENSORED)])


def gate_leakage(pit_payments: DataFrame, pit_usage: DataFrame, cutoff: date) -> DataFrame:
    """Nothing at or after the cutoff is left in what the features read."""
    late = pit_payments.agg(F.count_if(F.col("payment_date") >= day(cutoff)).alias("p")).join(pit_usage.agg(F.count_if(F.col("period") >= day(cutoff)).alias("u")))
    return report(late, [("payments_before_cutoff", BLOCKER, "p", F.col("p") == 0), ("usage_before_cutoff", BLOCKER, "u", F.col("u") == 0)])


def gate_output(out: DataFrame, expected: DataFrame) -> DataFrame:
    p, due = F.col("churn_probability"), F.col("stage") == "Active Paid"
    got = out.agg(F.count("*").alias("n"), F.count_if((p < 0) | (p > 1)).alias("range"), F.coalesce(F.avg(F.when(due, p.isNull().cast("int"))), F.lit(0.0)).alias("nulls"))
    both = got.join(expected.agg(F.count("*").alias("want")))
    return report(both, [("row_count", BLOCKER, "n", F.col("n") == F.col("want")), ("range", BLOCKER, "range", F.col("range") == 0), ("null_rate", BLOCKER, "nulls", F.col("nulls") <= 0.01)])


def quality_stats(df: DataFrame, amounts: list[str], dates: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> DataFrame:
    """Rows, accounts, negative amounts, shares of missing ids and dates, and the values of the categories, sorted."""
    missing = lambda c: F.round(F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)), 6).alias(f"{c}_missing")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.coalesce(F.col(c), F.lit("")))), ",").alias(f"{c}_values")
    return df.agg(
        F.count("*").alias("n"), F.count_distinct("acc_id").alias("accounts"), *[F.count_if(F.col(c) < 0).alias(f"{c}_negative") for c in amounts],
        *map(missing, ("acc_id", *dates)), *map(listed, categories),
    )
