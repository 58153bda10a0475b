"""Where results go: raw rows, runs, reports, feature sets, model artifacts, and CSV for spreadsheets. All through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.reports import EXPORT_ROWS

#: Columns of the export, in order.
EXPORT_COLUMNS = [
    "acc_id", "lifecycle_stage", "sub_stage", "segment", "churn_probability", "churn_risk_level", "predicted_clv_6m", "customer_value_tier", "revenue_at_risk", "credit_urgency_level",
    "estimated_days_until_topup", "predicted_credit_usage_30d", "predicted_credit_usage_90d", "days_since_last_activity", "n_purchases", "total_revenue", "priority_score", "priority_rank",
    "ever_paid", "usage_trend", "output_status",
]
BOM = "﻿"


def write_partition(df: DataFrame, path: str, column: str) -> None:
    """Parquet by the values of a column; partitions that ``df`` has are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_raw(rows: DataFrame, path: str) -> None:
    """Raw sheet rows (source_id, sheet, excel_row, row_payload), a partition a source."""
    write_partition(rows, path, "source_id")


def write_run(df: DataFrame, path: str, run_id: str, order: Column | None = None) -> None:
    """Outputs of one run: its partition is replaced, other runs stay; of rows with one account the last in ``order`` stays.

    Without an order the largest row by all its columns stays, so that a repeated write gives the same rows.
    """
    last = order if order is not None else F.struct(*sorted(df.columns))
    rows = df.groupBy("acc_id").agg(F.max_by(F.struct(*df.columns), last).alias("r")).select("r.*")
    write_partition(rows.withColumn("prediction_run_id", F.lit(run_id)), path, "prediction_run_id")


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge: rows of ``new`` replace those of ``old`` with the same keys, and the rest is added."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc("__new"))
    return both.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at", "__new")


def csv_cell(value: Column) -> Column:
    """A value as RFC 4180 text: quoted if it has a comma, a quote or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def export_lines(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """place, line of a CSV file of at most EXPORT_ROWS rows (a limit of the export); line 0 is the header behind a BOM."""
    top = df.orderBy(*order).limit(EXPORT_ROWS)
    numbered = top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))
    header = df.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(BOM + ",".join(columns)).alias("line"))
    return header.unionByName(numbered)


def write_export(df: DataFrame, columns: list[str], order: list[Column], path: str) -> None:
    """One CSV file with BOM and CRLF; it is bounded, so one task writes it."""
    export_lines(df, columns, order).orderBy("place").coalesce(1).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def _digest(spark: SparkSession, path: str) -> str:
    """One digest of all files below a path: names and contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0)
    each = files.select(F.concat(F.substring_index("path", "/", -3), F.lit(":"), F.sha2("content", 256)).alias("d"))
    return each.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("d"))).cast("binary"), 256).alias("d")).first()["d"]  # a row a file of one model


def save_artifact(spark: SparkSession, model, path: str, facts: dict[str, str]) -> str:
    """A fitted Spark ML model and a JSON companion with its facts and the digest of its files; returns the digest."""
    model.write().overwrite().save(f"{path}/model")
    digest = _digest(spark, f"{path}/model")
    row = {**facts, "sha256": digest}
    spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row)).coalesce(1).write.mode("overwrite").json(f"{path}/card")
    return digest


def load_artifact(spark: SparkSession, kind, path: str):
    """(model, facts); raises if the files are not those that were saved."""
    card = spark.read.json(f"{path}/card").first().asDict()
    if _digest(spark, f"{path}/model") != card["sha256"]:
        raise ValueError("the artifact's files have changed")
    return kind.load(f"{path}/model"), card
