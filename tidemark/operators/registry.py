"""Tables of model versions, aliases, evaluations, runs and imports: small metadata frames, joined, ranked and rewritten.

Every change takes the tables and returns them as they are afterwards; the caller writes them back (``sources.sinks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The alias of the version that serves.
CHAMPION = "champion"


def next_version(versions: DataFrame, model_type: str, month: str) -> DataFrame:
    """``{type}-{YYYY.MM}.{number of versions of that month + 1}``."""
    stem = f"{model_type}-{month}."
    return versions.where(F.col("version").startswith(stem)).agg(F.concat(F.lit(stem), (F.count("*") + 1).cast("string")).alias("version"))


def headline(metrics: Column, metric: str) -> Column:
    return F.get_json_object(metrics, f"$.{metric}").try_cast("double")


def model_versions(versions: DataFrame, model_type: str, metric: str) -> DataFrame:
    return versions.where(F.col("model_type") == model_type).select("version", "created_at", headline(F.col("metrics"), metric).alias("metric"))


def model_performance(versions: DataFrame, aliases: DataFrame, metric: str) -> DataFrame:
    """Champion of every model type with its metric, and how many versions of the type have a better one."""
    rows = versions.withColumn("metric", headline(F.col("metrics"), metric))
    champion = rows.join(aliases.where(F.col("alias") == CHAMPION).select("version"), "version").select("model_type", F.col("version").alias("champion"), F.col("metric").alias("champion_metric"))
    better = F.count_if(F.col("metric") > F.col("champion_metric"))
    return rows.join(champion, "model_type").groupBy("model_type", "champion", "champion_metric").agg(better.alias("n_better"), F.count("*").alias("n"))


def ranked_candidates(versions: DataFrame, evaluations: DataFrame, metric: str, higher_is_better: bool = True, order: list[str] | None = None) -> DataFrame:
    """model_type, version, metric on the holdout, mean over the backtests, the baseline's metric, and the place by the holdout.

    A mean of doubles depends in its last digit on the order in which they are added, and so do the places of equal means. With
    ``order`` (columns of the evaluations) a version's values are added in that order, wherever its rows stand.
    """
    value = headline(F.col("metrics"), metric)

    def part(kind: str) -> Column:
        own = F.when((F.col("kind") == kind) & value.isNotNull(), value if order is None else F.struct(*order, value.alias("__value")))
        if order is None:
            return F.avg(own).alias(kind)
        values = F.sort_array(F.collect_list(own))  # a version has few evaluations
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, v: total + v["__value"]), F.size(values)).alias(kind)

    measured = evaluations.groupBy("version").agg(*[part(k) for k in ("holdout", "backtest", "baseline")])
    rows = versions.select("model_type", "version").join(measured, "version", "left")
    best = F.col("holdout").desc_nulls_last() if higher_is_better else F.col("holdout").asc_nulls_last()
    place = F.rank().over(Window.partitionBy("model_type").orderBy(best))  # the versions of a type
    return rows.select("model_type", "version", "holdout", "backtest", "baseline", F.when(F.col("holdout").isNotNull(), place.cast("long")).alias("place"))


def inserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the new rows whose key it doesn't have yet."""
    return table.unionByName(new.join(table.select(key), key, "left_anti").select(*table.columns))


def promoted(aliases: DataFrame, model_type: str, version: str) -> DataFrame:
    """The alias table with that version as the type's champion."""
    new = aliases.sparkSession.createDataFrame([(model_type, CHAMPION, version)], "model_type string, alias string, version string")
    others = aliases.where(~((F.col("model_type") == model_type) & (F.col("alias") == CHAMPION)))
    return others.select("model_type", "alias", "version").unionByName(new)


def promote(versions: DataFrame, aliases: DataFrame, history: DataFrame, model_type: str, version: str, reason: str, action: str = "promote") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions (the old champion archived, the new one in production), aliases, and history with one row more."""
    mine = F.col("model_type") == model_type
    chosen = mine & (F.col("version") == version)
    status = F.when(chosen, "production").when(mine & (F.col("status") == "production"), "archived").otherwise(F.col("status"))
    previous = aliases.where(mine & (F.col("alias") == CHAMPION)).agg(F.max("version").alias("previous"))
    row = previous.select(F.lit(model_type).alias("model_type"), "previous", F.lit(version).alias("version"), F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    return versions.withColumn("status", status), promoted(aliases, model_type, version), history.unionByName(row.select(*history.columns))


def deleted(versions: DataFrame, aliases: DataFrame, version: str) -> DataFrame:
    """The versions without that one; a version that an alias names stays."""
    named = aliases.where(F.col("version") == version).select("version")
    gone = versions.where(F.col("version") == version).select("version").join(named, "version", "left_anti")
    return versions.join(gone, "version", "left_anti").select(*versions.columns)


def unmeasured_runs(runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    measured = evaluations.where(F.col("run_id").isNotNull()).select("run_id").distinct()
    return runs.where("status = 'completed'").join(measured, "run_id", "left_anti").select("run_id")


def realized_stored(evaluations: DataFrame, versions: DataFrame) -> DataFrame:
    return evaluations.join(versions.select("version", "model_type"), "version", "left").select("run_id", "version", "model_type", headline(F.col("metrics"), "value").alias("value"))


def retried(runs: DataFrame, run_id: str) -> DataFrame:
    """A failed run is queued again without its start and error; any other stays as it is."""
    again = (F.col("run_id") == run_id) & (F.col("status") == "failed")
    return runs.withColumns({"started_at": F.when(~again, F.col("started_at")), "error": F.when(~again, F.col("error")), "status": F.when(again, "queued").otherwise(F.col("status"))})


def without_run(runs: DataFrame, run_id: str, only_failed: bool = False) -> DataFrame:
    """The runs without that one; with ``only_failed`` a run that did not fail stays."""
    gone = F.col("run_id") == run_id
    return runs.where(~(gone & (F.col("status") == "failed") if only_failed else gone))


def newest_first(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(F.desc("created_at"), key)


def stale_imports(imports: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Imports that were left in the middle: under way, never cleaned, and begun too long ago."""
    return imports.where(F.col("import_status").isin("importing", "cleaning") & F.col("cleaned_at").isNull() & (F.col("created_at") < now - F.make_dt_interval(mins=F.lit(minutes))))
