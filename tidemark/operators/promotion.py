"""Which trained candidate replaces the champion: safety first, then quality, over tables of metrics.

``candidates``: name, leakage_ok, artifact_ok, validation, test, baseline_validation, baseline_test, calibration_error.
``backtests``: name, cutoff, value, baseline, champion (the last two may be null). Values are turned so that larger is
better before anything is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(
    candidates: DataFrame, backtests: DataFrame, higher_is_better: bool = True, margin: float = 0.0, relative_margin: float = 0.0, largest_drop: float = 0.30,
    ceiling: float | None = None, target: float | None = None, penalty: float = 1.0,
) -> DataFrame:
    """name, eligible, composite, reasons (comma-joined, in the order of the checks)."""
    sign = F.lit(1.0 if higher_is_better else -1.0)
    shared = F.col("champion").isNotNull()
    sums = backtests.groupBy("name").agg(
        F.count("*").alias("n"), F.sum(sign * F.col("value")).alias("total"), F.count_if(sign * F.col("value") <= sign * F.col("baseline")).alias("lost"),
        F.avg(F.when(shared, sign * (F.col("value") - F.col("champion")))).alias("gap"), F.abs(F.avg(F.when(shared, F.col("champion")))).alias("champion_size"),
        F.percentile("value", 0.5).alias("middle"), F.min(sign * F.col("value")).alias("worst"),
    )
    rows = candidates.join(sums, "name", "left")
    drop = F.when((F.col("n") >= 2) & (F.col("middle") != 0), (sign * F.col("middle") - F.col("worst")) / F.abs("middle"))
    needed = F.greatest(F.lit(margin), F.coalesce(relative_margin * F.col("champion_size"), F.lit(margin)))
    off = F.col("calibration_error")
    checks = [
        ("leakage", ~F.col("leakage_ok")), ("artifact", ~F.col("artifact_ok")),
        ("baseline on validation", sign * F.col("validation") <= sign * F.col("baseline_validation")), ("baseline on test", sign * F.col("test") <= sign * F.col("baseline_test")),
        ("baseline on a backtest", F.col("lost") > 0), ("champion", F.col("gap") < needed), ("unstable", drop > largest_drop),
        ("calibration", off > ceiling if ceiling is not None else F.lit(False)),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]))
    quality = (sign * F.col("test") + F.coalesce("total", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))
    excess = penalty * F.greatest(F.lit(0.0), F.coalesce(off - target, F.lit(0.0))) if target is not None else F.lit(0.0)
    return rows.select("name", (F.size(reasons) == 0).alias("eligible"), F.round(quality - excess, 6).alias("composite"), F.array_join(reasons, ", ").alias("reasons"))


def winner(decisions: DataFrame) -> DataFrame:
    """The eligible candidate with the largest composite; no row: the champion stays."""
    return decisions.where("eligible").orderBy(F.desc("composite"), "name").limit(1).select("name", "composite")
