"""Preprocessing and the models that Spark ML has a counterpart for.

Fits are one aggregation or one Spark ML fit over distributed rows; only parameters come to the driver. Ensembles of
other libraries are not reproduced number by number; populations, columns, ranges and order are.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import column_quantiles, medians, quantiles_row, union_all, with_position
from tidemark.functions.scalars import clipped
from tidemark.functions.storage import keep
from tidemark.operators.gates import BLOCKER, report
from tidemark.operators.metrics import brier, conformal_apply, conformal_margin, ece, pr_auc


@dataclass(frozen=True)
class Scaling:
    """fill, mean and scale of every feature, learned on training rows."""

    fill: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    rows: int = 0


def fit_scaling(train: DataFrame, names: list[str], defaults: dict[str, float] | None = None) -> Scaling:
    """Median (or default) for nulls, then mean and population deviation; a deviation of zero counts as one."""
    defaults = defaults or {}
    train = train.select(*names)
    _, middle = medians(train, names)
    fill = {c: defaults.get(c, middle[c] if middle[c] is not None else 0.0) for c in names}
    filled = train.select(*[F.coalesce(c, F.lit(fill[c])).alias(c) for c in names])
    row = filled.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    return Scaling(fill, {c: row[f"m_{c}"] or 0.0 for c in names}, {c: row[f"s_{c}"] or 1.0 for c in names}, row["n"])


def scaled(df: DataFrame, names: list[str], by: Scaling) -> DataFrame:
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[((F.coalesce(c, F.lit(by.fill[c])) - by.mean[c]) / by.scale[c]).alias(c) for c in names])


def gate_preprocessing(by: Scaling, train: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """Scaling was fitted, on the training rows and on nothing else, and keeps the order of the features."""
    out = [c for c in scaled(other, names, by).columns if c in names]
    counts = train.agg(F.count("*").alias("train"), F.lit(by.rows).alias("fitted"), F.lit(len(out)).alias("width")).join(other.agg(F.count("*").alias("other")))
    return report(counts, [
        ("preprocessor_is_fitted", BLOCKER, "fitted", F.col("fitted") > 0), ("fitted_rows_match_train", BLOCKER, "fitted", F.col("fitted") == F.col("train")),
        ("feature_order_preserved", BLOCKER, "width", F.lit(out == names)), ("no_other_split_refit", BLOCKER, "other", (F.col("fitted") != F.col("other")) | (F.col("train") == F.col("other"))),
    ])


def _class_weight(train: DataFrame, label: str) -> tuple[Column, int]:
    """A weight that gives both classes the same sum, and the number of rows."""
    n = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(n.values())
    return F.when(F.col(label) == 1, total / (2 * max(n.get(1, 0), 1))).otherwise(total / (2 * max(n.get(0, 0), 1))), total


def _scorer(model, join: VectorAssembler, names: list[str], by: Scaling, **facts):
    """A function that adds ``probability`` to rows; ``facts`` become its attributes."""

    def score(df: DataFrame) -> DataFrame:
        rows = model.transform(join.transform(scaled(df, names, by)))
        return rows.select(*[c for c in df.columns if c not in names], F.get(vector_to_array("__p"), F.lit(1)).alias("probability"))

    score.scaling = by
    for name, value in facts.items():
        setattr(score, name, value)
    return score


_COLUMNS = {"featuresCol": "__x", "weightCol": "__w", "probabilityCol": "__p", "predictionCol": "__y", "rawPredictionCol": "__r"}


def fit_churn(train: DataFrame, names: list[str], label: str, strength: float = 1.0, by: Scaling | None = None):
    """Class-balanced logistic regression; returns a function that adds ``probability`` to rows. ``by``: the scaling of these rows, if known."""
    by = by or fit_scaling(train, names)
    weight, total = _class_weight(train, label)
    join = VectorAssembler(inputCols=names, outputCol="__x")
    model = LogisticRegression(labelCol=label, regParam=1 / (strength * max(total, 1)), **_COLUMNS).fit(join.transform(scaled(train, names, by).withColumn("__w", weight)))
    return _scorer(model, join, names, by, coefficients=dict(zip(names, model.coefficients.toArray().tolist(), strict=True)))


def _fit_trees(classifier, train: DataFrame, names: list[str], label: str, by: Scaling | None = None):
    by = by or fit_scaling(train, names)
    weight, _ = _class_weight(train, label)
    join = VectorAssembler(inputCols=names, outputCol="__x")
    model = classifier.fit(join.transform(scaled(train, names, by).withColumn("__w", weight)))
    return _scorer(model, join, names, by, importances=dict(zip(names, model.featureImportances.toArray().tolist(), strict=True)), fitted=model, trees=model.getNumTrees)


def fit_forest(train: DataFrame, names: list[str], label: str, trees: int = 40, depth: int = 6, by: Scaling | None = None):
    """Class-balanced random forest."""
    return _fit_trees(RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=42, minInstancesPerNode=5, **_COLUMNS), train, names, label, by)


def fit_boosted(train: DataFrame, names: list[str], label: str, trees: int = 60, depth: int = 3, rate: float = 0.1, held: int = 5, gain: float = 0.001, by: Scaling | None = None):
    """Class-balanced gradient-boosted trees, as many as the loss of held-out accounts asks for (``trees`` at most).

    One account in ``held`` is kept from fitting; boosting ends when its loss no longer falls by ``gain`` (relative to the loss), and
    the trees of the least loss are kept. Their number is the attribute ``trees``.
    """
    boosted = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="__w", predictionCol="__y", maxIter=trees, maxDepth=depth, seed=42, stepSize=rate, minInstancesPerNode=5)
    boosted = boosted.setProbabilityCol("__p").setRawPredictionCol("__r").setValidationIndicatorCol("__held").setParams(validationTol=gain)
    marked = train.withColumn("__held", F.pmod(F.xxhash64(F.col("acc_id"), F.lit("held")), F.lit(held)) == 0)
    n = marked.agg(F.count_if("__held").alias("held"), F.count_if(~F.col("__held")).alias("fitted")).first()
    if not n["held"] or not n["fitted"]:  # too few accounts to keep any
        marked, boosted = marked.drop("__held"), boosted.copy()
        boosted.clear(boosted.validationIndicatorCol)
    return _fit_trees(boosted, marked, names, label, by)


#: What churn is tried with: the fit of every family, and of logistic regression its strengths.
FAMILIES = {
    "logistic": fit_churn, "logistic_weak": lambda *a, **k: fit_churn(*a, strength=0.1, **k), "logistic_strong": lambda *a, **k: fit_churn(*a, strength=10.0, **k),
    "forest": fit_forest, "boosted": fit_boosted,
}


def choose_family(train: DataFrame, names: list[str], label: str, folds: int = 5, families: dict | None = None) -> DataFrame:
    """family, pr_auc of its scores out of fold, the best one first: a search over families and their strengths or depths."""
    train = keep(with_fold(train, label, folds))
    by = fold_scalings(train, names, folds)

    def tried(family) -> DataFrame:
        name, fit = family
        worth = pr_auc(out_of_fold(train, names, label, folds, fit, by), "probability", label)
        return keep(worth.select(F.lit(name).alias("family"), F.round("pr_auc", 6).alias("pr_auc")))

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(tried, (families or FAMILIES).items()))
    return union_all(found).orderBy(F.desc("pr_auc"), "family")


def importances(train: DataFrame, names: list[str], label: str, n: int = 10) -> DataFrame:
    """The n features with the largest importance in a forest."""
    of = fit_forest(train, names, label).importances
    rows = sorted(of.items(), key=lambda x: (-x[1], x[0]))[:n]
    return train.sparkSession.createDataFrame([(i + 1, c, v) for i, (c, v) in enumerate(rows)], "place int, feature string, importance double")


def fit_hurdle(train: DataFrame, names: list[str], label: str):
    """Expected value in two parts: the chance of any, times a log-linear value where there is some."""
    train = keep(train.select(*names, label))
    chance = fit_plain_chance(train.withColumn("__any", (F.col(label) > 0).cast("int")), names, "__any")
    by = fit_scaling(train, names)
    join = VectorAssembler(inputCols=names, outputCol="__x")
    some = train.where(F.col(label) > 0)
    unit = some.agg(F.avg(label)).first()[0] or 1.0
    size = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="__x", labelCol="__label", predictionCol="__size", regParam=0.1, maxIter=50)
    model = size.fit(join.transform(scaled(some, names, by).withColumn("__label", F.col(label) / unit)))

    def score(df: DataFrame) -> DataFrame:
        likely = chance(df.withColumns({f"__{c}": F.col(c) for c in names})).withColumnsRenamed({f"__{c}": c for c in names})
        rows = model.transform(join.transform(scaled(likely, names, by)))
        return rows.select(*[c for c in df.columns if c not in names], (F.col("probability") * F.col("__size") * unit).alias("predicted"))

    return score


def fit_plain_chance(train: DataFrame, names: list[str], label: str):
    """Logistic regression without balancing: its probabilities are to be multiplied, not ranked."""
    by = fit_scaling(train, names)
    join = VectorAssembler(inputCols=names, outputCol="__x")
    model = LogisticRegression(labelCol=label, regParam=1e-3, **_COLUMNS).fit(join.transform(scaled(train, names, by).withColumn("__w", F.lit(1.0))))
    return _scorer(model, join, names, by)


def fit_isotonic(rows: DataFrame, score: str, label: str):
    """Monotone calibration of a score; returns a function that adds ``calibrated``, kept within 0..1."""
    model = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(rows.select(F.col(score).cast("double"), F.col(label).cast("double")))
    return lambda df: model.transform(df).withColumn("calibrated", F.greatest(F.lit(0.0), F.least("calibrated", F.lit(1.0))))


def fit_value(train: DataFrame, names: list[str], label: str, power: float = 1.5):
    """Tweedie regression of revenue with a log link, fitted in units of the mean revenue."""
    by = fit_scaling(train, names)
    unit = train.agg(F.avg(label)).first()[0] or 1.0
    join = VectorAssembler(inputCols=names, outputCol="__x")
    model = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, featuresCol="__x", labelCol="__label", predictionCol="predicted", regParam=0.1, maxIter=50).fit(join.transform(scaled(train, names, by).withColumn("__label", F.col(label) / unit)))
    return lambda df: model.transform(join.transform(scaled(df, names, by))).select(*[c for c in df.columns if c not in names], (F.col("predicted") * unit).alias("predicted"))


def top_factors(df: DataFrame, names: list[str], coefficients: dict[str, float], n: int = 5) -> DataFrame:
    """The n contributions (coefficient x scaled feature) with the largest size, largest first."""
    parts = F.array(*[F.struct((-F.abs(F.col(c) * coefficients[c])).alias("order"), F.lit(c).alias("feature"), (F.col(c) * coefficients[c]).alias("impact")) for c in names])
    return df.withColumn("factors", F.transform(F.slice(F.array_sort(parts), 1, n), lambda f: F.struct(f["feature"].alias("feature"), f["impact"].alias("impact"))))


def best_shrinkage(df: DataFrame, model: str, anchor: str, actual: str) -> DataFrame:
    """The weight in 0, 0.1 .. 1 of a forecast against its anchor with the smallest mean absolute error."""
    weights = F.explode(F.array(*[F.lit(i / 10) for i in range(11)]))
    rows = df.withColumn("weight", weights)
    error = F.abs(F.col("weight") * F.col(model) + (1 - F.col("weight")) * F.col(anchor) - F.col(actual))
    return rows.groupBy("weight").agg(F.round(F.avg(error), 6).alias("mae")).orderBy("mae", "weight").limit(1)


def magnitude_line(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Slope (20 at most) and intercept from predicted to actual; the identity if there are too few rows or no rise."""
    line = df.agg(F.regr_slope(actual, predicted).alias("a"), F.regr_intercept(actual, predicted).alias("b"), F.regr_count(actual, predicted).alias("n"))
    bad = (F.col("n") < 2) | F.col("a").isNull() | (F.col("a") < 0.01)
    return line.select(F.when(bad, 1.0).otherwise(F.least(F.col("a"), F.lit(20.0))).alias("slope"), F.when(bad, 0.0).otherwise(F.col("b")).alias("intercept"))


def alive_cuts(df: DataFrame, p_alive: str) -> DataFrame:
    """The 15th and 40th percentile of positive p_alive, clamped to (0.10, 0.30) and (0.35, 0.60); fixed under 50 values."""
    living = keep(df.where(F.col(p_alive) > 0).select(p_alive))
    got = quantiles_row(living, {"a": (p_alive, 0.15), "b": (p_alive, 0.40)}).join(living.agg(F.count("*").alias("n")))
    few, low = F.col("n") < 50, clipped(F.col("a"), 0.10, 0.30)
    high = F.greatest(clipped(F.col("b"), 0.35, 0.60), low + 1e-6)
    return got.select(F.when(few, 0.20).otherwise(F.round(low, 4)).alias("at_risk"), F.when(few, 0.50).otherwise(F.round(high, 4)).alias("watch"))


def with_fold(df: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """Folds of whole accounts, however many rows each has, with even shares of both labels.

    Accounts are put in order by their numbers of positive and of negative rows and then by a hash, and dealt to the folds in
    turn: two folds differ by at most one account's positive rows, and by one account's negative rows for every number of positive
    ones. Places are counted over range partitions; only accounts, one row each, are sorted.
    """
    of_account = df.groupBy("acc_id").agg(F.count_if(F.col(label) == 1).alias("__positive"), F.count_if(F.coalesce(F.col(label) != 1, F.lit(True))).alias("__negative"))
    order = [F.col("__positive").desc(), F.col("__negative").desc(), F.md5(F.concat_ws(":", F.col("acc_id").cast("string"), F.lit("fold"))), F.col("acc_id")]
    dealt = with_position(of_account, order, "__at").select(F.col("acc_id").alias("__acc"), F.pmod(F.col("__at") - 1, F.lit(folds)).cast("int").alias("fold"))
    return df.join(dealt, df["acc_id"].eqNullSafe(dealt["__acc"])).drop("__acc")


def fold_scalings(dealt: DataFrame, names: list[str], folds: int) -> list[Scaling]:
    """Per fold the scaling learned on the others: one for all fits that are tried on these folds."""
    with ThreadPoolExecutor(folds) as pool:
        return list(pool.map(lambda k: fit_scaling(dealt.where(F.col("fold") != k), names), range(folds)))


def out_of_fold(df: DataFrame, names: list[str], label: str, folds: int = 5, fit=fit_churn, by: list[Scaling] | None = None) -> DataFrame:
    """Scores of every row from a model that has not seen its account: ``folds`` fits over stratified folds, side by side.

    ``by``: what ``fold_scalings`` found for these folds, if ``fit`` takes it.
    """
    df = df if "fold" in df.columns else keep(with_fold(df, label, folds))
    with ThreadPoolExecutor(folds) as pool:  # each fit is a series of small jobs
        scored = pool.map(lambda k: fit(df.where(F.col("fold") != k), names, label, **({"by": by[k]} if by else {}))(df.where(F.col("fold") == k)), range(folds))
        return union_all(list(scored))


def calibrated(rows: DataFrame, score: str, label: str, ece_margin: float = 0.005, brier_margin: float = 0.02, least_positives: int = 200) -> DataFrame:
    """The score calibrated by a logistic line, or by isotonic steps.

    Steps need enough positives and a clearly smaller calibration error, or an equal one and a clearly smaller Brier score.
    """
    rows = keep(rows)
    join = VectorAssembler(inputCols=["__logit"], outputCol="__x")
    p = F.greatest(F.lit(1e-6), F.least(F.col(score), F.lit(1 - 1e-6)))
    with_logit = rows.withColumn("__logit", F.log(p / (1 - p)))
    line = LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", predictionCol="__y", rawPredictionCol="__r").fit(join.transform(with_logit))
    smooth = line.transform(join.transform(with_logit)).withColumn("calibrated", F.get(vector_to_array("__p"), F.lit(1))).select(*rows.columns, "calibrated")
    if (rows.agg(F.sum(label)).first()[0] or 0) < least_positives:
        return smooth
    steps = fit_isotonic(rows, score, label)(rows)
    measure = lambda df: ece(df, "calibrated", label).join(brier(df, "calibrated", label)).first()
    of_steps, of_line = measure(steps), measure(smooth)
    better = of_steps["ece"] < of_line["ece"] - ece_margin
    even = abs(of_steps["ece"] - of_line["ece"]) <= ece_margin and of_steps["brier"] < of_line["brier"] * (1 - brier_margin)
    return steps if better or even else smooth


def fit_topup(train: DataFrame, names: list[str], days: str, observed: str):
    """Weibull survival of the days to the next payment, right-censored; returns a function that adds ``expected_days``."""
    by = fit_scaling(train, names)
    join = VectorAssembler(inputCols=names, outputCol="__x")
    rows = scaled(train, names, by).withColumn("__days", F.greatest(F.col(days).cast("double"), F.lit(0.5))).withColumn("__seen", F.col(observed).cast("double"))
    model = AFTSurvivalRegression(featuresCol="__x", labelCol="__days", censorCol="__seen", predictionCol="expected_days").fit(join.transform(rows))
    return lambda df: model.transform(join.transform(scaled(df, names, by))).select(*[c for c in df.columns if c not in names], "expected_days")


def band_quantiles(train: DataFrame, anchor: str, actual: str, levels: list[float], bands: int = 5) -> DataFrame:
    """Quantiles of the log ratio of actual to anchor within bands of the anchor: band, low edge, one column a level."""
    ratio = F.log1p(F.greatest(F.col(actual), F.lit(0.0))) - F.log1p(F.greatest(F.col(anchor), F.lit(0.0)))
    train = keep(train.select(F.col(anchor).alias("__anchor"), ratio.alias("__ratio")))
    edges = column_quantiles(train, ["__anchor"], [i / bands for i in range(1, bands)]).select(F.array_distinct("quantiles").alias("__e"))
    rows = keep(train.join(F.broadcast(edges)).withColumn("band", F.size(F.filter("__e", lambda e: e < F.col("__anchor")))).drop("__e"))
    # One column a band, null outside of it: all bands are ranked in one pass.
    wide = rows.select(*[F.when(F.col("band") == b, F.col("__ratio")).alias(str(b)) for b in range(bands)])
    found = column_quantiles(wide, [str(b) for b in range(bands)], levels)
    low = rows.groupBy("band").agg(F.min("__anchor").alias("low"))
    return low.join(found, F.col("band").cast("string") == F.col("column")).select("band", "low", *[F.get("quantiles", F.lit(i)).alias(f"q{int(q * 100):02d}") for i, q in enumerate(levels)])


def banded_forecast(df: DataFrame, bands: DataFrame, anchor: str, levels: list[float]) -> DataFrame:
    """anchor moved by the quantiles of its band; the highest band that begins at or below it (the lowest for others)."""
    table = bands.select(F.sort_array(F.collect_list(F.struct("low", *[f"q{int(q * 100):02d}" for q in levels]))).alias("__b"))  # a row a band
    fits = F.filter("__b", lambda b: b["low"] <= F.col(anchor))
    own = F.when(F.size(fits) > 0, F.element_at(fits, -1)).otherwise(F.element_at("__b", 1))
    rows = df.join(F.broadcast(table)).withColumn("__own", own)
    for q in levels:
        name = f"q{int(q * 100):02d}"
        rows = rows.withColumn(f"p{int(q * 100):02d}", F.greatest(F.expm1(F.log1p(F.greatest(F.col(anchor), F.lit(0.0))) + F.col(f"__own.{name}")), F.lit(0.0)))
    return rows.drop("__b", "__own")


LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9]
QUANTILE_NAMES = [f"p{int(q * 100):02d}" for q in LEVELS]


def ordered_around_median(df: DataFrame) -> DataFrame:
    """Quantiles pinned at the median: the lower ones never above their upper neighbour, the upper ones never below."""
    low = F.least("p25", "p50")
    high = F.greatest("p75", "p50")
    return df.withColumns({"p10": F.least(F.col("p10"), low), "p25": low, "p75": high, "p90": F.greatest(F.col("p90"), high)})


def banded_guess(train: DataFrame, anchor: str, actual: str):
    """A function that adds the quantiles of the anchor's band."""
    bands = keep(band_quantiles(train, anchor, actual, LEVELS))
    return lambda df: ordered_around_median(banded_forecast(df, bands, anchor, LEVELS))


def quantile_forecast(rows: DataFrame, anchor: str, actual: str, learn=banded_guess) -> DataFrame:
    """acc_id and five quantiles from the log ratios of actual to anchor; ``learn`` makes a function that adds them from train.

    ``rows`` have a ``split``: quantiles are learned on train, the correction is shrunk toward the anchor by the weight that
    is best on validation, and the outer quantiles are moved by the conformal margin of validation.
    """
    train, valid = rows.where("split = 'train'"), rows.where("split = 'validation'")
    guess = learn(train, anchor, actual)
    tuned = keep(guess(valid))
    weight = best_shrinkage(tuned, "p50", anchor, actual).first()
    w = weight["weight"] if weight else 1.0

    def shrunk(df: DataFrame) -> DataFrame:
        # Only the place of the median moves, in log units; the spread around it stays.
        shift = F.exp((w - 1) * (F.log1p("p50") - F.log1p(anchor)))
        moved = {c: F.greatest((F.col(c) + 1) * shift - 1, F.lit(0.0)) for c in QUANTILE_NAMES}
        return ordered_around_median(df.withColumns(moved))

    margin = keep(conformal_margin(shrunk(tuned), "p10", "p90", actual))
    out = conformal_apply(shrunk(guess(rows)), margin, "p10", "p90")
    return ordered_around_median(out).select("acc_id", *QUANTILE_NAMES)
