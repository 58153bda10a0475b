"""Model metrics, baselines and drift as aggregations. Ranks come from ``functions.ranking``: no single-task sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import column_quantiles, quantiles_row, running, value_ranks, with_position, with_rank_shares
from tidemark.functions.scalars import chi_square_tail, clipped, correlation
from tidemark.functions.storage import keep

BINS = [float(x) for x in np.linspace(0, 1, 11)]


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: ties, hits (positives), before and before_hits (of the rows with smaller scores)."""
    return value_ranks(df, score, hits=F.col(label))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half: from rank sums of the distinct scores."""
    sums = by_score(df, score, label).agg(F.sum(F.col("hits") * (F.col("before") + (F.col("ties") + 1) / 2)).alias("r"), F.sum("hits").alias("p"), F.sum("ties").alias("n"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.expr("nullif(p * (n - p), 0)")).alias("roc_auc"))


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision, tied scores as one step."""
    steps = by_score(df, score, label)
    total = steps.agg(F.sum("hits").alias("all_p"), F.sum("ties").alias("all_n"))
    seen, caught = F.col("all_n") - F.col("before"), F.col("all_p") - F.col("before_hits")
    return steps.where("hits > 0").join(F.broadcast(total)).agg(F.sum(F.col("hits") / F.col("all_p") * caught / seen).alias("pr_auc"))


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", "tn", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    """Brier score, and its skill against always saying the base rate."""
    sums = df.agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"), F.var_pop(label).alias("base"))
    return sums.select("brier", (1 - F.try_divide("brier", "base")).alias("skill"))


def log_loss(df: DataFrame, score: str, label: str, tiny: float = 1e-15) -> DataFrame:
    p = clipped(F.col(score), tiny, 1 - tiny)
    return df.agg((-F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def bin_of(p: Column) -> Column:
    """0..9 by the edges k / 10 as doubles, the last bin closed."""
    return F.least(sum(((p >= e).cast("int") for e in BINS[1:]), F.lit(0)), F.lit(9))


def calibration_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(bin_of(F.col(score)).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(label).alias("observed"))


def ece(df: DataFrame, score: str, label: str) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return calibration_curve(df, score, label).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``__at`` (their place in the order) and ``__n`` (how many there are); the input is read once."""
    rows = keep(with_position(df, order, "__at"))
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("__n"))))


def tenths(df: DataFrame, order: list[Column], groups: int = 10) -> DataFrame:
    """ntile over everything, from positions counted by range partitions."""
    size, extra = F.floor(F.col("__n") / groups), F.col("__n") % groups
    early = F.col("__at") <= extra * (size + 1)
    tile = F.when(early, F.floor((F.col("__at") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("__at") - 1 - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return placed(df, order).withColumn("tile", (tile + 1).cast("int")).drop("__n")


def lift_table(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    tiles = tenths(df, [F.col(score).desc(), F.col(key)]).groupBy("tile").agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("rate"))
    base = tiles.agg(F.try_divide(F.sum("positives"), F.sum("n")).alias("__base"))  # of ten rows
    return tiles.join(F.broadcast(base)).select("tile", "n", "positives", "rate", F.try_divide("rate", "__base").alias("lift"))


def hosmer_lemeshow(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    g = tenths(df, [F.col(score), F.col(key)]).groupBy("tile").agg(F.count("*").alias("n"), F.sum(label).alias("o"), F.sum(score).alias("e"), F.avg(score).alias("m"))
    found = g.agg(F.sum(F.try_divide(F.pow(F.col("o") - F.col("e"), F.lit(2)), F.col("n") * F.col("m") * (1 - F.col("m")))).alias("chi2"), (F.count("*") - 2).alias("df"))
    return found.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("df")))


def at_k(df: DataFrame, score: str, label: str, fraction: float, key: str) -> DataFrame:
    """Recall and lift among the ceil(n * fraction) rows with the highest scores."""
    top = F.when(F.col("__at") <= F.ceil(F.col("__n") * fraction), F.col(label))
    sums = placed(df, [F.col(score).desc(), F.col(key)]).agg(F.sum(top).alias("hits"), F.avg(top).alias("rate"), F.sum(label).alias("all_hits"), F.avg(label).alias("all_rate"))
    return sums.select(F.try_divide("hits", "all_hits").alias("recall"), F.try_divide("rate", "all_rate").alias("lift"))


def top_capture(df: DataFrame, predicted: str, actual: str, key: str, fraction: float = 0.1) -> DataFrame:
    """What share of the actual sum the ceil(n * fraction) largest predictions hold."""
    top = F.when(F.col("__at") <= F.ceil(F.col("__n") * fraction), F.col(actual))
    return placed(df, [F.col(predicted).desc(), F.col(key)]).agg(F.try_divide(F.sum(top), F.sum(actual)).alias("capture"))


def top_share(df: DataFrame, value: str, key: str, fraction: float) -> DataFrame:
    """What share of the sum the largest max(1, floor(n * fraction)) values hold."""
    top = F.when(F.col("__at") <= F.greatest(F.floor(F.col("__n") * fraction), F.lit(1)), F.col(value))
    return placed(df, [F.col(value).desc(), F.col(key)]).agg(F.try_divide(F.sum(top), F.sum(value)).alias("share"))


def regression_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """n, Spearman (average ranks), MAE, RMSE, RMSLE, SMAPE."""
    p, a = F.col(predicted), F.col(actual)
    ranked = with_rank_shares(df, {predicted: "__rp", actual: "__ra"})
    size = F.abs(p) + F.abs(a)
    return ranked.agg(
        F.count("*").alias("n"), correlation("__rp", "__ra").alias("spearman"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg(F.pow(p - a, F.lit(2)))).alias("rmse"),
        F.sqrt(F.avg(F.pow(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(a, F.lit(0.0))), F.lit(2)))).alias("rmsle"), F.avg(F.when(size > 0, 2 * F.abs(p - a) / size).otherwise(0.0)).alias("smape"),
    )


def interval_metrics(df: DataFrame, low: str, middle: str, high: str, actual: str, alpha: float = 0.2) -> DataFrame:
    """Pinball losses, coverage and Winkler score of a quantile forecast."""
    y = F.col(actual)
    pinball = lambda q, c: F.avg(F.greatest(q * (y - F.col(c)), (q - 1) * (y - F.col(c))))
    lo, hi = F.col(low), F.col(high)
    winkler = (hi - lo) + 2 / alpha * F.greatest(lo - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - hi, F.lit(0.0))
    return df.agg(pinball(alpha / 2, low).alias("pinball_low"), pinball(0.5, middle).alias("pinball_mid"), pinball(1 - alpha / 2, high).alias("pinball_high"), F.avg(((y >= lo) & (y <= hi)).cast("int")).alias("coverage"), F.avg(winkler).alias("winkler"))


def conformal_margin(df: DataFrame, low: str, high: str, actual: str, alpha: float = 0.2) -> DataFrame:
    """How much both ends must move so that the interval covers 1 - alpha of the calibration rows."""
    miss = keep(df.select(F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high)).alias("miss")))
    n = miss.count()  # one number: the level of the quantile depends on it
    level = min(1.0, (1 - alpha) * (1 + 1 / max(n, 1)))
    return quantiles_row(miss, {"margin": ("miss", level)})


def conformal_apply(df: DataFrame, margin: DataFrame, low: str, high: str) -> DataFrame:
    """The interval with both ends moved outward by the margin (inward if negative), never below zero or crossed."""
    moved = df.join(F.broadcast(margin.select(F.col("margin").alias("__margin"))))
    a, b = F.greatest(F.col(low) - F.col("__margin"), F.lit(0.0)), F.greatest(F.col(high) + F.col("__margin"), F.lit(0.0))
    return moved.withColumn(low, F.least(a, b)).withColumn(high, F.greatest(a, b)).drop("__margin")


def f_beta_cuts(df: DataFrame, score: str, label: str, beta: float = 2.0) -> DataFrame:
    """cut, f for the score quantiles (2nd to 98th, four digits): counts per cut come from the distinct scores."""
    steps = keep(by_score(df, score, label))
    cuts = column_quantiles(df, [score], [q / 100 for q in range(2, 99)]).select(F.explode(F.array_distinct(F.transform("quantiles", lambda q: F.round(q, 4)))).alias("cut"))
    total = steps.agg(F.sum("hits").alias("all_p"), F.sum("ties").alias("all_n"))
    # At most 97 cuts: the scores from each cut on are summed up, not the rows.
    above = steps.join(F.broadcast(cuts), F.col(score) >= F.col("cut")).groupBy("cut").agg(F.sum("hits").alias("tp"), (F.sum("ties") - F.sum("hits")).alias("fp"))
    swept = cuts.join(above, "cut", "left").join(F.broadcast(total))
    tp, fp, b = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0)), beta * beta
    f = F.coalesce(F.try_divide((1 + b) * tp, (1 + b) * tp + b * (F.col("all_p") - tp) + fp), F.lit(0.0))
    return swept.select("cut", F.round(f, 9).alias("f"))


def best_threshold(df: DataFrame, score: str, label: str, beta: float = 2.0) -> DataFrame:
    """The cut with the best F-beta, the first of equal ones."""
    return f_beta_cuts(df, score, label, beta).orderBy(F.desc("f"), "cut").limit(1)


def baseline_recency(features: DataFrame) -> DataFrame:
    return features.select("acc_id", clipped(F.coalesce("days_since_last_activity", F.lit(180.0)) / 180, 0.0, 1.0).alias("score"))


def baseline_rfm(features: DataFrame) -> DataFrame:
    """Mean of three percentile ranks: silence, few payments, little revenue."""
    rows = keep(features.select("acc_id", F.coalesce("days_since_last_activity", F.lit(180.0)).alias("r"), (-F.col("payment_count_180d")).alias("f"), (-F.col("total_revenue_180d")).alias("m")))
    ranked = with_rank_shares(rows, {"r": "share_r", "f": "share_f", "m": "share_m"})
    return ranked.select("acc_id", ((F.col("share_r") + F.col("share_f") + F.col("share_m")) / 3).alias("score"))


def baseline_carryover(features: DataFrame) -> DataFrame:
    return features.select("acc_id", F.col("total_revenue_180d").alias("revenue"), (F.col("usage_recent_90d") / 3).alias("usage_30d"), (F.col("usage_total_180d") / 6).alias("usage_30d_long"))


def baseline_segment_mean(train: DataFrame, rows: DataFrame, past: str, actual: str) -> DataFrame:
    """The training mean of a row's quartile of past revenue."""
    train = keep(train.select(past, actual))
    edges = column_quantiles(train, [past], [0.25, 0.5, 0.75]).select(F.col("quantiles").alias("__e"))
    bucket = sum(((F.col(past) > F.get("__e", F.lit(i))).cast("int") for i in range(3)), F.lit(0)).alias("bucket")
    means = train.join(F.broadcast(edges)).select(bucket, actual).groupBy("bucket").agg(F.avg(actual).alias("predicted"))
    return rows.join(F.broadcast(edges)).select("acc_id", bucket).join(F.broadcast(means), "bucket", "left").select("acc_id", "predicted")


def long_values(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value of every non-null value of the named columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in names]))
    return df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())


def psi_drift(train: DataFrame, live: DataFrame, names: list[str], bins: int = 10, tiny: float = 1e-6) -> DataFrame:
    """Population stability of every feature: quantile bins of the training rows, shares, sum of (a - e) ln(a / e).

    A feature with fewer than ``bins`` values or three distinct edges has no bins: its status is ``constant``.
    """
    train = keep(train.select(*names))
    edges = column_quantiles(train, names, [i / bins for i in range(bins + 1)]).select("column", "n", F.array_distinct("quantiles").alias("edges"))
    binned = (F.size("edges") >= 3) & (F.col("n") >= bins)
    cut = keep(edges.select("column", F.when(binned, F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))).alias("inner")))  # a row a feature

    def shares(df: DataFrame, name: str) -> DataFrame:
        placed = long_values(df, names).join(F.broadcast(cut.where(F.col("inner").isNotNull())), "column").select("column", F.size(F.filter("inner", lambda e: e <= F.col("value"))).alias("bin"))
        counts = placed.groupBy("column", "bin").agg(F.count("*").alias("n"))
        whole = Window.partitionBy("column")  # a row a bin
        return counts.select("column", "bin", (F.col("n") / F.sum("n").over(whole)).alias(name))

    every = cut.select("column", F.explode_outer(F.when(F.col("inner").isNotNull(), F.sequence(F.lit(0), F.size("inner")))).alias("bin"))
    both = every.join(shares(train, "e"), ["column", "bin"], "left").join(shares(live, "a"), ["column", "bin"], "left")
    e, a = F.coalesce("e", F.lit(0.0)) + tiny, F.coalesce("a", F.lit(0.0)) + tiny
    psi = both.groupBy(F.col("column").alias("feature")).agg(F.sum(F.when(F.col("bin").isNotNull(), (a - e) * F.log(a / e))).alias("psi"))
    return psi.select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"), F.when(F.col("psi").isNull(), "constant").otherwise(drift_class(F.col("psi"))).alias("status"))


def drift_class(psi: Column) -> Column:
    return F.when(psi < 0.1, "stable").when(psi < 0.25, "minor").otherwise("major")


def overall_drift(psi: DataFrame) -> DataFrame:
    """Major from two features with major drift on; minor if any feature drifted at all."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    status = F.when(F.col("major") >= 2, "major").when(F.col("major") + F.col("minor") > 0, "minor").otherwise("stable")
    return psi.agg(n("minor"), n("major"), F.max("psi").alias("largest")).withColumn("status", status)


def spearman_scan(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """Rank correlation of every feature with a label over the rows that have the feature, all in one pass.

    The label is ranked once a feature, among that feature's rows: (feature, label value) is what is counted there.
    """
    of = lambda name: F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    pairs = df.select(F.explode(F.array(*map(of, names))).alias("p")).select("p.feature", "p.x", "p.y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cells = keep(pairs.groupBy("feature", "x", "y").agg(F.count("*").alias("n")))

    def ranks(value: str) -> DataFrame:
        counts = cells.groupBy("feature", value).agg(F.sum("n").alias("ties"))
        found = keep(running(counts, ["feature", value], ["ties"]))
        first = found.groupBy("feature").agg(F.min("before_ties").alias("__first"))  # a row a feature
        return found.join(F.broadcast(first), "feature").select("feature", value, (F.col("before_ties") - F.col("__first") + (F.col("ties") + 1) / 2).alias(f"rank_{value}"))

    ranked = cells.join(ranks("x"), ["feature", "x"]).join(ranks("y"), ["feature", "y"])
    a, b, n = F.col("rank_x"), F.col("rank_y"), F.col("n")
    total = F.sum("n")
    mean_a, mean_b = F.sum(n * a) / total, F.sum(n * b) / total
    sums = ranked.groupBy("feature").agg((F.sum(n * a * b) / total - mean_a * mean_b).alias("ab"), (F.sum(n * a * a) / total - mean_a * mean_a).alias("aa"), (F.sum(n * b * b) / total - mean_b * mean_b).alias("bb"))
    return sums.select("feature", F.when((F.col("aa") > 1e-9) & (F.col("bb") > 1e-9), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


#: Cumulative Poisson(1) probabilities of 0..5 draws.
POISSON = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518]
_PRIME = (1 << 31) - 1


def poisson_weights(first: np.ndarray, second: np.ndarray, draws: int) -> np.ndarray:
    """Rows by draws -1 .. draws - 1: how often each draw takes each row. Draw -1 is the table itself; a row without a hash is in no other."""
    out = np.zeros((len(first), draws + 1))
    u = (first[:, None] + np.arange(draws) * second[:, None]) % _PRIME / _PRIME
    for p in POISSON:
        out[:, 1:] += u >= p
    out[first < 0, 1:] = 0
    out[:, 0] = 1
    return out


#: Rows whose weights a task holds at a time.
WEIGHED_ROWS = 512
_CELL = "s double, inner boolean, n array<double>, p array<double>, b array<double>, l array<double>, r array<double>"


def _weighed(draws: int):
    """Rows (s, y, b, l, h1, h2) in the order of s to three cells a task: its first score, its last one, and all between.

    A cell has a number a draw: the weights n, those of positives p, sums b and l, and the sum r of the positives' ranks inside the cell.
    Only the first and the last score can stand in other tasks too; their ranks are counted when these are put together.
    """
    zeros = lambda: np.zeros(draws + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at = None  # the scores of the first and of the current cell
        head, own, inner = [zeros(), zeros()], [zeros(), zeros()], [zeros(), zeros(), zeros()]
        start, loss = None, [zeros(), zeros()]

        def close() -> None:
            n, p = own
            if at == first:
                head[0] += n
                head[1] += p
            else:
                inner[2] += p * (inner[0] + (n + 1) / 2)
                inner[0] += n
                inner[1] += p

        for whole in batches:
            for k in range(0, whole.num_rows, WEIGHED_ROWS):
                s, y, b, el, h1, h2 = (c.to_numpy(zero_copy_only=False) for c in whole.slice(k, WEIGHED_ROWS).columns)
                w = poisson_weights(h1, h2, draws)
                loss[0] += b @ w
                loss[1] += el @ w
                cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                counts, hits = np.add.reduceat(w, cuts), np.add.reduceat(w * y[:, None], cuts)
                for score, n, p in zip(s[cuts].tolist(), counts, hits, strict=True):
                    if first is None:
                        first = at = start = score
                    if score != at:
                        close()
                        if at != first and start == first:
                            start = at
                        at, own = score, [zeros(), zeros()]
                    own[0] += n
                    own[1] += p
        if first is None:
            return
        cells = [(first, False, *(own if at == first else head), *loss, zeros())]
        if at != first:
            cells.append((at, False, *own, zeros(), zeros(), zeros()))
            if start != first:
                cells.append((start, True, inner[0], inner[1], zeros(), zeros(), inner[2]))
        columns = list(zip(*cells, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *(pa.array([x.tolist() for x in c], pa.list_(pa.float64())) for c in columns[2:])], [c.split()[0] for c in _CELL.split(", ")])

    return run


def bootstrap_churn(df: DataFrame, score: str, label: str, key: str, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """metric, value, low, high: percentile intervals of the Brier score, log loss, ROC AUC and rate.

    Rows, in the order of their scores to four digits over range partitions, are weighed for all draws where they stand; a
    task gives three rows of a number a draw. Rows without a score or a label are left out.
    """
    p, y = clipped(F.col(score), 1e-15, 1 - 1e-15), F.col(label)
    digest = F.md5(F.col(key).cast("string"))
    part = lambda at: F.coalesce(F.conv(F.substring(digest, at, 7), 16, 10).cast("long"), F.lit(-1))
    rows = keep(df.where(F.col(score).isNotNull() & y.isNotNull()).select(
        F.round(score, 4).cast("double").alias("s"), y.cast("double").alias("y"), F.pow(F.col(score) - y, F.lit(2)).alias("b"), (-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("l"), part(1).alias("h1"), part(9).alias("h2"),
    ))
    # A score that very many rows have is dealt to several tasks by the hashes.
    dealt = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s", "h1", "h2").sortWithinPartitions("s")
    parts = dealt.mapInArrow(_weighed(draws), _CELL)
    each_draw = parts.select("s", "inner", F.posexplode(F.arrays_zip("n", "p", "b", "l", "r")).alias("draw", "c")).select((F.col("draw") - 1).alias("draw"), "s", "inner", "c.*")
    cells = each_draw.groupBy("draw", "s").agg(F.bool_or("inner").alias("inner"), *[F.sum(c).alias(c) for c in ("n", "p", "b", "l", "r")])
    below = F.coalesce(F.sum("n").over(Window.partitionBy("draw").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # three rows a task
    inside = F.when(F.col("inner"), F.col("r")).otherwise(F.col("p") * (F.col("n") + 1) / 2)
    sums = cells.withColumn("r", F.col("p") * below + inside).groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("n", "p", "b", "l", "r")])
    n, pos = F.col("n"), F.col("p")
    auc = (F.col("r") - pos * (pos + 1) / 2) / F.expr("nullif(p * (n - p), 0)")
    share = lambda c: F.try_divide(F.col(c), n)
    each = sums.select("draw", F.explode(F.create_map(F.lit("brier"), share("b"), F.lit("log_loss"), share("l"), F.lit("roc_auc"), auc, F.lit("positive_rate"), share("p"))).alias("metric", "v"))
    drawn, tail = F.when(F.col("draw") >= 0, F.col("v")), (1 - level) / 2
    return each.groupBy("metric").agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("value"), F.percentile(drawn, tail).alias("low"), F.percentile(drawn, 1 - tail).alias("high"))
