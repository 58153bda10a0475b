"""Queries of fitted models: folds, search, quantiles, timing, contributions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import union_all
from tidemark.functions.storage import keep
from tidemark.operators import labels, lifetime, metrics, models, quantile_models, scoring, search, survival, tree_contributions
from tidemark.operators.features import FEATURES
from tidemark.plans.catalog import CUTOFF, Tables, query
from tidemark.sources import adapter

_PANEL = "(SELECT acc_id, churned, 1 AS part FROM churn UNION ALL SELECT acc_id, purchased, 2 FROM clv)"


def churn_rows(t: Tables) -> DataFrame:
    return keep(t.features().join(t.churn(), "acc_id"))


@query(f"""SELECT acc_id, part, churned, fold FROM {_PANEL} JOIN (SELECT acc_id, CAST((row_number() OVER (ORDER BY positive DESC, negative DESC, md5(acc_id || ':fold'), acc_id) - 1) % 5 AS INT) AS fold
  FROM (SELECT acc_id, count(*) FILTER (churned = 1) AS positive, count(*) FILTER (coalesce(churned, 0) <> 1) AS negative FROM {_PANEL} GROUP BY 1)) USING (acc_id)""")
def grouped_folds(t: Tables) -> DataFrame:
    """Five folds of a panel in which an account may have several rows: none stands in two folds."""
    older = t.clv().select("acc_id", F.col("purchased").alias("churned"), F.lit(2).alias("part"))
    return models.with_fold(t.churn().select("acc_id", "churned", F.lit(1).alias("part")).unionByName(older), "churned", 5)


#: Strength of logistic regression, or rate and depth of boosting.
SPACE = {"family": search.Choice(("logistic", "boosted")), "strength": search.Real(1e-3, 1e2, log=True), "rate": search.Real(0.03, 0.3, log=True), "depth": search.Whole(2, 4)}


def fit_of(settings: dict):
    """The fit that settings from SPACE name."""
    if settings["family"] == "logistic":
        return lambda train, names, label, by=None: models.fit_churn(train, names, label, settings["strength"], by)
    return lambda train, names, label, by=None: models.fit_boosted(train, names, label, 20, settings["depth"], settings["rate"], by=by)


def searched(rows: DataFrame, names: list[str], trials: int = 8, folds: int = 3) -> list[search.Trial]:
    """Trials by average precision out of fold, four at a time on one kept frame of folds."""
    dealt = keep(models.with_fold(rows, "churned", folds))
    by = models.fold_scalings(dealt, names, folds)

    def loss(settings: dict) -> float:
        scored = models.out_of_fold(dealt, names, "churned", folds, fit_of(settings), by)
        worth = metrics.pr_auc(scored, "probability", "churned").first()["pr_auc"]
        return 1.0 if worth is None else 1 - worth

    return search.search(SPACE, loss, trials=trials, at_random=trials // 2, parallel=4)


@query()
def churn_search(t: Tables) -> DataFrame:
    """What was tried for churn over all 31 features, and the average precision out of fold."""
    done = searched(churn_rows(t), FEATURES)
    rows = [(i, x.settings["family"], float(x.settings["strength"]), float(x.settings["rate"]), int(x.settings["depth"]), 1 - x.loss) for i, x in enumerate(done)]
    return t.spark.createDataFrame(rows, "trial int, family string, strength double, rate double, depth int, pr_auc double")


@query()
def boosted_scores(t: Tables) -> DataFrame:
    """Scores of boosted trees over all 31 features; how many trees there are is decided by held-out accounts."""
    rows = churn_rows(t)
    score = models.fit_boosted(rows, FEATURES, "churned")
    return score(rows).select("acc_id", "churned", "probability", F.lit(score.trees).alias("trees"))


def factors_of(score, rows: DataFrame, names: list[str], n: int = 5) -> DataFrame:
    """acc_id, feature, impact of any fitted family: coefficients times scaled features, or contributions of trees."""
    ready = models.scaled(rows.select("acc_id", *names), names, score.scaling)
    if hasattr(score, "coefficients"):
        found = models.top_factors(ready, names, score.coefficients, n)
        return found.select("acc_id", F.explode("factors").alias("f")).select("acc_id", "f.feature", "f.impact")
    leaves, _ = tree_contributions.read_leaves(score.fitted, ready)
    return tree_contributions.largest(tree_contributions.contributions(ready, "acc_id", names, leaves), "acc_id", names, n)


@query()
def tree_factors(t: Tables) -> DataFrame:
    """The five largest contributions to every account's margin in boosted trees over all 31 features."""
    rows = churn_rows(t)
    return factors_of(models.fit_boosted(rows, FEATURES, "churned"), rows, FEATURES)


@query()
def quantile_losses(t: Tables) -> DataFrame:
    """Pinball loss of held-out accounts, by horizon and level, of linear quantiles and of bands of the anchor."""
    rows = credit_rows(t)
    out = []
    for d in (30, 90):
        for kind, learn in (("linear", quantile_models.pinball_guess(FEATURES)), ("bands", models.banded_guess)):
            told = models.quantile_forecast(rows, f"anchor_{d}d", f"usage_{d}d", learn).join(rows.where("split = 'test'").select("acc_id", f"usage_{d}d"), "acc_id")
            losses = quantile_models.pinball_losses(told, f"usage_{d}d", dict(zip(models.QUANTILE_NAMES, models.LEVELS, strict=True)))
            out.append(losses.select(F.lit(d).alias("horizon"), F.lit(kind).alias("kind"), "level", "loss"))
    return union_all(out)


def credit_rows(t: Tables) -> DataFrame:
    """Features, anchors and realized usage of both horizons, with a split. Features are computed once: they have all accounts."""
    known = keep(t.features())
    scores = scoring.stand_in_scores(known, t.lifecycle()).where(F.col("usage_30d").isNotNull())
    anchors = scores.select("acc_id", F.col("usage_30d").alias("anchor_30d"), (F.col("usage_30d") * 3).alias("anchor_90d"))
    usage = adapter.usage(t.spark, t.folder, CUTOFF + timedelta(days=90))
    rows = labels.with_usage_after(anchors.join(known, "acc_id"), usage, CUTOFF)
    return keep(labels.hashed_split(rows))


@query()
def credit_forecast(t: Tables) -> DataFrame:
    """Five quantiles of usage for 30 and 90 days by pinball fits on 60 % of the accounts, their outer ends moved by the margin of 20 %."""
    rows = credit_rows(t)
    out = rows.select("acc_id", "split", "usage_30d", "usage_90d")
    told = lambda d: models.quantile_forecast(rows, f"anchor_{d}d", f"usage_{d}d", quantile_models.pinball_guess(FEATURES))
    with ThreadPoolExecutor(2) as pool:
        found = dict(zip((30, 90), pool.map(told, (30, 90)), strict=True))
    for d, one in found.items():
        out = out.join(one.select("acc_id", *[F.col(c).alias(f"{c}_{d}d") for c in models.QUANTILE_NAMES]), "acc_id")
    # More days never mean less usage.
    return out.withColumns({f"{c}_90d": F.greatest(f"{c}_90d", f"{c}_30d") for c in models.QUANTILE_NAMES})


@query()
def topup_model(t: Tables) -> DataFrame:
    """Median days to the next payment over all 31 features: log-normal or log-logistic, whichever finds urgent accounts better."""
    window = F.lit(180.0)  # who has not paid by then was only watched
    top = labels.labels_topup(*t.all, CUTOFF).select("acc_id", F.least(F.coalesce("days_to_topup", window), window).alias("days"), F.coalesce((F.col("days_to_topup") <= window).cast("int"), F.lit(0)).alias("observed"))
    rows = keep(labels.hashed_split(t.features().join(top, "acc_id")))
    model = survival.choose_timing(rows.where("split = 'train'"), rows.where("split = 'validation'"), FEATURES, "days", "observed")
    return model.add(rows).select("acc_id", "split", "observed", "days", "expected_days", F.lit(model.family).alias("family"))


def _rfm(t: Tables) -> DataFrame:
    return keep(labels.rfm_summary(t.payments, CUTOFF).where("age > 0"))


def _fitted(rfm: DataFrame):
    held = F.pmod("acc_id", F.lit(3)) == 0
    return lifetime.fit_penalties(rfm.where(~held), rfm.where(held))


@query()
def bgnbd_penalties(t: Tables) -> DataFrame:
    """Parameters of BG/NBD under nine penalties, fitted at once on two thirds of the accounts, and what the others say of each."""
    fits, told, best = _fitted(_rfm(t))
    rows = [(p, m.r, m.alpha, m.a, m.b, v, k == best) for k, (p, m, v) in enumerate(zip(lifetime.PENALTIES, fits, told, strict=True))]
    return t.spark.createDataFrame(rows, "penalty double, r double, alpha double, a double, b double, held_out double, best boolean")


@query()
def clv_expected_revenue(t: Tables) -> DataFrame:
    """Purchases times spend of 180 days, under the penalty that held-out accounts prefer."""
    rfm = _rfm(t)
    fits, _, best = _fitted(rfm)
    return lifetime.expected_revenue(rfm, fits[best], lifetime.fit_gamma_gamma(rfm, max(lifetime.PENALTIES[best], 0.001)), 180)
