"""Fits over distributed rows against numpy, brute force and planted parameters."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifetime, models, quantile_models, search, survival, tree_contributions


def frame(spark, x, y, extra=()):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, x[i]), float(y[i]), *(e[i] for e in extra)) for i in range(len(x))]
    return spark.createDataFrame(rows, ["acc_id", *names, "y", *[f"e{k}" for k in range(len(extra))]]).repartition(3), names


def test_pinball_fit_equals_numpy_and_is_optimal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = 1 + x @ [2.0, -1.0, 0.0] + (1 + 0.5 * np.abs(x[:, 0])) * rng.standard_t(3, 1500)
    df, names = frame(spark, x, y)
    levels = [0.1, 0.5, 0.9]
    model = quantile_models.fit_quantiles(df, names, "y", levels)
    z = (x - x.mean(0)) / x.std(0)
    sums = lambda beta, width: quantile_models.step_sums(np.column_stack([z, y]), beta, np.array(levels), width)
    local = quantile_models.solve_pinball(sums, 3, levels, len(y), y.mean(), y.std())
    assert np.abs(np.array(model.beta) - local).max() < 1e-4
    loss = lambda b, q: np.maximum(q * (r := y - b[0] - z @ b[1:]), (q - 1) * r).mean()
    for b, q in zip(np.array(model.beta), levels, strict=True):
        assert abs((y < b[0] + z @ b[1:]).mean() - q) < 0.01
        for _ in range(200):  # no step away from it is better
            assert loss(b, q) <= loss(b + rng.normal(scale=rng.choice([0.01, 0.1, 0.5]), size=4), q) + 1e-4
    out = model.add(df, ["q10", "q50", "q90"])
    losses = {r.level: r.loss for r in quantile_models.pinball_losses(out, "y", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).collect()}
    assert losses == pytest.approx({q: loss(np.array(b), q) for b, q in zip(model.beta, levels, strict=True)})
    assert quantile_models.fit_quantiles(df.limit(0), names, "y", levels).beta == [[0.0] * 4] * 3


def test_pinball_forecast_beats_bands_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    anchor = np.exp(rng.normal(3, 1, 3000))
    x = rng.normal(size=(3000, 2))
    actual = anchor * np.exp(0.6 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(0, 0.3 + 0.2 * (x[:, 0] > 0), 3000))
    split = rng.choice(["train", "validation", "test"], 3000, p=[0.6, 0.2, 0.2]).tolist()
    df, names = frame(spark, x, actual, [anchor.tolist(), split])
    rows = df.withColumnsRenamed({"e0": "anchor", "e1": "split"}).persist()
    told = {}
    for name, learn in (("bands", models.banded_guess), ("pinball", quantile_models.pinball_guess(names))):
        out = models.quantile_forecast(rows, "anchor", "y", learn).join(rows, "acc_id").where("split = 'test'").persist()
        losses = quantile_models.pinball_losses(out, "y", dict(zip(models.QUANTILE_NAMES, models.LEVELS, strict=True)))
        told[name] = sum(r.loss for r in losses.collect()), out.agg(F.avg(((F.col("y") >= F.col("p10")) & (F.col("y") <= F.col("p90"))).cast("int"))).first()[0]
    rows.unpersist()
    assert told["pinball"][0] < 0.85 * told["bands"][0]
    assert 0.75 <= told["pinball"][1] <= 0.9


def labelled(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, n) > 0).astype(int)
    df, names = frame(spark, x, y)
    return df.withColumn("y", F.col("y").cast("int")), names, x


def brute_shapley(nodes, value, x):
    """Over all sets of known features: the tree's value, unknown splits weighted by cover."""
    by_id = {n["id"]: n for n in nodes}

    def worth(at, known):
        n = by_id[at]
        if n["left"] < 0:
            return value(n)
        if n["feature"] in known:
            return worth(n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], known)
        return sum(by_id[c]["cover"] / n["cover"] * worth(c, known) for c in (n["left"], n["right"]))

    out = []
    for k in range(3):
        others = [f for f in range(3) if f != k]
        out.append(sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (worth(0, {*s, k}) - worth(0, set(s))) for r in range(3) for s in itertools.combinations(others, r)))
    return np.array(out), worth(0, set())


def test_leaf_tables_equal_shapley_sums():
    leaf = {"left": -1, "right": -1}
    nodes = [
        {"id": 0, "cover": 10.0, "left": 1, "right": 2, "feature": 0, "threshold": 0.5}, {"id": 1, "cover": 4.0, "left": 3, "right": 4, "feature": 1, "threshold": 0.0},
        {"id": 2, "cover": 6.0, "left": 5, "right": 6, "feature": 0, "threshold": 2.0}, {"id": 3, "cover": 1.0, "prediction": 1.0, **leaf}, {"id": 4, "cover": 3.0, "prediction": -2.0, **leaf},
        {"id": 5, "cover": 5.0, "left": 7, "right": 8, "feature": 2, "threshold": 1.0}, {"id": 6, "cover": 1.0, "prediction": 4.0, **leaf}, {"id": 7, "cover": 2.0, "prediction": 0.5, **leaf}, {"id": 8, "cover": 3.0, "prediction": 7.0, **leaf},
    ]
    leaves = list(tree_contributions.leaves_of(nodes, lambda n: n["prediction"], 1.0))
    for x in itertools.product([0.0, 0.5, 1.0, 3.0], [-1.0, 1.0], [0.0, 2.0]):
        want, base = brute_shapley(nodes, lambda n: n["prediction"], x)
        assert tree_contributions.explain(leaves, np.array([x]))[0] == pytest.approx(want, abs=1e-12)
        assert sum(leaf.expected for leaf in leaves) == pytest.approx(base)


@pytest.mark.parametrize("family", ["forest", "boosted"])
def test_contributions_add_up_to_the_margin(spark, family):
    df, names, _ = labelled(spark)
    score = models.FAMILIES[family](df, names, "y")
    leaves, base = tree_contributions.read_leaves(score.fitted, df)
    ready = models.scaled(df, names, score.scaling)
    explained = tree_contributions.contributions(ready, "acc_id", names, leaves)
    both = explained.join(score(df).select("acc_id", "probability"), "acc_id").collect()
    assert len(both) == 400
    for r in both:
        margin = base + sum(r.impacts)
        assert (margin if family == "forest" else 1 / (1 + math.exp(-2 * margin))) == pytest.approx(r.probability, abs=1e-6)
    top = tree_contributions.largest(explained, "acc_id", names, 2).where("acc_id = 7").collect()
    assert [abs(r.impact) for r in top] == sorted((abs(v) for v in next(r for r in both if r.acc_id == 7).impacts), reverse=True)[:2]


def test_boosting_stops_early(spark):
    df, names, _ = labelled(spark)
    noise = df.withColumn("y", (F.xxhash64("acc_id") % 2 == 0).cast("int"))
    assert models.fit_boosted(noise, names, "y").trees < models.fit_boosted(df, names, "y").trees <= 60
    assert models.fit_boosted(df.limit(3).withColumn("acc_id", F.lit(1)), names, "y", trees=3).trees == 3


def test_folds_hold_whole_accounts_and_even_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(a, int(rng.random() < 0.2), k) for a in range(900) for k in range(rng.integers(1, 4))] + [(None, 1, 0), (None, 0, 1), (901, None, 0)]
    df = spark.createDataFrame(rows, "acc_id int, y int, k int").repartition(5)
    got = models.with_fold(df, "y", 5).collect()
    assert len(got) == len(rows)
    of_account, positive, negative = {}, [0] * 5, [0] * 5
    for r in got:
        assert of_account.setdefault(r.acc_id, r.fold) == r.fold
        positive[r.fold] += r.y == 1
        negative[r.fold] += r.y != 1
    assert max(positive) - min(positive) <= 3 and max(negative) - min(negative) <= 3 * 4


@pytest.mark.parametrize("family", survival.FAMILIES)
def test_censored_fits_recover_planted_parameters(spark, family):
    """Seventy per cent of the rows are censored."""
    rng = np.random.default_rng(5)
    n = 6000
    x = rng.normal(size=(n, 2))
    error = {"normal": rng.normal(size=n), "logistic": rng.logistic(size=n), "extreme": np.log(rng.exponential(size=n))}[family]
    days = np.exp(3 + 0.8 * x[:, 0] - 0.5 * x[:, 1] + 0.6 * error)
    limit = np.quantile(days, 0.55) * rng.uniform(0.2, 1.0, n)
    seen = (days <= limit).astype(int)
    assert 0.6 < 1 - seen.mean() < 0.8
    df, names = frame(spark, x, np.minimum(days, limit), [seen.tolist()])
    fits = {f.family: f for f in survival.fit_days(df, names, "y", "e0")}
    own = fits[family]
    assert own.beta[1:] == pytest.approx([0.8 * x[:, 0].std(), -0.5 * x[:, 1].std()], abs=0.06)
    assert own.beta[0] == pytest.approx(3 + 0.8 * x[:, 0].mean() - 0.5 * x[:, 1].mean(), abs=0.1) and own.scale == pytest.approx(0.6, abs=0.05)
    assert own.likelihood >= max(f.likelihood for f in fits.values()) - 1e-3
    median = own.add(df.limit(200)).select(*names, "expected_days").collect()
    shift = 0.6 * math.log(math.log(2)) if family == "extreme" else 0.0
    assert all(abs(math.log(r.expected_days) - (3 + 0.8 * r.x0 - 0.5 * r.x1 + shift)) < 0.3 for r in median)


def test_likelihood_sums_equal_differences():
    rng = np.random.default_rng(6)
    rows = np.column_stack([rng.normal(size=(50, 2)), rng.normal(2, 1, 50), rng.integers(0, 2, 50)])
    at, p = np.array([1.5, 0.3, -0.2, 0.1]), 4
    for family in survival.FAMILIES:
        parts = survival.likelihood_sums(rows, family, at)
        hessian = np.zeros((p, p))
        hessian[np.triu_indices(p)] = parts[1 + p :]
        hessian += np.triu(hessian, 1).T
        for k in range(p):
            h = np.eye(p)[k] * 1e-5
            up, down = survival.likelihood_sums(rows, family, at + h), survival.likelihood_sums(rows, family, at - h)
            assert parts[1 + k] == pytest.approx((up[0] - down[0]) / 2e-5, abs=1e-5)
            assert hessian[k] == pytest.approx((up[1 : 1 + p] - down[1 : 1 + p]) / 2e-5, abs=1e-4)


def test_urgent_threshold_is_the_best_cut(spark):
    rng = np.random.default_rng(7)
    days, actual = rng.uniform(0.2, 60, 300), rng.uniform(0, 60, 300)
    df = spark.createDataFrame([(float(d), bool(a <= 14 and d < 40)) for d, a in zip(days, actual, strict=True)], "d double, u boolean")
    rows = [(r.d, r.u) for r in df.collect()]
    f2 = lambda cut: 5 * sum(u for d, u in rows if d <= cut) / (sum(d <= cut for d, _ in rows) + 4 * sum(u for _, u in rows))
    best = max(range(1, 61), key=f2)
    cut, score = survival.urgent_threshold(df, "d", F.col("u"))
    assert (cut, score) == (best, pytest.approx(f2(best)))
    assert survival.urgent_threshold(df.limit(0), "d", F.col("u")) == (14.0, 0.0)


def test_timing_is_chosen_on_validation(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 1))
    days = np.exp(2.5 + x[:, 0] + 0.4 * rng.logistic(size=2000))
    df, names = frame(spark, x, np.minimum(days, 90), [(days <= 90).astype(int).tolist()])
    model = survival.choose_timing(df.where("acc_id % 5 > 0"), df.where("acc_id % 5 = 0"), names, "y", "e0")
    out = model.add(df).select((F.col("expected_days") <= 14).alias("said"), ((F.col("y") <= 14) & (F.col("e0") == 1)).alias("true")).collect()
    assert sum(r.said and r.true for r in out) > 0.9 * sum(r.true for r in out)
    assert survival.fit_days(df.withColumn("e0", F.lit(0)), names, "y", "e0")[0].scale == 1.0


def test_search_finds_a_planted_optimum_in_fewer_trials_than_a_grid():
    space = {"rate": search.Real(1e-3, 1.0, log=True), "depth": search.Whole(1, 9), "kind": search.Choice(("a", "b", "c"))}
    loss = lambda s: (math.log10(s["rate"]) + 1.4) ** 2 + 0.1 * (s["depth"] - 6) ** 2 + {"a": 1.0, "b": 0.0, "c": 0.6}[s["kind"]]
    grid = [{"rate": 10 ** (-3 + i / 3), "depth": d, "kind": k} for i in range(10) for d in range(1, 10) for k in "abc"]
    wanted = 0.15
    for seed in range(5):
        done = search.search(space, loss, trials=60, parallel=4, seed=seed)
        assert [t.settings for t in done] == [t.settings for t in search.search(space, loss, trials=60, parallel=4, seed=seed)]
        first = next(i for i, t in enumerate(done) if t.loss <= wanted)
        assert first < 60 < len(grid)
    rng = random.Random(1)  # and fewer than chance needs
    chance = [next(i for i in range(10_000) if loss(search.drawn(space, rng)) <= wanted) for _ in range(40)]
    guided = [next((i for i, t in enumerate(search.search(space, loss, trials=80, parallel=1, seed=s)) if t.loss <= wanted), 80) for s in range(20)]
    assert sum(guided) / 20 < 0.6 * sum(chance) / 40
    odd = search.search({"x": search.Real(0, 1)}, lambda s: math.nan, trials=5, at_random=2)
    assert [t.loss for t in odd] == [math.inf] * 5


def bought(n, seed=9):
    """Accounts that buy at a rate of their own until they stop, as BG/NBD has it: frequency, recency, age."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        rate, stop, age = rng.gamma(2.0, 1 / 40), rng.beta(1.0, 3.0), rng.integers(100, 400)
        at, x, last = 0.0, 0, 0.0
        while (at := at + rng.exponential(1 / rate)) < age:
            x, last = x + 1, at
            if rng.random() < stop:
                break
        out.append((x, float(round(last)), float(age)))
    return out


def test_penalties_fitted_at_once_equal_single_searches(spark):
    rows = bought(1500)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "acc_id long, frequency long, recency double, age double").repartition(3)
    train, valid = df.where("acc_id % 3 > 0"), df.where("acc_id % 3 = 0")
    penalties = [0.0, 0.01, 0.1, 1.0]
    fits, told, best = lifetime.fit_penalties(train, valid, penalties)
    cells = lambda keep: np.array([(*r, 1.0) for i, r in enumerate(rows) if (i % 3 > 0) == keep])
    cost = lambda m, lam: -lifetime.likelihoods(cells(True), np.array([[m.r, m.alpha, m.a, m.b]]))[0] / 1000 + lam * (m.r**2 + m.a**2 + m.b**2)
    rng = np.random.default_rng(1)
    for m, lam in zip(fits, penalties, strict=True):
        at = np.log([m.r, m.alpha, m.a, m.b])
        for _ in range(150):  # nothing near or far is better
            other = lifetime.BgNbd(*np.exp(at + rng.normal(scale=rng.choice([0.02, 0.2, 1.0]), size=4)))
            assert cost(m, lam) <= cost(other, lam) + 1e-7
        single = lifetime.fit_bgnbd(train, penalty=lam)
        assert cost(m, lam) <= cost(single, lam) + 1e-9
        assert abs(cost(m, lam) - cost(single, lam)) < 2e-3
    assert told == pytest.approx([lifetime.likelihoods(cells(False), np.array([[m.r, m.alpha, m.a, m.b]]))[0] / 500 for m in fits])
    assert best == int(np.argmax(np.round(told, 9)))
    assert lifetime.fit_penalties(train.limit(0), valid, penalties)[2] == 0


def test_many_runs_equal_single_runs(spark):
    """Rows of runs measured together are those of each run measured alone; small, one-sided and late runs have reasons."""
    from datetime import date

    from tidemark.operators import backfill, outcomes

    rng = np.random.default_rng(10)
    rows = [(run, a, float(round(rng.random(), 2)), int(rng.random() < 0.3) if run != 2 else 0) for run, n in ((0, 400), (1, 60), (2, 50), (3, 7), (4, 40)) for a in range(n)]
    scored = spark.createDataFrame(rows, "run_id int, acc_id int, p double, y int").repartition(4)
    runs = spark.createDataFrame([(r, date(2040, 1, 1) if r == 4 else date(2020, 1, 1), 180) for r in range(6)], "run_id int, cutoff date, horizon int")
    last = spark.createDataFrame([(date(2021, 1, 1),)], "last date")
    got = {}
    for r in backfill.backfill_churn(scored, runs, last).collect():
        got.setdefault(r.run_id, {})[r.metric] = (r.value, r.skipped)
    assert set(got) == set(range(6))
    assert [got[r][None][1].split()[0] for r in (2, 3, 4, 5)] == ["all", "only", "horizon", "only"]
    for run in (0, 1):
        own = scored.where(F.col("run_id") == run)
        alone = outcomes.realized_churn(own.select("acc_id", F.col("p").alias("churn_probability")), own.select("acc_id", F.col("y").alias("churned")), last, date(2020, 1, 1))
        want = {r.metric: (r.value, r.skipped) for r in alone.collect()}
        assert set(want) == set(got[run])
        assert all(got[run][m][0] == pytest.approx(want[m][0], abs=1e-6) for m in want)
    values = scored.withColumns({"p": F.col("p") * 100, "y": F.col("y") * F.col("acc_id") * 1.5})
    told = {(r.run_id, r.metric): r.value for r in backfill.backfill_value(values, runs, last).collect()}
    for run in (0, 1, 2):
        own = values.where(F.col("run_id") == run)
        alone = outcomes.realized_clv(own.select("acc_id", F.col("p").alias("predicted_clv")), own.select("acc_id", F.col("y").alias("future_revenue")), last, date(2020, 1, 1))
        for r in alone.collect():
            assert told[run, r.metric] == pytest.approx(r.value, abs=1e-6, nan_ok=True) or (told[run, r.metric] is None and r.value is None)
