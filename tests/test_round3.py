"""Places, bootstrap draws and fits that must not depend on where rows stand or how many there are."""

import hashlib
import os

import numpy as np

from tidemark.functions import ranking
from tidemark.operators import metrics, models, outcomes, registry
from tidemark.plans import checks, stored
from tidemark.plans.catalog import Tables

FOLDER = os.environ.get("TIDEMARK_TEST_TABLES", "/root/testdata/sf0.001")


def test_equal_evaluations_give_equal_places_wherever_they_stand(spark):
    """The values 0.231, 0.081 and 0.135 have two sums of doubles, by their order."""
    values = [0.231, 0.081, 0.135]
    versions = spark.createDataFrame([("churn", f"v{i}") for i in range(6)], "model_type string, version string")
    rows = []
    for i, turn in enumerate([(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]):
        rows += [(f"v{i}", "holdout", f'{{"m": {values[k]}}}', k) for k in turn]
    evaluations = spark.createDataFrame(rows, "version string, kind string, metrics string, nr int").coalesce(1)
    assert len({(values[a] + values[b]) + values[c] for a, b, c in [(0, 1, 2), (1, 2, 0)]}) == 2
    found = registry.ranked_candidates(versions, evaluations, "m", order=["nr"]).collect()
    assert {r["place"] for r in found} == {1} and {r["holdout"] for r in found} == {(0.231 + 0.081 + 0.135) / 3}


def test_bootstrap_equals_direct_draws_without_a_row_a_draw(spark):
    rng, n, draws = np.random.default_rng(3), 3000, 40  # the first draws may take no row: they do not count
    p = np.where(rng.random(n) < 0.4, 0.25, np.round(rng.random(n), 2))  # one score is very frequent: it stands in several tasks
    y = (rng.random(n) < p).astype(int)
    rows = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))] + [(n, None, 1), (n + 1, 0.5, None)], "acc_id int, p double, y int")
    frame = metrics.bootstrap_churn(rows, "p", "y", "acc_id", draws=draws)
    got = {r["metric"]: r for r in frame.collect()}
    digest = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
    h1, h2 = (np.array([int(d[a:b], 16) for d in digest]) for a, b in ((0, 7), (8, 15)))

    def told(w):
        s = np.round(p, 4)
        below = np.array([w[s < v].sum() + (w[s == v].sum() + 1) / 2 for v in np.unique(s)])[np.searchsorted(np.unique(s), s)]
        pos, all_ = (w * y).sum(), w.sum()
        q = np.clip(p, 1e-15, 1 - 1e-15)
        loss = -(w * np.where(y == 1, np.log(q), np.log(1 - q))).sum() / all_
        return {"brier": (w * (p - y) ** 2).sum() / all_, "log_loss": loss, "roc_auc": ((w * y * below).sum() - pos * (pos + 1) / 2) / (pos * (all_ - pos)), "positive_rate": pos / all_}

    u = [((h1 + k * h2) % ((1 << 31) - 1)) / ((1 << 31) - 1) for k in range(draws)]
    each = [told(sum((x >= c).astype(float) for c in metrics.POISSON)) for x in u]
    for name, value in told(np.ones(n)).items():
        of = [e[name] for e in each]
        assert np.allclose([got[name]["value"], got[name]["low"], got[name]["high"]], [value, np.nanquantile(of, 0.025), np.nanquantile(of, 0.975)], atol=1e-9)
    assert metrics.bootstrap_churn(rows.limit(0), "p", "y", "acc_id", draws=5).count() == 0
    # Rows are weighed where they stand: a task hands on three, however many it has.
    cells = metrics._weighed(draws)
    handed = rows.where("p IS NOT NULL AND y IS NOT NULL").selectExpr("p AS s", "CAST(y AS DOUBLE) AS y", "p AS b", "p AS l", "CAST(1 AS LONG) AS h1", "CAST(2 AS LONG) AS h2")
    assert handed.coalesce(1).sortWithinPartitions("s").mapInArrow(cells, metrics._CELL).count() == 3


def test_runs_of_realized_churn_share_their_rows(spark, monkeypatch):
    """Scores and labels come from what was materialised, not once a run from the tables."""
    seen, real = [], outcomes.realized_churn
    monkeypatch.setattr(outcomes, "realized_churn", lambda scored, labels, *a: seen.append((scored, labels)) or real(scored, labels, *a))
    checks.realized_churn(Tables(spark, FOLDER))
    assert len(seen) == 4 and not any("parquet" in df._jdf.queryExecution().toString() for pair in seen for df in pair)


def test_guarded_statements_share_one_view(spark, monkeypatch):
    made, real = [], Tables.derived
    monkeypatch.setattr(Tables, "derived", lambda self: made.append(1) or real(self))
    assert stored.guarded_refusals(Tables(spark, FOLDER)).count() == len(stored.STATEMENTS)
    assert len(made) == 1


def test_medians_are_exact_and_one_scaling_a_fold_serves_all_families(spark, monkeypatch):
    rng, n = np.random.default_rng(8), 20_001
    x, y = np.round(rng.normal(size=n), 4), np.where(rng.random(n) < 0.5, 0.0, rng.random(n))
    rows = spark.createDataFrame([(i, float(a), float(b) if i % 3 else None, None, int(i % 4 == 0)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "acc_id long, x double, y double, z double, churned int")
    count, found = ranking.medians(rows, ["x", "y", "z"])
    assert count == n and found == {"x": np.median(x), "y": np.median(y[np.arange(n) % 3 > 0]), "z": None}
    calls, real = [], models.fit_scaling
    monkeypatch.setattr(models, "fit_scaling", lambda *a: calls.append(1) or real(*a))
    families = {"one": models.FAMILIES["logistic"], "weak": models.FAMILIES["logistic_weak"]}
    assert models.choose_family(rows, ["x", "y"], "churned", 2, families).count() == 2
    assert len(calls) == 2
