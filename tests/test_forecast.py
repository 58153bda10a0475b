"""The rows of the credit forecast come from one computation of the features; passes of its fits read blocks."""

import os

import numpy as np

from tidemark.functions import sums
from tidemark.operators import labels, quantile_models
from tidemark.plans import fits
from tidemark.plans.catalog import CUTOFF, Tables

FOLDER = os.environ.get("TIDEMARK_TEST_TABLES", "/root/testdata/sf0.001")


def test_credit_rows_compute_features_once_and_keep_the_labels(spark, monkeypatch):
    made, real = [], Tables.features
    monkeypatch.setattr(Tables, "features", lambda self, *a: made.append(1) or real(self, *a))
    t = Tables(spark, FOLDER)
    rows = {r["acc_id"]: (r["usage_30d"], r["usage_90d"]) for r in fits.credit_rows(t).collect()}
    assert len(made) == 1
    told = {r["acc_id"]: (r["usage_30d"], r["usage_90d"]) for r in labels.labels_credit(*t.all, CUTOFF).collect()}
    scored = {r["acc_id"] for r in t.scores().where("usage_30d IS NOT NULL").select("acc_id").collect()}
    assert set(rows) == scored and rows == {k: told[k] for k in scored}


def test_blocks_have_all_rows_and_passes_read_nothing_else(spark, monkeypatch):
    values = np.random.default_rng(4).normal(size=(9001, 2))
    rows = spark.createDataFrame([(float(a), float(b) if i % 5 else None) for i, (a, b) in enumerate(values)], "a double, b double")
    blocks = sums.packed(rows.coalesce(1), ["a", "b"])
    assert blocks.columns == ["block"] and 2 <= blocks.count() < 20
    got = sums.summed_blocks(blocks, 2, lambda x: np.array([len(x), x[:, 0].sum(), np.isnan(x[:, 1]).sum()]), 3)
    assert np.allclose(got, [9001, values[:, 0].sum(), 1801])
    assert (sums.summed_blocks(blocks.limit(0), 2, lambda x: np.ones(3), 3) == 0).all()
    seen, real = [], quantile_models.summed_blocks
    monkeypatch.setattr(quantile_models, "summed_blocks", lambda df, *a: seen.append(df.columns) or real(df, *a))
    quantile_models.fit_quantiles(rows, ["a"], "b", [0.5], steps=2)
    assert seen == [["block"]] * 2
