"""Edge rows that the given tables do not have."""

import datetime as dt
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranking, scalars
from tidemark.operators import features, labels, metrics, scoring
from tidemark.plans import guarded_sql
from tidemark.sources import sinks, workbook
from tidemark.streaming.monthly import windowed_usage

CUT = dt.date(2024, 7, 1)


def tables(spark):
    customers = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 8, 1)), (2, dt.date(2023, 8, 1)), (None, None), (4, None)], "acc_id int, join_date date")
    at = lambda s: dt.datetime.fromisoformat(s)
    payments = spark.createDataFrame(
        [(1, 1, at("2024-06-15 13:00:00"), 100.0, 10.0), (1, 2, at("2024-06-01 00:00:00"), 0.0, None), (1, 3, at("2024-07-01 00:00:00"), 999.0, 1.0), (None, 4, at("2024-06-01 00:00:00"), 1.0, 1.0), (3, 5, None, 5.0, 5.0), (5, 6, at("2024-06-30 23:59:59"), None, 2.0)],
        "acc_id int, payment_uid long, payment_date timestamp_ntz, amount double, credit_add double",
    )
    usage = spark.createDataFrame(
        [(1, dt.date(2024, 6, 1), 6.0, "sms", "bc"), (1, dt.date(2024, 2, 1), 2.0, "email", "api"), (1, dt.date(2024, 7, 1), 50.0, "sms", "bc"), (4, dt.date(2024, 5, 1), 0.0, "sms", "otp"), (4, dt.date(2024, 5, 1), None, "sms", "otp"), (1, None, 9.0, "sms", "bc")],
        "acc_id int, period date, usage double, channel string, usage_source string",
    )
    return customers, payments, usage


def test_features_of_edge_rows(spark):
    rows = {r.acc_id: r.asDict() for r in features.features_all(*tables(spark), CUT).collect()}
    assert set(rows) == {1, 2, 4, 5}
    one = rows[1]
    assert one["days_since_last_payment"] == 15 and one["payment_interval_mean_days"] == 14
    assert one["payment_count_all"] == 2 and one["total_revenue_all"] == 100 and one["credit_balance_proxy"] == 2
    assert one["usage_total_180d"] == 8 and one["usage_recent_90d"] == 6 and one["usage_prev_90d"] == 2
    assert one["usage_slope_6m"] == pytest.approx((2.5 * 6 + -1.5 * 2) / 17.5) and one["multichannel_flag"] == 1
    assert rows[2]["customer_age_days"] == -31 and rows[2]["days_since_last_activity"] is None
    assert rows[4]["usage_total_180d"] == 0 and rows[4]["days_since_last_usage"] is None
    assert rows[5]["avg_transaction_value"] is None and rows[5]["payment_amount_cv"] is None
    assert list(rows[1])[1:] == features.FEATURES and len(features.FEATURES) == 31


def test_lifecycle_and_labels_of_edge_rows(spark):
    stage = {r.acc_id: r.stage for r in features.lifecycle(*tables(spark), CUT).collect()}
    assert stage == {1: "Active Paid", 2: "Ghost", 4: "Ghost", 5: "Active Paid"}
    _, payments, usage = tables(spark)
    assert {r.acc_id: r.churned for r in labels.labels_churn(payments, usage, CUT).collect()} == {1: 0, 5: 1}


def test_elapsed_days_floor(spark):
    later, earlier = F.lit("2024-07-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-06-15 13:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(scalars.elapsed_days(later, earlier).alias("a"), scalars.elapsed_days(earlier, later).alias("b")).first()
    assert (row.a, row.b) == (15, -16)


def test_ranks_equal_pandas(spark):
    values = [1.0, 2.0, 2.0, 4.0, None, -3.0, 2.0, 4.0]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    want = pd.Series(values).rank(pct=True)
    got = {r.id: r.share for r in ranking.with_rank_share(df, "v", "share").collect()}
    assert all((got[i] is None) == pd.isna(w) and (pd.isna(w) or got[i] == pytest.approx(w)) for i, w in enumerate(want))
    places = {r.id: r.at for r in ranking.with_position(df, [F.col("v").desc_nulls_last(), F.col("id")], "at").collect()}
    assert [places[i] for i in (3, 7, 1, 2, 6, 0, 5, 4)] == list(range(1, 9))


def test_calibration_bins_use_double_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,)], "p double")
    assert [r.b for r in df.select(metrics.bin_of(F.col("p")).alias("b")).collect()] == [2, 3, 9, 0]


def test_rules(spark):
    df = spark.createDataFrame([(0.9, 10.0, 50.0), (0.9, 100.0, None), (None, 100.0, 0.0)], "p double, age double, total double")
    got = df.select(scoring.risk_level(scoring.abstained(F.col("p"), F.col("age"))).alias("r"), scoring.usage_trend(F.col("total"), F.lit(0.2)).alias("t")).collect()
    assert [tuple(r) for r in got] == [(None, "growing"), ("critical", "growing"), (None, "no_usage")]


def test_guarded_sql(spark):
    views = {"outputs": lambda s: s.range(200).selectExpr("id as acc_id", "id % 3 as tier", "cast(id % 2 as string) as prediction_run_id"), "payments": lambda s: s.range(1)}
    run = lambda sql, *more, **named: guarded_sql.run_guarded(spark, sql, "viewer", views, *more, **named)
    assert run("SELECT tier, count(*) n FROM outputs GROUP BY tier -- note").count() == 3
    assert run("select acc_id from outputs;").count() == 50
    assert run("select extract(day from date'2024-01-02') d, 'drop table' x, date_trunc('month', now()) m from outputs", 1000).count() == 100
    assert run("select case when tier between 1 and 2 then round(avg(acc_id), 1) end a from outputs where acc_id in (select acc_id from outputs where tier like '1%') group by tier having count(*) > 1 order by a").count() == 1
    for bad in ("DROP TABLE outputs", "select acc_id from payments", "select acc_id from parquet.`/tmp`", "select nothing from outputs", "select 1; select 2", "with x as (select 1) insert into outputs select * from x", "select * from outputs", "select o.* from outputs o", "select explode(array(1)) from outputs", "select java_method('java.lang.Math', 'random') from outputs", "select acc_id from range(3)"):
        with pytest.raises(guarded_sql.Refused):
            run(bad)
    mine, other = "00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002"
    assert run("select acc_id from outputs", scope=guarded_sql.Scope(run_ids=frozenset("0"))).where("acc_id % 2 = 1").count() == 0
    assert run("select acc_id from outputs", scope=guarded_sql.Scope(run_ids=frozenset("01"), bound_run="1")).where("acc_id % 2 = 0").count() == 0
    assert run(f"select acc_id from outputs where prediction_run_id = '{mine}'", scope=guarded_sql.Scope(run_ids=frozenset([mine]))).count() == 0
    with pytest.raises(guarded_sql.Refused, match=other):
        run(f"select acc_id from outputs where prediction_run_id = '{other}'", scope=guarded_sql.Scope(run_ids=frozenset([mine])))


def test_guarded_results_are_fetched_in_time_or_not_at_all(spark):
    assert guarded_sql.fetch(spark.sql("select date'2024-01-02' d, 1 n"), 60) == [{"d": "2024-01-02", "n": 1}]
    slow = spark.range(0, 10**13, 1, 4).where("pmod(hash(id), 7) = 8")
    with pytest.raises(guarded_sql.Refused, match="longer"):
        guarded_sql.fetch(slow, 1)
    assert spark.range(5).count() == 5
    asked = []

    def propose(reason):
        asked.append(reason)
        return "select acc_id from outputs" if reason else "drop table outputs"

    views = {"outputs": lambda s: s.range(2).selectExpr("id as acc_id")}
    rows = guarded_sql.ask(propose, lambda sql: guarded_sql.run_guarded(spark, sql, "viewer", views))
    assert rows == [{"acc_id": 0}, {"acc_id": 1}] and asked == [None, "only SELECT is allowed"]


def test_positions_and_ranks_beyond_one_range_partition(spark, tmp_path):
    """300,000 wide rows: every position once, ten equal tiles, ranks as counted; before, rows were lost here."""
    rows = spark.range(300_000).select(F.col("id").alias("acc_id"), (F.pmod(F.xxhash64("id"), F.lit(70_000)) / 1000).alias("v"), F.repeat(F.lit("wide "), 40).alias("wide"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    ranking.with_position(rows, [F.col("v").desc(), F.col("acc_id")], "at").write.parquet(str(tmp_path / "placed"))
    back = spark.read.parquet(str(tmp_path / "placed"))
    assert back.agg(F.count("*"), F.count_distinct("at"), F.min("at"), F.max("at")).first() == (300_000, 300_000, 1, 300_000)
    found = back.select("at", "v", "acc_id").toPandas().sort_values("at")
    assert (found.acc_id.to_numpy() == found.sort_values(["v", "acc_id"], ascending=[False, True]).acc_id.to_numpy()).all()
    assert {(r.tile, r.n) for r in metrics.lift_table(rows, "v", "y", "acc_id").collect()} == {(i, 30_000) for i in range(1, 11)}
    ranks = ranking.value_ranks(rows, "v", hits=F.col("y")).toPandas().sort_values("v")
    assert (ranks.before.to_numpy() == ranks.ties.cumsum().shift(1).fillna(0).to_numpy()).all() and ranks.ties.sum() == 300_000
    assert (ranks.before_hits.to_numpy() == ranks.hits.cumsum().shift(1).fillna(0).to_numpy()).all()
    quantiles = ranking.column_quantiles(rows, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0]).first().quantiles
    assert quantiles == pytest.approx(found.v.quantile([0.0, 0.25, 0.5, 0.9, 1.0]).tolist())
    places = ranking.numbered_within(rows.select("acc_id", "y"), "y", [F.col("acc_id")], "k").groupBy("y").agg(F.min("k"), F.max("k"), F.count_distinct("k")).collect()
    assert sorted(map(tuple, places)) == [(0, 1, 200_000, 200_000), (1, 1, 100_000, 100_000)]


def test_ranks_of_nulls_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 1.0)], "acc_id int, v double")
    shares = {r.acc_id: r.s for r in ranking.with_rank_share(rows, "v", "s").collect()}
    assert shares == {1: pytest.approx(2.5 / 3), 2: None, 3: pytest.approx(2.5 / 3), 4: pytest.approx(1 / 3)}
    empty = rows.limit(0)
    assert ranking.with_position(empty, [F.col("acc_id")], "at").count() == 0 and ranking.with_rank_share(empty, "v", "s").count() == 0
    assert ranking.quantiles_row(empty, {"m": ("v", 0.5)}).first().m is None


def test_split_keeps_the_shares_of_every_label(spark):
    rows = spark.range(1000).select(F.col("id").cast("int").alias("acc_id"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    n = {(r.y, r.split): r["count"] for r in labels.split_stratified(rows, "y").groupBy("y", "split").count().collect()}
    assert n == {(0, "train"): 588, (0, "validation"): 196, (0, "test"): 196, (1, "train"): 12, (1, "validation"): 4, (1, "test"): 4}
    assert labels.split_stratified(rows.limit(24), "y").where("split <> 'train'").count() == 0


def test_models_learn_what_is_there(spark):
    """Held-out bounds that a model without the signal would miss."""
    from tidemark.operators import models

    x = lambda i: F.randn(i)
    rows = spark.range(1500).select(F.col("id").cast("int").alias("acc_id"), x(1).alias("a"), x(2).alias("b"), x(3).alias("noise")).coalesce(1)
    rows = rows.withColumn("y", (F.col("a") * F.col("b") > 0).cast("int")).withColumn("value", F.when(F.col("a") > 0, F.exp(F.col("b") + 3)).otherwise(0.0)).checkpoint()
    names = ["a", "b", "noise"]
    best = models.choose_family(rows, names, "y", 3, {f: models.FAMILIES[f] for f in ("logistic", "forest")}).collect()
    assert best[0].family == "forest" and best[0].pr_auc > 0.9 > best[1].pr_auc  # a product is no line
    oof = models.out_of_fold(rows, names, "y", 5)
    assert oof.count() == 1500 and oof.select("acc_id").distinct().count() == 1500
    assert {r.fold: r["count"] for r in models.with_fold(rows, "y").groupBy("fold").count().collect()}.keys() == set(range(5))
    train, held = rows.where("acc_id % 3 > 0").drop("y"), rows.where("acc_id % 3 = 0").drop("y")
    two_part = metrics.regression_metrics(models.fit_hurdle(train, names, "value")(held), "predicted", "value").first()
    assert two_part.spearman > 0.75
    assert {r.feature for r in models.importances(rows.drop("value"), names, "y", 2).collect()} == {"a", "b"}


def test_leakage_suite_finds_a_leak_and_passes_honest_rows(spark):
    from tidemark.operators import leakage

    rows = spark.range(900).select(F.col("id").cast("int").alias("acc_id"), F.randn(1).alias("a"), F.randn(2).alias("b"), F.rand(3).alias("u")).coalesce(1)
    rows = labels.hashed_split(rows.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-F.col("a")))).cast("int")).drop("u").checkpoint())
    honest = {r.check: r.passed for r in leakage.churn_suite(rows, ["a", "b"], "y", shuffles=3).collect()}
    assert honest == dict.fromkeys(honest, True) and len(honest) == 5
    leaky = rows.withColumn("b", F.col("y") + F.col("b") / 100).unionByName(rows.where("split = 'test'").limit(5).withColumn("split", F.lit("train")))
    found = {r.check: r.passed for r in leakage.churn_suite(leaky, ["a", "b"], "y", shuffles=3).collect()}
    assert not found["single_feature_auc"] and not found["score_sanity"] and not found["split_contamination"]
    dealt = leakage.shuffled(rows, "y", 1)
    assert dealt.agg(F.sum("y"), F.count("*")).first() == rows.agg(F.sum("y"), F.count("*")).first()
    assert dealt.withColumnRenamed("y", "z").join(rows, "acc_id").where("z <> y").count() > 200


def test_forecast_covers_what_it_says(spark):
    from tidemark.operators import models

    rows = spark.range(3000).select(F.col("id").cast("int").alias("acc_id"), (F.pmod(F.xxhash64("id"), F.lit(200)) + 1.0).alias("anchor"), F.exp(F.randn(7) * 0.5).alias("e")).coalesce(1).checkpoint()
    rows = labels.hashed_split(rows.withColumn("y", F.col("anchor") * F.col("e")))
    out = models.quantile_forecast(rows, "anchor", "y").join(rows, "acc_id").where("split = 'test'")
    got = out.agg(F.avg(((F.col("y") >= F.col("p10")) & (F.col("y") <= F.col("p90"))).cast("int")).alias("c"), F.avg((F.col("y") <= F.col("p50")).cast("int")).alias("m"), F.count_if(~((F.col("p10") <= F.col("p25")) & (F.col("p25") <= F.col("p50")) & (F.col("p50") <= F.col("p75")) & (F.col("p75") <= F.col("p90")))).alias("crossed")).first()
    assert 0.75 < got.c < 0.87 and 0.42 < got.m < 0.58 and got.crossed == 0


def test_sinks_and_artifacts(spark, tmp_path):
    from tidemark.operators import models
    from tidemark.sources import sinks

    raw = spark.createDataFrame([("s1", "a", 2), ("s2", "a", 2)], "source_id string, sheet string, excel_row int")
    for part in (raw, raw.where("source_id = 's1'").withColumn("sheet", F.lit("b"))):
        sinks.write_raw(part, str(tmp_path / "raw"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "raw")).select("source_id", "sheet").collect()) == [("s1", "b"), ("s2", "a")]
    for _ in range(2):
        sinks.append_report(raw, str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports")).count() == 4
    runs = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "acc_id int, note string, at int")
    sinks.write_run(runs, str(tmp_path / "runs"), "r", F.col("at"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "runs")).select("acc_id", "note").collect()) == [(1, "new"), (2, "x")]
    cells = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "line\nbreak")], "acc_id int, note string")
    sinks.write_export(cells, ["acc_id", "note"], [F.col("acc_id")], str(tmp_path / "csv"))
    part = next(f for f in os.listdir(tmp_path / "csv") if f.startswith("part"))
    assert (tmp_path / "csv" / part).read_bytes() == '\ufeffacc_id,note\r\n1,"a ""b"", c"\r\n2,\r\n3,"line\nbreak"\r\n'.encode()

    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(0.0, 0), (1.0, 1), (0.2, 0), (0.9, 1)], "x double, label int"))
    model = LogisticRegression(regParam=0.1).fit(rows)
    digest = sinks.save_artifact(spark, model, str(tmp_path / "model"), {"version": "churn-2024.01.1"})
    again, card = sinks.load_artifact(spark, LogisticRegressionModel, str(tmp_path / "model"))
    assert card == {"version": "churn-2024.01.1", "sha256": digest} and again.coefficients == model.coefficients
    spark.range(1).write.parquet(str(tmp_path / "model" / "model" / "more"))
    with pytest.raises(ValueError, match="changed"):
        sinks.load_artifact(spark, LogisticRegressionModel, str(tmp_path / "model"))
    assert models.LEVELS == [0.1, 0.25, 0.5, 0.75, 0.9]


def test_missing_sheets(spark, tmp_path):
    write_book(tmp_path / "a.xlsx")
    got = workbook.missing_sheets(spark, str(tmp_path), ["Backend_payment", "Users+User_profile"]).first()
    assert got.file == "a.xlsx" and got.missing == ["Users+User_profile"]


def write_book(path):
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Backend_payment" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t> acc_id </t></si><si><t>amount</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t> </t></is></c></row><row r="4"><c r="B4"><v>2.5</v></c></row></sheetData></worksheet>')


def test_workbooks_both_ways(spark, tmp_path):
    write_book(tmp_path / "a.xlsx")
    spark.dataSource.register(workbook.WorkbookSource)
    source = spark.read.format("workbook").option("sheet", "Backend_payment").load(str(tmp_path))
    for df in (source, workbook.read_workbooks(spark, str(tmp_path), "Backend_payment")):
        assert sorted((r.excel_row, r.cells["acc_id"], r.cells["amount"]) for r in df.collect()) == [(2, "7", None), (4, None, "2.5")]


def test_csv_and_run_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "acc_id int, note string").coalesce(1)
    workbook.write_csv(df, str(tmp_path / "csv"))
    part = next(f for f in os.listdir(tmp_path / "csv") if f.startswith("part"))
    assert (tmp_path / "csv" / part).read_bytes().startswith(b'acc_id,note\r\n1,"a ""quoted"", text"\r\n2,')
    for run in ("a", "b", "a"):
        sinks.write_run(df, str(tmp_path / "runs"), run)
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("prediction_run_id").count().collect() == [("a", 2), ("b", 2)] or spark.read.parquet(str(tmp_path / "runs")).count() == 4


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, h), u, "t", float(d)) for d in range(1, 6) for h in (1, 5) for u in (1, 2)]
    events = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = windowed_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage_windows").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from usage_windows").collect())) == sorted(map(tuple, windowed_usage(events).collect()))


def _elsewhere(tmp_path, code, ignore):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns(*ignore, "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


RUN_ONE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert 'agg_lifecycle' in q and not [k for k in q if k.startswith('op')] and set(e.oracle_sql()) <= set(q)
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
assert q['promotion_reasons'](s, '').count() > 0  # reads no table
"""


def test_entry_point_without_training_data_operators(tmp_path):
    """The rest must work when the llm folders and corpus_pipeline.py are gone."""
    _elsewhere(tmp_path, RUN_ONE, ["llm"])


def test_entry_point_without_a_library_that_only_they_need(tmp_path):
    _elsewhere(tmp_path, "import sys; sys.modules['zstandard'] = None\n" + RUN_ONE, [])


def test_promotion(spark):
    from tidemark.operators import promotion

    head = "name string, leakage_ok boolean, artifact_ok boolean, validation double, test double, baseline_validation double, baseline_test double, calibration_error double"
    rows = [("strong", True, True, 0.8, 0.82, 0.5, 0.5, 0.061), ("weak", True, True, 0.6, 0.6, 0.5, 0.5, 0.01), ("leaky", False, True, 0.9, 0.9, 0.5, 0.5, 0.01), ("off", True, True, 0.9, 0.9, 0.5, 0.5, 0.3), ("shaky", True, True, 0.9, 0.9, 0.5, 0.5, 0.0), ("even", True, True, 0.9, 0.9, 0.5, 0.5, 0.0)]
    tests = [(n, c, v, 0.5, None) for n, v in (("strong", 0.8), ("weak", 0.6), ("leaky", 0.9), ("off", 0.9)) for c in "ab"]
    tests += [("shaky", c, v, None, None) for c, v in zip("abc", (0.9, 0.9, 0.4), strict=True)] + [("even", c, 0.9, 0.5, 0.8995) for c in "ab"]
    candidates, backtests = spark.createDataFrame(rows, head), spark.createDataFrame(tests, "name string, cutoff string, value double, baseline double, champion double")
    got = promotion.judged(candidates, backtests, relative_margin=0.01, ceiling=0.15, target=0.05)
    assert {r.name: r.reasons for r in got.collect()} == {"strong": "", "weak": "", "leaky": "leakage", "off": "calibration", "shaky": "unstable", "even": "champion"}
    assert promotion.winner(got).first().name == "strong"
    assert promotion.winner(got.where("name = 'leaky'")).count() == 0


def test_lifetime_model(spark):
    import math

    import numpy as np

    from tidemark.operators import lifetime

    xs = [0.05, 0.5, 1.0, 2.5, 10.0, 150.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(lifetime.log_gamma(F.col("x")).alias("g")).collect()
    assert [r.g for r in got] == pytest.approx([math.lgamma(x) for x in xs], abs=1e-9)
    rng, rows = np.random.default_rng(0), []
    for _ in range(1500):  # r 2, alpha 40 days, a 1, b 3
        rate, leave, at, x, last = rng.gamma(2, 1 / 40), rng.beta(1, 3), 0.0, 0, 0.0
        while True:
            at += rng.exponential(1 / rate)
            if at > 365:
                break
            x, last = x + 1, at
            if rng.random() < leave:
                break
        rows.append((x, last, 365.0))
    rfm = spark.createDataFrame(rows, "frequency long, recency double, age double")
    m = lifetime.fit_bgnbd(rfm, penalty=0.0)
    true = lifetime.BgNbd(2, 40, 1, 3)
    both = rfm.agg(F.avg(lifetime.log_likelihood(m)).alias("fit"), F.avg(lifetime.log_likelihood(true)).alias("true")).first()
    assert both.fit >= both.true - 1e-3 and 1 < m.r < 4 and 20 < m.alpha < 80
    p = rfm.select("frequency", "recency", lifetime.p_alive(m).alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in p) and all(r.p == 1 for r in p if r.frequency == 0)


def test_expected_purchases_and_spend(spark):
    import math

    import numpy as np

    from tidemark.operators import lifetime

    m, days = lifetime.BgNbd(0.8, 30.0, 0.7, 2.5), 180.0
    rows = [(0, 0.0, 400.0), (1, 20.0, 300.0), (7, 350.0, 365.0), (40, 100.0, 900.0)]

    def published(x, recency, age):
        z, term, total, n = days / (m.alpha + age + days), 1.0, 1.0, 0
        while n < 20000:  # the plain Gauss series
            term *= (m.r + x + n) * (m.b + x + n) / ((m.a + m.b + x - 1 + n) * (n + 1)) * z
            total, n = total + term, n + 1
        up = (m.a + m.b + x - 1) / (m.a - 1) * (1 - ((m.alpha + age) / (m.alpha + age + days)) ** (m.r + x) * total)
        return up / (1 + (x > 0) * m.a / (m.b + x - 1) * ((m.alpha + age) / (m.alpha + recency)) ** (m.r + x))

    rfm = spark.createDataFrame(rows, "frequency long, recency double, age double")
    got = rfm.select("frequency", lifetime.expected_purchases(m, days).alias("n")).collect()
    assert {r.frequency: r.n for r in got} == pytest.approx({x: published(x, t, age) for x, t, age in rows}, rel=1e-6)

    rng = np.random.default_rng(1)
    true, spent = lifetime.GammaGamma(6.0, 4.0, 15.0), []
    for i in range(3000):
        x, rate = int(rng.integers(1, 12)), rng.gamma(true.q, 1 / true.v)
        spent.append((i, x, float(rng.gamma(true.p * x, 1 / (rate * x))), 10.0, 50.0))
    spent.append((3000, 0, 0.0, 0.0, 50.0))
    spent = spark.createDataFrame(spent, "acc_id long, frequency long, monetary double, recency double, age double")
    g = lifetime.fit_gamma_gamma(spent, penalty=0.0)
    both = spent.where("frequency > 0").agg(F.avg(lifetime.spend_log_likelihood(g)).alias("fit"), F.avg(lifetime.spend_log_likelihood(true)).alias("true")).first()
    assert both.fit >= both.true - 1e-3
    assert g.p * g.v / (g.q - 1) == pytest.approx(true.p * true.v / (true.q - 1), rel=0.1)
    assert lifetime.fit_gamma_gamma(spent.limit(10)) is None
    out = {r.acc_id: r for r in lifetime.expected_revenue(spent, m, g, 180).collect()}
    assert len(out) == 3001 and all(r.predicted_clv == pytest.approx(r.purchases * r.spend) for r in out.values())
    assert out[3000].spend == pytest.approx(spent.agg(F.avg("monetary")).first()[0])


def test_chi_square_tail(spark):
    """Against the closed forms of even and odd degrees of freedom, sums of exponentials and the error function."""
    import math

    from tidemark.functions import scalars

    def tail(x, k):
        h = x / 2
        if k % 2 == 0:
            return math.exp(-h) * math.fsum(h**i / math.factorial(i) for i in range(k // 2))
        return math.erfc(math.sqrt(h)) + math.exp(-h) * math.fsum(h ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (k + 1) // 2))

    rows = [(x, k) for k in range(1, 51) for x in (0.0, 1e-6, 0.3, 1.0, 3.3, 8.0, 20.0, 49.9, 120.0)]
    got = spark.createDataFrame(rows, "x double, k int").select("x", "k", scalars.chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.p - (1.0 if r.x == 0 else tail(r.x, r.k))) < 1e-9, (r.x, r.k, r.p)
    assert spark.range(1).select(scalars.chi_square_tail(F.lit(1.0), F.lit(0))).first()[0] is None


def test_dates_reach_the_scans(spark):
    import contextlib
    import io
    from datetime import date

    from tidemark.plans.catalog import CUTOFF, Tables
    from tidemark.sources import adapter

    assert [adapter.month_after(date(1996, m, d)) for m, d in ((1, 1), (1, 2), (12, 31), (3, 1))] == [date(1996, 1, 1), date(1996, 2, 1), date(1997, 1, 1), date(1996, 3, 1)]
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        Tables(spark, folder).features().explain("formatted")
    pushed = [line for line in shown.getvalue().splitlines() if line.startswith("PushedFilters")]
    assert any("LessThan(l_shipdate" in line for line in pushed) and any("LessThan(o_orderdate" in line for line in pushed)
    for cutoff in (CUTOFF, date(1995, 6, 15)):
        whole = adapter.usage(spark, folder).where(F.col("period") < F.lit(cutoff.isoformat()).cast("date"))
        cut = adapter.usage(spark, folder, cutoff)
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
