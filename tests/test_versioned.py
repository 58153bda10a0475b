"""Versioned tables: merges, two writers at once, a job lost between files and manifest."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versioned


def rows_of(spark, items):
    return spark.createDataFrame(items, "id int, value string")


def content(table, version=None):
    df = table.read(version)
    return {} if df is None else {r.id: r.value for r in df.collect()}


def test_merges_replace_and_add_and_versions_stay_readable(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    assert table.read() is None and table.version() == 0
    assert table.merge(rows_of(spark, [(i, "a") for i in range(40)])) == 1
    before = table.manifest()
    assert table.merge(rows_of(spark, [(3, "b"), (100, "b")])) == 2
    changed = [b for b in before if before[b] != table.manifest()[b]]
    assert 1 <= len(changed) <= 2  # only touched buckets are rewritten
    assert content(table) == {**dict.fromkeys(range(40), "a"), 3: "b", 100: "b"}
    assert content(table, 1) == dict.fromkeys(range(40), "a")
    assert table.merge(rows_of(spark, [])) == 2
    wider = rows_of(spark, [(5, "c")]).withColumn("more", F.lit(1))
    table.merge(wider)
    assert table.read().where("id = 5").first().more == 1 and table.read().where("id = 6").first().more is None


def test_a_lost_job_changes_nothing(spark, tmp_path, monkeypatch):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=2)
    table.merge(rows_of(spark, [(1, "a"), (2, "a")]))

    def lost(*_):
        raise RuntimeError("executor gone")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lost)
        with pytest.raises(RuntimeError):
            table.merge(rows_of(spark, [(1, "lost")]))
    assert content(table) == {1: "a", 2: "a"} and table.version() == 1
    assert table.merge(rows_of(spark, [(2, "b")])) == 2
    assert table.vacuum() >= 1
    assert content(table) == {1: "a", 2: "b"}
    assert table.merge(rows_of(spark, [(3, "c")])) == 3 and content(table) == {1: "a", 2: "b", 3: "c"}


def test_two_writers_lose_no_rows(spark, tmp_path):
    folder, errors = str(tmp_path / "t"), []
    versioned.VersionedTable(spark, folder, ["id"], buckets=2).merge(rows_of(spark, [(0, "start")]))

    def write(name):
        try:
            own = versioned.VersionedTable(spark, folder, ["id"], buckets=2)
            for k in range(4):
                own.merge(rows_of(spark, [(i, f"{name}{k}") for i in ((name == "b") * 50 + k * 5 + 1, (name == "b") * 50 + k * 5 + 2, 99)]))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    table = versioned.VersionedTable(spark, folder, ["id"], buckets=2)
    got = content(table)
    assert table.version() == 9 and len(got) == 1 + 16 + 1
    assert all(got[50 * (n == "b") + k * 5 + j] == f"{n}{k}" for n in "ab" for k in range(4) for j in (1, 2))
    assert got[99] in ("a3", "b3")


def test_a_manifest_is_created_once(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ["id"])
    assert table._publish(1, {"0": "files/x"}) and not table._publish(1, {"0": "files/y"})
    assert table.manifest(1) == {"0": "files/x"}
