"""The keyed table: what a change touches, what a failure leaves, nulls, maps and versions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from draftloom.sources import keyed, tables
from draftloom.sources.keyed import KeyedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], frame(spark, [(0, "a")]).schema, 8)
    t.upsert(frame(spark, [(i, "a") for i in range(100)] + [(None, "n")]))
    return t


def test_only_buckets_of_incoming_keys_change(spark, table):
    before, files = table.folders(), set(glob.glob(f"{table.path}/data/*/*/*.parquet"))
    table.upsert(frame(spark, [(5, "b"), (1000, "b")]))
    touched = {r[0] for r in spark.createDataFrame([(5,), (1000,)], "k int").select(F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    after = table.folders()
    assert {b for b in after if after[b] != before.get(b)} == touched
    new = set(glob.glob(f"{table.path}/data/*/*/*.parquet")) - files
    assert {int(os.path.basename(os.path.dirname(f)).split("=")[1]) for f in new} == touched
    assert rows(table.read()) == sorted([(i, "b" if i == 5 else "a") for i in range(100)] + [(None, "n"), (1000, "b")], key=str)


def test_a_failed_run_leaves_the_old_version(spark, table, monkeypatch):
    old = rows(table.read())
    monkeypatch.setattr(table, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(frame(spark, [(1, "z")]))
    again = KeyedTable(spark, table.path, ["k"])
    assert rows(again.read()) == old and again.version == 1
    os.makedirs(f"{table.path}/manifest/v=2/_temporary")  # a run that failed while it wrote the manifest
    again.upsert(frame(spark, [(1, "y")]))
    assert KeyedTable(spark, table.path, ["k"]).version == 3 and (1, "y") in rows(again.read())


def test_two_writers(spark, table):
    other = KeyedTable(spark, table.path, ["k"])
    table.upsert(frame(spark, [(1, "z")]))
    with pytest.raises(keyed.ConflictError):
        other.upsert(frame(spark, [(2, "y")]))
    assert (1, "z") in rows(KeyedTable(spark, table.path, ["k"]).read())


def test_new_keys_are_added_and_nulls_are_keys(spark, table):
    before = table.folders()
    table.insert_new(frame(spark, [(5, "x"), (None, "x"), (200, "x"), (200, "y")]), [F.col("v")])
    got = dict(rows(table.read()))
    assert got[5] == "a" and got[None] == "n" and got[200] == "y" and len(got) == 102
    assert all(set(before[b]) <= set(table.folders()[b]) for b in before)
    table.compact(1)
    assert all(len(f) == 1 for f in table.folders().values()) and dict(rows(table.read())) == got


def test_columns_set_in_place(spark, table):
    new = frame(spark, [(1, None), (2, "q"), (999, "r")])
    table.update_columns(new, ["v"])
    got = dict(rows(table.read()))
    assert got[1] == "a" and got[2] == "q" and 999 not in got
    table.update_columns(new, ["v"], set_null=True)
    got = dict(rows(table.read()))
    assert got[1] is None and got[2] == "q" and len(got) == 101
    cur = frame(spark, [(1, "a"), (2, "a")])
    assert rows(tables.upsert_columns(cur, new, ["k"], ["v"], set_null=True)) == [(1, None), (2, "q")]


def test_versions_deletion_and_vacuum(spark, table):
    table.delete(spark.createDataFrame([(3,), (None,), (5000,)], "k int"))
    assert {r[0] for r in rows(table.read())} == set(range(100)) - {3}
    assert len(rows(table.read(version=1))) == 101
    table.vacuum()
    assert len(rows(table.read())) == 99
    live = {f for folders in table.folders().values() for f in folders}
    assert set(os.listdir(f"{table.path}/data")) == live
    table.delete(table.read())
    assert rows(table.read()) == [] and table.folders() == {}
    table.upsert(frame(spark, []))
    assert rows(table.read()) == []


def test_rows_with_maps_and_ties(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 3}), (2, None)], "k int, m map<string,int>")
    t = KeyedTable(spark, str(tmp_path / "m"), ["k"], df.schema, 2)
    got = []
    for n in (1, 3, 5):
        t.upsert(df.repartition(n))
        got.append(rows(t.read()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 2
