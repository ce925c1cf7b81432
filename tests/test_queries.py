"""Every registered query of the library against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from draftloom import queries as Q
from draftloom.plans import fixtures as fx


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in fx.BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    want = duck.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    expected = rows(want.columns, want.fetchall())
    assert got == expected
    assert got


def test_names_are_registered():
    assert set(Q.SQL) <= set(Q.QUERIES)
    assert len(Q.QUERIES) >= 100


@pytest.mark.parametrize("name", ["a26_deck_stacks", "a26_deck_summary", "s7_deck_text", "a8_card_occurrence", "a28_dictionary_coverage", "j12_part_mentions"])
def test_many_lines_are_dealt_out_by_their_number(spark, duck, sf_dir, monkeypatch, name):
    """Beyond the session's four shuffle partitions a task's share of the lines stays the same, and so does the result."""
    monkeypatch.setattr(fx, "_LINES", 500)
    df = Q.QUERIES[name](spark, sf_dir)
    want = duck.sql(Q.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
    items = fx.frame(spark, sf_dir, "fx_items")
    shares = [r["count"] for r in items.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 4 and max(shares) <= 2 * 500


def test_skeletons_read_the_lines_once(spark, sf_dir, monkeypatch):
    asked, real = [], fx.frame
    monkeypatch.setattr(fx, "frame", lambda s, d, name: asked.append(name) or real(s, d, name))
    assert Q.QUERIES["a26_skeleton_stacks"](spark, sf_dir).count()
    assert asked.count("lineitem") == 1


def test_skeletons_read_the_orders_once(spark, sf_dir, monkeypatch):
    asked, real = [], fx.frame
    monkeypatch.setattr(fx, "frame", lambda s, d, name: asked.append(name) or real(s, d, name))
    assert Q.QUERIES["a26_skeleton_summary"](spark, sf_dir).count()
    assert asked.count("orders") == asked.count("customer") == 1


def test_orders_without_customers_are_no_decks(spark, sf_dir, tmp_path):
    """An order whose customer is missing or null comes once, with its cards, and is no deck."""
    c, d = duckdb.connect(), str(tmp_path)
    changed = {"orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey)", "customer": "SELECT * REPLACE (CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS c_custkey)"}
    for t in fx.BASE:
        c.sql(f"COPY ({changed.get(t, 'SELECT *')} FROM '{sf_dir}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    orders = fx.orders_with_cards(spark, d)
    assert orders.count() == orders.select("aggregate_id").distinct().count() == len(c.sql("SELECT o_orderkey FROM orders").fetchall())
    decks = fx.decks_of(orders).drop("cardlist")
    want = c.sql(fx.with_ctes("SELECT * FROM fx_decks"))
    assert rows(decks.columns, [tuple(r) for r in decks.collect()]) == rows(want.columns, want.fetchall())
    assert orders.where("not has_player and size(cardlist) > 0").count()


def test_skeletons_of_orders_without_customers_or_lines(spark, sf_dir, tmp_path):
    """Cards that only orders without a customer have are in the list of cards, but in no deck."""
    c, d = duckdb.connect(), str(tmp_path)
    kept = {"customer": "c_custkey % 3 <> 0", "lineitem": "l_orderkey % 5 <> 0"}
    for t in fx.BASE:
        c.sql(f"COPY (SELECT * FROM '{sf_dir}/{t}.parquet' WHERE {kept.get(t, 'true')}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    same = lambda df: rows(df.columns, [tuple(r) for r in df.collect()])
    orders = fx.orders_with_cards(spark, d)
    assert orders.where("not has_player").count() and orders.where("size(cardlist) = 0").count()
    assert same(fx.meta_of(orders)) == same(fx.meta(spark, d))
    for name in ("a8_card_occurrence", "a26_skeleton_stacks"):
        want = c.sql(Q.SQL[name])
        assert same(Q.QUERIES[name](spark, d)) == rows(want.columns, want.fetchall())
