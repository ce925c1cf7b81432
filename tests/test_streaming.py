"""Streams give what the batch functions give, also when the input comes late, repeated and in several files."""

import pytest
from pyspark.sql import functions as F

from draftloom.operators import articles, snapshots
from draftloom.streaming import jobs


def run(writer, at):
    writer.option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination()


def fed(spark, parts, at):
    """A stream that reads one file a trigger, in the given order."""
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(str(at))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def decks(spark, rows):
    df = spark.createDataFrame(rows, "aggregate_id string, d int")
    return df.select("aggregate_id", F.expr("timestamp'2024-01-01' + make_dt_interval(d)").alias("trophy_time"))


def test_late_and_repeated_decks(spark, tmp_path):
    parts = [decks(spark, x) for x in ([("a", 9), ("b", 2)], [("a", 3), ("c", 20), ("d", 21)], [("late", 1), ("late", 4), (None, 3), ("e", None), ("d", 5), ("f", 2)])]
    table = jobs.deck_table(spark, str(tmp_path / "decks"), parts[0].schema, 4)
    table.insert_new(decks(spark, [("f", 2)]).withColumn("batch", F.lit(None).cast("long")))
    stream = fed(spark, parts, tmp_path / "in")
    run(jobs.stream_new_decks(stream, table, "2024-01-01", "2024-01-20"), tmp_path / "ck")
    got = sorted((r.aggregate_id, r.trophy_time.day, r.batch is None) for r in table.read().collect())
    assert got == [("a", 10, False), ("b", 3, False), ("d", 6, False), ("f", 3, True), ("late", 2, False)]
    jobs.expire_decks(table, F.lit("2024-01-04").cast("timestamp"))
    assert sorted(r.aggregate_id for r in table.read().collect()) == ["a", "d"]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    rows = decks(spark, [("a", 1), ("b", 2)])
    table = jobs.deck_table(spark, str(tmp_path / "decks"), rows.schema, 2)
    stream = fed(spark, [rows], tmp_path / "in")
    for k in range(2):  # a new checkpoint: the first batch comes again
        run(jobs.stream_new_decks(stream, table), tmp_path / f"ck{k}")
    assert table.read().count() == 2


def test_days_close(spark, tmp_path):
    one = lambda k, d: spark.sql(f"SELECT 'x{k}' AS aggregate_id, timestamp'2024-01-01' + make_dt_interval({d}) AS trophy_time, 'S' AS set_code, 'F' AS format, 'WU' AS archetype, 7 AS wins, 1 AS losses")
    stream = fed(spark, [one(k, d) for k, d in enumerate((1, 20, 21, 2))], tmp_path / "in")
    out = jobs.stream_daily_rates(stream, "2 days").select(F.col("window.start").alias("day"), "decks")
    run(out.writeStream.outputMode("append").foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b={e}")), tmp_path / "ck")
    assert [(str(r.day)[:10], r.decks) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("2024-01-02", 1)]


VOTES = [(1, 9, "2024-01-03", 5, "no"), (1, 9, "2024-01-01", 1, "yes"), (1, 8, "2024-01-02", 2, "meh"), (2, 9, "2024-01-02", 3, "yes"), (2, 9, "2024-01-02", 4, "no"), (2, 7, "2024-01-02", 6, "odd"), (3, 9, "2024-01-02", 7, "no")]


def votes_frame(spark):
    return spark.createDataFrame(VOTES, "article_id long, reader_id long, t string, event_id long, kind string").withColumn("ts", F.to_timestamp("t")).drop("t")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("order", [list(range(7)), list(range(6, -1, -1)), [3, 0, 5, 4, 1, 6, 2]])
def test_votes_equal_the_batch_count_in_any_order(spark, tmp_path, order):
    events = votes_frame(spark)
    stream = fed(spark, [events.where(F.col("event_id") == i + 1) for i in order], tmp_path / "in")
    votes, counts = jobs.vote_tables(spark, str(tmp_path / "t"), buckets=2)
    run(jobs.stream_votes(stream, votes, counts), tmp_path / "ck")
    want = articles.count_votes(events.where("kind <> 'odd'"))
    assert rows(counts.read()) == rows(want) == [(1, 1, 1, 0), (2, 1, 0, 0), (3, 0, 0, 1)]


def test_votes_count_once_when_a_batch_fails_between_its_tables(spark, tmp_path, monkeypatch):
    events = votes_frame(spark)
    stream = fed(spark, [events], tmp_path / "in")
    votes, counts = jobs.vote_tables(spark, str(tmp_path / "t"), buckets=2)
    merge = counts.merge
    monkeypatch.setattr(counts, "merge", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError|division by zero"):
        run(jobs.stream_votes(stream, votes, counts), tmp_path / "ck")
    assert votes.read().count() == 4 and counts.version == 0
    monkeypatch.setattr(counts, "merge", merge)
    run(jobs.stream_votes(stream, votes, counts), tmp_path / "ck")
    assert rows(counts.read()) == [(1, 1, 1, 0), (2, 1, 0, 0), (3, 0, 0, 1)]


@pytest.mark.parametrize("skip_null", [False, True])
def test_history_equals_rebuild_after_days_out_of_order(spark, tmp_path, skip_null):
    log = spark.createDataFrame([(k, d, None if d % 5 == 0 else float(d)) for k in ("k", "l", None) for d in range(1, 31 if k else 5)], "k string, d int, r double")
    log = log.select("k", F.expr("date_add(date'2024-01-01', d)").alias("run_date"), "r")
    parts = [log.where(F.pmod(F.day("run_date") * 7, F.lit(4)) == i) for i in (2, 0, 3, 1)]
    table = jobs.history_table(spark, str(tmp_path / "h"), log.select("k").schema, 2)
    run(jobs.stream_history(fed(spark, parts, tmp_path / "in"), table, "r", skip_null=skip_null), tmp_path / "ck")
    want = snapshots.history_from_log(log, ["k"], "r", skip_null=skip_null)
    order = lambda df: sorted((str(r.k), [str(x) for x in r.win_rate_history]) for r in df.collect())
    assert order(jobs.history_of(table)) == order(want)
    assert all(len(r.points) <= 14 for r in table.read().collect())


def test_a_day_that_comes_again_is_replaced(spark, tmp_path):
    day = lambda d, r: spark.createDataFrame([("k", d, r)], "k string, d string, r double").select("k", F.to_date("d").alias("run_date"), "r")
    table = jobs.history_table(spark, str(tmp_path / "h"), day("2024-01-01", 1.0).select("k").schema, 1)
    run(jobs.stream_history(fed(spark, [day("2024-01-01", 1.0), day("2024-01-02", 2.0), day("2024-01-01", 3.0)], tmp_path / "in"), table, "r"), tmp_path / "ck")
    assert [list(r.win_rate_history) for r in jobs.history_of(table).collect()] == [[3.0, 2.0]]
