"""The incremental jobs as Structured Streaming; each gives what its batch form gives on the same input.

Input may come in any order, late and repeated.  What a job must remember lies in
keyed tables (``sources.keyed``), of which a batch reads and writes the buckets of its
own keys.  A batch that runs again after a failure changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.keyed import KeyedTable

_MARK = "batch"


def deck_table(spark, path: str, decks: StructType, buckets: int | None = None) -> KeyedTable:
    """The table that stream_new_decks adds to: decks by aggregate_id, and the batch that brought each."""
    return KeyedTable(spark, path, ["aggregate_id"], StructType([*decks.fields, StructField("batch", LongType())]), buckets)


def stream_new_decks(stream: DataFrame, table: KeyedTable, start: str | None = None, end: str | None = None) -> DataStreamWriter:
    """Decks with an id and a valid time inside [start, end) are added to the table, each id once, however late it comes.

    Of an id's decks in one batch the earliest counts; an id that the table has stays
    as it is.  Ids are remembered for as long as their decks are in the table;
    expire_decks takes out those that are too old to be fetched again.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.where("trophy_time is not null and aggregate_id is not null")
        if start:
            rows = rows.where(F.col("trophy_time") >= F.lit(start).cast("timestamp"))
        if end:
            rows = rows.where(F.col("trophy_time") < F.lit(end).cast("timestamp"))
        table.insert_new(rows.withColumn("batch", F.lit(epoch).cast("long")), [-F.unix_micros("trophy_time")])

    return stream.writeStream.foreachBatch(each)


def expire_decks(table: KeyedTable, before: Column) -> None:
    """Takes out decks from before the start of the earliest window that is still fetched; they can not come again."""
    table.delete(table.read().where(F.col("trophy_time") < before).select("aggregate_id"))


def history_table(spark, path: str, keys: StructType, buckets: int | None = None) -> KeyedTable:
    """The table that stream_history keeps: the last points of each key."""
    schema = StructType([*keys.fields, *StructType.fromDDL("points array<struct<run_date:date,rate:double>>").fields])
    return KeyedTable(spark, path, keys.names, schema, buckets)


def stream_history(stream: DataFrame, table: KeyedTable, rate: str, keep: int = 14, skip_null: bool = False, day: str = "run_date") -> DataStreamWriter:
    """R2: the last ``keep`` rates by day of every key, whatever order the days come in.

    A day that comes again takes the later batch's rate, of several in one batch the
    largest.  With skip_null a missing rate is no point at all.  A batch reads the
    histories of its own keys, no log.
    """
    keys = table.keys

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.where(F.col(rate).isNotNull()) if skip_null else batch
        days = rows.groupBy(*keys, F.col(day).cast("date").alias("run_date")).agg(F.max(rate).cast("double").alias("rate"))
        new = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run_date", "rate"))).alias("points"))

        def combine(rows: DataFrame, stored: DataFrame) -> DataFrame:
            old = stored.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("points").alias("old"))
            on = F.lit(True)
            for k in keys:
                on = on & rows[k].eqNullSafe(old[f"__{k}"])
            again = F.transform("points", lambda x: x["run_date"])
            before = F.filter(F.coalesce("old", F.array().cast("array<struct<run_date:date,rate:double>>")), lambda x: ~F.array_contains(again, x["run_date"]))
            both = F.array_sort(F.concat(before, F.col("points")))
            last = F.when(F.size(both) > keep, F.slice(both, -keep, keep)).otherwise(both)
            return rows.join(old, on, "left").select(*keys, last.alias("points"))

        table.merge(new, combine)

    return stream.writeStream.foreachBatch(each)


def history_of(table: KeyedTable) -> DataFrame:
    """R2: each key's history."""
    return table.read().select(*table.keys, F.transform("points", lambda x: x["rate"]).alias("win_rate_history"))


_KINDS = ("yes", "meh", "no")


def vote_tables(spark, path: str, article: str = "bigint", reader: str = "bigint", buckets: int | None = None) -> tuple[KeyedTable, KeyedTable]:
    """The tables that stream_votes keeps: the first vote of every reader on every article, and the counts of each article."""
    votes = StructType.fromDDL(f"article_id {article}, reader_id {reader}, vote struct<ts:timestamp,event_id:bigint,kind:string>")
    counts = StructType.fromDDL(f"article_id {article}, {', '.join(f'votes_{k} bigint' for k in _KINDS)}")
    return KeyedTable(spark, f"{path}/votes", ["article_id", "reader_id"], votes, buckets), KeyedTable(spark, f"{path}/counts", ["article_id"], counts, buckets)


def stream_votes(stream: DataFrame, votes: KeyedTable, counts: KeyedTable) -> DataStreamWriter:
    """Votes by kind of each article; of a reader's votes on it only the first in time counts, in whatever batch it comes.

    A batch writes by how much its votes change the counts before it stores the
    votes, and adds that to the counts last; each table is marked with the batch
    that it has, so a batch that runs again goes on where it failed.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = f"{counts.path}/changes/batch={epoch}"
        if votes.mark(_MARK) < epoch:
            first = F.min(F.struct("ts", F.col("event_id").cast("bigint").alias("event_id"), "kind")).alias("vote")
            new = batch.where(F.col("kind").isin(*_KINDS)).groupBy("article_id", "reader_id").agg(first)

            def combine(rows: DataFrame, stored: DataFrame) -> DataFrame:
                old = stored.select(F.col("article_id").alias("a"), F.col("reader_id").alias("r"), F.col("vote").alias("old"))
                both = rows.join(old, rows["article_id"].eqNullSafe(old["a"]) & rows["reader_id"].eqNullSafe(old["r"]), "left")
                better = F.col("old").isNull() | (F.col("vote") < F.col("old"))
                change = lambda k: F.sum((F.col("vote.kind") == k).cast("long") - F.coalesce((F.col("old.kind") == k).cast("long"), F.lit(0))).alias(f"votes_{k}")
                both.where(better).groupBy("article_id").agg(*[change(k) for k in _KINDS]).write.mode("overwrite").parquet(at)
                return both.select("article_id", "reader_id", F.when(better, F.col("vote")).otherwise(F.col("old")).alias("vote"))

            votes.merge(new, combine, {_MARK: epoch})
        if counts.mark(_MARK) < epoch:

            def added(rows: DataFrame, stored: DataFrame) -> DataFrame:
                old = stored.select(F.col("article_id").alias("a"), *[F.col(f"votes_{k}").alias(f"old_{k}") for k in _KINDS])
                both = rows.join(old, rows["article_id"].eqNullSafe(old["a"]), "left")
                return both.select("article_id", *[(F.col(f"votes_{k}") + F.coalesce(f"old_{k}", F.lit(0))).alias(f"votes_{k}") for k in _KINDS])

            counts.merge(spark.read.schema(counts.schema).parquet(at), added, {_MARK: epoch})

    return stream.writeStream.foreachBatch(each)


def stream_daily_rates(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Decks and share of won games per archetype and day."""
    day = F.window("trophy_time", "1 day")
    return stream.withWatermark("trophy_time", delay).groupBy(day, "set_code", "format", "archetype").agg(
        F.count("*").alias("decks"), (F.sum("wins") / F.sum(F.col("wins") + F.col("losses")) * 100).alias("win_rate"))
