"""Daily snapshots: clean feeds into keyed rows and roll their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import last_by_key


def archetype_snapshot(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A1: one row per (set, format, colours); rows without a name or games are skipped, the last one wins."""
    rate = F.coalesce(C.safe_rate("win_rate"), F.try_divide("wins", "games") * 100)
    rows = raw.where(~C.blank("color_name") & (F.coalesce("games", F.lit(0)) != 0)).select(
        "set_code", "format", *extra, F.col("color_name").alias("archetype_name"), C.clean_color_code("color_name").alias("colors"),
        F.round(rate, 1).alias("win_rate"), F.col("games").alias("games_count"), "ingest_seq")
    return last_by_key(rows, ["set_code", "format", *extra, "colors"], [F.col("ingest_seq"), F.col("archetype_name")]).drop("ingest_seq")


def card_snapshot(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A2: one row per (set, format, context, card); a missing rate stays null."""
    rows = raw.where(~C.blank("name")).select(
        "set_code", "format", "filter_context", *extra, F.col("name").alias("card_name"), F.coalesce("rarity", F.lit("common")).alias("rarity"),
        F.coalesce("color", F.lit("")).alias("colors"), F.round(C.safe_rate("ever_drawn_win_rate"), 2).alias("gih_wr"),
        F.col("avg_seen").alias("alsa"), F.coalesce("game_count", F.lit(0)).alias("img_count"), "ingest_seq")
    return last_by_key(rows, ["set_code", "format", "filter_context", *extra, "card_name"], [F.col("ingest_seq")]).drop("ingest_seq")


def roll_history(prior: DataFrame, snapshot: DataFrame, keys: list[str], rate: str, keep: int = 14, skip_null: bool = False, hist: str = "win_rate_history") -> DataFrame:
    """Snapshot with the stored history plus this run's rate, at most the last ``keep`` points."""
    old = F.coalesce(F.col("__h"), F.array().cast("array<double>"))
    grown = F.slice(F.concat(old, F.array(rate)), -keep, keep)
    grown = F.when(F.size(old) + 1 <= keep, F.concat(old, F.array(rate))).otherwise(grown)
    new = F.when(F.col(rate).isNull(), old).otherwise(grown) if skip_null else grown
    return snapshot.join(prior.select(*keys, F.col(hist).alias("__h")), keys, "left").withColumn(hist, new).drop("__h")


def history_from_log(log: DataFrame, keys: list[str], rate: str, day: str = "run_date", keep: int = 14, skip_null: bool = False) -> DataFrame:
    """W1 rebuilt: the last ``keep`` rates by day of every key; a day counts once, so a re-run adds nothing."""
    rows = log.where(F.col(rate).isNotNull()) if skip_null else log
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    last = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep)
    return last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(rate).alias("v")))), lambda x: x["v"]).alias("win_rate_history"))


def dedup_last(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The last row of each key."""
    return last_by_key(df, keys, [F.col(order_col)])


def top_n(df: DataFrame, part: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their rank.  ``order`` must end in a unique key."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
