"""Statistics of archetypes and formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import columns as C

GROUP = ["set_code", "format"]


def real_archetypes(df: DataFrame) -> DataFrame:
    """without the aggregate rows."""
    return df.where(~F.coalesce(F.col("archetype_name").isin(*C.AGGREGATE_ARCHETYPES), F.lit(False)))


def with_deck_type(df: DataFrame) -> DataFrame:
    return real_archetypes(df).withColumn("deck_type", C.deck_type("colors"))


def meta_share(decks: DataFrame) -> DataFrame:
    """A3: each archetype's games and share of its format's games."""
    games = F.coalesce("games_count", F.lit(0))
    total = F.sum(games).over(Window.partitionBy(*GROUP))
    return real_archetypes(decks).withColumn("total_games", F.when(F.coalesce(total, F.lit(0)) == 0, 1).otherwise(total)).withColumn("meta_share", games / F.col("total_games"))


_BINS = (("Mono-color", "Mono Color"), ("Two colors", "2 Color"), ("Two colors + splash", "2 Color + Splash"), ("Three colors", "3 Color"))


def color_breakdown(decks: DataFrame) -> DataFrame:
    """Games by kind of deck in five bins; decks without games are left out."""
    kind = F.lit(">3 Color")
    for k, name in reversed(_BINS):
        kind = F.when(F.col("deck_type") == k, name).otherwise(kind)
    rows = with_deck_type(decks).where(F.coalesce("games_count", F.lit(0)) != 0).withColumn("bin", kind)
    per = rows.groupBy(*GROUP, "bin").agg(F.sum("games_count").alias("games"))
    return per.withColumn("share", F.col("games") / F.sum("games").over(Window.partitionBy(*GROUP)))


def pair_share(decks: DataFrame) -> DataFrame:
    """Games of the ten colour pairs as shares of all two-colour games, splash included."""
    two = with_deck_type(decks).where(F.col("deck_type").isin("Two colors", "Two colors + splash"))
    names = F.create_map(*[F.lit(x) for p in C.PAIRS for x in ("".join(sorted(p)), p)])
    per = two.withColumn("pair", F.try_element_at(names, C.colors_key("colors"))).where("pair is not null").groupBy(*GROUP, "pair").agg(F.sum(F.coalesce("games_count", F.lit(0))).alias("games"))
    total = F.sum("games").over(Window.partitionBy(*GROUP))
    return per.withColumn("share", F.when(total > 0, F.col("games") / total).otherwise(0.0))


def format_averages(card_meta: DataFrame) -> DataFrame:
    """Mean rate of cards that have one, mean ALSA, lowest and highest rate, with the defaults of empty sets."""
    wr = F.when(F.coalesce("gih_wr", F.lit(0.0)) != 0, F.col("gih_wr"))
    return card_meta.groupBy(*GROUP).agg(
        F.coalesce(F.avg(wr), F.lit(55.0)).alias("avg_wr"), F.coalesce(F.avg("alsa"), F.lit(4.0)).alias("avg_alsa"),
        F.coalesce(F.min(wr), F.lit(45.0)).alias("min_wr"), F.coalesce(F.max(wr), F.lit(70.0)).alias("max_wr"))


def format_mean_wr(archetype_stats: DataFrame) -> DataFrame:
    """The rate of all decks of a format, 55.0 where it is missing or zero."""
    all_decks = F.max(F.when(F.col("archetype_name") == "All Decks", F.col("win_rate")))
    return archetype_stats.groupBy(*GROUP).agg(F.coalesce(F.nullif(all_decks, F.lit(0.0)), F.lit(55.0)).alias("mean_wr"))


def in_trophy_window(df: DataFrame, start: Column, end: Column, ts: str = "trophy_time") -> DataFrame:
    """half-open time window."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def new_decks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Decks whose id is neither stored nor met before in the batch."""
    w = Window.partitionBy("aggregate_id").orderBy("trophy_time")
    once = incoming.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return once.join(stored.select("aggregate_id"), "aggregate_id", "left_anti")


def _outcomes(incoming: DataFrame, stored: DataFrame, start: Column, end: Column) -> DataFrame:
    """incoming with ``outcome``: saved, existing, repeated, out of window or error."""
    w = Window.partitionBy("aggregate_id").orderBy("trophy_time")
    known = stored.select("aggregate_id").distinct().withColumn("__known", F.lit(True))
    t = F.col("trophy_time")
    rows = incoming.withColumn("__r", F.row_number().over(w)).join(known, "aggregate_id", "left")
    outcome = F.when(t.isNull(), "error").when(~((t >= start) & (t < end)), "out of window").when(F.col("__known"), "existing").when(F.col("__r") > 1, "repeated").otherwise("saved")
    return rows.withColumn("outcome", outcome).drop("__r", "__known")


def ingest_audit(incoming: DataFrame, stored: DataFrame, start: Column, end: Column) -> DataFrame:
    """How many incoming decks were saved, known, repeated, out of the window or without a time."""
    return _outcomes(incoming, stored, start, end).groupBy("outcome").agg(F.count("*").alias("decks"))


OUTCOMES = ("saved", "existing", "repeated", "out of window", "error")


def ingest(incoming: DataFrame, stored: DataFrame, start: Column, end: Column, write: Callable[[DataFrame], None]) -> DataFrame:
    """A12 of a run: hands the decks to be saved to ``write`` and gives (outcome, decks), counted in that same pass."""
    spark = incoming.sparkSession
    seen = Observation()
    count = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(k)
    rows = _outcomes(incoming, stored, start, end).observe(seen, *map(count, OUTCOMES))
    write(rows.where("outcome = 'saved'").drop("outcome"))
    return spark.createDataFrame([(k, n) for k, n in seen.get.items() if n], "outcome string, decks long")
