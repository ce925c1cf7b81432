"""The skeleton table: variants, profiles, decks and key cards of every archetype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import skeletons as S
from ..sources.keyed import KeyedTable
from ..sources.tables import dropped, saved

KEY = ["set_code", "format", "archetype_name", "is_alternative"]


def skeletons(decks: DataFrame, meta: DataFrame, synergy: DataFrame, as_of: Column, bounds: tuple[int, int] = (7, 14), days: int = 7, **cluster) -> DataFrame:
    """M4: one row per archetype (at least three decks) and variant that has a full deck.

    decks is read twice, so it should be a table.  Their tally is a row per variant and card;
    everything after it grows with the groups and cards, not with the decks.
    """
    by = ["set_code", "format", "archetype"]
    marked, used = S.marked_decks(decks, keep=("trophy_time", "cardlist"), **cluster)
    counts = saved(S.tally(marked, as_of, bounds, days), "skeleton-counts")
    dropped(*used)
    sizes = counts.where("card_name is null").select(*S.GROUP, F.col("decks").alias("sample_size"))
    enough = sizes.groupBy(*by).agg(F.sum("sample_size").alias("n")).where("n >= 3").select(*by)
    profile = S.profile(counts, meta).join(enough, by, "left_semi")
    freq = saved(S.frequency(counts, meta), "skeleton-freq")
    scores = saved(S.candidate_scores(freq, synergy), "skeleton-scores")
    lists = S.build_skeleton(scores, profile, meta)

    def gathered(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in (*S.GROUP, "rank", "card_name")]
        item = F.struct("rank", F.col("card_name").alias("name"), *cols)
        return df.groupBy(*S.GROUP).agg(F.array_sort(F.collect_list(item)).alias(name))

    out = lists.join(profile, S.GROUP).join(sizes, S.GROUP)
    for df, name in ((S.sleeper_cards(freq, meta), "sleeper_cards"), (S.trending(counts, meta), "trending_cards"), (S.importance_cards(scores, meta), "importance_cards")):
        out = out.join(gathered(df, name), S.GROUP, "left")
    out = out.join(S.openness(freq, meta).select(*S.GROUP, "openness_score"), S.GROUP, "left")
    ratio = C.half_up(F.col("avg_creatures") / F.nullif(F.lit(40) - F.col("avg_lands"), F.lit(0.0)), 3)
    out = out.withColumn("creature_ratio", ratio).withColumn("avg_lands", F.round("avg_lands", 1)).drop("full_decks", "avg_creatures").withColumnRenamed("archetype", "archetype_name")
    out = saved(out, "skeletons")
    dropped(counts, freq, scores)
    return out


def store_skeletons(rows: DataFrame, path: str, prune: bool = False) -> KeyedTable:
    """M4: a run's skeletons in the keyed table at path; those that it did not give stay.

    With prune a set and format that the run gives any skeleton of holds only these
    afterwards, so variants that are no longer found go.
    """
    table = KeyedTable(rows.sparkSession, path, KEY, rows.schema)
    table.upsert(rows)
    if prune:
        stored = table.read(columns=KEY).join(rows.select("set_code", "format").distinct(), ["set_code", "format"], "left_semi")
        stale = stored.join(rows.select(*KEY), KEY, "left_anti")
        table.delete(stale.select(*KEY))
    return table
