"""Card pairs by support, lift and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BASIC_LANDS
from .snapshots import top_n

GROUP = ("set_code", "format")


def _items(decks: DataFrame) -> DataFrame:
    """decks with their sorted distinct cards, the five basic lands left out."""
    return decks.withColumn("cards", F.sort_array(F.array_except(F.map_keys("cardlist"), F.array(*[F.lit(x) for x in BASIC_LANDS]))))


def card_occurrence(decks: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """In how many decks each card is."""
    return _items(decks).select(*by, F.explode("cards").alias("card_name")).groupBy(*by, "card_name").agg(F.count("*").alias("decks"))


def _pairs(listed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts of unordered pairs, built inside each row's sorted card array and combined map-side."""
    firsts = listed.select(*by, "cards", F.posexplode("cards").alias("i", "card_a"))
    later = F.slice(F.col("cards"), F.col("i") + 2, F.greatest(F.size("cards") - F.col("i") - 1, F.lit(0)))
    return firsts.select(*by, "card_a", F.explode(later).alias("card_b")).groupBy(*by, "card_a", "card_b").agg(F.count("*").alias("co_occurrence_count"))


def pair_occurrence(decks: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """In how many decks each pair a < b is."""
    return _pairs(_items(decks), by)


def frequent_cards(decks: DataFrame, by: tuple[str, ...] = GROUP, card_floor: int = 20, card_share: float = 0.03) -> DataFrame:
    """(by..., card_name, decks, n): the cards that enough of the n decks have; empty decks count."""
    n = decks.groupBy(*by).agg(F.count("*").alias("n"))
    support = card_occurrence(decks, by).join(n, list(by))
    return support.where(F.col("decks") >= F.greatest(F.lit(card_floor), F.floor(F.lit(card_share) * F.col("n"))))


def synergy_scores(
    decks: DataFrame, by: tuple[str, ...] = GROUP, min_lift: float = 1.2, pair_floor: int = 10, pair_share: float = 0.02, card_floor: int = 20, card_share: float = 0.03,
    frequent: DataFrame | None = None,
) -> DataFrame:
    """A10: lift and confidences of the pairs whose pair and cards are frequent enough.

    Empty decks count in the number of decks.  Cards under their threshold are
    dropped from the decks before pairs are made, which gives the same result.
    frequent_cards is read several times; where it is written already, it can be given.
    """
    if frequent is None:
        frequent = frequent_cards(decks, by, card_floor, card_share)
    n = frequent.groupBy(*by).agg(F.max("n").alias("n"))
    kept = frequent.groupBy(*by).agg(F.collect_list("card_name").alias("kept"))
    # the number of groups and cards is that of the game, not of the decks played; a shuffle would deal all decks out by one of the few groups
    pruned = decks.join(F.broadcast(kept), list(by)).select(*by, F.sort_array(F.array_intersect(F.map_keys("cardlist"), "kept")).alias("cards"))
    pairs = _pairs(pruned, by)
    a = frequent.select(*by, F.col("card_name").alias("card_a"), F.col("decks").alias("na"))
    b = frequent.select(*by, F.col("card_name").alias("card_b"), F.col("decks").alias("nb"))
    rows = pairs.join(n, list(by)).where(F.col("co_occurrence_count") >= F.greatest(F.lit(pair_floor), F.floor(F.lit(pair_share) * F.col("n"))))
    rows = rows.join(a, [*by, "card_a"]).join(b, [*by, "card_b"])
    co = F.col("co_occurrence_count")
    lift = (co / F.col("n")) / ((F.col("na") / F.col("n")) * (F.col("nb") / F.col("n")))
    return rows.withColumn("lift", lift).where(F.col("lift") >= min_lift).select(
        *by, "card_a", "card_b", F.round("lift", 4).alias("synergy_score"), F.round("lift", 4).alias("lift_score"),
        F.round(co / F.col("na"), 4).alias("confidence_a_to_b"), F.round(co / F.col("nb"), 4).alias("confidence_b_to_a"), "co_occurrence_count")


def card_partners(synergy: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Each pair seen from both of its cards."""
    seen = lambda a, b: F.struct(F.col(f"card_{a}").alias("card_name"), F.col(f"card_{b}").alias("partner"), F.col(f"confidence_{a}_to_{b}").alias("confidence"))
    both = synergy.select(*by, F.explode(F.array(seen("a", "b"), seen("b", "a"))).alias("s"), "synergy_score", "co_occurrence_count")
    return both.select(*by, "s.card_name", "s.partner", "s.confidence", "synergy_score", "co_occurrence_count")


def top_synergies(synergy: DataFrame, by: str = "lift_score", n: int = 10, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The n best pairs of each group by lift or by one of the confidences."""
    return top_n(synergy, list(group), [F.desc(by), F.asc("card_a"), F.asc("card_b")], n)


def top_partners(synergy: DataFrame, n: int = 3, group: tuple[str, ...] = GROUP) -> DataFrame:
    """T5: each card's best partners by confidence and by synergy."""
    rows = card_partners(synergy, group)
    key = [*group, "card_name"]
    rank = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(c), F.asc("partner")))
    ranked = rows.withColumn("by_confidence", rank("confidence")).withColumn("by_synergy", rank("synergy_score"))
    kinds = F.array_compact(F.array(*[F.when(F.col(f"by_{k}") <= n, F.struct(F.col(f"by_{k}").alias("rank"), F.lit(k).alias("kind"))) for k in ("confidence", "synergy")]))
    return ranked.select(*rows.columns, F.explode(kinds).alias("s")).select(*rows.columns, "s.rank", "s.kind")
