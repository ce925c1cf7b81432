"""Archetype variants and skeletons from winning decks.

decks everywhere: set_code, format, archetype, aggregate_id, trophy_time,
cardlist MAP<name, copies>, and is_alternative where variants are told apart.
meta: set_code, format, card_name, card_cmc, card_cost, card_type, rarity, gih_wr, alsa.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import dropped, saved
from .snapshots import top_n
from .synergy import card_partners

GROUP = ["set_code", "format", "archetype", "is_alternative"]
_BASIC_WORDS = "Plains|Island|Swamp|Mountain|Forest"


def jaccard(a: Column | str, b: Column | str) -> Column:
    """M1: shared part of two card sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def _coded(decks: DataFrame, by: list[str], broadcast_groups: int, keep: tuple[str, ...]) -> DataFrame:
    """(by..., aggregate_id, keep..., ids, bits, size): each deck's cards, basic lands left out, by number within their group.

    Cards are numbered in the order of their names; ids lists the numbers and bits
    holds them as a bitmap of 64-bit words.
    """
    # the cards of a group are those of the game, however many decks it has
    cards = decks.select(*by, F.explode(F.map_keys("cardlist")).alias("card")).distinct().where(~F.col("card").rlike(_BASIC_WORDS))
    names = saved(cards.groupBy(*by).agg(F.array_sort(F.collect_list("card")).alias("names")), "cluster-cards")
    side = F.broadcast(names) if names.count() <= broadcast_groups else names
    ids = F.sort_array(F.filter(F.transform(F.map_keys("cardlist"), lambda c: (F.array_position("names", c) - 1).cast("int")), lambda i: i >= 0))
    coded = decks.join(side, by, "left").select(*by, "aggregate_id", *keep, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    words = F.sequence(F.lit(0), F.coalesce(F.floor(F.array_max("ids") / 64), F.lit(0)).cast("int"))
    word = lambda w: F.aggregate(F.filter("ids", lambda i: F.floor(i / 64) == w), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)))
    out = saved(coded.select(*by, "aggregate_id", *keep, "ids", F.transform(words, word).alias("bits"), F.size("ids").alias("size")), "cluster-decks")
    dropped(names)
    return out


def _near(bits: str, size: str, other: str, other_size: str) -> Column:
    """M1 of two bitmaps."""
    both = F.aggregate(F.zip_with(bits, other, lambda x, y: F.bit_count(F.coalesce(x.bitwiseAND(y), F.lit(0).cast("long")))), F.lit(0), lambda s, n: s + n)
    union = F.col(size) + F.col(other_size) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def cluster_decks(decks: DataFrame, by: tuple[str, ...] = ("set_code", "format", "archetype"), **limits) -> DataFrame:
    """M2: (by..., aggregate_id, is_alternative), written: two clusters per group where they differ enough."""
    marked, tables = marked_decks(decks, by, **limits)
    out = saved(marked, "cluster-marks")
    dropped(*tables)
    return out


def marked_decks(
    decks: DataFrame, by: tuple[str, ...] = ("set_code", "format", "archetype"), min_decks: int = 40, sample: int = 50, rounds: int = 3,
    min_cluster: int = 20, min_share: float = 0.15, max_common: int = 9, top: int = 15, broadcast_groups: int = 20_000, keep: tuple[str, ...] = (),
) -> tuple[DataFrame, list[DataFrame]]:
    """M2: (by..., aggregate_id, keep..., is_alternative) and the saved tables that it reads.

    The columns in keep go with the decks, so that no join has to find them again by
    the id.  decks is read twice, so it should be a table.

    All groups are clustered together.  Seeds are the most distant pair of a sample
    per group (the ``sample`` smallest by MD5 of the id; ties to the smaller ids);
    then each round assigns decks to the nearer centroid and takes as centroid the
    cards of at least half of a cluster's decks.  Decks and centroids are bitmaps.
    There are two centroids a group: up to broadcast_groups groups they are broadcast, so
    decks are never dealt out by their group, of which there are few; what a round
    counts is combined before it is shuffled.  Each round's counts and centroids, a few
    rows a card, are written, which cuts the lineage, and removed after the next.
    """
    by_ = list(by)
    base = _coded(decks, by_, broadcast_groups, keep)
    # the smallest digests are those with the most leading zeros: as many are asked for as still leave a full sample, so that few decks are sorted
    digest = F.md5(F.col("aggregate_id").cast("string"))
    zeros = F.coalesce(F.length(digest) - F.length(F.ltrim(digest, F.lit("0"))), F.lit(32))
    leave = F.size(F.filter(F.array(*[F.count(F.when(zeros >= i, 1)) for i in range(1, 9)]), lambda k: k >= sample))
    sizes = saved(base.groupBy(*by_).agg(F.count("*").alias("n"), leave.alias("zeros")).where(F.col("n") >= min_decks).select(*by_, "zeros"), "cluster-groups")
    small = F.broadcast if sizes.count() <= broadcast_groups else (lambda df: df)
    big = base.join(small(sizes), by_)
    w = Window.partitionBy(*by_).orderBy(digest, "aggregate_id")
    pick = saved(big.where(zeros >= F.col("zeros")).select(*by_, "aggregate_id", "bits", "size").withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).drop("r"), "cluster-sample")
    half = lambda x: pick.select(*by_, *[F.col(c).alias(f"{c}_{x}") for c in ("aggregate_id", "bits", "size")])
    far = half("a").join(half("b"), by_).where("aggregate_id_a < aggregate_id_b").withColumn("d", 1 - _near("bits_a", "size_a", "bits_b", "size_b"))
    seeds = top_n(far, by_, [F.desc("d"), "aggregate_id_a", "aggregate_id_b"], 1)
    # decks of the same cards always fall into the same cluster, so they are counted once for all rounds
    sets = saved(big.groupBy(*by_, "ids", "bits", "size").agg(F.count("*").alias("same")), "cluster-sets")
    centroids = saved(seeds.select(*by_, F.col("bits_a").alias("c0"), F.col("size_a").alias("s0"), F.col("bits_b").alias("c1"), F.col("size_b").alias("s1")), "cluster-seeds")
    dropped(pick)
    nearer = F.when(_near("bits", "size", "c1", "s1") > _near("bits", "size", "c0", "s0"), 1).otherwise(0)
    for k in range(rounds):
        near = sets.join(small(centroids), by_).withColumn("cluster", nearer)
        # decks and cards of each cluster are counted in one pass; -1 stands for the deck itself
        counted = saved(near.select(*by_, "cluster", "same", F.explode(F.concat(F.array(F.lit(-1)), "ids")).alias("id")).groupBy(*by_, "cluster", "id").agg(F.sum("same").alias("m")), f"cluster-{k}")
        n = counted.where("id < 0").select(*by_, "cluster", F.col("m").alias("n"))
        held = counted.where("id >= 0")
        if k + 1 == rounds:
            break
        often = held.join(n, [*by_, "cluster"]).where(F.col("m") * 2 >= F.col("n"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id") % 64)
        words = often.groupBy(*by_, "cluster", F.floor(F.col("id") / 64).alias("w")).agg(F.bit_or(bit).alias("word"), F.count("*").alias("cards"))
        maps = words.groupBy(*by_, "cluster").agg(F.map_from_entries(F.collect_list(F.struct("w", "word"))).alias("m"), F.max("w").alias("top"), F.sum("cards").cast("int").alias("s"))
        bits = F.transform(F.sequence(F.lit(0).cast("long"), "top"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
        new = n.join(maps, [*by_, "cluster"], "left").select(*by_, "cluster", F.coalesce(bits, F.array().cast("array<bigint>")).alias("b"), F.coalesce("s", F.lit(0)).alias("s"))
        both = new.groupBy(*by_).agg(*[F.max_by(c, F.when(F.col("cluster") == i, 1)).alias(f"{c}{i}_new") for c in ("b", "s") for i in (0, 1)])
        # a cluster that has lost all its decks keeps its centroid
        step = centroids.join(both, by_, "left").select(*by_, *[F.coalesce(f"{c}{i}_new", f"{o}{i}").alias(f"{o}{i}") for c, o in (("b", "c"), ("s", "s")) for i in (0, 1)])
        step = saved(step, f"cluster-centroids-{k}")
        dropped(counted, centroids)
        centroids = step
    # numbers are in the order of names, so ties go to the first by name
    lists = top_n(held, [*by_, "cluster"], [F.desc("m"), "id"], top)
    common = lists.groupBy(*by_, "id").agg(F.count("*").alias("k")).groupBy(*by_).agg(F.count(F.when(F.col("k") == 2, 1)).alias("common"))
    split = n.groupBy(*by_).agg(F.sum(F.when(F.col("cluster") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("cluster") == 1, F.col("n")).otherwise(0)).alias("n1")).join(common, by_)
    least = F.least("n0", "n1")
    ok = split.where((least >= min_cluster) & (least / (F.col("n0") + F.col("n1")) >= min_share) & (F.col("common") <= max_common)).select(*by_, F.when(F.col("n0") >= F.col("n1"), 1).otherwise(0).alias("alt"))
    # only groups with two clusters that differ enough are in ok; all other decks are the main version
    accepted = saved(centroids.join(ok, by_), "cluster-accepted")
    marked = base.join(small(accepted), by_, "left").withColumn("cluster", nearer)
    out = marked.select(*by_, "aggregate_id", *keep, F.coalesce(F.col("cluster") == F.col("alt"), F.lit(False)).alias("is_alternative"))
    dropped(sizes, sets, counted, centroids)
    return out, [base, accepted]


def tally(decks: DataFrame, as_of: Column, bounds: tuple[int, int] = (7, 14), days: int = 7, min_cards: int = 35) -> DataFrame:
    """What the statistics of a group need of its decks, in one pass: a row per group and card, and one without card_name for the decks themselves.

    decks and recent count those that hold the card, full those of at least min_cards
    cards; weight and copies are weighted sums, full_weight and full_copies those of full
    decks.  Decks are summed up before anything is joined, so no deck is dealt out by one of the few cards.
    """
    out = decks if "is_alternative" in decks.columns else decks.withColumn("is_alternative", F.lit(False))
    recent = F.coalesce(F.col("trophy_time") >= as_of - F.expr(f"make_interval(0, 0, 0, {days})"), F.lit(False))
    full = F.aggregate(F.map_values("cardlist"), F.lit(0), lambda s, x: s + x) >= min_cards
    itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).alias("value")))
    rows = out.select(*GROUP, C.recency_weight("trophy_time", as_of, bounds).alias("w"), recent.alias("is_recent"), full.alias("is_full"), F.concat(itself, F.map_entries("cardlist")).alias("cardlist"))
    rows = rows.select(*GROUP, "w", "is_recent", "is_full", F.explode("cardlist").alias("c")).select(*GROUP, "w", "is_recent", "is_full", F.col("c.key").alias("card_name"), F.col("c.value").alias("qty"))
    copies, if_full = F.col("w") * F.col("qty"), lambda x: F.when(F.col("is_full"), x)
    return rows.groupBy(*GROUP, "card_name").agg(
        F.count("*").alias("decks"), F.count(F.when(F.col("is_recent"), 1)).alias("recent"), F.count(if_full(1)).alias("full"),
        F.sum("w").alias("weight"), F.sum(copies).alias("copies"), F.sum(if_full(F.col("w"))).alias("full_weight"), F.sum(if_full(copies)).alias("full_copies"))


def _of_decks(counts: DataFrame) -> DataFrame:
    return counts.where("card_name is null").drop("card_name")


def _of_cards(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """The rows of cards that have metadata."""
    return counts.join(meta.select("set_code", "format", "card_name", "card_cmc", "card_type"), ["set_code", "format", "card_name"])


def deck_profile(decks: DataFrame, meta: DataFrame, as_of: Column, bounds: tuple[int, int] = (7, 14), min_cards: int = 35) -> DataFrame:
    """Weighted means of lands, creatures and mana curve over decks of at least min_cards cards."""
    return profile(tally(decks, as_of, bounds, min_cards=min_cards), meta)


def profile(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """A13 from the tally of the decks."""
    q, land = F.col("full_copies"), C.is_land("card_type")
    per = [F.sum(F.when(~land & (C.cmc_bucket("card_cmc") == i), q)).alias(f"c{i}") for i in range(8)]
    total = _of_decks(counts).where("full > 0").select(*GROUP, F.col("full_weight").alias("w"), F.col("full").alias("full_decks"))
    # weighted sums over decks are those over the group's cards
    sums = _of_cards(counts, meta).groupBy(*GROUP).agg(F.sum(F.when(land, q)).alias("lands"), F.sum(F.when(~land & C.is_creature("card_type"), q)).alias("creatures"), *per)
    mean = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.col("w")
    curve = F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(8)]), F.array(*[F.round(mean(f"c{i}"), 1) for i in range(8)]))
    return total.join(sums, GROUP, "left").select(*GROUP, "full_decks", mean("lands").alias("avg_lands"), mean("creatures").alias("avg_creatures"), curve.alias("avg_mana_curve"))


def weighted_frequency(decks: DataFrame, meta: DataFrame, as_of: Column, bounds: tuple[int, int] = (7, 14)) -> DataFrame:
    """Weighted copies of each card per deck, over all decks of the group."""
    return frequency(tally(decks, as_of, bounds), meta)


def frequency(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """A14 from the tally of the decks."""
    total = _of_decks(counts).select(*GROUP, F.col("weight").alias("w"))
    per = _of_cards(counts, meta).groupBy(*GROUP, "card_name").agg(F.sum("copies").alias("s"))
    return per.join(total, GROUP).select(*GROUP, "card_name", F.col("s").alias("weight_sum"), (F.col("s") / F.col("w")).alias("freq"))


def _not_land(df: DataFrame, meta: DataFrame) -> DataFrame:
    kinds = meta.where(~C.is_land("card_type")).select("set_code", "format", "card_name", "alsa", "gih_wr")
    return df.join(kinds, ["set_code", "format", "card_name"])


def pillar_synergy(freq: DataFrame, synergy: DataFrame, n: int = 15) -> DataFrame:
    """Mean synergy of each card with the group's n commonest cards."""
    pillars = top_n(freq, GROUP, [F.desc("freq"), "card_name"], n).select(*GROUP, F.col("card_name").alias("pillar"))
    both = card_partners(synergy.where("synergy_score > 0")).select("set_code", "format", F.col("card_name").alias("pillar"), F.col("partner").alias("card_name"), "synergy_score")
    return pillars.join(both, ["set_code", "format", "pillar"]).groupBy(*GROUP, "card_name").agg(F.avg("synergy_score").alias("syn"))


def candidate_scores(freq: DataFrame, synergy: DataFrame) -> DataFrame:
    """0.8 of the frequency and 0.2 of the synergy, which counts up to 10; to 12 decimals, so that ties are ties."""
    syn = pillar_synergy(freq, synergy)
    out = freq.join(syn, [*GROUP, "card_name"], "left").withColumn("syn", F.coalesce("syn", F.lit(0.0)))
    return out.withColumn("score", F.round(F.lit(0.8) * F.col("freq") + F.lit(0.2) * F.least(F.col("syn") / 10, F.lit(1.0)), 12))


def _means(meta: DataFrame) -> DataFrame:
    wr = F.when(F.coalesce("gih_wr", F.lit(0.0)) != 0, F.col("gih_wr"))
    return meta.groupBy("set_code", "format").agg(F.coalesce(F.avg(wr), F.lit(55.0)).alias("avg_wr"), F.coalesce(F.avg("alsa"), F.lit(4.0)).alias("avg_alsa"))


def sleeper_cards(freq: DataFrame, meta: DataFrame, n: int = 5) -> DataFrame:
    """Non-lands that go late and still are played."""
    rows = _not_land(freq, meta).join(_means(meta), ["set_code", "format"]).where("alsa > avg_alsa and freq >= 0.15")
    rows = rows.withColumn("raw", (F.col("alsa") - F.col("avg_alsa")) * F.col("freq"))
    return top_n(rows, GROUP, [F.desc("raw"), "card_name"], n).select(*GROUP, "rank", "card_name", F.round("alsa", 2).alias("alsa"), F.round(F.col("freq") * 100, 1).alias("frequency"), F.round("raw", 3).alias("score"))


def trending_cards(decks: DataFrame, meta: DataFrame, as_of: Column, days: int = 7, n: int = 5) -> DataFrame:
    """Non-lands whose share of decks has risen lately."""
    return trending(tally(decks, as_of, days=days), meta, n)


def trending(counts: DataFrame, meta: DataFrame, n: int = 5) -> DataFrame:
    """A18 from the tally of the decks."""
    share = lambda r, o: [F.col("recent").alias(r), (F.col("decks") - F.col("recent")).alias(o)]
    sizes = _of_decks(counts).select(*GROUP, *share("nr", "no")).where("nr >= 3 and no >= 3")
    cards = counts.where("card_name is not null").select(*GROUP, "card_name", *share("r", "o"))
    rows = _not_land(cards, meta).join(sizes, GROUP).withColumn("rf", F.try_divide("r", "nr")).withColumn("of", F.try_divide("o", "no")).withColumn("delta_raw", F.col("rf") - F.col("of")).where("delta_raw > 0.15 and rf > 0.20")
    pct = lambda c: F.round(F.col(c) * 100, 1)
    return top_n(rows, GROUP, [F.desc("delta_raw"), "card_name"], n).select(*GROUP, "rank", "card_name", pct("rf").alias("recent_freq"), pct("of").alias("old_freq"), pct("delta_raw").alias("delta"))


def openness(freq: DataFrame, meta: DataFrame) -> DataFrame:
    """How many cards make up 80 % of a group's non-land weight, as a score and label."""
    rows = _not_land(freq, meta)
    part = Window.partitionBy(*GROUP)
    run = part.orderBy(F.desc("weight_sum"), "card_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("total", F.sum("weight_sum").over(part)).withColumn("before", F.sum("weight_sum").over(run) - F.col("weight_sum"))
    out = rows.groupBy(*GROUP).agg(F.count(F.when(F.col("before") < F.lit(0.8) * F.col("total"), 1)).alias("n_cards"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround((F.col("n_cards") - 25) / 45 * 100).cast("int")))
    return out.withColumn("openness_score", score).withColumn("label", F.when(F.col("openness_score") >= 70, "Open").when(F.col("openness_score") >= 40, "Moderate").otherwise("Focused"))


def importance_cards(scores: DataFrame, meta: DataFrame, n: int = 15) -> DataFrame:
    """The cards that matter most by frequency, synergy and rate."""
    rows = _not_land(scores, meta).join(_means(meta), ["set_code", "format"])
    wr = F.when(F.coalesce("gih_wr", F.lit(0.0)) != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("gih_wr") - F.col("avg_wr") + 10) / 20))).otherwise(0.0)
    rows = rows.withColumn("w", wr).withColumn("s", F.least(F.col("syn") / 5, F.lit(1.0)))
    # to 12 decimals, so that ties are ties
    rows = rows.withColumn("imp", F.round(F.lit(0.4) * F.col("freq") + F.lit(0.3) * F.col("s") + F.lit(0.3) * F.col("w"), 12))
    pct = lambda c: C.half_up(F.col(c) * 100, 1)
    return top_n(rows, GROUP, [F.desc("imp"), "card_name"], n).select(*GROUP, "rank", "card_name", pct("imp").alias("importance"), pct("freq").alias("freq_score"), pct("s").alias("synergy_score"), pct("w").alias("wr_score"), pct("freq").alias("frequency"), "gih_wr")


def dictionary_coverage(decks: DataFrame, meta: DataFrame) -> DataFrame:
    """Distinct deck cards of each archetype, and how many of them the dictionary has."""
    cards = decks.select("set_code", "format", "archetype", F.explode(F.map_keys("cardlist")).alias("card_name")).distinct()
    known = meta.select("set_code", "format", "card_name").distinct().withColumn("known", F.lit(1))
    return cards.join(known, ["set_code", "format", "card_name"], "left").groupBy("set_code", "format", "archetype").agg(F.count("*").alias("cards"), F.count("known").alias("found"))


_CARD = "struct<name:string,cmc:double,type:string,cost:string,rarity:string>"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: inside a fold, where there is no other name for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spells(cards: Column, spells: Column, creatures: Column, curve: Column) -> Column:
    """The spells of a deck as a fold over its candidates in score order.

    A kind may go one over its quota, a mana value two over the curve; up to two
    commons of more than one copy a deck go in twice.
    """
    zero = F.struct(
        F.array().cast(f"array<{_CARD}>").alias("deck"), F.lit(0).alias("added"), F.lit(0).alias("creatures"), F.lit(0).alias("others"), F.lit(0).alias("pairs"),
        F.array_repeat(F.lit(0), 8).alias("filled"))

    def step(s: Column, c: Column) -> Column:
        kind, slot = C.is_creature(c["type"]), F.least(F.coalesce(c["cmc"], F.lit(0.0)).cast("int"), F.lit(7))
        room = F.when(kind, creatures + 1 - s["creatures"]).otherwise(spells - creatures + 1 - s["others"])
        want = F.when((c["rarity"] == "common") & (s["pairs"] < 2) & (c["freq"] > 1.0), 2).otherwise(1)
        open_slot = F.get(s["filled"], slot) < F.bround(F.get(curve, slot)).cast("int") + 2
        n = F.when(open_slot, F.greatest(F.least(want, spells - s["added"], room), F.lit(0))).otherwise(0)
        card = F.struct(c["card_name"].alias("name"), slot.cast("double").alias("cmc"), c["type"].alias("type"), c["cost"].alias("cost"), c["rarity"].alias("rarity"))

        def taken(n: Column) -> Column:
            return F.struct(
                F.concat(s["deck"], F.array_repeat(card, n)).alias("deck"), (s["added"] + n).alias("added"), (s["creatures"] + F.when(kind, n).otherwise(0)).alias("creatures"),
                (s["others"] + F.when(kind, 0).otherwise(n)).alias("others"), (s["pairs"] + (n == 2).cast("int")).alias("pairs"),
                F.transform(s["filled"], lambda x, i: x + F.when(i == slot, n).otherwise(0)).alias("filled"))

        return _bound(n, taken)

    return F.aggregate(F.filter(cards, lambda c: ~C.is_land(c["type"])), zero, step, lambda s: s["deck"])


def _basics(spells: Column, need: Column) -> Column:
    """``need`` basic lands in proportion to the mana symbols of the spells, one of each colour's if there are none."""

    def pips(x: str) -> Column:
        sign = F.lit("{%s}" % x)
        return F.aggregate(spells, F.lit(0), lambda n, c: n + ((F.length(c["cost"]) - F.length(F.replace(c["cost"], sign, F.lit("")))) / 3).cast("int"))

    def lands(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0), lambda a, n: a + n)
        share = F.when(total == 0, F.array_repeat(F.lit(1), 5)).otherwise(own)

        def dealt(share: Column) -> Column:
            sum_ = F.aggregate(share, F.lit(0), lambda a, n: a + n)
            names = F.array(*[F.lit(n) for n in C.BASIC_LANDS])
            even = F.flatten(F.zip_with(names, share, lambda name, n: F.array_repeat(name, F.bround(n / sum_ * need).cast("int"))))
            most = F.get(names, (F.array_position(share, F.array_max(share)) - 1).cast("int"))
            return F.slice(F.concat(even, F.array_repeat(most, need)), F.lit(1), need)

        return _bound(share, dealt)

    card = lambda name: F.struct(name.alias("name"), F.lit(0.0).alias("cmc"), F.lit("Basic Land").alias("type"), F.lit("").alias("cost"), F.lit("common").alias("rarity"))
    return F.when(need > 0, F.transform(_bound(F.array(*map(pips, C.WUBRG)), lands), card)).otherwise(F.array().cast(f"array<{_CARD}>"))


def build_skeleton(candidates: DataFrame, profile: DataFrame, meta: DataFrame, size: int = 40) -> DataFrame:
    """M3: one deck list per group of the profile: non-basic lands, spells by score, basic lands.

    The order-dependent choice is a fold over a group's few hundred candidates.
    """
    info = meta.select("set_code", "format", "card_name", "card_cmc", "card_cost", "card_type", "rarity")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    card = F.struct((-F.col("score")).alias("order"), "card_name", F.col("card_cmc").alias("cmc"), text("card_type").alias("type"), text("card_cost").alias("cost"), text("rarity").alias("rarity"), "freq")
    listed = candidates.join(info, ["set_code", "format", "card_name"]).groupBy(*GROUP).agg(F.array_sort(F.collect_list(card)).alias("cards"))
    curve = F.array(*[F.coalesce(F.try_element_at("avg_mana_curve", F.lit(str(i))), F.lit(0.0)) for i in range(8)])
    rows = profile.select(*GROUP, "avg_lands", "avg_creatures", curve.alias("curve")).join(listed, GROUP, "left")
    goal = F.bround("avg_lands").cast("int")
    spells = F.lit(size) - goal
    creatures = F.bround(spells * F.col("avg_creatures") / F.greatest(F.lit(1.0), F.lit(size) - F.col("avg_lands"))).cast("int")
    rows = rows.select(*GROUP, "cards", "curve", goal.alias("goal"), spells.alias("spells"), creatures.alias("creatures"))
    good = F.filter("cards", lambda c: C.is_land(c["type"]) & ~C.is_basic(c["type"]) & (c["freq"] > 0.2))
    land = lambda c: F.struct(c["card_name"].alias("name"), F.lit(0.0).alias("cmc"), c["type"].alias("type"), F.lit("").alias("cost"), c["rarity"].alias("rarity"))
    none = F.array().cast(f"array<{_CARD}>")
    lands = F.coalesce(F.transform(F.slice(good, F.lit(1), F.greatest("goal", F.lit(0))), land), none)
    rows = rows.select(*GROUP, "goal", lands.alias("lands"), F.coalesce(_spells(F.col("cards"), F.col("spells"), F.col("creatures"), F.col("curve")), none).alias("chosen"))
    return rows.select(*GROUP, F.concat("lands", "chosen", _basics(F.col("chosen"), F.col("goal") - F.size("lands"))).alias("deck_list"))


def select_skeletons(skeletons: DataFrame, mode: int | None = None) -> DataFrame:
    """main skeletons by number of colours (1, 2, 3, 4 for more), largest sample first; has_alternative tells of a variant."""
    key = ["set_code", "format", "archetype_name"]
    out = skeletons.withColumn("has_alternative", F.max("is_alternative").over(Window.partitionBy(*key))).where(~F.col("is_alternative"))
    n = F.length(C.extract_colors("archetype_name"))
    if mode:
        out = out.where(n >= 4 if mode >= 4 else n == mode)
    return out.orderBy(F.desc("sample_size"), *key)


def skeleton_summary(skeletons: DataFrame) -> DataFrame:
    """Mean and modal mana value, colour counts of the non-land cards and the highest bucket."""
    key = ["set_code", "format", "archetype_name", "is_alternative"]
    buckets = skeletons.select(*key, F.explode("avg_mana_curve").alias("b", "v")).withColumn("b", F.col("b").cast("int")).where("b >= 1")
    mean = F.when(F.sum("v") > 0, F.sum(F.col("b") * F.col("v")) / F.sum("v")).otherwise(0.0)
    curve = buckets.groupBy(*key).agg(mean.alias("avg_cmc"), F.max_by("b", F.struct("v", -F.col("b"))).alias("modal_bucket"), F.greatest(F.max(F.when(F.col("v") > 0, F.col("b"))), F.lit(5)).alias("top_bucket"))
    cards = skeletons.select(*key, F.explode("deck_list").alias("c")).where(~C.is_land("c.type"))
    colors = cards.groupBy(*key).agg(*[F.count(F.when(C.cost_has_color("c.cost", x), 1)).alias(f"n_{x.lower()}") for x in C.WUBRG])
    return curve.join(colors, key, "left")


def skeleton_stacks(skeletons: DataFrame) -> DataFrame:
    """Copies by mana value, of creatures and of the other spells."""
    key = ["set_code", "format", "archetype_name", "is_alternative"]
    cards = skeletons.select(*key, F.explode("deck_list").alias("c")).where(~C.is_land("c.type"))
    stack = F.when(C.is_creature("c.type") | F.col("c.type").contains("Planeswalker"), "creature").otherwise("other")
    return cards.groupBy(*key, C.cmc_bucket("c.cmc").alias("bucket"), stack.alias("stack"), F.col("c.name").alias("card_name")).agg(F.count("*").alias("copies"))
