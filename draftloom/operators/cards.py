"""Cards: filters, joins with archetypes, ranks among peers and evaluations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .stats import GROUP, format_mean_wr, real_archetypes

_num = lambda c: F.coalesce(F.col(c), F.lit(0.0))  # noqa: E731  zero counts as missing
sealed = lambda c="format": F.lower(F.col(c)).contains("sealed")


def _color_terms(colors: list[str], mono_only: bool) -> Column:
    key = F.coalesce(C.extract_colors("colors"), F.lit(""))
    n = F.length(key)
    terms = [n > 1 if c == "M" else n == 0 if c == "C" else key.contains(c) & ((n == 1) | F.lit(not mono_only)) for c in colors]
    return reduce(lambda a, b: a | b, terms)


def filter_cards(df: DataFrame, search: str = "", rarities: list[str] | None = None, colors: list[str] | None = None, mono_only: bool = False) -> DataFrame:
    """name contains, rarity in, any colour term holds (M: several colours, C: none, a letter: has it)."""
    out = df.where(F.lower("card_name").contains(search.lower())) if search else df
    if rarities:
        out = out.where(C.normalize_rarity("rarity").isin(*rarities))
    return out.where(_color_terms(colors, mono_only)) if colors else out


def suggest_cards(df: DataFrame, text: str, n: int = 8) -> DataFrame:
    """the first n card names that contain a text of at least two characters."""
    if len(text) < 2:
        return df.select("card_name").limit(0)
    return df.where(F.lower("card_name").contains(text.lower())).select("card_name").distinct().orderBy("card_name").limit(n)


def card_meta(card_list: DataFrame, card_stats: DataFrame) -> DataFrame:
    """Card metadata with the Global rate and ALSA of each format.

    The dictionary of a set has one row per card; Spark broadcasts it if it is small.
    """
    stats = card_stats.where("filter_context = 'Global'").select("set_code", "format", "card_name", "gih_wr", "alsa")
    formats = card_stats.select("set_code", "format").distinct()
    return card_list.join(formats, "set_code").join(stats, ["set_code", "format", "card_name"], "left")


def archetype_cards(card_stats: DataFrame) -> DataFrame:
    """Cards of every context of at most three colours with their Global rate; rank by rate, missing ones last."""
    keyed = card_stats.where("filter_context <> 'Global'").withColumn("colors_key", C.colors_key("filter_context")).where(F.length("colors_key") <= 3)
    world = card_stats.where("filter_context = 'Global'").select("set_code", "format", "card_name", F.col("gih_wr").alias("global_wr"))
    rows = keyed.join(world, ["set_code", "format", "card_name"], "left")
    w = Window.partitionBy(*GROUP, "colors_key").orderBy(_num("gih_wr").desc(), "card_name")
    return rows.withColumn("rank", F.row_number().over(w))


def card_cross_performance(card_stats: DataFrame, archetype_stats: DataFrame, min_games: int = 500, min_games_sealed: int = 10) -> DataFrame:
    """Each card in each archetype beside the archetype's and the card's own average."""
    best = Window.partitionBy(*GROUP, "key").orderBy(F.desc("win_rate"), "archetype_name")
    decks = real_archetypes(archetype_stats).withColumn("key", C.colors_key(C.extract_colors("colors"))).where("key is not null")
    decks = decks.withColumn("r", F.row_number().over(best)).where("r = 1").select(*GROUP, "key", F.col("archetype_name").alias("deck"), F.col("win_rate").alias("wr"), C.deck_type("colors").alias("kind"))
    world = card_stats.where("filter_context = 'Global'").select(*GROUP, "card_name", F.nullif("gih_wr", F.lit(0.0)).alias("g"))
    rows = card_stats.where((F.col("filter_context") != "Global") & (_num("gih_wr") != 0) & (F.col("img_count") >= F.when(sealed(), min_games_sealed).otherwise(min_games)))
    rows = rows.withColumn("key", C.colors_key("filter_context")).join(decks, [*GROUP, "key"], "left").join(world, [*GROUP, "card_name"], "left")
    rows = rows.where(F.when(F.col("deck").isNotNull(), F.col("kind").isin("Two colors", "Three colors")).otherwise(F.length("filter_context").isin(2, 3)))
    rows = rows.select(
        *GROUP, "card_name", F.coalesce("deck", F.concat("filter_context", F.lit(" Deck"))).alias("deck_name"), F.col("filter_context").alias("deck_colors"),
        F.coalesce("wr", F.lit(55.0)).alias("deck_wr"), F.col("gih_wr").alias("card_wr"), F.coalesce("g", F.lit(55.0)).alias("avg_card_wr"))
    once = Window.partitionBy(*GROUP, "card_name", "deck_name").orderBy("deck_colors")
    out = rows.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    return out.withColumn("diff", F.col("card_wr") - F.col("deck_wr")).withColumn("grade", C.card_grade("card_wr", "deck_wr"))


def archetype_grid(archetype_stats: DataFrame, kind: str = "Two colors") -> DataFrame:
    """All ten pairs or trios of every format, zero where nobody played them."""
    codes = C.PAIRS if kind.startswith("Two") else C.TRIOS
    template = archetype_stats.select(*GROUP).distinct().withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes]))).withColumn("key", C.colors_key("code"))
    own = real_archetypes(archetype_stats).where(C.deck_type("colors") == kind).withColumn("key", C.colors_key("colors"))
    first = Window.partitionBy(*GROUP, "key").orderBy(F.desc("win_rate"), "archetype_name")
    own = own.withColumn("r", F.row_number().over(first)).where("r = 1").select(*GROUP, "key", "archetype_name", "win_rate", "games_count")
    return template.join(own, [*GROUP, "key"], "left").select(
        *GROUP, "code", F.coalesce("archetype_name", "code").alias("archetype_name"), F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"), F.coalesce("games_count", F.lit(0)).alias("games_count"))


def enrich_cards(card_stats: DataFrame, cards: DataFrame) -> DataFrame:
    """card_stats with cost, type and mana value from the dictionary."""
    meta = cards.select(F.col("name").alias("card_name"), "card_cmc", "card_cost", "card_type").dropDuplicates(["card_name"])
    return card_stats.join(meta, "card_name", "left")


def unmatched_names(card_stats: DataFrame, cards: DataFrame) -> DataFrame:
    """Card names that the dictionary lacks."""
    return card_stats.select("card_name").distinct().join(cards.select(F.col("name").alias("card_name")), "card_name", "left_anti")


_SHORT = 12  # names below this length are looked up by what is left after deletions, longer ones by pieces


def _deletions(name: Column, most: int) -> Column:
    """name, and what is left of it after up to ``most`` characters are taken out."""
    out = level = F.array(name)
    for _ in range(most):
        shorter = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda s: F.length(s) > 0), shorter)))
        out = F.array_distinct(F.concat(out, level))
    return out


def near_names(queries: DataFrame, names: DataFrame, max_dist: int = 2) -> DataFrame:
    """(query, name, dist): all names within max_dist edits of a query, upper and lower case alike.

    Two names within k edits have something in common that is left of both after k
    deletions; that is the key for short names.  A longer one is cut in k + 1 pieces,
    of which one is left whole and has moved by k places at most, so it is looked up by
    pieces of about their place.  Both ways miss nothing; the distance decides.
    """
    q = queries.select("query", F.lower("query").alias("q_low")).distinct()
    d = names.select("name", F.lower("name").alias("n_low")).distinct().withColumn("n", F.length("n_low"))
    few = d.where(F.col("n") < _SHORT).select("name", "n_low", F.explode(_deletions(F.col("n_low"), max_dist)).alias("key"))
    asked = q.where(F.length("q_low") < _SHORT + max_dist).select("query", "q_low", F.explode(_deletions(F.col("q_low"), max_dist)).alias("key"))
    short = asked.join(few, "key").select("query", "name", "q_low", "n_low")

    parts = max_dist + 1
    cut = lambda n, i: F.floor(n * i / parts).cast("int")
    numbered = F.explode(F.sequence(F.lit(0), F.lit(max_dist))).alias("i")
    at, size = cut(F.col("n"), F.col("i")), cut(F.col("n"), F.col("i") + 1) - cut(F.col("n"), F.col("i"))
    own = d.where(F.col("n") >= _SHORT).select("name", "n_low", "n", numbered).select("name", "n_low", "n", "i", F.substring("n_low", at + 1, size).alias("piece"))
    lengths = F.sequence(F.greatest(F.length("q_low") - max_dist, F.lit(_SHORT)), F.length("q_low") + max_dist)
    tried = q.where(F.length("q_low") + max_dist >= _SHORT).select("query", "q_low", F.explode(lengths).alias("n"))
    tried = tried.select("query", "q_low", "n", numbered).select("query", "q_low", "n", "i", F.explode(F.sequence(F.lit(-max_dist), F.lit(max_dist))).alias("moved"))
    at = at + F.col("moved")
    tried = tried.where(at >= 0).select("query", "q_low", "n", "i", F.substring("q_low", at + 1, size).alias("piece")).distinct()
    long = tried.join(own, ["n", "i", "piece"]).select("query", "name", "q_low", "n_low")
    near = short.unionByName(long).distinct()
    return near.withColumn("dist", F.levenshtein("q_low", "n_low", max_dist)).where("dist >= 0").select("query", "name", "dist")


def resolve_names(names: DataFrame, dictionary: DataFrame, max_dist: int = 2, elsewhere: DataFrame | None = None) -> DataFrame:
    """(query, name, tier): exact, then by the front face, then so in the dictionary of other sets, then the nearest within max_dist edits.

    A name ``A // B`` answers to ``A``, and ``A // B`` finds ``A``.  The nearest name
    comes from both dictionaries; of equally near ones the first by name.
    """
    q = names.select("query").distinct()
    face = lambda c: F.split_part(c, F.lit(" // "), F.lit(1))

    def looked_up(left: DataFrame, d: DataFrame, exact: str, front: str) -> DataFrame:
        d = d.select("name").distinct()
        same = left.join(d, left["query"] == d["name"]).select("query", "name", F.lit(0).alias("t"), F.lit(exact).alias("tier"))
        by_front = left.withColumn("face", face("query")).join(d, F.col("face") == d["name"]).select("query", "name", F.lit(1).alias("t"), F.lit(front).alias("tier"))
        fronts = d.where(F.col("name").contains(" // ")).withColumn("face", face("name"))
        of_front = left.join(fronts, left["query"] == fronts["face"]).select("query", "name", F.lit(2).alias("t"), F.lit(front).alias("tier"))
        best = Window.partitionBy("query").orderBy("t", "name")
        return same.unionByName(by_front).unionByName(of_front).withColumn("r", F.row_number().over(best)).where("r = 1").select("query", "name", "tier")

    found = looked_up(q, dictionary, "exact", "front")
    left = q.join(found.select("query"), "query", "left_anti")
    pool = dictionary.select("name")
    if elsewhere is not None:
        other = looked_up(left, elsewhere, "elsewhere", "elsewhere")
        left = left.join(other.select("query"), "query", "left_anti")
        found, pool = found.unionByName(other), pool.unionByName(elsewhere.select("name"))
    w = Window.partitionBy("query").orderBy("dist", "name")
    fuzzy = near_names(left, pool, max_dist).withColumn("r", F.row_number().over(w)).where("r = 1").select("query", "name", F.lit("fuzzy").alias("tier"))
    return found.unionByName(fuzzy)


def _grams(k: Column, n: int) -> Column:
    """The distinct runs of n characters of k."""
    every = F.transform(F.sequence(F.lit(1), F.length(k) - n + 1), lambda i: F.substring(k, i, F.lit(n)))
    return F.when(F.length(k) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contained(short: DataFrame, long: DataFrame, n: int = 3) -> DataFrame:
    """(a, b): keys ``a`` of short, of n characters at least, and the keys ``b`` of long that they stand in.

    The grams of the long keys are an index; a short key is looked up by that one of
    its grams which the fewest of them have, and not at all if one is missing.
    """
    index = long.select("b", F.explode(_grams(F.col("b"), n)).alias("g"))
    common = index.groupBy("g").agg(F.count("*").alias("df"))
    own = short.where(F.length("a") >= n).select("a", F.explode(_grams(F.col("a"), n)).alias("g")).join(common, "g", "left")
    rarest = own.groupBy("a").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("m")).where("m.df > 0").select("a", F.col("m.g").alias("g"))
    return rarest.join(index, "g").where(F.contains("b", "a")).select("a", "b")


def match_names_normalized(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query, name): equal when reduced to letters and digits; else one contains the other; the first by name.

    Only what the equi-join leaves over is compared by containment, names of three
    characters and more by their rarest three (``contained``).  Of one or two characters
    there are few different names: for these the first name of each is aggregated.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    q = a.select("query").distinct().withColumn("k", norm("query")).where("k <> ''")
    d = b.select("name").distinct().withColumn("k", norm("name")).where("k <> ''")
    exact = q.join(d, "k").groupBy("query").agg(F.min("name").alias("name"))
    rest = q.join(exact.select("query"), "query", "left_anti")
    keys, asked = d.groupBy(F.col("k").alias("b")).agg(F.min("name").alias("name")), rest.select("k").distinct()
    pairs = lambda x, y: contained(x.select(F.col(x.columns[0]).alias("a")), y.select(F.col(y.columns[0]).alias("b")))
    inside = pairs(asked, keys).join(keys, "b").groupBy(F.col("a").alias("k")).agg(F.min("name").alias("name"))
    around = pairs(keys, asked).select(F.col("a"), F.col("b").alias("k")).join(keys.withColumnRenamed("b", "a"), "a").groupBy("k").agg(F.min("name").alias("name"))
    small = lambda c: F.concat(_grams(c, 1), _grams(c, 2))
    firsts = keys.select("name", F.explode(small(F.col("b"))).alias("k")).groupBy("k").agg(F.min("name").alias("name"))
    tiny_queries = asked.where(F.length("k") <= 2).join(firsts, "k").select("k", "name")
    tiny_names = asked.select("k", F.explode(small(F.col("k"))).alias("b")).join(keys.where(F.length("b") <= 2), "b").groupBy("k").agg(F.min("name").alias("name"))
    best = inside.unionByName(around).unionByName(tiny_queries).unionByName(tiny_names).groupBy("k").agg(F.min("name").alias("name"))
    return exact.unionByName(rest.join(best, "k").select("query", "name"))


def apply_arena_ids(card_list: DataFrame, ratings: DataFrame) -> DataFrame:
    """Client ids set by (card, set) where the feed has them."""
    ids = ratings.where("name is not null and coalesce(mtga_id, 0) <> 0").groupBy("set_code", F.col("name").alias("card_name")).agg(F.max("mtga_id").alias("new_id"))
    out = card_list.join(ids, ["set_code", "card_name"], "left")
    return out.select(*[F.coalesce("new_id", "arena_id").alias(c) if c == "arena_id" else F.col(c) for c in card_list.columns])


def card_peers(card_stats: DataFrame) -> DataFrame:
    """How many Global cards share the rarity, and the rarity and colours (none for colourless cards)."""
    g = card_stats.where("filter_context = 'Global'").withColumn("rarity_code", C.normalize_rarity("rarity")).withColumn("key", C.colors_key("colors"))
    n = lambda *k: F.count("*").over(Window.partitionBy(*GROUP, *k))
    return g.select(*GROUP, "card_name", "rarity_code", n("rarity_code").alias("rarity_peers"), F.when(F.col("key").isNotNull(), n("rarity_code", "key")).otherwise(0).alias("color_peers"))


def peer_ranks(card_stats: DataFrame) -> DataFrame:
    """Ranks by rate and by ALSA among cards of the rarity, and of the rarity and colours."""
    g = card_stats.where("filter_context = 'Global'").withColumn("rarity_code", C.normalize_rarity("rarity")).withColumn("key", C.colors_key("colors"))
    out = g
    for name, part in (("rarity", ["rarity_code"]), ("color", ["rarity_code", "key"])):
        for metric, order in (("gih_wr", F.desc_nulls_last("gih_wr")), ("alsa", F.asc_nulls_last("alsa"))):
            w = Window.partitionBy(*GROUP, *part)
            usable = F.col(metric).isNotNull() & (F.lit(True) if name == "rarity" else F.col("key").isNotNull())
            out = out.withColumn(f"{name}_{metric}_rank", F.when(usable, F.row_number().over(w.orderBy(order, "card_name"))))
            out = out.withColumn(f"{name}_{metric}_total", F.when(usable, F.count(metric).over(w)))
    rank, total = F.col("rarity_gih_wr_rank"), F.col("rarity_gih_wr_total")
    bar = F.greatest(F.lit(5.0), F.least(F.lit(100.0), (total - rank) / total * 100))
    mark = F.when(rank <= F.ceil(total * 0.15), "top").when(rank >= F.floor(total * 0.85), "bad").otherwise("mid")
    ranks = [c for c in out.columns if c.endswith(("_rank", "_total"))]
    return out.select(*GROUP, "card_name", *ranks, F.when(rank.isNotNull(), bar).alias("bar"), F.when(rank.isNotNull(), mark).alias("mark"))


def top_quarter_threshold(cards: DataFrame, by: list[str]) -> DataFrame:
    """The rate at position floor(n/4) of the rates in falling order."""
    w = Window.partitionBy(*by)
    rows = cards.where("gih_wr is not null").withColumn("r", F.row_number().over(w.orderBy(F.desc("gih_wr"), "card_name"))).withColumn("n", F.count("*").over(w))
    found = rows.where("r = floor(n * 0.25) + 1").select(*by, F.col("gih_wr").alias("threshold"))
    return cards.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("threshold", F.lit(100.0)).alias("threshold"))


_SORTS = {"name": "card_name", "gih_wr": "gih_wr", "alsa": "alsa"}


def sort_cards(df: DataFrame, key: str = "gih_wr", descending: bool = True, page: int = 0, size: int = 40) -> DataFrame:
    """One page of cards; rows without the value come last both ways."""
    c = C.history_trend("win_rate_history")["delta"] if key == "trend" else F.col(_SORTS[key])
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "card_name").offset(page * size).limit(size)


def archetype_dashboard(card_stats: DataFrame, archetype_stats: DataFrame, kinds: tuple[str, ...] = ("Two colors", "Three colors", "Mono-color")) -> DataFrame:
    """(section, rank, card) of every archetype: best commons and uncommons, best card, gems and traps.

    All ranks are window columns over the archetype's cards, dealt out once; the sections are unfolded from them.
    """
    decks = real_archetypes(archetype_stats).where(C.deck_type("colors").isin(*kinds)).select(*GROUP, "archetype_name", C.colors_key("colors").alias("colors_key"), F.col("win_rate").alias("deck_wr"))
    cards = archetype_cards(card_stats).drop("rank")
    quarter = Window.partitionBy(*GROUP, "colors_key")
    cards = cards.withColumn("r", F.row_number().over(quarter.orderBy(F.desc_nulls_last("gih_wr"), "card_name"))).withColumn("n", F.count("gih_wr").over(quarter))
    cards = cards.withColumn("threshold", F.coalesce(F.max(F.when(F.col("r") == F.floor(F.col("n") * 0.25) + 1, F.col("gih_wr"))).over(quarter), F.lit(100.0)))
    rows = decks.join(cards, [*GROUP, "colors_key"]).join(format_mean_wr(archetype_stats), GROUP).withColumn("rarity_code", C.normalize_rarity("rarity"))
    part = [*GROUP, "archetype_name"]
    wr, world, deck, mean = F.col("gih_wr"), F.col("global_wr"), F.col("deck_wr"), F.col("mean_wr")
    has = _num("gih_wr") != 0
    rank = lambda flag, *order: F.when(flag, F.row_number().over(Window.partitionBy(*part, flag).orderBy(*order, "card_name")))
    rows = rows.repartition(*part)
    for code in "CU":
        rows = rows.withColumn(f"top{code}", rank(has & (F.col("rarity_code") == code), F.desc("gih_wr")))
    top = F.coalesce((F.col("topC") <= 5) | (F.col("topU") <= 5), F.col("topC") <= 5, F.col("topU") <= 5, F.lit(False))
    rated = has & (_num("global_wr") != 0)
    gem = rated & (wr >= mean) & (sealed() | (_num("alsa") > 4)) & (wr > world + 1) & F.when(sealed(), wr > deck).otherwise(wr > deck - 1) & ~top
    own = F.forall(C.letters_of("colors"), lambda c: F.col("colors_key").contains(c))
    trap = rated & own & (wr < F.col("threshold")) & (wr <= mean + 4) & (sealed() | ((_num("alsa") != 0) & (F.col("alsa") <= 4))) & (wr < world - 1) & F.when(sealed(), wr < deck).otherwise(wr < deck + 0.5)
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumn("best", rank(top, F.when(F.col("rarity_code") == "C", 0).otherwise(1), F.desc("gih_wr")))
    rows = rows.withColumn("gem", rank(sure(gem), (wr - world).desc())).withColumn("trap", rank(sure(trap), "gih_wr"))
    sections = (("commons", "topC", 5), ("uncommons", "topU", 5), ("best", "best", 1), ("gems", "gem", 5), ("traps", "trap", 5))
    found = F.array(*[F.when(F.col(c) <= n, F.struct(F.lit(name).alias("section"), F.col(c).alias("rank"))) for name, c, n in sections])
    return rows.select(*part, F.explode(F.array_compact(found)).alias("s"), "card_name", "gih_wr").select(*part, "s.section", "s.rank", "card_name", "gih_wr")


# fixed values: labels by rate row and ALSA column
_GRID = (
    ("Bomb", "Underrated Bomb", "Absolute Gem", "Absolute Gem"),
    ("Top Tier", "Underrated Top Tier", "Underrated Gem", "Underrated Gem"),
    ("Overrated Top Tier", "Good Pick", "Gem", "Good Filler"),
    ("Overhyped Trap", "Bait", "Mediocre", "Filler"),
    ("Overhyped Trap", "Bait", "Chaff", "Unplayable"),
)
_TIERS = ((9, "Bomb"), (7, "Top Tier"), (5, "Very Good"), (3, "Good"), (1, "Solid Playable"), (-1, "Playable"), (-3, "Filler"), (-5, "Bad"))


def evaluate_cards(card_stats: DataFrame, archetype_stats: DataFrame) -> DataFrame:
    """The status of each Global card by its rate and, where it has one, its ALSA.

    The centre is the format's rate of all decks, not the mean of its cards.
    """
    g = card_stats.where("filter_context = 'Global'")
    bounds = g.where("gih_wr is not null or alsa is not null").groupBy(*GROUP).agg(
        F.coalesce(F.min("gih_wr"), F.lit(45.0)).alias("min_wr"), F.coalesce(F.max("gih_wr"), F.lit(70.0)).alias("max_wr"), F.coalesce(F.avg("alsa"), F.lit(4.5)).alias("avg_alsa"))
    rows = g.where(_num("gih_wr") != 0).join(bounds, GROUP).join(format_mean_wr(archetype_stats), GROUP, "left").withColumn("avg_wr", F.coalesce("mean_wr", F.lit(55.0)))
    wr, avg, alsa, a = F.col("gih_wr"), F.col("avg_wr"), F.col("alsa"), F.col("avg_alsa")
    lo, hi = F.floor(F.col("min_wr") - 1), F.ceil(F.col("max_wr") + 1)
    col = F.when(alsa < (1.25 + a) / 2, 0).when(alsa < a, 1).when(alsa < (a + 8.75) / 2, 2).otherwise(3)
    row = F.when(wr >= avg + (hi - avg) * 2 / 3, 0).when(wr >= avg + (hi - avg) / 3, 1).when(wr >= avg, 2).when(wr >= avg - (avg - lo) / 2, 3).otherwise(4)
    grid = F.get(F.get(F.array(*[F.array(*[F.lit(x) for x in r]) for r in _GRID]), row), col)
    grid = F.when((grid == "Overrated Top Tier") & (alsa >= 2), "Top Tier").otherwise(grid)
    with_alsa = F.when(wr >= F.col("max_wr") - 4, "Bomb").when((F.abs(wr - avg) <= 0.5) & col.isin(1, 2), "Playable").otherwise(grid)
    plain = F.lit("Chaff")
    for edge, name in reversed(_TIERS):
        plain = F.when(wr - avg >= edge, name).otherwise(plain)
    return rows.select(*GROUP, "card_name", "gih_wr", "alsa", F.when(_num("alsa") != 0, with_alsa).otherwise(plain).alias("status"))


def matrix_quadrants(card_stats: DataFrame, archetype_stats: DataFrame) -> DataFrame:
    """T4: quadrant of each card in each context, around the archetype's rate and the mean ALSA.

    Contexts without a matching archetype, Global among them, have the format's rate as centre.
    """
    best = Window.partitionBy(*GROUP, "key").orderBy(F.desc("win_rate"), "archetype_name")
    decks = real_archetypes(archetype_stats).withColumn("key", C.colors_key("colors")).where("key is not null").withColumn("r", F.row_number().over(best)).where("r = 1").select(*GROUP, "key", F.col("win_rate").alias("deck_wr"))
    rated = card_stats.where("gih_wr is not null").withColumn("key", F.when(F.col("filter_context") != "Global", C.colors_key("filter_context")))
    alsa = F.coalesce(F.avg("alsa").over(Window.partitionBy(*GROUP, "filter_context")), F.lit(4.5))
    rows = rated.withColumn("mean_alsa", alsa).where((_num("gih_wr") != 0) & (_num("alsa") != 0))
    rows = rows.join(decks, [*GROUP, "key"], "left").join(format_mean_wr(archetype_stats), GROUP, "left")
    good, late = F.col("gih_wr") >= F.coalesce("deck_wr", "mean_wr", F.lit(55.0)), F.col("alsa") >= F.col("mean_alsa")
    kind = F.when(good & ~late, "Top tier").when(good, "Gem").when(~late, "Overrated").otherwise("Chaff")
    return rows.select(*GROUP, "filter_context", "card_name", kind.alias("quadrant"))
