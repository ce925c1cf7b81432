"""Whole formats: power distribution, balance, radar and comparisons."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .cards import filter_cards
from .stats import GROUP, format_mean_wr, meta_share

SHORT = {"PremierDraft": "premier", "TradDraft": "trad", "Sealed": "sealed", "ArenaDirect_Sealed": "direct"}
_clamp = lambda c, lo=0.0, hi=10.0: F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def global_cards(card_stats: DataFrame) -> DataFrame:
    """Global rows that have a rate, with rarity code and colour class (a letter, M or C)."""
    key = F.coalesce(C.extract_colors("colors"), F.lit(""))
    kind = F.when(F.length(key) > 1, "M").when(F.length(key) == 0, "C").otherwise(key)
    return card_stats.where("filter_context = 'Global' and coalesce(gih_wr, 0) <> 0").withColumn("rarity_code", C.normalize_rarity("rarity")).withColumn("color_class", kind)


def filter_archetypes(df: DataFrame, mode: str = "All") -> DataFrame:
    """archetypes for the comparison view."""
    n, splash = F.length(C.extract_colors("colors")), F.col("colors").rlike("(?i)splash")
    keep = {"All": (n == 2) | (n == 3) & ~splash, "2color": (n == 2) & ~splash, "splash": (n == 2) & splash, "3color": n == 3}[mode]
    return df.where(keep)


def blueprint_stats(card_stats: DataFrame, archetype_stats: DataFrame, mode: str = "all", rarities: list[str] | None = None, colors: list[str] | None = None) -> DataFrame:
    """Per rarity and per colour class the mean rate, its distance to the format mean and the spread.

    mode: all cards, the ten best or the ten worst of each class; rarities and
    colors restrict the cards.  Both groupings are made in one pass over the
    ranked cards.  ``place`` orders the colour classes of a format by delta.
    """
    card_stats = filter_cards(card_stats, rarities=rarities, colors=colors, mono_only=True)
    g = global_cards(card_stats).select(*GROUP, "card_name", "gih_wr", F.explode(F.array(F.struct(F.lit("rarity").alias("axis"), F.col("rarity_code").alias("value")), F.struct(F.lit("color").alias("axis"), F.col("color_class").alias("value")))).alias("k")).select(*GROUP, "card_name", "gih_wr", "k.*")
    part = Window.partitionBy(*GROUP, "axis", "value")
    g = g.withColumn("best", F.row_number().over(part.orderBy(F.desc("gih_wr"), "card_name"))).withColumn("worst", F.row_number().over(part.orderBy("gih_wr", "card_name")))
    used = {"all": F.lit(True), "top10": F.col("best") <= 10, "bottom10": F.col("worst") <= 10}[mode]
    wr = F.when(used, F.col("gih_wr"))
    sd = F.when(F.count(wr) < 2, 0.0).otherwise(F.coalesce(F.stddev_pop(wr), F.lit(0.0)))
    out = g.groupBy(*GROUP, "axis", "value").agg(F.avg(wr).alias("mean_wr"), sd.alias("sigma"), F.count(wr).alias("cards")).join(format_mean_wr(archetype_stats).withColumnRenamed("mean_wr", "format_wr"), GROUP, "left")
    delta = F.col("mean_wr") - F.coalesce("format_wr", F.lit(55.0))
    label = F.when(F.col("sigma") < 2, "Very consistent").when(F.col("sigma") < 4, "Moderate spread").otherwise("High variance")
    out = out.select(*GROUP, "axis", "value", "cards", "mean_wr", "sigma", delta.alias("delta"), label.alias("consistency"))
    place = F.row_number().over(Window.partitionBy(*GROUP, "axis").orderBy(F.desc("delta"), "value"))
    return out.withColumn("place", F.when(F.col("axis") == "color", place))


def blueprint_lists(card_stats: DataFrame, n: int = 10) -> DataFrame:
    """The n best and the n worst cards of each rarity and of each colour class."""
    g = global_cards(card_stats)
    axes = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(c).alias("value")) for axis, c in (("rarity", "rarity_code"), ("color", "color_class"))])
    g = g.select(*GROUP, "card_name", "gih_wr", F.explode(axes).alias("k")).select(*GROUP, "card_name", "gih_wr", "k.*")
    part = Window.partitionBy(*GROUP, "axis", "value")
    g = g.withColumn("best", F.row_number().over(part.orderBy(F.desc("gih_wr"), "card_name"))).withColumn("worst", F.row_number().over(part.orderBy("gih_wr", "card_name")))
    lists = F.array_compact(F.array(*[F.when(F.col(k) <= n, F.struct(F.lit(k).alias("list"), F.col(k).alias("rank"))) for k in ("best", "worst")]))
    return g.select(*GROUP, "axis", "value", F.explode(lists).alias("l"), "card_name", "gih_wr").select(*GROUP, "axis", "value", "l.list", "l.rank", "card_name", "gih_wr")


def format_spread(card_stats: DataFrame, archetype_stats: DataFrame) -> DataFrame:
    """The overall spread of card rates around the format mean."""
    rows = global_cards(card_stats).join(format_mean_wr(archetype_stats), GROUP)
    return rows.groupBy(*GROUP).agg(F.sqrt(F.avg((F.col("gih_wr") - F.col("mean_wr")) * (F.col("gih_wr") - F.col("mean_wr")))).alias("sigma"), F.count("*").alias("cards"))


def _label(score: Column) -> Column:
    return F.when(score >= 7, "Balanced").when(score >= 5, "Slightly Balanced").when(score >= 4, "Slightly Unbalanced").otherwise("Unbalanced")


def weighted_stddev(value: str, weight: str) -> Column:
    """Population deviation weighted by games; 0 without weight."""
    w, v = F.col(weight), F.col(value)
    mean = F.sum(w * v) / F.sum(w)
    return F.when(F.sum(w) > 0, F.sqrt(F.greatest(F.lit(0.0), F.sum(w * v * v) / F.sum(w) - mean * mean))).otherwise(0.0)


def format_balance(archetype_stats: DataFrame, card_stats: DataFrame) -> DataFrame:
    """Balance scores of archetypes and of colours, 0 to 10."""
    decks = meta_share(archetype_stats).where((F.col("meta_share") >= 0.01) & (F.coalesce("win_rate", F.lit(0.0)) > 0))
    arch = decks.groupBy(*GROUP).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("win_rate")).alias("archetype_stddev"), weighted_stddev("win_rate", "games_count").alias("weighted_stddev"))
    mono = global_cards(card_stats).where(F.col("color_class").isin(*C.WUBRG)).groupBy(*GROUP, "color_class").agg(F.avg("gih_wr").alias("m"))
    color = mono.groupBy(*GROUP).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("m")).alias("color_stddev"))
    score = lambda c, top, width: _clamp(F.floor((top - F.col(c)) / width * 100 + 0.5) / 10)
    out = arch.join(color, GROUP, "full").withColumn("archetype_score", score("archetype_stddev", 3.25, 2.25)).withColumn("color_score", score("color_stddev", 1.75, 1.5))
    return out.select(*GROUP, "archetype_score", "archetype_stddev", "weighted_stddev", "color_score", "color_stddev", _label(F.col("archetype_score")).alias("archetype_label"), _label(F.col("color_score")).alias("color_label"))


def balance_extremes(balance: DataFrame) -> DataFrame:
    """Mean, best and worst set of each score by format; the first set wins ties."""
    rows = balance.select("format", "set_code", F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(f"{n}_score").alias("value")) for n in ("archetype", "color")])).alias("s")).select("format", "set_code", "s.*").where("value is not null")
    hi = F.min_by("set_code", F.struct(-F.col("value"), "set_code"))
    lo = F.min_by("set_code", F.struct("value", "set_code"))
    return rows.groupBy("format", "score").agg(F.avg("value").alias("mean_score"), hi.alias("best_set"), F.max("value").alias("best"), lo.alias("worst_set"), F.min("value").alias("worst"))


def format_radar(card_stats: DataFrame, archetype_stats: DataFrame) -> DataFrame:
    """Five axes from 0 to 10 of how far rare cards carry a format, the area they span and its class."""
    g = global_cards(card_stats).withColumn("class", F.when(F.col("rarity_code").isin("M", "R"), "MR").otherwise(F.col("rarity_code")))
    w = Window.partitionBy(*GROUP, "class").orderBy(F.desc("gih_wr"), "card_name")
    g = g.withColumn("r", F.row_number().over(w)).join(format_mean_wr(archetype_stats), GROUP)
    mean = F.first("mean_wr")
    top = lambda k, n: F.coalesce(F.avg(F.when((F.col("class") == k) & (F.col("r") <= n), F.col("gih_wr"))), mean)
    low = F.col("class").isin("C", "U")
    bad = F.coalesce(F.sum(F.when(low & (F.col("gih_wr") < F.col("mean_wr") - 2), 1)) / F.nullif(F.count(F.when(low, 1)), F.lit(0)), F.lit(0.0))
    m = g.groupBy(*GROUP).agg(mean.alias("mean_wr"), top("MR", 15).alias("mr15"), top("C", 10).alias("c10"), top("U", 10).alias("u10"), top("MR", 20).alias("mr20"), bad.alias("bad"))
    x = F.col
    axes = {
        "bombs": (x("mr15") / x("mean_wr") - 1) * 50, "commons": (1.15 - x("c10") / x("mean_wr")) * 60, "uncommons": (1.15 - x("u10") / x("mean_wr")) * 60,
        "gap": (x("mr20") / ((x("c10") + x("u10")) / 2) - 1) * 60, "filler": x("bad") * 20,
    }
    m = m.select(*GROUP, *[_clamp(v).alias(k) for k, v in axes.items()])
    r = [x(k) for k in axes]
    m = m.withColumn("area", F.lit(0.475) * sum((r[i] * r[(i + 1) % 5] for i in range(1, 5)), r[0] * r[1]))
    kind = F.when(x("area") >= 90, "PRINCE").when(x("area") >= 60, "BALANCED").otherwise("PAUPER")
    lean = F.when((x("area") >= 80) & (x("area") < 90), "leaning prince").when((x("area") >= 60) & (x("area") < 70), "leaning pauper").otherwise("")
    return m.withColumn("percent", x("area") / 237.5 * 100).withColumn("kind", kind).withColumn("leaning", lean)


def compare_formats_radar(radar: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Two (set, format) pairs side by side on each axis."""
    axes = ("bombs", "commons", "uncommons", "gap", "filler")
    long = radar.select(*GROUP, F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).alias("value")) for k in axes])).alias("s")).select(*GROUP, "s.*")
    one = lambda k, n: long.where((F.col("set_code") == k[0]) & (F.col("format") == k[1])).select("axis", F.col("value").alias(n))
    return one(a, "a").join(one(b, "b"), "axis").withColumn("delta", F.col("a") - F.col("b"))


def card_format_pivot(card_stats: DataFrame, archetype_stats: DataFrame) -> DataFrame:
    """One row per card with its rate and distance to the mean in each format."""
    rows = card_stats.where("filter_context = 'Global'").join(format_mean_wr(archetype_stats), GROUP, "left")
    aggs = []
    for f, s in SHORT.items():
        wr = F.max(F.when(F.col("format") == f, F.col("gih_wr")))
        aggs += [wr.alias(f"card_wr_{s}"), F.max(F.when(F.col("format") == f, F.col("gih_wr") - F.col("mean_wr"))).alias(f"card_delta_{s}")]
    return rows.groupBy("set_code", "card_name").agg(*aggs)


def archetype_format_pivot(archetype_stats: DataFrame) -> DataFrame:
    """One row per archetype with its rate, distance to the mean and share of games in each format."""
    rows = meta_share(archetype_stats).join(format_mean_wr(archetype_stats), GROUP, "left")
    aggs = []
    for f, s in SHORT.items():
        here = F.col("format") == f
        aggs += [F.max(F.when(here, F.col("win_rate"))).alias(f"arch_wr_{s}"), F.max(F.when(here, F.col("win_rate") - F.col("mean_wr"))).alias(f"arch_delta_{s}"), F.max(F.when(here, F.col("meta_share"))).alias(f"meta_share_{s}")]
    return rows.groupBy("set_code", "archetype_name", "colors").agg(*aggs)


def compare_formats(pivot: DataFrame, a: str, b: str, mode: str = "cards", metric: str = "winrate", descending: bool = True) -> DataFrame:
    """Rows that both formats have, with the difference, sorted by it."""
    stem = "card_wr" if mode == "cards" else "arch_wr" if metric == "winrate" else "meta_share"
    name = "card_name" if mode == "cards" else "archetype_name"
    x, y = F.col(f"{stem}_{a}"), F.col(f"{stem}_{b}")
    rows = pivot.where(x.isNotNull() & y.isNotNull()).select("set_code", name, x.alias("value_a"), y.alias("value_b"), (x - y).alias("diff"))
    return rows.orderBy(F.desc("diff") if descending else F.asc("diff"), "set_code", name)


