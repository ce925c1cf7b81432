"""Scalar functions of the domain, as Column expressions (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: colour letters in their canonical order, basic lands, aggregate archetype names
WUBRG = "WUBRG"
BASIC_LANDS = ("Plains", "Island", "Swamp", "Mountain", "Forest")
AGGREGATE_ARCHETYPES = ("All Decks", "Mono-color", "Mono-color + Splash", "Two-color", "Two-color + Splash", "Three-color", "Three-color + Splash")
FORMATS = ("PremierDraft", "TradDraft", "Sealed", "ArenaDirect_Sealed")
PAIRS = ("WU", "UB", "BR", "RG", "WG", "WB", "UR", "BG", "WR", "UG")
TRIOS = ("WUB", "WUR", "WUG", "WBR", "WBG", "WRG", "UBR", "UBG", "URG", "BRG")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank(col: Column | str) -> Column:
    """Null or empty."""
    c = _c(col)
    return c.isNull() | (c == "")


def letters_of(col: Column | str) -> Column:
    """Array of the colour letters in their order of appearance."""
    return F.regexp_extract_all(_c(col), F.lit("[WUBRG]"), 0)


def clean_color_code(col: Column | str) -> Column:
    """Colour code of an archetype name: distinct letters in alphabetical order, plus the splash mark."""
    c = _c(col)
    inner = F.regexp_extract(c, r"\(([WUBRG]+)\)", 1)
    letters = F.array_join(F.array_sort(F.array_distinct(letters_of(F.when(inner != "", inner).otherwise(c)))), "")
    suffix = F.when(c.contains("Splash"), " + Splash").otherwise("")
    bare = F.trim(F.replace(F.replace(c, F.lit(" + Splash"), F.lit("")), F.lit(" (Splash)"), F.lit("")))
    return F.when(blank(c), "Unknown").when(letters == "", F.concat(bare, suffix)).otherwise(F.concat(letters, suffix))


def extract_colors(col: Column | str) -> Column:
    """Colour letters only, order and repeats kept."""
    return F.regexp_replace(F.replace(_c(col), F.lit(" + Splash"), F.lit("")), "[^WUBRG]", "")


def colors_key(col: Column | str) -> Column:
    """Order-free key of a colour code; null for a null or empty code, so that it equals nothing."""
    return F.when(~blank(col), F.array_join(F.array_sort(letters_of(col)), ""))


def colors_equal(a: Column | str, b: Column | str) -> Column:
    """Same colours in any order; false if either side is null or empty."""
    return F.coalesce(colors_key(a) == colors_key(b), F.lit(False))


def sort_wubrg(col: Column | str, distinct: bool = False) -> Column:
    """Letters in canonical order."""
    digits = F.split(F.translate(F.regexp_replace(_c(col), "[^WUBRG]", ""), WUBRG, "12345"), "")
    return F.translate(F.array_join(F.array_sort(F.array_distinct(digits) if distinct else digits), ""), "12345", WUBRG)


def normalize_archetype_name(col: Column | str) -> Column:
    """P5: the colours of 'Name (XY)suffix', 'XY + Splash' and bare codes put in canonical order."""
    c = _c(col)
    parts = r"^(.+?)\s*\(([WUBRG]+)\)(.*)$"
    named = F.concat(F.trim(F.regexp_extract(c, parts, 1)), F.lit(" ("), sort_wubrg(F.regexp_extract(c, parts, 2)), F.lit(")"), F.regexp_extract(c, parts, 3))
    splash = r"(?i)^([WUBRG]+)\s*\+\s*Splash$"
    marked = F.concat(sort_wubrg(F.regexp_extract(c, splash, 1)), F.lit(" + Splash"))
    return F.when(c.rlike(parts), named).when(c.rlike(splash), marked).when(F.trim(c).rlike("^[WUBRG]{2,5}$"), sort_wubrg(c)).otherwise(c)


def archetype_acronym(col: Column | str) -> Column:
    """Colours (of the brackets, else of the whole name) in canonical order, '+' for a splash."""
    c = _c(col)
    inner = F.regexp_extract(c, r"\(([WUBRG]+)\)", 1)
    return F.concat(sort_wubrg(F.when(inner != "", inner).otherwise(extract_colors(c))), F.when(c.rlike("(?i)splash"), "+").otherwise(""))


def normalize_rarity(col: Column | str) -> Column:
    """M, R, U or C; C for anything else."""
    first = F.upper(F.substring(_c(col), 1, 1))
    return F.when(first.isin("M", "R", "U", "C"), first).otherwise("C")


def safe_rate(col: Column | str, percentage: bool = True) -> Column:
    """A finite double or null; as a percentage, values in [0, 1] are shares."""
    v = _c(col).try_cast("double")
    ok = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return F.when((ok >= 0) & (ok <= 1), ok * 100).otherwise(ok) if percentage else ok


def parse_utc(col: Column | str) -> Column:
    """ISO time with Z, an offset or none (UTC); null if empty or bad.  Needs a session in UTC."""
    return F.try_to_timestamp(F.nullif(F.trim(_c(col)), F.lit("")))


def half_up(col: Column | str, n: int) -> Column:
    """col (not negative) to n decimals, halves up; what is within 0.0000005 of a half in the last place is one, so that the order of a sum does not decide."""
    return F.floor(F.round(_c(col) * 10.0**n, 6) + 0.5) / 10.0**n


def recency_weight(ts: Column | str, as_of: Column, bounds: tuple[int, int] = (7, 14)) -> Column:
    """P10: 1.0, 0.75 or 0.5 by age in whole days; unknown times weigh 0.5, future ones 1.0."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(_c(ts))) / F.lit(86_400_000_000))
    return F.when(days <= bounds[0], 1.0).when(days <= bounds[1], 0.75).otherwise(0.5)


def mana_pips(cost: Column | str) -> Column:
    """Struct of the number of exact {W}..{G} symbols."""
    c = F.coalesce(_c(cost), F.lit(""))
    return F.struct(*[F.regexp_count(c, F.lit(r"\{%s\}" % x)).cast("int").alias(x) for x in WUBRG])


def cost_has_color(cost: Column | str, color: str) -> Column:
    """The cost needs the colour, also as half of a hybrid symbol."""
    c = F.coalesce(_c(cost), F.lit(""))
    return c.contains("{%s}" % color) | c.contains("{%s/" % color) | c.contains("/%s}" % color)


def cmc_bucket(cmc: Column | str) -> Column:
    """Mana value from 0 to 7 and above."""
    return F.least(F.coalesce(_c(cmc), F.lit(0.0)).cast("int"), F.lit(7))


def is_land(kind: Column | str) -> Column:
    return F.coalesce(_c(kind), F.lit("")).contains("Land")


def is_creature(kind: Column | str) -> Column:
    return F.coalesce(_c(kind), F.lit("")).contains("Creature")


def is_basic(kind: Column | str) -> Column:
    return F.coalesce(_c(kind), F.lit("")).contains("Basic")


def flatten_card(cards: DataFrame) -> DataFrame:
    """Cost, type and colours of a card; of its first face where the card itself has no cost."""
    face = F.get(F.col("card_faces"), 0)
    fall = blank("mana_cost") & (F.coalesce(F.size("card_faces"), F.lit(0)) > 0)
    own = F.coalesce(F.col("colors"), F.array().cast("array<string>"))
    colors = F.when(fall & (F.size(own) == 0), F.coalesce(face["colors"], F.array().cast("array<string>"))).otherwise(own)
    return cards.select(
        "name", F.col("cmc").cast("double").alias("card_cmc"),
        F.when(fall, F.coalesce(face["mana_cost"], F.lit(""))).otherwise(F.coalesce("mana_cost", F.lit(""))).alias("card_cost"),
        F.when(fall, F.coalesce(face["type_line"], F.lit(""))).otherwise(F.coalesce("type_line", F.lit(""))).alias("card_type"),
        F.array_join(colors, "").alias("colors"), "rarity")


def with_front_face_aliases(cards: DataFrame, name: str = "name") -> DataFrame:
    """P15: 'A // B' is also known as 'A' and then replaces an entry of that name."""
    front = cards.where(F.col(name).contains(" // ")).withColumn("__full", F.col(name)).withColumn(name, F.split_part(F.col(name), F.lit(" // "), F.lit(1))).withColumn("__first", F.lit(0))
    rows = front.unionByName(cards.withColumn("__full", F.col(name)).withColumn("__first", F.lit(1)))
    best = Window.partitionBy(name).orderBy("__first", "__full")
    return rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__first").withColumnRenamed("__full", "full_name")


def maindeck_cardlist(decks: DataFrame) -> DataFrame:
    """Decks with a column cardlist, card name -> copies in the main deck; decks without one go.

    decks: cards MAP<id, {name}>, groups ARRAY<{name, cards ARRAY<id>}>.
    """
    low = lambda g: F.lower(F.coalesce(g["name"], F.lit("")))
    names = lambda g: F.filter(F.transform(F.coalesce(g["cards"], F.array().cast("array<bigint>")), lambda i: F.try_element_at(F.col("cards"), i.cast("string"))["name"]), lambda n: n.isNotNull())
    main = F.filter("groups", lambda g: low(g).isin("deck", "maindeck", "main"))
    other = F.filter(F.transform(F.filter("groups", lambda g: ~low(g).contains("side")), names), lambda x: F.size(x) > 0)
    listed = decks.withColumn("__names", F.coalesce(F.when(F.size(main) > 0, names(F.get(main, 0))).otherwise(F.get(other, 0)), F.array().cast("array<string>")))
    keys = F.array_sort(F.array_distinct("__names"))
    copies = F.transform(keys, lambda k: F.size(F.filter(F.col("__names"), lambda n: n == k)))
    return listed.where(F.size("__names") > 0).withColumn("cardlist", F.map_from_arrays(keys, copies)).drop("__names")


def parse_pg_array(col: Column | str) -> Column:
    """The elements of an array literal {"a","b"}; null gives an empty array."""
    body = F.regexp_replace(_c(col), r"^\{|\}$", "")
    items = F.transform(F.split(body, ","), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    return F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(items, lambda x: x != ""))


#: White space, also beyond ASCII.
BLANK = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def clean_summary(col: Column | str) -> Column:
    """Text before the first '{', without fences, back-ticks and rules, and without white space at both ends."""
    head = F.split_part(F.coalesce(_c(col), F.lit("")), F.lit("{"), F.lit(1))
    for pattern in (r"(?s)```.*\z", "`", r"[-_*]{3,}", rf"\A{BLANK}+|{BLANK}+\z"):
        head = F.regexp_replace(head, pattern, "")
    return head


def video_id(url: Column | str) -> Column:
    """The 11-character id in the known forms of a video URL (short link, v, embed and u paths, watch page), else null."""
    u = _c(url)
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    part = lambda name, *key: F.try_parse_url(full, F.lit(name), *map(F.lit, key))
    path = F.split(F.coalesce(part("PATH"), F.lit("")), "/")
    step = lambda i: F.get(path, i)
    found = F.when(F.endswith(part("HOST"), F.lit("youtu.be")), step(1)).when(step(1).isin("v", "embed"), step(2)).when(step(1) == "u", step(3)).otherwise(part("QUERY", "v"))
    return F.when(F.length(found) == 11, found)


def video_thumbnail(url: Column | str, thumb: Column | str) -> Column:
    """The video's own picture, else the stored one."""
    return F.coalesce(F.concat(F.lit("https://img.youtube.com/vi/"), video_id(url), F.lit("/maxresdefault.jpg")), _c(thumb))


def delta_tier(wr: Column | str, avg: Column | str) -> Column:
    """P20: 0 (best) to 7 by the distance to the average; null if a rate is missing or zero."""
    w, a = _c(wr), _c(avg)
    d = w - a
    out = F.when((F.coalesce(w, F.lit(0.0)) == 0) | (F.coalesce(a, F.lit(0.0)) == 0), F.lit(None).cast("int"))
    for i, edge in enumerate((9, 6, 3, 0, -3, -6, -9)):
        out = out.when(d >= edge, i)
    return out.otherwise(7)


def card_grade(card_wr: Column | str, deck_wr: Column | str) -> Column:
    """S, A, B, C, D or F; '-' if a rate is missing or zero."""
    w, a = _c(card_wr), _c(deck_wr)
    d = w - a
    out = F.when((F.coalesce(w, F.lit(0.0)) == 0) | (F.coalesce(a, F.lit(0.0)) == 0), "-")
    for grade, edge in (("S", 5.5), ("A", 3.0), ("B", 0.5), ("C", -1.5), ("D", -3.5)):
        out = out.when(d >= edge, grade)
    return out.otherwise("F")


def history_or_flat(hist: Column | str, wr: Column | str) -> Column:
    """A history of at least two points."""
    h = F.coalesce(_c(hist), F.array().cast("array<double>"))
    one = F.coalesce(F.get(h, 0), _c(wr))
    return F.when(F.size(h) < 2, F.array(one, one)).otherwise(h)


def history_trend(hist: Column | str) -> Column:
    """Struct of the last-first difference, its class, the curve's class and the number of days."""
    h = F.coalesce(_c(hist), F.array().cast("array<double>"))
    d = F.when(F.size(h) < 2, 0.0).otherwise(F.get(h, F.size(h) - 1) - F.get(h, 0))
    kind = F.when(F.abs(d) < 0.1, "none").when(d > 0.5, "strong up").when(d > 0, "up").when(d < -0.5, "strong down").otherwise("down")
    curve = F.when(d > 0.1, "rising").when(d < -0.1, "falling").otherwise("flat")
    return F.struct(d.alias("delta"), kind.alias("trend"), curve.alias("curve"), F.size(h).alias("days"))


def history_scaled(hist: Column | str) -> Column:
    """Points scaled to 0..1 by the history's range; a flat curve is 0.5 throughout."""
    h = F.coalesce(_c(hist), F.array().cast("array<double>"))
    lo, hi = F.array_min(h), F.array_max(h)
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    flat = F.abs(history_trend(h)["delta"]) <= 0.1
    return F.transform(h, lambda x: F.when(flat, 0.5).otherwise((x - lo) / span))


def deck_type(colors: Column | str) -> Column:
    """P25: kind of deck by its number of colours and splash."""
    n, splash = F.length(extract_colors(colors)), _c(colors).contains("Splash")
    return F.when(n == 1, "Mono-color").when((n == 2) & ~splash, "Two colors").when(n == 2, "Two colors + splash").when((n == 3) & ~splash, "Three colors").when(n >= 3, "More than 3 colors").otherwise("Other")
