"""The registered queries: each operator over the mapped tables, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .functions import columns as C
from .operators import articles, cards, formats, skeletons, snapshots, stats, synergy
from .plans import fixtures as fx
from .plans import skeleton_table
from .sources import tables
from .sources.keyed import KeyedTable
from .sources.tables import saved, shared
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "2001-08-02"
BOUNDS = (365, 730)
DAYS = 365


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL of its result."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = fx.with_ctes(sql)
        return f

    return put


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _card_stats(s: SparkSession, d: str) -> DataFrame:
    return fx.frame(s, d, "fx_card_stats")


def _arch(s: SparkSession, d: str) -> DataFrame:
    return fx.frame(s, d, "fx_archetype_stats")


def _names(s: SparkSession, d: str) -> DataFrame:
    return fx.frame(s, d, "fx_color_names")


# ---- SQL fragments (DuckDB) ----

def q_letters(x: str) -> str:
    return f"regexp_extract_all({x}, '[WUBRG]')"


def q_key(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {x} <> '' THEN array_to_string(list_sort({q_letters(x)}), '') END"


def q_extract(x: str) -> str:
    return f"regexp_replace(replace({x}, ' + Splash', ''), '[^WUBRG]', '', 'g')"


def q_wubrg(x: str) -> str:
    return f"translate(array_to_string(list_sort(regexp_extract_all(translate(regexp_replace({x}, '[^WUBRG]', '', 'g'), 'WUBRG', '12345'), '[0-9]')), ''), '12345', 'WUBRG')"


def q_clean(x: str) -> str:
    inner = f"regexp_extract({x}, '\\(([WUBRG]+)\\)', 1)"
    src = f"CASE WHEN {inner} <> '' THEN {inner} ELSE {x} END"
    letters = f"array_to_string(list_sort(list_distinct({q_letters('(' + src + ')')})), '')"
    tail = f"CASE WHEN contains({x}, 'Splash') THEN ' + Splash' ELSE '' END"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'Unknown' WHEN {letters} = '' THEN trim(replace(replace({x}, ' + Splash', ''), ' (Splash)', '')) || {tail} ELSE {letters} || {tail} END"


def q_type(x: str) -> str:
    n, s = f"length({q_extract(x)})", f"contains({x}, 'Splash')"
    return (f"CASE WHEN {n} = 1 THEN 'Mono-color' WHEN {n} = 2 AND NOT {s} THEN 'Two colors' WHEN {n} = 2 THEN 'Two colors + splash' "
            f"WHEN {n} = 3 AND NOT {s} THEN 'Three colors' WHEN {n} >= 3 THEN 'More than 3 colors' ELSE 'Other' END")


REAL = "archetype_name NOT IN ('All Decks', 'Mono-color', 'Mono-color + Splash', 'Two-color', 'Two-color + Splash', 'Three-color', 'Three-color + Splash')"
RARITY = "upper(substr(rarity, 1, 1))"
GRADE = "CASE WHEN coalesce({w}, 0) = 0 OR coalesce({a}, 0) = 0 THEN '-' WHEN {w} - {a} >= 5.5 THEN 'S' WHEN {w} - {a} >= 3 THEN 'A' WHEN {w} - {a} >= 0.5 THEN 'B' WHEN {w} - {a} >= -1.5 THEN 'C' WHEN {w} - {a} >= -3.5 THEN 'D' ELSE 'F' END"
WEIGHT = f"CASE WHEN floor((epoch(TIMESTAMP '{AS_OF}') - epoch(trophy_time)) / 86400) <= {BOUNDS[0]} THEN 1.0 WHEN floor((epoch(TIMESTAMP '{AS_OF}') - epoch(trophy_time)) / 86400) <= {BOUNDS[1]} THEN 0.75 ELSE 0.5 END"
MEAN_WR = "mean_wr AS (SELECT set_code, format, coalesce(nullif(max(CASE WHEN archetype_name = 'All Decks' THEN win_rate END), 0), 55.0) AS mean_wr FROM fx_archetype_stats GROUP BY 1, 2)"
COLOR_CLASS = "CASE WHEN length(colors) > 1 THEN 'M' WHEN length(colors) = 0 THEN 'C' ELSE colors END"
GLOBAL_CARDS = f"g AS (SELECT set_code, format, card_name, gih_wr, alsa, {RARITY} AS rarity_code, {COLOR_CLASS} AS color_class FROM fx_card_stats WHERE filter_context = 'Global' AND gih_wr <> 0)"


# ---- scalar functions ----

@query(f"SELECT id, name, {q_clean('name')} AS code FROM fx_color_names")
def p1_clean_color_code(s, d):
    return _names(s, d).select("id", "name", C.clean_color_code("name").alias("code"))


@query(f"SELECT id, {q_extract('name')} AS letters FROM fx_color_names")
def p2_extract_colors(s, d):
    return _names(s, d).select("id", C.extract_colors("name").alias("letters"))


@query(f"SELECT id, coalesce(({q_key('name')}) = ({q_key('other')}), false) AS same, {q_key('other')} AS other_key FROM fx_color_names")
def p3_colors_equal(s, d):
    return _names(s, d).select("id", C.colors_equal("name", "other").alias("same"), C.colors_key("other").alias("other_key"))


@query(f"SELECT id, {q_wubrg('name')} AS sorted, {q_wubrg('other')} AS sorted_other FROM fx_color_names")
def p4_sort_wubrg(s, d):
    return _names(s, d).select("id", C.sort_wubrg("name").alias("sorted"), C.sort_wubrg("other").alias("sorted_other"))


_P5 = r"'^(.+?)\s*\(([WUBRG]+)\)(.*)$'"
_P5S = r"'^([WUBRGwubrg]+)\s*\+\s*[Ss][Pp][Ll][Aa][Ss][Hh]$'"


@query(f"""SELECT id, CASE WHEN regexp_matches(name, {_P5}) THEN trim(regexp_extract(name, {_P5}, 1)) || ' (' || {q_wubrg(f'regexp_extract(name, {_P5}, 2)')} || ')' || regexp_extract(name, {_P5}, 3)
    WHEN regexp_matches(name, {_P5S}) THEN {q_wubrg(f'regexp_extract(name, {_P5S}, 1)')} || ' + Splash'
    WHEN regexp_matches(trim(name), '^[WUBRG]{{2,5}}$') THEN {q_wubrg('name')} ELSE name END AS normalized FROM fx_color_names""")
def p5_normalize_archetype_name(s, d):
    return _names(s, d).select("id", C.normalize_archetype_name("name").alias("normalized"))


@query(f"""SELECT id, {q_wubrg("CASE WHEN regexp_extract(name, '\\(([WUBRG]+)\\)', 1) <> '' THEN regexp_extract(name, '\\(([WUBRG]+)\\)', 1) ELSE name END")} || CASE WHEN lower(name) LIKE '%splash%' THEN '+' ELSE '' END AS acronym FROM fx_color_names""")
def p6_archetype_acronym(s, d):
    return _names(s, d).select("id", C.archetype_acronym("name").alias("acronym"))


@query(f"SELECT set_code, format, filter_context, card_name, CASE WHEN {RARITY} IN ('M', 'R', 'U', 'C') THEN {RARITY} ELSE 'C' END AS code FROM fx_card_stats")
def p7_normalize_rarity(s, d):
    return _card_stats(s, d).select("set_code", "format", "filter_context", "card_name", C.normalize_rarity("rarity").alias("code"))


_RAW_RATE = "CASE l_linenumber % 4 WHEN 0 THEN CAST(l_discount AS {t}) WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(l_quantity AS {t}) ELSE 'NaN' END"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN v >= 0 AND v <= 1 THEN v * 100 ELSE v END AS rate FROM (
    SELECT l_orderkey, l_linenumber, CASE WHEN isnan(w) OR isinf(w) THEN NULL ELSE w END AS v FROM (SELECT l_orderkey, l_linenumber, TRY_CAST({_RAW_RATE.format(t='VARCHAR')} AS DOUBLE) AS w FROM lineitem))""")
def p8_safe_rate(s, d):
    return fx.frame(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.safe_rate(F.expr(_RAW_RATE.format(t="STRING"))).alias("rate"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('second', ts) END AS parsed FROM events""")
def p9_parse_utc(s, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(iso, F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, iso).otherwise("soon")
    return fx.frame(s, d, "events").select("event_id", C.parse_utc(text).alias("parsed"))


@query(f"SELECT aggregate_id, {WEIGHT} AS weight FROM fx_decks")
def p10_recency_weight(s, d):
    return fx.frame(s, d, "fx_decks").select("aggregate_id", C.recency_weight("trophy_time", as_of(), BOUNDS).alias("weight"))


@query("""SELECT set_code, card_name, """ + ", ".join(f"CAST((length(card_cost) - length(replace(card_cost, '{{{x}}}', ''))) / 3 AS INT) AS pips_{x.lower()}, contains(card_cost, '{{{x}}}') AS has_{x.lower()}" for x in "WUBRG") + " FROM fx_card_list")
def p11_p12_mana_pips(s, d):
    pips = C.mana_pips("card_cost")
    out = [c for x in C.WUBRG for c in (pips[x].alias(f"pips_{x.lower()}"), C.cost_has_color("card_cost", x).alias(f"has_{x.lower()}"))]
    return fx.frame(s, d, "fx_card_list").select("set_code", "card_name", *out)


@query("SELECT set_code, card_name, CAST(least(card_cmc, 7) AS INT) AS bucket, contains(card_type, 'Land') AS land, contains(card_type, 'Creature') AS creature, contains(card_type, 'Basic') AS basic FROM fx_card_list")
def p13_card_kinds(s, d):
    return fx.frame(s, d, "fx_card_list").select("set_code", "card_name", C.cmc_bucket("card_cmc").alias("bucket"), C.is_land("card_type").alias("land"), C.is_creature("card_type").alias("creature"), C.is_basic("card_type").alias("basic"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '{2}{U}' ELSE '{1}{G}' END AS card_cost, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS card_type,
    CASE WHEN p_partkey % 3 = 0 THEN 'U' ELSE 'G' END AS colors FROM part""")
def p14_flatten_card(s, d):
    two = F.col("p_partkey") % 3 == 0
    raw = fx.frame(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("double").alias("cmc"), F.when(two, "").otherwise("{1}{G}").alias("mana_cost"), F.when(two, "").otherwise(F.col("p_brand")).alias("type_line"),
        F.when(two, F.array().cast("array<string>")).otherwise(F.array(F.lit("G"))).alias("colors"), F.lit("rare").alias("rarity"),
        F.when(two, F.array(F.struct(F.lit("{2}{U}").alias("mana_cost"), F.col("p_type").alias("type_line"), F.array(F.lit("U")).alias("colors")))).alias("card_faces"))
    return C.flatten_card(raw).select(F.col("name").cast("long").alias("id"), "card_cost", "card_type", "colors")


@query("""WITH c AS (SELECT p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' // ' || p_type ELSE '' END AS full_name, min(p_partkey) AS k FROM part GROUP BY 1),
    a AS (SELECT split_part(full_name, ' // ', 1) AS name, full_name, k, 0 AS pr FROM c WHERE contains(full_name, ' // ') UNION ALL SELECT full_name, full_name, k, 1 FROM c)
    SELECT name, full_name, k FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr, full_name) AS r FROM a) WHERE r = 1""")
def p15_front_face_aliases(s, d):
    name = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" // "), F.col("p_type"))).otherwise(""))
    base = fx.frame(s, d, "part").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("k"))
    return C.with_front_face_aliases(base).select("name", "full_name", "k")


@query("""SELECT l_orderkey AS aggregate_id, p_brand AS card_name, CAST(count(*) AS INT) AS copies FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_partkey % 10 <> 0 AND l_orderkey % 4 <> 3 GROUP BY 1, 2""")
def p16_maindeck_cardlist(s, d):
    rows = fx.frame(s, d, "lineitem").join(fx.frame(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    per = rows.groupBy(F.col("l_orderkey").alias("aggregate_id")).agg(
        F.map_from_entries(F.collect_set(F.when(F.col("l_partkey") % 10 != 0, F.struct(F.col("l_partkey").cast("string"), F.struct(F.col("p_brand").alias("name")))))).alias("cards"), F.collect_list("l_partkey").alias("ids"))
    k = F.col("aggregate_id") % 4
    group = lambda name, ids: F.struct(F.lit(name).alias("name"), ids.alias("cards"))
    ids, none = F.col("ids"), F.array().cast("array<bigint>")
    side = group("Sideboard", ids)
    groups = F.when(k == 0, F.array(side, group("Deck", ids))).when(k == 1, F.array(group("MainDeck", ids), side)).when(k == 2, F.array(side, group("Extra", none), group("Pile", ids))).otherwise(F.array(side))
    return C.maindeck_cardlist(per.withColumn("groups", groups)).select("aggregate_id", F.explode("cardlist").alias("card_name", "copies"))


@query("SELECT id, list_aggregate(list_transform(string_split(trim(mentioned_cards, '{}'), ','), lambda x: trim(x, '\"')), 'string_agg', '|') AS names FROM fx_articles")
def p17_parse_pg_array(s, d):
    return fx.articles(s, d).select("id", F.array_join(C.parse_pg_array("mentioned_cards"), "|").alias("names"))


@query(rf"SELECT id, regexp_replace(regexp_replace(replace(regexp_replace(split_part(coalesce(summary, ''), '{{', 1), '(?s)```.*$', ''), '`', ''), '[-_*]{{3,}}', '', 'g'), '^{C.BLANK}+|{C.BLANK}+$', '', 'g') AS cleaned FROM fx_articles")
def p18_clean_summary(s, d):
    return fx.articles(s, d).select("id", C.clean_summary("summary").alias("cleaned"))


@query("SELECT id, CASE WHEN video_url IS NULL THEN 'none.jpg' ELSE 'https://img.youtube.com/vi/' || substr(video_url, 18) || '/maxresdefault.jpg' END AS thumb FROM fx_articles")
def p19_video_thumbnail(s, d):
    return fx.articles(s, d).select("id", C.video_thumbnail("video_url", F.lit("none.jpg")).alias("thumb"))


@query(f"""WITH {MEAN_WR} SELECT c.set_code, c.format, filter_context, card_name, CASE WHEN gih_wr = 0 THEN NULL WHEN gih_wr - mean_wr >= 9 THEN 0 WHEN gih_wr - mean_wr >= 6 THEN 1 WHEN gih_wr - mean_wr >= 3 THEN 2
    WHEN gih_wr - mean_wr >= 0 THEN 3 WHEN gih_wr - mean_wr >= -3 THEN 4 WHEN gih_wr - mean_wr >= -6 THEN 5 WHEN gih_wr - mean_wr >= -9 THEN 6 ELSE 7 END AS tier, {GRADE.format(w='gih_wr', a='mean_wr')} AS grade
    FROM fx_card_stats c JOIN mean_wr USING (set_code, format)""")
def p20_p21_tiers(s, d):
    rows = _card_stats(s, d).join(stats.format_mean_wr(_arch(s, d)), stats.GROUP)
    return rows.select("set_code", "format", "filter_context", "card_name", C.delta_tier("gih_wr", "mean_wr").alias("tier"), C.card_grade("gih_wr", "mean_wr").alias("grade"))


RATE_SQL = "round(100.0 * wins / games, 1)"
_SNAP = f"""snap AS (SELECT set_code, format, run_date, colors, rate FROM (SELECT set_code, format, run_date, {q_clean('color_name')} AS colors, {RATE_SQL} AS rate,
    row_number() OVER (PARTITION BY set_code, format, run_date, {q_clean('color_name')} ORDER BY ingest_seq DESC, color_name DESC) AS r FROM fx_raw_ratings WHERE games <> 0) WHERE r = 1)"""
_HIST = f"""{_SNAP}, hist AS (SELECT set_code, format, colors, list(rate ORDER BY run_date) AS h FROM (SELECT *, row_number() OVER (PARTITION BY set_code, format, colors ORDER BY run_date DESC) AS k FROM snap) WHERE k <= 14 GROUP BY 1, 2, 3)"""


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    raw = fx.frame(s, d, "fx_raw_ratings").withColumn("win_rate", F.lit(None).cast("string"))
    return snapshots.archetype_snapshot(raw, ("run_date",))


def _histories(s: SparkSession, d: str) -> DataFrame:
    return snapshots.history_from_log(_snapshots(s, d), ["set_code", "format", "colors"], "win_rate")


@query(f"WITH {_SNAP} SELECT set_code, format, run_date, colors, rate AS win_rate FROM snap")
def a1_archetype_snapshot(s, d):
    return _snapshots(s, d).select("set_code", "format", "run_date", "colors", "win_rate")


@query(f"""SELECT set_code, format, filter_context, card_name, rarity, colors, gih_wr, round(alsa, 6) AS alsa, img_count FROM fx_card_stats""")
def a2_card_snapshot(s, d):
    c = _card_stats(s, d).select("set_code", "format", "filter_context", F.col("card_name").alias("name"), "rarity", F.col("colors").alias("color"), (F.col("gih_wr") / 100).alias("ever_drawn_win_rate"), F.col("alsa").alias("avg_seen"), F.col("img_count").alias("game_count"), F.lit(2).alias("ingest_seq"))
    older = c.withColumn("ever_drawn_win_rate", F.lit(0.5)).withColumn("ingest_seq", F.lit(1))
    return rounded(snapshots.card_snapshot(c.unionByName(older)))


@query(f"WITH {_HIST} SELECT set_code, format, colors, array_to_string(list_transform(h, lambda x: CAST(round(x * 10) AS BIGINT)), ',') AS points FROM hist")
def w1_roll_history(s, d):
    """Rebuilt from the log of all runs."""
    return _histories(s, d).select("set_code", "format", "colors", F.array_join(F.transform("win_rate_history", lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("points"))


@query(f"WITH {_HIST}, l AS (SELECT set_code, format, colors, max(run_date) AS m FROM snap GROUP BY 1, 2, 3) SELECT set_code, format, colors, array_to_string(list_transform(h, lambda x: CAST(round(x * 10) AS BIGINT)), ',') AS points FROM hist JOIN l USING (set_code, format, colors)")
def w1_incremental(s, d):
    """The last run appended to the history of the runs before it."""
    log = saved(_snapshots(s, d), "log")
    key = ["set_code", "format", "colors"]
    last = log.groupBy(*key).agg(F.max("run_date").alias("m"))
    marked = log.join(last, key)
    prior = snapshots.history_from_log(marked.where("run_date < m"), key, "win_rate")
    out = snapshots.roll_history(prior, marked.where("run_date = m"), key, "win_rate")
    return out.select(*key, F.array_join(F.transform("win_rate_history", lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("points"))


@query(f"""WITH {_HIST}, t AS (SELECT *, CASE WHEN len(h) < 2 THEN 0 ELSE h[len(h)] - h[1] END AS dd FROM hist)
    SELECT set_code, format, colors, round(dd, 6) AS delta, CASE WHEN abs(dd) < 0.1 THEN 'none' WHEN dd > 0.5 THEN 'strong up' WHEN dd > 0 THEN 'up' WHEN dd < -0.5 THEN 'strong down' ELSE 'down' END AS trend,
    CASE WHEN dd > 0.1 THEN 'rising' WHEN dd < -0.1 THEN 'falling' ELSE 'flat' END AS curve, len(h) AS days FROM t""")
def p23_history_trend(s, d):
    t = C.history_trend("win_rate_history")
    return _histories(s, d).select("set_code", "format", "colors", F.round(t["delta"], 6).alias("delta"), t["trend"].alias("trend"), t["curve"].alias("curve"), t["days"].cast("long").alias("days"))


@query(f"""WITH {_HIST}, t AS (SELECT *, abs(CASE WHEN len(h) < 2 THEN 0 ELSE h[len(h)] - h[1] END) <= 0.1 AS flat FROM hist)
    SELECT set_code, format, colors, len(CASE WHEN len(h) < 2 THEN [1, 1] ELSE h END) AS points, round(CASE WHEN flat THEN 0.5 * len(h) ELSE list_sum(list_transform(h, lambda x: (x - list_min(h)) / CASE WHEN list_max(h) = list_min(h) THEN 1 ELSE list_max(h) - list_min(h) END)) END, 6) AS scaled_sum FROM t""")
def p22_p24_history_scaled(s, d):
    total = F.aggregate(C.history_scaled("win_rate_history"), F.lit(0.0), lambda a, x: a + x)
    return _histories(s, d).select("set_code", "format", "colors", F.size(C.history_or_flat("win_rate_history", F.lit(1.0))).cast("long").alias("points"), F.round(total, 6).alias("scaled_sum"))


@query(f"SELECT set_code, format, archetype_name, {q_type('colors')} AS deck_type FROM fx_archetype_stats WHERE {REAL}")
def p25_f1_deck_type(s, d):
    return stats.with_deck_type(_arch(s, d)).select("set_code", "format", "archetype_name", "deck_type")


# ---- sources ----

@query("""SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer
    UNION ALL SELECT c_custkey + 10000000, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 5 = 0""")
def s3_upsert(s, d):
    now = fx.frame(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    changed = now.where("id % 3 = 0").withColumn("balance", F.col("balance") + 1).withColumn("seq", F.lit(2))
    stale = changed.withColumn("balance", F.lit(0.0)).withColumn("seq", F.lit(1))
    fresh = now.where("id % 5 = 0").withColumn("id", F.col("id") + 10_000_000).withColumn("seq", F.lit(2))
    return tables.upsert(now, changed.unionByName(stale).unionByName(fresh), ["id"], "seq")


def _accounts(s: SparkSession, d: str) -> tuple[DataFrame, KeyedTable]:
    """Customers as a keyed table that was written in two versions."""
    now = fx.frame(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    table = KeyedTable(s, shared(s), ["id"], now.schema)
    table.upsert(now.where("id % 4 <> 0"))
    table.insert_new(now.withColumn("balance", F.when(F.col("id") % 4 == 0, F.col("balance"))))
    return now, table


@query("""SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 10 <> 0
    UNION ALL SELECT c_custkey + 10000000, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 5 = 0""")
def s3_keyed_table(s, d):
    """Rows added, replaced and taken out in a table that is there."""
    now, table = _accounts(s, d)
    table.upsert(now.where("id % 3 = 0").withColumn("balance", F.col("balance") + 1).unionByName(now.where("id % 5 = 0").withColumn("id", F.col("id") + 10_000_000)))
    table.delete(now.where("id % 10 = 0"))
    table.compact(1)
    table.vacuum()
    return table.read()


@query("SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer")
def s4_keyed_columns(s, d):
    """One column set in place, to null for some rows."""
    now, table = _accounts(s, d)
    table.update_columns(now.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 != 0, F.col("balance") + 1).alias("balance")), ["balance"], set_null=True)
    return table.read()


@query("SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer")
def s4_upsert_columns(s, d):
    """By a join; s4_keyed_columns writes the same in place."""
    now = fx.frame(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return tables.upsert_columns(now, now.where("id % 3 = 0").select("id", (F.col("balance") + 1).alias("balance")), ["id"], ["balance"])


@query("SELECT set_code, format, aggregate_id, archetype FROM fx_decks WHERE format <> 'Sealed' UNION ALL SELECT set_code, format, aggregate_id, 'new' FROM fx_decks WHERE format = 'Sealed' AND aggregate_id % 2 = 0")
def s2_s5_replace_partitions(s, d):
    decks = fx.frame(s, d, "fx_decks").select("set_code", "format", "aggregate_id", "archetype")
    root = shared(s)
    tables.replace_partitions(decks, f"{root}/decks")
    tables.replace_partitions(decks.where("format = 'Sealed' and aggregate_id % 2 = 0").withColumn("archetype", F.lit("new")), f"{root}/decks")
    return tables.read_table(s, root, "decks", columns=["set_code", "format", "aggregate_id", "archetype"])


_SETS = "sets AS (SELECT o_orderstatus || substr(o_orderpriority, 1, 1) AS code, max(o_orderdate) AS start_date, count(*) % 4 <> 0 AS active FROM orders GROUP BY 1)"


@query(f"WITH {_SETS} SELECT code, start_date FROM sets WHERE active AND code <> 'F5'")
def s6_select_sets(s, d):
    sets = fx.frame(s, d, "orders").groupBy(F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("code")).agg(F.max("o_orderdate").alias("start_date"), (F.count("*") % 4 != 0).alias("active"))
    return tables.select_sets(sets, embargoed=["F5"]).select("code", "start_date")


@query(f"WITH {_SETS} SELECT DISTINCT p_brand AS code FROM part WHERE p_brand NOT IN (SELECT code FROM sets WHERE active) UNION SELECT code FROM sets WHERE NOT active")
def s6_missing_targets(s, d):
    sets = fx.frame(s, d, "orders").groupBy(F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("code")).agg((F.count("*") % 4 != 0).alias("active"))
    return tables.missing_targets(sets, sets.select("code").unionByName(fx.frame(s, d, "part").select(F.col("p_brand").alias("code"))))


@query("SELECT set_code, format, filter_context, card_name AS name, rarity, colors AS color, gih_wr AS ever_drawn_win_rate, img_count AS game_count FROM fx_card_stats")
def s1_read_ratings(s, d):
    """The card statistics written as feed files of all three layouts, and read."""
    root = shared(s)
    c = _card_stats(s, d)
    row = F.struct(F.col("card_name").alias("name"), "rarity", F.col("colors").alias("color"), F.col("gih_wr").alias("ever_drawn_win_rate"), F.col("alsa").alias("avg_seen"), F.col("img_count").alias("game_count"))
    files = c.groupBy("set_code", "format", "filter_context").agg(F.collect_list(row).alias("rows"))
    layout = F.pmod(F.hash("set_code", "format", "filter_context"), F.lit(3))
    body = F.when(layout == 0, F.to_json("rows")).when(layout == 1, F.to_json(F.struct(F.col("rows").alias("results")))).otherwise(F.to_json(F.struct(F.lit(1).alias("n"), F.col("rows").alias("cards"))))
    files.select("set_code", "format", "filter_context", body.alias("value")).write.partitionBy("set_code", "format", "filter_context").text(root)
    return tables.read_ratings(s, root).select("set_code", "format", "filter_context", "name", "rarity", "color", "ever_drawn_win_rate", "game_count")


# ---- statistics ----

@query(f"WITH t AS (SELECT * FROM fx_archetype_stats WHERE {REAL}) SELECT set_code, format, archetype_name, games_count, round(games_count / sum(games_count) OVER (PARTITION BY set_code, format), 6) AS meta_share FROM t")
def a3_meta_share(s, d):
    return rounded(stats.meta_share(_arch(s, d)).select("set_code", "format", "archetype_name", "games_count", "meta_share"))


@query(f"""WITH t AS (SELECT set_code, format, games_count, {q_type('colors')} AS k FROM fx_archetype_stats WHERE {REAL} AND games_count <> 0),
    b AS (SELECT set_code, format, CASE k WHEN 'Mono-color' THEN 'Mono Color' WHEN 'Two colors' THEN '2 Color' WHEN 'Two colors + splash' THEN '2 Color + Splash' WHEN 'Three colors' THEN '3 Color' ELSE '>3 Color' END AS bin, CAST(sum(games_count) AS BIGINT) AS games FROM t GROUP BY 1, 2, 3)
    SELECT *, round(games / sum(games) OVER (PARTITION BY set_code, format), 6) AS share FROM b""")
def a6_color_breakdown(s, d):
    return rounded(stats.color_breakdown(_arch(s, d)))


_PAIRS_SQL = "(VALUES " + ", ".join(f"('{''.join(sorted(p))}', '{p}')" for p in C.PAIRS) + ") AS p(k, pair)"


@query(f"""WITH t AS (SELECT set_code, format, pair, CAST(sum(games_count) AS BIGINT) AS games FROM fx_archetype_stats JOIN {_PAIRS_SQL} ON k = {q_key('colors')} WHERE {REAL} GROUP BY 1, 2, 3)
    SELECT *, round(games / sum(games) OVER (PARTITION BY set_code, format), 6) AS share FROM t""")
def a7_pair_share(s, d):
    return rounded(stats.pair_share(_arch(s, d)))


@query("SELECT set_code, format, round(avg(gih_wr) FILTER (gih_wr <> 0), 6) AS avg_wr, round(avg(alsa), 6) AS avg_alsa, min(gih_wr) FILTER (gih_wr <> 0) AS min_wr, max(gih_wr) FILTER (gih_wr <> 0) AS max_wr FROM fx_card_stats WHERE filter_context = 'Global' GROUP BY 1, 2")
def a11_format_averages(s, d):
    return rounded(stats.format_averages(fx.meta(s, d).where("gih_wr is not null")))


@query(f"WITH {MEAN_WR} SELECT * FROM mean_wr")
def a25_format_mean_wr(s, d):
    return stats.format_mean_wr(_arch(s, d))


_AUDIT = "CASE WHEN trophy_time < TIMESTAMP '1996-01-01' OR trophy_time >= TIMESTAMP '2001-01-01' THEN 'out of window' WHEN aggregate_id % 7 = 0 THEN 'existing' WHEN r > 1 THEN 'repeated' ELSE 'saved' END"


def _feed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    decks = fx.frame(s, d, "fx_decks")
    return decks.unionByName(decks.where("aggregate_id % 9 = 0")), decks.where("aggregate_id % 7 = 0")


@query("SELECT aggregate_id, set_code, format FROM fx_decks WHERE aggregate_id % 7 <> 0")
def j2_new_decks(s, d):
    return stats.new_decks(*_feed(s, d)).select("aggregate_id", "set_code", "format")


@query("SELECT aggregate_id, trophy_time FROM fx_decks WHERE trophy_time >= TIMESTAMP '1996-03-01' AND trophy_time < TIMESTAMP '1996-04-01'")
def f6_trophy_window(s, d):
    return stats.in_trophy_window(fx.frame(s, d, "fx_decks"), F.lit("1996-03-01").cast("timestamp"), F.lit("1996-04-01").cast("timestamp")).select("aggregate_id", "trophy_time")


@query(f"""WITH u AS (SELECT aggregate_id, trophy_time, 1 AS c FROM fx_decks UNION ALL SELECT aggregate_id, trophy_time, 2 FROM fx_decks WHERE aggregate_id % 9 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY trophy_time) AS r FROM u) SELECT {_AUDIT} AS outcome, count(*) AS decks FROM t GROUP BY 1""")
def a12_ingest_audit(s, d):
    return stats.ingest_audit(*_feed(s, d), F.lit("1996-01-01").cast("timestamp"), F.lit("2001-01-01").cast("timestamp"))


@query(f"""WITH u AS (SELECT aggregate_id, trophy_time, 1 AS c FROM fx_decks UNION ALL SELECT aggregate_id, trophy_time, 2 FROM fx_decks WHERE aggregate_id % 9 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY trophy_time) AS r FROM u) SELECT {_AUDIT} AS outcome, count(*) AS decks FROM t GROUP BY 1""")
def a12_ingest_run(s, d):
    """The same counts, taken while the new decks are written."""
    at = f"{shared(s)}/decks"
    return stats.ingest(*_feed(s, d), F.lit("1996-01-01").cast("timestamp"), F.lit("2001-01-01").cast("timestamp"), lambda df: df.write.parquet(at))


# ---- synergy ----

@query("SELECT set_code, format, card_name, count(*) AS decks FROM fx_items GROUP BY 1, 2, 3")
def a8_card_occurrence(s, d):
    return synergy.card_occurrence(fx.decks_with_cards(s, d))


@query("SELECT a.set_code, a.format, a.card_name AS card_a, b.card_name AS card_b, count(*) AS co_occurrence_count FROM fx_items a JOIN fx_items b ON a.aggregate_id = b.aggregate_id AND a.card_name < b.card_name GROUP BY 1, 2, 3, 4")
def a9_pair_occurrence(s, d):
    return synergy.pair_occurrence(fx.decks_with_cards(s, d))


def _syn_cte(keys: str) -> str:
    return f"""n AS (SELECT {keys}, count(*) AS n FROM fx_decks GROUP BY {keys}), k AS (SELECT {keys}, card_name, count(*) AS k FROM fx_items GROUP BY {keys}, card_name),
    p AS (SELECT {', '.join('a.' + x.strip() for x in keys.split(','))}, a.card_name AS card_a, b.card_name AS card_b, count(*) AS co FROM fx_items a JOIN fx_items b ON a.aggregate_id = b.aggregate_id AND a.card_name < b.card_name GROUP BY ALL),
    syn AS (SELECT {', '.join('p.' + x.strip() for x in keys.split(','))}, card_a, card_b, round((co / n) / ((ka.k / n) * (kb.k / n)), 4) AS synergy_score, round((co / n) / ((ka.k / n) * (kb.k / n)), 4) AS lift_score, round(co / ka.k, 4) AS confidence_a_to_b, round(co / kb.k, 4) AS confidence_b_to_a, co AS co_occurrence_count
        FROM p JOIN n USING ({keys}) JOIN k ka ON ka.card_name = card_a AND {' AND '.join(f'ka.{x.strip()} = p.{x.strip()}' for x in keys.split(','))} JOIN k kb ON kb.card_name = card_b AND {' AND '.join(f'kb.{x.strip()} = p.{x.strip()}' for x in keys.split(','))}
        WHERE co >= greatest(10, floor(0.02 * n)) AND ka.k >= greatest(20, floor(0.03 * n)) AND kb.k >= greatest(20, floor(0.03 * n)) AND (co / n) / ((ka.k / n) * (kb.k / n)) >= 1.2)"""


def _deck_table(s: SparkSession, d: str) -> DataFrame:
    """The decks, written once where several passes read them."""
    return saved(fx.decks_with_cards(s, d), "decks")


@query(f"WITH {_syn_cte('set_code, format')} SELECT * FROM syn")
def a10_synergy_scores(s, d):
    return synergy.synergy_scores(_deck_table(s, d))


@query(f"WITH {_syn_cte('set_code')} SELECT * FROM syn")
def a10_synergy_by_set(s, d):
    return synergy.synergy_scores(_deck_table(s, d), ("set_code",))


def _syn(s: SparkSession, d: str) -> DataFrame:
    return synergy.synergy_scores(_deck_table(s, d), min_lift=1.0)


_SYN = _syn_cte("set_code, format").replace(">= 1.2)", ">= 1.0)")
_PARTNERS = f"""{_SYN}, both_ways AS (SELECT set_code, format, card_a AS card_name, card_b AS partner, confidence_a_to_b AS confidence, synergy_score FROM syn UNION ALL SELECT set_code, format, card_b, card_a, confidence_b_to_a, synergy_score FROM syn)"""


@query(f"WITH {_PARTNERS} SELECT * FROM both_ways")
def j10_card_partners(s, d):
    return synergy.card_partners(_syn(s, d)).drop("co_occurrence_count")


@query(f"WITH {_SYN} SELECT set_code, format, card_a, card_b, lift_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY set_code, format ORDER BY lift_score DESC, card_a, card_b) AS rank FROM syn) WHERE rank <= 10")
def w3_w4_top_synergies(s, d):
    return synergy.top_synergies(_syn(s, d)).select("set_code", "format", "card_a", "card_b", "lift_score", "rank")


@query(f"WITH {_SYN} " + " UNION ALL ".join(f"SELECT set_code, format, card_a, card_b, {c} AS confidence, rank, '{c}' AS ranking FROM (SELECT *, row_number() OVER (PARTITION BY set_code, format ORDER BY {c} DESC, card_a, card_b) AS rank FROM syn) WHERE rank <= 10" for c in ("confidence_a_to_b", "confidence_b_to_a")))
def w4_top_by_confidence(s, d):
    syn = saved(_syn(s, d), "synergy")
    best = lambda c: synergy.top_synergies(syn, c).select("set_code", "format", "card_a", "card_b", F.col(c).alias("confidence"), "rank", F.lit(c).alias("ranking"))
    return best("confidence_a_to_b").unionByName(best("confidence_b_to_a"))


@query(f"""WITH {_PARTNERS} SELECT set_code, format, card_name, partner, rank, 'confidence' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY set_code, format, card_name ORDER BY confidence DESC, partner) AS rank FROM both_ways) WHERE rank <= 3
    UNION ALL SELECT set_code, format, card_name, partner, rank, 'synergy' FROM (SELECT *, row_number() OVER (PARTITION BY set_code, format, card_name ORDER BY synergy_score DESC, partner) AS rank FROM both_ways) WHERE rank <= 3""")
def t5_top_partners(s, d):
    return synergy.top_partners(_syn(s, d)).select("set_code", "format", "card_name", "partner", "rank", "kind")


# ---- cards ----

@query(f"SELECT set_code, format, filter_context, card_name FROM fx_card_stats WHERE contains(lower(card_name), 'brand#1') AND {RARITY} IN ('R', 'M') AND (length(colors) > 1 OR contains(colors, 'W'))")
def f2_filter_cards(s, d):
    return cards.filter_cards(_card_stats(s, d), "Brand#1", ["R", "M"], ["M", "W"]).select("set_code", "format", "filter_context", "card_name")


@query("SELECT set_code, format, filter_context, card_name FROM fx_card_stats WHERE length(colors) = 0 OR colors = 'W'")
def f3_filter_cards_mono(s, d):
    return cards.filter_cards(_card_stats(s, d), colors=["C", "W"], mono_only=True).select("set_code", "format", "filter_context", "card_name")


@query("SELECT card_name FROM (SELECT DISTINCT card_name FROM fx_card_stats WHERE contains(lower(card_name), '#3')) ORDER BY card_name LIMIT 8")
def f9_suggest_cards(s, d):
    return cards.suggest_cards(_card_stats(s, d), "#3")


@query("SELECT l.set_code, f.format, l.card_name, l.card_type, g.gih_wr, round(g.alsa, 6) AS alsa FROM fx_card_list l JOIN (SELECT DISTINCT set_code, format FROM fx_card_stats) f USING (set_code) LEFT JOIN (SELECT * FROM fx_card_stats WHERE filter_context = 'Global') g ON g.set_code = l.set_code AND g.format = f.format AND g.card_name = l.card_name")
def j1_card_meta(s, d):
    return rounded(fx.meta(s, d).select("set_code", "format", "card_name", "card_type", "gih_wr", "alsa"))


_ARCH_CARDS = f"""world AS (SELECT set_code, format, card_name, gih_wr AS global_wr FROM fx_card_stats WHERE filter_context = 'Global'),
    ac AS (SELECT c.*, {q_key('filter_context')} AS colors_key, global_wr FROM fx_card_stats c LEFT JOIN world USING (set_code, format, card_name) WHERE filter_context <> 'Global' AND length(filter_context) <= 3)"""


@query(f"WITH {_ARCH_CARDS} SELECT set_code, format, colors_key, card_name, gih_wr, global_wr, row_number() OVER (PARTITION BY set_code, format, colors_key ORDER BY coalesce(gih_wr, 0) DESC, card_name) AS rank FROM ac")
def j3_archetype_cards(s, d):
    return cards.archetype_cards(_card_stats(s, d)).select("set_code", "format", "colors_key", "card_name", "gih_wr", "global_wr", "rank")


_BEST_DECK = f"""bd AS (SELECT set_code, format, k, archetype_name, win_rate, kind FROM (SELECT *, {q_key('colors')} AS k, {q_type('colors')} AS kind, row_number() OVER (PARTITION BY set_code, format, {q_key('colors')} ORDER BY win_rate DESC, archetype_name) AS r FROM fx_archetype_stats WHERE {REAL}) WHERE r = 1)"""


@query(f"""WITH {_BEST_DECK}, w AS (SELECT set_code, format, card_name, nullif(gih_wr, 0) AS g FROM fx_card_stats WHERE filter_context = 'Global'),
    x AS (SELECT c.set_code, c.format, c.card_name, coalesce(archetype_name, filter_context || ' Deck') AS deck_name, filter_context AS deck_colors, coalesce(win_rate, 55.0) AS deck_wr, gih_wr AS card_wr, coalesce(g, 55.0) AS avg_card_wr
          FROM fx_card_stats c LEFT JOIN bd ON bd.set_code = c.set_code AND bd.format = c.format AND bd.k = {q_key('filter_context')} LEFT JOIN w ON w.set_code = c.set_code AND w.format = c.format AND w.card_name = c.card_name
          WHERE filter_context <> 'Global' AND gih_wr <> 0 AND img_count >= CASE WHEN contains(lower(c.format), 'sealed') THEN 10 ELSE 20 END
            AND CASE WHEN archetype_name IS NOT NULL THEN kind IN ('Two colors', 'Three colors') ELSE length(filter_context) IN (2, 3) END)
    SELECT *, {GRADE.format(w='card_wr', a='deck_wr')} AS grade FROM x""")
def j4_card_cross_performance(s, d):
    return cards.card_cross_performance(_card_stats(s, d), _arch(s, d), 20).drop("diff")


@query(f"""WITH t AS (SELECT DISTINCT set_code, format, pair, k FROM fx_archetype_stats CROSS JOIN {_PAIRS_SQL}), o AS (SELECT *, {q_key('colors')} AS k2 FROM fx_archetype_stats WHERE {REAL} AND {q_type('colors')} = 'Two colors')
    SELECT t.set_code, t.format, pair AS code, coalesce(archetype_name, pair) AS archetype_name, coalesce(win_rate, 0.0) AS win_rate, coalesce(games_count, 0) AS games_count FROM t LEFT JOIN o ON o.set_code = t.set_code AND o.format = t.format AND o.k2 = t.k""")
def j5_archetype_grid(s, d):
    return cards.archetype_grid(_arch(s, d))


_TRIOS_SQL = "(VALUES " + ", ".join(f"('{''.join(sorted(p))}', '{p}')" for p in C.TRIOS) + ") AS p(k, trio)"


@query(f"""WITH t AS (SELECT DISTINCT set_code, format, trio, k FROM fx_archetype_stats CROSS JOIN {_TRIOS_SQL}), o AS (SELECT *, {q_key('colors')} AS k2 FROM fx_archetype_stats WHERE {REAL} AND {q_type('colors')} = 'Three colors')
    SELECT t.set_code, t.format, trio AS code, coalesce(archetype_name, trio) AS archetype_name, coalesce(win_rate, 0.0) AS win_rate, coalesce(games_count, 0) AS games_count FROM t LEFT JOIN o ON o.set_code = t.set_code AND o.format = t.format AND o.k2 = t.k""")
def j5_archetype_grid_trios(s, d):
    return cards.archetype_grid(_arch(s, d), "Three colors")


def _half_dictionary(s: SparkSession, d: str) -> DataFrame:
    return fx.frame(s, d, "fx_card_list").where("arena_id % 2 = 0").select(F.col("card_name").alias("name"), "card_cmc", "card_cost", "card_type").distinct()


@query("SELECT c.set_code, c.format, c.filter_context, c.card_name, l.card_type, l.card_cmc FROM fx_card_stats c LEFT JOIN fx_card_list l ON l.set_code = c.set_code AND l.card_name = c.card_name AND arena_id % 2 = 0")
def j6_enrich_cards(s, d):
    return cards.enrich_cards(_card_stats(s, d), _half_dictionary(s, d)).select("set_code", "format", "filter_context", "card_name", "card_type", "card_cmc")


@query("SELECT DISTINCT card_name FROM fx_card_list WHERE arena_id % 2 <> 0 AND card_name IN (SELECT card_name FROM fx_card_stats)")
def j6_unmatched_names(s, d):
    return cards.unmatched_names(_card_stats(s, d), _half_dictionary(s, d))


_EDITED = """names AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT name, CASE length(name) % 4 WHEN 0 THEN name WHEN 1 THEN name || ' // Back' WHEN 2 THEN substr(name, 1, length(name) - 1) ELSE upper(name) END AS query FROM names)"""


def _edited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = fx.frame(s, d, "part").select(F.col("p_name").alias("name")).distinct()
    n = F.length("name") % 4
    q = F.when(n == 0, F.col("name")).when(n == 1, F.concat("name", F.lit(" // Back"))).when(n == 2, F.col("name").substr(F.lit(1), F.length("name") - 1)).otherwise(F.upper("name"))
    return names.select(q.alias("query")), names


@query(f"""WITH {_EDITED}, u AS (SELECT DISTINCT query FROM q), c AS (SELECT query, n.name, CASE WHEN query = n.name THEN 0 WHEN split_part(query, ' // ', 1) = n.name THEN 1 ELSE 2 END AS t, levenshtein(lower(query), lower(n.name)) AS dist FROM u JOIN names n ON query = n.name OR split_part(query, ' // ', 1) = n.name OR levenshtein(lower(query), lower(n.name)) <= 2)
    SELECT query, name, CASE t WHEN 0 THEN 'exact' WHEN 1 THEN 'front' ELSE 'fuzzy' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY t, dist, name) AS r FROM c) WHERE r = 1""")
def j7_resolve_names(s, d):
    return cards.resolve_names(*_edited(s, d))


@query(f"""WITH {_EDITED}, known AS (SELECT name FROM names WHERE ascii(name) % 2 = 0), u AS (SELECT DISTINCT CASE WHEN length(query) % 2 = 0 THEN 'x' || substr(query, 2) ELSE query END AS query FROM q),
    c AS (SELECT query, n.name, CASE WHEN query = n.name THEN 0 WHEN split_part(query, ' // ', 1) = n.name THEN 1 END + CASE WHEN n.name IN (FROM known) THEN 0 ELSE 2 END AS t, levenshtein(lower(query), lower(n.name)) AS dist FROM u JOIN names n ON query = n.name OR split_part(query, ' // ', 1) = n.name OR levenshtein(lower(query), lower(n.name)) <= 2)
    SELECT query, name, CASE t WHEN 0 THEN 'exact' WHEN 1 THEN 'front' WHEN 2 THEN 'elsewhere' WHEN 3 THEN 'elsewhere' ELSE 'fuzzy' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coalesce(t, 4), dist, name) AS r FROM c) WHERE r = 1""")
def j7_other_sets(s, d):
    """Half of the names are in this set's dictionary, and half of the queries have another first letter."""
    asked, names = _edited(s, d)
    asked = asked.select(F.when(F.length("query") % 2 == 0, F.concat(F.lit("x"), F.col("query").substr(F.lit(2), F.length("query")))).otherwise(F.col("query")).alias("query"))
    return cards.resolve_names(asked, names.where(F.ascii("name") % 2 == 0), elsewhere=names)


@query(f"""WITH {_EDITED}, u AS (SELECT DISTINCT query, regexp_replace(lower(query), '[^a-z0-9]', '', 'g') AS a FROM q), m AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS b FROM names),
    c AS (SELECT query, name, CASE WHEN a = b THEN 0 ELSE 1 END AS t FROM u JOIN m ON a = b OR contains(a, b) OR contains(b, a)) SELECT query, name FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY t, name) AS r FROM c) WHERE r = 1""")
def j8_match_names(s, d):
    return cards.match_names_normalized(*_edited(s, d))


@query("SELECT set_code, card_name, CASE WHEN arena_id % 2 = 0 THEN arena_id + 1000 ELSE arena_id END AS arena_id FROM fx_card_list")
def j9_apply_arena_ids(s, d):
    listed = fx.frame(s, d, "fx_card_list")
    feed = listed.select("set_code", F.col("card_name").alias("name"), F.when(F.col("arena_id") % 2 == 0, F.col("arena_id") + 1000).otherwise(0).alias("mtga_id"))
    return cards.apply_arena_ids(listed, feed).select("set_code", "card_name", "arena_id")


@query(f"""SELECT set_code, format, card_name, {RARITY} AS rarity_code, count(*) OVER (PARTITION BY set_code, format, rarity) AS rarity_peers,
    CASE WHEN colors <> '' THEN count(*) OVER (PARTITION BY set_code, format, rarity, {q_key('colors')}) ELSE 0 END AS color_peers FROM fx_card_stats WHERE filter_context = 'Global'""")
def j11_card_peers(s, d):
    return cards.card_peers(_card_stats(s, d))


@query(f"""WITH g AS (SELECT *, {q_key('colors')} AS k FROM fx_card_stats WHERE filter_context = 'Global'), t AS (SELECT set_code, format, card_name,
    row_number() OVER (PARTITION BY set_code, format, rarity ORDER BY gih_wr DESC, card_name) AS rk, count(*) OVER (PARTITION BY set_code, format, rarity) AS tot,
    CASE WHEN k IS NOT NULL THEN row_number() OVER (PARTITION BY set_code, format, rarity, k ORDER BY alsa, card_name) END AS color_alsa_rank FROM g)
    SELECT set_code, format, card_name, rk AS rarity_gih_wr_rank, tot AS rarity_gih_wr_total, color_alsa_rank, round(greatest(5, least(100, (tot - rk) / tot * 100)), 6) AS bar, CASE WHEN rk <= ceil(tot * 0.15) THEN 'top' WHEN rk >= floor(tot * 0.85) THEN 'bad' ELSE 'mid' END AS mark FROM t""")
def w5_peer_ranks(s, d):
    return rounded(cards.peer_ranks(_card_stats(s, d)).select("set_code", "format", "card_name", "rarity_gih_wr_rank", "rarity_gih_wr_total", "color_alsa_rank", "bar", "mark"))


_LIMIT = "lim AS (SELECT set_code, format, colors_key, list(gih_wr ORDER BY gih_wr DESC)[CAST(floor(count(*) * 0.25) AS INT) + 1] AS threshold FROM ac WHERE gih_wr IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"WITH {_ARCH_CARDS}, {_LIMIT} SELECT * FROM lim")
def w6_top_quarter_threshold(s, d):
    return cards.top_quarter_threshold(cards.archetype_cards(_card_stats(s, d)), ["set_code", "format", "colors_key"])


@query("SELECT set_code, format, filter_context, card_name, gih_wr FROM fx_card_stats ORDER BY gih_wr DESC NULLS LAST, card_name, set_code, format, filter_context LIMIT 40")
def t1_sort_cards(s, d):
    """A page of the sorted cards; full ties are broken by the remaining keys."""
    rows = _card_stats(s, d).withColumn("label", F.col("card_name")).withColumn("card_name", F.concat_ws("\x01", "card_name", "set_code", "format", "filter_context"))
    return cards.sort_cards(rows, "gih_wr").select("set_code", "format", "filter_context", F.col("label").alias("card_name"), "gih_wr")


@query(f"""WITH {_ARCH_CARDS}, {_LIMIT}, {MEAN_WR}, dk AS (SELECT set_code, format, archetype_name, {q_key('colors')} AS colors_key, win_rate AS deck_wr FROM fx_archetype_stats WHERE {REAL} AND {q_type('colors')} IN ('Two colors', 'Three colors', 'Mono-color')),
    x AS (SELECT dk.*, ac.card_name, ac.gih_wr, ac.global_wr, ac.alsa, ac.colors, upper(substr(ac.rarity, 1, 1)) AS rc, threshold, mean_wr, contains(lower(dk.format), 'sealed') AS sealed FROM dk JOIN ac USING (set_code, format, colors_key) JOIN lim USING (set_code, format, colors_key) JOIN mean_wr USING (set_code, format)),
    tp AS (SELECT *, CASE rc WHEN 'C' THEN 'commons' ELSE 'uncommons' END AS section, row_number() OVER (PARTITION BY set_code, format, archetype_name, rc ORDER BY gih_wr DESC, card_name) AS rank FROM x WHERE rc IN ('C', 'U') AND gih_wr <> 0),
    tops AS (SELECT * FROM tp WHERE rank <= 5),
    best AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, archetype_name ORDER BY CASE rc WHEN 'C' THEN 0 ELSE 1 END, gih_wr DESC, card_name) AS b FROM tops),
    gems AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, archetype_name ORDER BY gih_wr - global_wr DESC, card_name) AS rank FROM x WHERE gih_wr <> 0 AND global_wr <> 0 AND gih_wr >= mean_wr AND (sealed OR alsa > 4) AND gih_wr > global_wr + 1 AND CASE WHEN sealed THEN gih_wr > deck_wr ELSE gih_wr > deck_wr - 1 END
        AND NOT EXISTS (SELECT 1 FROM tops t WHERE t.set_code = x.set_code AND t.format = x.format AND t.archetype_name = x.archetype_name AND t.card_name = x.card_name)),
    traps AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, archetype_name ORDER BY gih_wr, card_name) AS rank FROM x WHERE gih_wr <> 0 AND global_wr <> 0 AND (length(colors) = 0 OR contains(colors_key, substr(colors, 1, 1))) AND (length(colors) < 2 OR contains(colors_key, substr(colors, 2, 1)))
        AND gih_wr < threshold AND gih_wr <= mean_wr + 4 AND (sealed OR alsa <= 4) AND gih_wr < global_wr - 1 AND CASE WHEN sealed THEN gih_wr < deck_wr ELSE gih_wr < deck_wr + 0.5 END)
    SELECT set_code, format, archetype_name, section, rank, card_name, gih_wr FROM tops UNION ALL SELECT set_code, format, archetype_name, 'best', b, card_name, gih_wr FROM best WHERE b = 1
    UNION ALL SELECT set_code, format, archetype_name, 'gems', rank, card_name, gih_wr FROM gems WHERE rank <= 5 UNION ALL SELECT set_code, format, archetype_name, 'traps', rank, card_name, gih_wr FROM traps WHERE rank <= 5""")
def t2_archetype_dashboard(s, d):
    return cards.archetype_dashboard(_card_stats(s, d), _arch(s, d))


_GRID = [("Bomb", "Underrated Bomb", "Absolute Gem", "Absolute Gem"), ("Top Tier", "Underrated Top Tier", "Underrated Gem", "Underrated Gem"), ("Overrated Top Tier", "Good Pick", "Gem", "Good Filler"), ("Overhyped Trap", "Bait", "Mediocre", "Filler"), ("Overhyped Trap", "Bait", "Chaff", "Unplayable")]


@query(f"""WITH {MEAN_WR}, a AS (SELECT set_code, format, mean_wr AS avg_wr, avg_alsa, mn, mx FROM (SELECT set_code, format, avg(alsa) AS avg_alsa, min(gih_wr) AS mn, max(gih_wr) AS mx FROM fx_card_stats WHERE filter_context = 'Global' GROUP BY 1, 2) JOIN mean_wr USING (set_code, format)),
    x AS (SELECT c.set_code, c.format, card_name, gih_wr AS w, alsa, avg_wr, mx, CASE WHEN alsa < (1.25 + avg_alsa) / 2 THEN 1 WHEN alsa < avg_alsa THEN 2 WHEN alsa < (avg_alsa + 8.75) / 2 THEN 3 ELSE 4 END AS col,
      CASE WHEN gih_wr >= avg_wr + (ceil(mx + 1) - avg_wr) * 2 / 3 THEN 1 WHEN gih_wr >= avg_wr + (ceil(mx + 1) - avg_wr) / 3 THEN 2 WHEN gih_wr >= avg_wr THEN 3 WHEN gih_wr >= avg_wr - (avg_wr - floor(mn - 1)) / 2 THEN 4 ELSE 5 END AS rw
      FROM fx_card_stats c JOIN a USING (set_code, format) WHERE filter_context = 'Global' AND gih_wr <> 0)
    SELECT set_code, format, card_name, CASE WHEN w >= mx - 4 THEN 'Bomb' WHEN abs(w - avg_wr) <= 0.5 AND col IN (2, 3) THEN 'Playable' WHEN rw = 3 AND col = 1 AND alsa >= 2 THEN 'Top Tier'
      ELSE ([{', '.join('[' + ', '.join(f"'{v}'" for v in r) + ']' for r in _GRID)}])[rw][col] END AS status FROM x""")
def t3_evaluate_cards(s, d):
    return cards.evaluate_cards(_card_stats(s, d), _arch(s, d)).select("set_code", "format", "card_name", "status")


_PLAIN_TIERS = "CASE " + " ".join(f"WHEN gih_wr - mean_wr >= {e} THEN '{n}'" for e, n in ((9, "Bomb"), (7, "Top Tier"), (5, "Very Good"), (3, "Good"), (1, "Solid Playable"), (-1, "Playable"), (-3, "Filler"), (-5, "Bad"))) + " ELSE 'Chaff' END"


@query(f"WITH {MEAN_WR} SELECT set_code, format, card_name, {_PLAIN_TIERS} AS status FROM fx_card_stats JOIN mean_wr USING (set_code, format) WHERE filter_context = 'Global' AND gih_wr <> 0")
def t3_evaluate_without_alsa(s, d):
    return cards.evaluate_cards(_card_stats(s, d).withColumn("alsa", F.lit(None).cast("double")), _arch(s, d)).select("set_code", "format", "card_name", "status")


@query(f"""WITH {_BEST_DECK}, {MEAN_WR}, m AS (SELECT set_code, format, filter_context, avg(alsa) AS ma FROM fx_card_stats WHERE gih_wr IS NOT NULL GROUP BY 1, 2, 3),
    r AS (SELECT *, CASE WHEN filter_context <> 'Global' THEN {q_key('filter_context')} END AS k FROM fx_card_stats JOIN mean_wr USING (set_code, format) WHERE gih_wr <> 0 AND alsa <> 0)
    SELECT r.set_code, r.format, r.filter_context, card_name, CASE WHEN gih_wr >= coalesce(win_rate, mean_wr) AND NOT alsa >= ma THEN 'Top tier' WHEN gih_wr >= coalesce(win_rate, mean_wr) THEN 'Gem' WHEN NOT alsa >= ma THEN 'Overrated' ELSE 'Chaff' END AS quadrant
    FROM r JOIN m USING (set_code, format, filter_context) LEFT JOIN bd ON bd.set_code = r.set_code AND bd.format = r.format AND bd.k = r.k""")
def t4_matrix_quadrants(s, d):
    return cards.matrix_quadrants(_card_stats(s, d), _arch(s, d))


# ---- formats ----

@query(f"SELECT set_code, format, archetype_name FROM fx_archetype_stats WHERE length({q_extract('colors')}) = 2 OR (length({q_extract('colors')}) = 3 AND NOT contains(colors, 'Splash'))")
def f4_filter_archetypes(s, d):
    return formats.filter_archetypes(_arch(s, d)).select("set_code", "format", "archetype_name")


@query("SELECT set_code, format, archetype_name, mode FROM (" + " UNION ALL ".join(f"SELECT *, '{m}' AS mode FROM fx_archetype_stats WHERE {w}" for m, w in (
    ("2color", f"length({q_extract('colors')}) = 2 AND NOT contains(colors, 'Splash')"), ("splash", f"length({q_extract('colors')}) = 2 AND contains(colors, 'Splash')"), ("3color", f"length({q_extract('colors')}) = 3"))) + ")")
def f4_filter_archetypes_modes(s, d):
    one = lambda m: formats.filter_archetypes(_arch(s, d), m).select("set_code", "format", "archetype_name", F.lit(m).alias("mode"))
    return one("2color").unionByName(one("splash")).unionByName(one("3color"))


def _blueprint(mode: str, where: str = "true") -> str:
    used = {"all": "true", "top10": "b <= 10", "bottom10": "w <= 10"}[mode]
    return f"""WITH {MEAN_WR}, {GLOBAL_CARDS}, f AS (SELECT * FROM g WHERE {where}), k AS (SELECT set_code, format, card_name, gih_wr, 'rarity' AS axis, rarity_code AS value FROM f UNION ALL SELECT set_code, format, card_name, gih_wr, 'color', color_class FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, axis, value ORDER BY gih_wr DESC, card_name) AS b, row_number() OVER (PARTITION BY set_code, format, axis, value ORDER BY gih_wr, card_name) AS w FROM k)
    SELECT *, CASE WHEN axis = 'color' THEN row_number() OVER (PARTITION BY set_code, format, axis ORDER BY delta DESC, value) END AS place FROM (
    SELECT set_code, format, axis, value, count(*) AS cards, round(avg(gih_wr), 6) AS mean_wr, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(gih_wr) END, 6) AS sigma, round(avg(gih_wr) - max(mean_wr), 6) AS delta,
      CASE WHEN CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(gih_wr) END < 2 THEN 'Very consistent' WHEN stddev_pop(gih_wr) < 4 THEN 'Moderate spread' ELSE 'High variance' END AS consistency
    FROM r JOIN mean_wr USING (set_code, format) WHERE {used} GROUP BY 1, 2, 3, 4)"""


@query(_blueprint("all"))
def a21_blueprint_stats(s, d):
    return rounded(formats.blueprint_stats(_card_stats(s, d), _arch(s, d)))


@query(_blueprint("top10"))
def a21_blueprint_top10(s, d):
    return rounded(formats.blueprint_stats(_card_stats(s, d), _arch(s, d), "top10"))


@query(_blueprint("bottom10", "rarity_code IN ('C', 'U') AND (length(color_class) = 1 AND color_class IN ('W', 'U', 'M'))"))
def a21_blueprint_bottom10(s, d):
    return rounded(formats.blueprint_stats(_card_stats(s, d), _arch(s, d), "bottom10", ["C", "U"], ["W", "U", "M"]))


@query(f"""WITH {GLOBAL_CARDS}, k AS (SELECT set_code, format, card_name, gih_wr, 'rarity' AS axis, rarity_code AS value FROM g UNION ALL SELECT set_code, format, card_name, gih_wr, 'color', color_class FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, axis, value ORDER BY gih_wr DESC, card_name) AS b, row_number() OVER (PARTITION BY set_code, format, axis, value ORDER BY gih_wr, card_name) AS w FROM k)
    SELECT set_code, format, axis, value, 'best' AS list, b AS rank, card_name, gih_wr FROM r WHERE b <= 10 UNION ALL SELECT set_code, format, axis, value, 'worst', w, card_name, gih_wr FROM r WHERE w <= 10""")
def a21_blueprint_lists(s, d):
    return formats.blueprint_lists(_card_stats(s, d))


@query(f"WITH {MEAN_WR}, {GLOBAL_CARDS} SELECT set_code, format, round(sqrt(avg((gih_wr - mean_wr) * (gih_wr - mean_wr))), 6) AS sigma, count(*) AS cards FROM g JOIN mean_wr USING (set_code, format) GROUP BY 1, 2")
def a21_format_spread(s, d):
    return rounded(formats.format_spread(_card_stats(s, d), _arch(s, d)))


_BALANCE = f"""{GLOBAL_CARDS}, sh AS (SELECT *, games_count / sum(games_count) OVER (PARTITION BY set_code, format) AS share FROM fx_archetype_stats WHERE {REAL}),
    ar AS (SELECT set_code, format, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(win_rate) END AS sa FROM sh WHERE share >= 0.01 AND win_rate > 0 GROUP BY 1, 2),
    mc AS (SELECT set_code, format, color_class, avg(gih_wr) AS m FROM g WHERE color_class IN ('W', 'U', 'B', 'R', 'G') GROUP BY 1, 2, 3), co AS (SELECT set_code, format, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(m) END AS sc FROM mc GROUP BY 1, 2),
    bal AS (SELECT set_code, format, greatest(0, least(10, floor((3.25 - sa) / 2.25 * 100 + 0.5) / 10)) AS archetype_score, sa, greatest(0, least(10, floor((1.75 - sc) / 1.5 * 100 + 0.5) / 10)) AS color_score, sc FROM ar FULL JOIN co USING (set_code, format))"""


@query(f"WITH {_BALANCE} SELECT set_code, format, round(archetype_score, 6) AS archetype_score, round(sa, 6) AS archetype_stddev, round(color_score, 6) AS color_score, round(sc, 6) AS color_stddev FROM bal")
def a22_format_balance(s, d):
    return rounded(formats.format_balance(_arch(s, d), _card_stats(s, d)).select("set_code", "format", "archetype_score", "archetype_stddev", "color_score", "color_stddev"))


@query(f"""WITH {_BALANCE}, u AS (SELECT format, set_code, 'archetype' AS score, archetype_score AS v FROM bal UNION ALL SELECT format, set_code, 'color', color_score FROM bal)
    SELECT format, score, round(avg(v), 6) AS mean_score, list(set_code ORDER BY v DESC, set_code)[1] AS best_set, round(max(v), 6) AS best, list(set_code ORDER BY v, set_code)[1] AS worst_set, round(min(v), 6) AS worst FROM u WHERE v IS NOT NULL GROUP BY 1, 2""")
def a23_balance_extremes(s, d):
    return rounded(formats.balance_extremes(formats.format_balance(_arch(s, d), _card_stats(s, d))))


_RADAR = f"""{MEAN_WR}, {GLOBAL_CARDS}, rk AS (SELECT g.*, mean_wr, CASE WHEN rarity_code IN ('M', 'R') THEN 'MR' ELSE rarity_code END AS c FROM g JOIN mean_wr USING (set_code, format)),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, c ORDER BY gih_wr DESC, card_name) AS r FROM rk),
    ag AS (SELECT set_code, format, max(mean_wr) AS m, coalesce(avg(gih_wr) FILTER (c = 'MR' AND r <= 15), max(mean_wr)) AS mr15, coalesce(avg(gih_wr) FILTER (c = 'C' AND r <= 10), max(mean_wr)) AS c10, coalesce(avg(gih_wr) FILTER (c = 'U' AND r <= 10), max(mean_wr)) AS u10,
        coalesce(avg(gih_wr) FILTER (c = 'MR' AND r <= 20), max(mean_wr)) AS mr20, coalesce(count(*) FILTER (c IN ('C', 'U') AND gih_wr < mean_wr - 2) / nullif(count(*) FILTER (c IN ('C', 'U')), 0), 0) AS bad FROM r2 GROUP BY 1, 2),
    ax AS (SELECT set_code, format, greatest(0, least(10, (mr15 / m - 1) * 50)) AS a1, greatest(0, least(10, (1.15 - c10 / m) * 60)) AS a2, greatest(0, least(10, (1.15 - u10 / m) * 60)) AS a3, greatest(0, least(10, (mr20 / ((c10 + u10) / 2) - 1) * 60)) AS a4, greatest(0, least(10, bad * 20)) AS a5 FROM ag)"""


@query(f"""WITH {_RADAR}, ar AS (SELECT *, 0.475 * (a1 * a2 + a2 * a3 + a3 * a4 + a4 * a5 + a5 * a1) AS area FROM ax) SELECT set_code, format, round(a1, 6) AS bombs, round(a2, 6) AS commons, round(a3, 6) AS uncommons, round(a4, 6) AS gap, round(a5, 6) AS filler, round(area, 6) AS area,
    CASE WHEN area >= 90 THEN 'PRINCE' WHEN area >= 60 THEN 'BALANCED' ELSE 'PAUPER' END AS kind FROM ar""")
def a24_format_radar(s, d):
    return rounded(formats.format_radar(_card_stats(s, d), _arch(s, d)).drop("percent", "leaning"))


@query(f"""WITH {_RADAR}, l AS (SELECT set_code, format, unnest([{{'axis': 'bombs', 'v': a1}}, {{'axis': 'commons', 'v': a2}}, {{'axis': 'uncommons', 'v': a3}}, {{'axis': 'gap', 'v': a4}}, {{'axis': 'filler', 'v': a5}}]) AS s FROM ax)
    SELECT x.s.axis AS axis, round(x.s.v, 6) AS a, round(y.s.v, 6) AS b, round(x.s.v - y.s.v, 6) AS delta FROM l x JOIN l y ON x.s.axis = y.s.axis WHERE x.set_code = 'F' AND x.format = 'Sealed' AND y.set_code = 'O' AND y.format = 'TradDraft'""")
def j13_compare_formats_radar(s, d):
    return rounded(formats.compare_formats_radar(formats.format_radar(_card_stats(s, d), _arch(s, d)), ("F", "Sealed"), ("O", "TradDraft")))


@query(f"WITH {MEAN_WR} SELECT set_code, card_name, " + ", ".join(f"max(gih_wr) FILTER (format = '{f}') AS card_wr_{x}, round(max(gih_wr - mean_wr) FILTER (format = '{f}'), 6) AS card_delta_{x}" for f, x in formats.SHORT.items()) + " FROM fx_card_stats JOIN mean_wr USING (set_code, format) WHERE filter_context = 'Global' GROUP BY 1, 2")
def a29_card_format_pivot(s, d):
    return rounded(formats.card_format_pivot(_card_stats(s, d), _arch(s, d)))


_ARCH_PIVOT = f"{MEAN_WR}, sh AS (SELECT *, games_count / sum(games_count) OVER (PARTITION BY set_code, format) AS share FROM fx_archetype_stats WHERE {REAL}), pv AS (SELECT set_code, archetype_name, colors, " + ", ".join(
    f"max(win_rate) FILTER (format = '{f}') AS arch_wr_{x}, round(max(win_rate - mean_wr) FILTER (format = '{f}'), 6) AS arch_delta_{x}, round(max(share) FILTER (format = '{f}'), 6) AS meta_share_{x}" for f, x in formats.SHORT.items()) + " FROM sh JOIN mean_wr USING (set_code, format) GROUP BY 1, 2, 3)"


@query(f"WITH {_ARCH_PIVOT} SELECT * FROM pv")
def a29_archetype_format_pivot(s, d):
    return rounded(formats.archetype_format_pivot(_arch(s, d)))


@query(f"WITH {_ARCH_PIVOT} SELECT set_code, archetype_name, meta_share_premier AS value_a, meta_share_sealed AS value_b, round(meta_share_premier - meta_share_sealed, 5) AS diff FROM pv WHERE meta_share_premier IS NOT NULL AND meta_share_sealed IS NOT NULL")
def a30_compare_formats(s, d):
    out = formats.compare_formats(rounded(formats.archetype_format_pivot(_arch(s, d))), "premier", "sealed", "archetypes", "metashare")
    return out.withColumn("diff", F.round("diff", 5))


@query("WITH c AS (SELECT set_code, card_name, max(gih_wr) FILTER (format = 'PremierDraft') AS value_a, max(gih_wr) FILTER (format = 'TradDraft') AS value_b FROM fx_card_stats WHERE filter_context = 'Global' GROUP BY 1, 2) SELECT *, round(value_a - value_b, 5) AS diff FROM c WHERE value_a IS NOT NULL AND value_b IS NOT NULL")
def a30_compare_cards(s, d):
    out = formats.compare_formats(rounded(formats.card_format_pivot(_card_stats(s, d), _arch(s, d))), "premier", "trad")
    return out.withColumn("diff", F.round("diff", 5))


# ---- skeletons ----

def _decks(s: SparkSession, d: str) -> DataFrame:
    return fx.decks_with_cards(s, d).withColumn("is_alternative", F.lit(False))


_META = "meta AS (SELECT l.set_code, f.format, l.card_name, l.card_cmc, l.card_type, g.gih_wr, g.alsa FROM fx_card_list l JOIN (SELECT DISTINCT set_code, format FROM fx_card_stats) f USING (set_code) LEFT JOIN (SELECT * FROM fx_card_stats WHERE filter_context = 'Global') g ON g.set_code = l.set_code AND g.format = f.format AND g.card_name = l.card_name)"
_FREQ = f"""{_META}, wd AS (SELECT *, {WEIGHT} AS weight FROM fx_decks), tw AS (SELECT set_code, format, archetype, sum(weight) AS w FROM wd GROUP BY 1, 2, 3),
    fr AS (SELECT i.set_code, i.format, i.archetype, i.card_name, sum(wd.weight * qty) AS weight_sum, sum(wd.weight * qty) / max(w) AS freq FROM fx_items i JOIN wd USING (aggregate_id) JOIN tw ON tw.set_code = i.set_code AND tw.format = i.format AND tw.archetype = i.archetype JOIN meta m ON m.set_code = i.set_code AND m.format = i.format AND m.card_name = i.card_name GROUP BY 1, 2, 3, 4),
    nl AS (SELECT fr.*, m.alsa, m.gih_wr FROM fr JOIN meta m USING (set_code, format, card_name) WHERE NOT contains(card_type, 'Land')),
    mm AS (SELECT set_code, format, coalesce(avg(gih_wr) FILTER (gih_wr <> 0), 55.0) AS avg_wr, coalesce(avg(alsa), 4.0) AS avg_alsa FROM meta GROUP BY 1, 2)"""


@query("""WITH n AS (SELECT set_code, format, archetype, count(DISTINCT aggregate_id) AS n FROM fx_items GROUP BY 1, 2, 3), core AS (SELECT set_code, format, archetype, list(card_name) AS k FROM (SELECT i.set_code, i.format, i.archetype, card_name FROM fx_items i JOIN n USING (set_code, format, archetype) GROUP BY 1, 2, 3, 4 HAVING count(*) * 10 >= max(n)) GROUP BY 1, 2, 3),
    d AS (SELECT aggregate_id, set_code, format, archetype, list(card_name) AS c FROM fx_items GROUP BY 1, 2, 3, 4)
    SELECT aggregate_id, round(len(list_intersect(c, coalesce(k, []))) / len(list_distinct(list_concat(c, coalesce(k, [])))), 6) AS similarity FROM d LEFT JOIN core USING (set_code, format, archetype)""")
def m1_jaccard(s, d):
    """Each deck against the cards that a tenth of its archetype's decks have."""
    key = ["set_code", "format", "archetype"]
    decks = _deck_table(s, d).where(F.size("cardlist") > 0).select(*key, "aggregate_id", F.map_keys("cardlist").alias("c"))
    n = decks.groupBy(*key).agg(F.count("*").alias("n"))
    held = decks.select(*key, F.explode("c").alias("card")).groupBy(*key, "card").agg(F.count("*").alias("m")).join(n, key).where(F.col("m") * 10 >= F.col("n"))
    core = held.groupBy(*key).agg(F.collect_list("card").alias("k"))
    # a row a group: a shuffle would deal all decks out by one of the few groups
    both = decks.join(F.broadcast(core), key, "left").withColumn("k", F.coalesce("k", F.array().cast("array<string>")))
    return rounded(both.select("aggregate_id", skeletons.jaccard("c", "k").alias("similarity")))


_CURVE = ", ".join(f"round(coalesce(sum(weight * c{i}), 0) / max(w), 1) AS curve_{i}" for i in range(8))


@query(f"""WITH {_META}, wd AS (SELECT d.*, {WEIGHT} AS weight FROM fx_decks d JOIN (SELECT aggregate_id, sum(qty) AS n FROM fx_items GROUP BY 1) z USING (aggregate_id) WHERE z.n >= 35),
    dk AS (SELECT i.aggregate_id, i.set_code, i.format, i.archetype, weight, coalesce(sum(qty) FILTER (contains(card_type, 'Land')), 0) AS lands, coalesce(sum(qty) FILTER (contains(card_type, 'Creature')), 0) AS creatures,
        {', '.join(f"coalesce(sum(qty) FILTER (NOT contains(card_type, 'Land') AND least(CAST(card_cmc AS INT), 7) = {i}), 0) AS c{i}" for i in range(8))}
        FROM fx_items i JOIN wd USING (aggregate_id) JOIN meta m ON m.set_code = i.set_code AND m.format = i.format AND m.card_name = i.card_name GROUP BY 1, 2, 3, 4, 5),
    tw AS (SELECT set_code, format, archetype, sum(weight) AS w, count(*) AS full_decks FROM wd GROUP BY 1, 2, 3)
    SELECT dk.set_code, dk.format, dk.archetype, max(full_decks) AS full_decks, round(sum(weight * lands) / max(w), 6) AS avg_lands, round(sum(weight * creatures) / max(w), 6) AS avg_creatures, {_CURVE} FROM dk JOIN tw USING (set_code, format, archetype) GROUP BY 1, 2, 3""")
def a13_deck_profile(s, d):
    p = skeletons.deck_profile(_decks(s, d), fx.meta(s, d), as_of(), BOUNDS)
    return rounded(p.select("set_code", "format", "archetype", "full_decks", "avg_lands", "avg_creatures", *[F.element_at("avg_mana_curve", F.lit(str(i))).alias(f"curve_{i}") for i in range(8)]))


def _freq(s: SparkSession, d: str) -> DataFrame:
    return skeletons.weighted_frequency(_decks(s, d), fx.meta(s, d), as_of(), BOUNDS)


@query(f"WITH {_FREQ} SELECT set_code, format, archetype, card_name, round(weight_sum, 6) AS weight_sum, round(freq, 6) AS freq FROM fr")
def a14_weighted_frequency(s, d):
    return rounded(_freq(s, d).drop("is_alternative"))


_SCORES = f"""{_FREQ}, {_PARTNERS}, pil AS (SELECT set_code, format, archetype, card_name AS pillar FROM (SELECT *, row_number() OVER (PARTITION BY set_code, format, archetype ORDER BY freq DESC, card_name) AS r FROM fr) WHERE r <= 15),
    ps AS (SELECT set_code, format, archetype, partner AS card_name, avg(synergy_score) AS syn FROM pil JOIN (SELECT set_code, format, card_name AS pillar, partner, synergy_score FROM both_ways WHERE synergy_score > 0) b USING (set_code, format, pillar) GROUP BY 1, 2, 3, 4),
    sc AS (SELECT fr.*, coalesce(syn, 0) AS syn FROM fr LEFT JOIN ps USING (set_code, format, archetype, card_name))"""


@query(f"WITH {_SCORES} SELECT set_code, format, archetype, card_name, round(syn, 9) AS syn, round(0.8 * freq + 0.2 * least(syn / 10, 1), 9) AS score FROM sc")
def a15_a16_candidate_scores(s, d):
    return rounded(skeletons.candidate_scores(_freq(s, d), _syn(s, d)).select("set_code", "format", "archetype", "card_name", "syn", "score"), 9)


@query(f"""WITH {_FREQ}, z AS (SELECT nl.*, (alsa - avg_alsa) * freq AS sc, row_number() OVER (PARTITION BY set_code, format, archetype ORDER BY (alsa - avg_alsa) * freq DESC, card_name) AS rank FROM nl JOIN mm USING (set_code, format) WHERE alsa > avg_alsa AND freq >= 0.15)
    SELECT set_code, format, archetype, rank, card_name, round(alsa, 2) AS alsa, round(freq * 100, 1) AS frequency, round(sc, 3) AS score FROM z WHERE rank <= 5""")
def a17_sleeper_cards(s, d):
    return skeletons.sleeper_cards(_freq(s, d), fx.meta(s, d)).drop("is_alternative")


@query(f"""WITH {_META}, dd AS (SELECT *, trophy_time >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AS rc FROM fx_decks), n AS (SELECT set_code, format, archetype, count(*) FILTER (rc) AS nr, count(*) FILTER (NOT rc) AS no FROM dd GROUP BY 1, 2, 3),
    c AS (SELECT i.set_code, i.format, i.archetype, card_name, count(*) FILTER (rc) AS r, count(*) FILTER (NOT rc) AS o FROM fx_items i JOIN dd USING (aggregate_id) GROUP BY 1, 2, 3, 4),
    z AS (SELECT c.*, r / nr AS rf, o / no AS of_, r / nr - o / no AS dl FROM c JOIN n USING (set_code, format, archetype) JOIN meta m USING (set_code, format, card_name) WHERE nr >= 3 AND no >= 3 AND NOT contains(card_type, 'Land')),
    y AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, archetype ORDER BY dl DESC, card_name) AS rank FROM z WHERE dl > 0.15 AND rf > 0.20)
    SELECT set_code, format, archetype, rank, card_name, round(rf * 100, 1) AS recent_freq, round(of_ * 100, 1) AS old_freq, round(dl * 100, 1) AS delta FROM y WHERE rank <= 5""")
def a18_trending_cards(s, d):
    return skeletons.trending_cards(_decks(s, d), fx.meta(s, d), as_of(), DAYS).drop("is_alternative")


@query(f"""WITH {_FREQ}, z AS (SELECT *, sum(weight_sum) OVER (PARTITION BY set_code, format, archetype) AS t, sum(weight_sum) OVER (PARTITION BY set_code, format, archetype ORDER BY weight_sum DESC, card_name ROWS UNBOUNDED PRECEDING) - weight_sum AS b FROM nl),
    y AS (SELECT set_code, format, archetype, count(*) FILTER (b < 0.8 * t) AS n_cards FROM z GROUP BY 1, 2, 3) SELECT set_code, format, archetype, n_cards, CAST(greatest(0, least(100, round_even((n_cards - 25) / 45 * 100, 0))) AS INT) AS openness_score FROM y""")
def a19_openness(s, d):
    return skeletons.openness(_freq(s, d), fx.meta(s, d)).select("set_code", "format", "archetype", "n_cards", "openness_score")


@query(f"""WITH {_SCORES}, z AS (SELECT sc.set_code, sc.format, archetype, card_name, 0.4 * freq + 0.3 * least(syn / 5, 1) + 0.3 * CASE WHEN coalesce(m.gih_wr, 0) <> 0 THEN greatest(0, least(1, (m.gih_wr - avg_wr + 10) / 20)) ELSE 0 END AS imp FROM sc JOIN meta m USING (set_code, format, card_name) JOIN mm USING (set_code, format) WHERE NOT contains(card_type, 'Land')),
    y AS (SELECT *, row_number() OVER (PARTITION BY set_code, format, archetype ORDER BY imp DESC, card_name) AS rank FROM z) SELECT set_code, format, archetype, rank, card_name, round(imp * 100, 1) AS importance FROM y WHERE rank <= 15""")
def a20_importance_cards(s, d):
    scores = skeletons.candidate_scores(_freq(s, d), _syn(s, d))
    return skeletons.importance_cards(scores, fx.meta(s, d)).select("set_code", "format", "archetype", "rank", "card_name", "importance")


@query("SELECT set_code, format, archetype, count(DISTINCT card_name) AS cards, count(DISTINCT CASE WHEN arena_id % 2 = 0 THEN card_name END) AS found FROM fx_items JOIN fx_card_list USING (set_code, card_name) GROUP BY 1, 2, 3")
def a28_dictionary_coverage(s, d):
    known = fx.meta(s, d).where("arena_id % 2 = 0")
    return skeletons.dictionary_coverage(fx.decks_with_cards(s, d), known)


def _jac(x: str, y: str) -> str:
    n = f"len(list_distinct(list_concat({x}, {y})))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / {n} END"


def _clusters_sql() -> str:
    g = "set_code, format, archetype"
    out = f"""WITH base AS (SELECT d.set_code, d.format, d.archetype, d.aggregate_id, coalesce(list(card_name) FILTER (card_name IS NOT NULL AND NOT regexp_matches(card_name, 'Plains|Island|Swamp|Mountain|Forest')), []) AS cards FROM fx_decks d LEFT JOIN (SELECT aggregate_id, card_name FROM fx_items) i USING (aggregate_id) GROUP BY 1, 2, 3, 4),
    big AS (SELECT * FROM base JOIN (SELECT {g} FROM base GROUP BY ALL HAVING count(*) >= 40) USING ({g})),
    pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY md5(CAST(aggregate_id AS VARCHAR)), aggregate_id) AS r FROM big) WHERE r <= 50),
    far AS (SELECT a.set_code, a.format, a.archetype, a.aggregate_id AS ia, b.aggregate_id AS ib, a.cards AS c0, b.cards AS c1, 1 - {_jac('a.cards', 'b.cards')} AS d FROM pick a JOIN pick b ON a.set_code = b.set_code AND a.format = b.format AND a.archetype = b.archetype AND a.aggregate_id < b.aggregate_id),
    cent0 AS (SELECT {g}, c0, c1 FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY d DESC, ia, ib) AS r FROM far) WHERE r = 1)"""
    for k in range(3):
        out += f""",
    near{k} AS (SELECT {g}, aggregate_id, cards, CASE WHEN {_jac('cards', 'c1')} > {_jac('cards', 'c0')} THEN 1 ELSE 0 END AS cluster FROM big JOIN cent{k} USING ({g})),
    n{k} AS (SELECT {g}, count(*) FILTER (cluster = 0) AS n0, count(*) FILTER (cluster = 1) AS n1 FROM near{k} GROUP BY ALL),
    m{k} AS (SELECT {g}, cluster, card, count(*) AS m FROM (SELECT {g}, cluster, unnest(cards) AS card FROM near{k}) GROUP BY ALL),
    h{k} AS (SELECT {g}, coalesce(list(card) FILTER (cluster = 0 AND m * 2 >= n0), []) AS h0, coalesce(list(card) FILTER (cluster = 1 AND m * 2 >= n1), []) AS h1 FROM m{k} JOIN n{k} USING ({g}) GROUP BY ALL),
    cent{k + 1} AS (SELECT c.set_code, c.format, c.archetype, CASE WHEN n0 > 0 THEN coalesce(h0, []) ELSE c0 END AS c0, CASE WHEN n1 > 0 THEN coalesce(h1, []) ELSE c1 END AS c1 FROM cent{k} c JOIN n{k} USING ({g}) LEFT JOIN h{k} USING ({g}))"""
    return out + f""",
    lists AS (SELECT {g}, card, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY {g}, cluster ORDER BY m DESC, card) AS r FROM m2) WHERE r <= 15 GROUP BY ALL),
    common AS (SELECT {g}, count(*) FILTER (k = 2) AS common FROM lists GROUP BY ALL),
    ok AS (SELECT {g}, CASE WHEN n0 >= n1 THEN 1 ELSE 0 END AS alt FROM n2 JOIN common USING ({g}) WHERE least(n0, n1) >= 20 AND least(n0, n1) / (n0 + n1) >= 0.15 AND common <= 9)
    SELECT base.set_code, base.format, base.archetype, base.aggregate_id, coalesce(cluster = alt, false) AS is_alternative FROM base LEFT JOIN ok USING ({g}) LEFT JOIN near2 ON near2.aggregate_id = base.aggregate_id"""


@query(_clusters_sql())
def m2_cluster_decks(s, d):
    decks = _deck_table(s, d)
    out = skeletons.cluster_decks(decks)
    tables.dropped(decks)
    return out


def _skeletons(s: SparkSession, d: str) -> DataFrame:
    orders = saved(fx.orders_with_cards(s, d), "orders")
    decks, meta = fx.decks_of(orders), fx.meta_of(orders)
    frequent = saved(synergy.frequent_cards(decks), "frequent")
    scores = saved(synergy.synergy_scores(decks, min_lift=1.0, frequent=frequent), "synergy")
    out = skeleton_table.skeletons(decks, meta, scores, as_of(), BOUNDS, DAYS)
    tables.dropped(orders, meta, frequent, scores)
    return out


_G = "set_code, format, archetype, is_alternative"


def _list(rows: str, name: str, cols: str) -> str:
    """The ranked rows of each group as a list of structs."""
    return f"{name} AS (SELECT {_G}, list({{'rank': rank, 'name': card_name, {', '.join(f'{chr(39)}{c}{chr(39)}: {c}' for c in cols.split())}}} ORDER BY rank) AS {name}_list FROM {rows} GROUP BY ALL)"


def _half_up(x: str, n: int) -> str:
    """C.half_up."""
    return f"floor(round(({x}) * 1e{n}, 6) + 0.5) / 1e{n}"


def _skeleton_sql() -> str:
    """M4's rows: the clusters' marks, profiles and frequencies by variant, the deck as a recursion over its candidates."""
    curve = ", ".join(f"round(coalesce(sum(weight * c{i}), 0) / max(w), 1)" for i in range(8))
    slots = ", ".join(f"coalesce(sum(qty) FILTER (NOT contains(card_type, 'Land') AND least(CAST(card_cmc AS INT), 7) = {i}), 0) AS c{i}" for i in range(8))
    pips = ", ".join(f"coalesce(sum(n * (length(cost) - length(replace(cost, '{{{x}}}', ''))) / 3), 0)" for x in "WUBRG")
    lands = "[" + ", ".join(f"'{x}'" for x in C.BASIC_LANDS) + "]"
    card = "{'name': card_name, 'cmc': CAST(least(CAST(cmc AS INT), 7) AS DOUBLE), 'type': kind, 'cost': cost, 'rarity': rarity}"
    return f"""WITH RECURSIVE {_META.replace("l.card_type,", "l.card_type, l.card_cost, l.rarity,")}, {_PARTNERS}, clu AS ({_clusters_sql()}),
    enough AS (SELECT set_code, format, archetype FROM fx_decks GROUP BY ALL HAVING count(*) >= 3),
    dk AS (SELECT d.*, is_alternative, {WEIGHT} AS weight, trophy_time >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AS rc FROM fx_decks d JOIN enough USING (set_code, format, archetype) JOIN (SELECT aggregate_id, is_alternative FROM clu) USING (aggregate_id)),
    it AS (SELECT i.aggregate_id, i.card_name, i.qty, dk.set_code, dk.format, dk.archetype, dk.is_alternative, dk.weight, dk.rc FROM fx_items i JOIN dk USING (aggregate_id)),
    fd AS (SELECT * FROM dk JOIN (SELECT aggregate_id FROM fx_items GROUP BY 1 HAVING sum(qty) >= 35) USING (aggregate_id)),
    pd AS (SELECT it.aggregate_id, {', '.join('it.' + x for x in _G.split(', '))}, it.weight, coalesce(sum(qty) FILTER (contains(card_type, 'Land')), 0) AS lands, coalesce(sum(qty) FILTER (NOT contains(card_type, 'Land') AND contains(card_type, 'Creature')), 0) AS creatures, {slots}
        FROM it JOIN fd USING (aggregate_id) JOIN meta m ON m.set_code = it.set_code AND m.format = it.format AND m.card_name = it.card_name GROUP BY ALL),
    tf AS (SELECT {_G}, sum(weight) AS w FROM fd GROUP BY ALL),
    prof AS (SELECT {_G}, coalesce(sum(weight * lands), 0) / max(w) AS avg_lands, coalesce(sum(weight * creatures), 0) / max(w) AS avg_creatures, [{curve}] AS curve FROM tf LEFT JOIN pd USING ({_G}) GROUP BY {_G}),
    goals AS (SELECT *, CAST(round_even(avg_lands, 0) AS INT) AS goal, 40 - CAST(round_even(avg_lands, 0) AS INT) AS spells, CAST(round_even((40 - CAST(round_even(avg_lands, 0) AS INT)) * avg_creatures / greatest(1.0, 40 - avg_lands), 0) AS INT) AS want FROM prof),
    tw AS (SELECT {_G}, sum(weight) AS w, count(*) AS sample_size FROM dk GROUP BY ALL),
    fr AS (SELECT {_G}, card_name, weight_sum, weight_sum / w AS freq FROM (SELECT {_G}, card_name, sum(weight * qty) AS weight_sum FROM it JOIN meta USING (set_code, format, card_name) GROUP BY ALL) JOIN tw USING ({_G})),
    pil AS (SELECT {_G}, card_name AS pillar FROM (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY freq DESC, card_name) AS r FROM fr) WHERE r <= 15),
    ps AS (SELECT {_G}, partner AS card_name, avg(synergy_score) AS syn FROM pil JOIN (SELECT set_code, format, card_name AS pillar, partner, synergy_score FROM both_ways WHERE synergy_score > 0) b USING (set_code, format, pillar) GROUP BY ALL),
    sc AS (SELECT *, round(0.8 * freq + 0.2 * least(syn / 10, 1), 12) AS score FROM (SELECT {_G}, card_name, weight_sum, freq, coalesce(syn, 0) AS syn FROM fr LEFT JOIN ps USING ({_G}, card_name))),
    cand AS (SELECT {', '.join('sc.' + x for x in _G.split(', '))}, sc.card_name, freq, weight_sum, syn, coalesce(m.card_cmc, 0) AS cmc, coalesce(m.card_type, '') AS kind, coalesce(m.card_cost, '') AS cost, coalesce(m.rarity, '') AS rarity, gih_wr, alsa,
        row_number() OVER (PARTITION BY {', '.join('sc.' + x for x in _G.split(', '))} ORDER BY score DESC, sc.card_name) AS place FROM sc JOIN meta m USING (set_code, format, card_name)),
    spell AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY place) AS r FROM cand WHERE NOT contains(kind, 'Land')),
    walk AS (SELECT {_G}, 0 AS r, 0 AS added, 0 AS cs, 0 AS os, 0 AS pairs, [0, 0, 0, 0, 0, 0, 0, 0] AS filled, 0 AS n FROM goals
        UNION ALL SELECT {_G}, r, added + n, cs + CASE WHEN creature THEN n ELSE 0 END, os + CASE WHEN creature THEN 0 ELSE n END, pairs + CASE WHEN n = 2 THEN 1 ELSE 0 END, list_transform(filled, lambda x, i: x + CASE WHEN i = slot + 1 THEN n ELSE 0 END), n
        FROM (SELECT *, CASE WHEN filled[slot + 1] < CAST(round_even(curve[slot + 1], 0) AS INT) + 2 THEN CAST(greatest(0, least(CASE WHEN rarity = 'common' AND pairs < 2 AND freq > 1 THEN 2 ELSE 1 END, spells - added, CASE WHEN creature THEN want + 1 - cs ELSE spells - want + 1 - os END)) AS INT) ELSE 0 END AS n
            FROM (SELECT {', '.join('w.' + x for x in _G.split(', '))}, CAST(s.r AS INT) AS r, added, cs, os, pairs, filled, curve, spells, want, s.rarity, s.freq, contains(s.kind, 'Creature') AS creature, CAST(least(CAST(s.cmc AS INT), 7) AS INT) AS slot
                FROM walk w JOIN spell s ON s.r = w.r + 1 AND {' AND '.join(f's.{x} = w.{x}' for x in _G.split(', '))} JOIN goals g ON {' AND '.join(f'g.{x} = w.{x}' for x in _G.split(', '))})))
    , taken AS (SELECT s.*, w.n FROM walk w JOIN spell s ON s.r = w.r AND {' AND '.join(f's.{x} = w.{x}' for x in _G.split(', '))} WHERE w.n > 0),
    chosen AS (SELECT {_G}, list({card} ORDER BY r, k) AS chosen FROM taken, range(1, 3) AS two(k) WHERE k <= n GROUP BY ALL),
    land AS (SELECT {_G}, list({{'name': card_name, 'cmc': 0.0::DOUBLE, 'type': kind, 'cost': '', 'rarity': rarity}} ORDER BY place) AS lands FROM (SELECT cand.*, goal, row_number() OVER (PARTITION BY {_G} ORDER BY place) AS k FROM cand JOIN goals USING ({_G}) WHERE contains(kind, 'Land') AND NOT contains(kind, 'Basic') AND freq > 0.2) WHERE k <= goal GROUP BY {_G}),
    pip AS (SELECT {_G}, [{pips}] AS p FROM taken GROUP BY ALL),
    need AS (SELECT {_G}, goal, coalesce(lands, []) AS lands, coalesce(chosen, []) AS chosen, goal - len(coalesce(lands, [])) AS need, CASE WHEN coalesce(list_sum(p), 0) = 0 THEN [1, 1, 1, 1, 1] ELSE p END AS p FROM goals LEFT JOIN land USING ({_G}) LEFT JOIN chosen USING ({_G}) LEFT JOIN pip USING ({_G})),
    basic AS (SELECT *, list_concat(flatten(list_transform(range(1, 6), lambda i: list_transform(range(0, CAST(round_even(p[i] / list_sum(p) * need, 0) AS BIGINT)), lambda k: ({lands})[i]))), list_transform(range(0, need), lambda k: ({lands})[list_position(p, list_max(p))]))[1:need] AS basics FROM need),
    deck AS (SELECT {_G}, list_concat(lands, chosen, list_transform(CASE WHEN need > 0 THEN basics ELSE [] END, lambda b: {{'name': b, 'cmc': 0.0::DOUBLE, 'type': 'Basic Land', 'cost': '', 'rarity': 'common'}})) AS deck_list FROM basic),
    nl AS (SELECT * FROM cand WHERE NOT contains(kind, 'Land')),
    mm AS (SELECT set_code, format, coalesce(avg(gih_wr) FILTER (gih_wr <> 0), 55.0) AS avg_wr, coalesce(avg(alsa), 4.0) AS avg_alsa FROM meta GROUP BY 1, 2),
    sl AS (SELECT {_G}, card_name, {_half_up("alsa", 2)} AS alsa, round(freq * 100, 1) AS frequency, round((alsa - avg_alsa) * freq, 3) AS score, CAST(row_number() OVER (PARTITION BY {_G} ORDER BY (alsa - avg_alsa) * freq DESC, card_name) AS INT) AS rank FROM nl JOIN mm USING (set_code, format) WHERE alsa > avg_alsa AND freq >= 0.15 QUALIFY rank <= 5),
    tn AS (SELECT {_G}, count(*) FILTER (rc) AS nr, count(*) FILTER (NOT rc) AS no FROM dk GROUP BY ALL),
    tc AS (SELECT {_G}, card_name, count(*) FILTER (rc) / any_value(nr) AS rf, count(*) FILTER (NOT rc) / any_value(no) AS ofr FROM it JOIN tn USING ({_G}) JOIN meta USING (set_code, format, card_name) WHERE nr >= 3 AND no >= 3 AND NOT contains(card_type, 'Land') GROUP BY ALL),
    tr AS (SELECT {_G}, card_name, round(rf * 100, 1) AS recent_freq, round(ofr * 100, 1) AS old_freq, round((rf - ofr) * 100, 1) AS delta, CAST(row_number() OVER (PARTITION BY {_G} ORDER BY rf - ofr DESC, card_name) AS INT) AS rank FROM tc WHERE rf - ofr > 0.15 AND rf > 0.20 QUALIFY rank <= 5),
    im AS (SELECT *, round(0.4 * freq + 0.3 * s + 0.3 * wr, 12) AS imp FROM (SELECT nl.*, least(syn / 5, 1) AS s, CASE WHEN coalesce(gih_wr, 0) <> 0 THEN greatest(0.0, least(1.0, (gih_wr - avg_wr + 10) / 20)) ELSE 0.0 END AS wr FROM nl JOIN mm USING (set_code, format))),
    ic AS (SELECT {_G}, card_name, {_half_up("imp * 100", 1)} AS importance, {_half_up("freq * 100", 1)} AS freq_score, {_half_up("s * 100", 1)} AS synergy_score, {_half_up("wr * 100", 1)} AS wr_score, {_half_up("freq * 100", 1)} AS frequency, gih_wr, CAST(row_number() OVER (PARTITION BY {_G} ORDER BY imp DESC, card_name) AS INT) AS rank FROM im QUALIFY rank <= 15),
    op AS (SELECT {_G}, CAST(greatest(0, least(100, round_even((count(*) FILTER (b < 0.8 * t) - 25) / 45 * 100, 0))) AS INT) AS openness_score FROM (SELECT *, sum(weight_sum) OVER (PARTITION BY {_G}) AS t, sum(weight_sum) OVER (PARTITION BY {_G} ORDER BY weight_sum DESC, card_name ROWS UNBOUNDED PRECEDING) - weight_sum AS b FROM nl) GROUP BY ALL),
    {_list("sl", "sleeper", "alsa frequency score")}, {_list("tr", "trend", "recent_freq old_freq delta")}, {_list("ic", "key", "importance freq_score synergy_score wr_score frequency gih_wr")},
    skel AS (SELECT set_code, format, archetype AS archetype_name, is_alternative, sample_size, round(avg_lands, 1) AS avg_lands, {_half_up("avg_creatures / nullif(40 - avg_lands, 0)", 3)} AS creature_ratio, openness_score, curve, deck_list, sleeper_list, trend_list, key_list
        FROM goals JOIN deck USING ({_G}) JOIN tw USING ({_G}) LEFT JOIN op USING ({_G}) LEFT JOIN sleeper USING ({_G}) LEFT JOIN trend USING ({_G}) LEFT JOIN key USING ({_G}))"""


_SKELETONS = _skeleton_sql()


@query(f"{_SKELETONS} SELECT set_code, format, archetype_name, is_alternative, sample_size, avg_lands, creature_ratio, openness_score, CAST(to_json(deck_list) AS VARCHAR) AS deck_list, CAST(to_json(sleeper_list) AS VARCHAR) AS sleeper_cards, CAST(to_json(trend_list) AS VARCHAR) AS trending_cards, CAST(to_json(key_list) AS VARCHAR) AS importance_cards FROM skel")
def m3_m4_skeletons(s, d):
    return _skeletons(s, d).select("set_code", "format", "archetype_name", "is_alternative", "sample_size", "avg_lands", "creature_ratio", "openness_score", F.to_json("deck_list").alias("deck_list"), F.to_json("sleeper_cards").alias("sleeper_cards"), F.to_json("trending_cards").alias("trending_cards"), F.to_json("importance_cards").alias("importance_cards"))


_NTH = "cards AS (SELECT set_code, format, archetype_name, is_alternative, unnest(deck_list, recursive := true), unnest(range(len(deck_list))) AS pos FROM skel)"


@query(f"""{_SKELETONS}, {_NTH}, per_name AS (SELECT set_code, format, archetype_name, is_alternative, name, count(*) AS n, min(pos) AS pos FROM cards GROUP BY ALL)
    SELECT set_code, format, archetype_name, is_alternative, 'Deck' || chr(10) || string_agg(n || ' ' || name, chr(10) ORDER BY pos) AS deck_text FROM per_name WHERE NOT is_alternative AND length({q_extract('archetype_name')}) = 2 GROUP BY ALL""")
def s7_f5_export_deck_text(s, d):
    return tables.export_deck_text(skeletons.select_skeletons(_skeletons(s, d), 2))


@query(f"""{_SKELETONS}, {_NTH}, per_value AS (SELECT set_code, format, archetype_name, is_alternative, unnest(range(1, 8)) AS b, unnest(curve[2:8]) AS v FROM skel),
    summed AS (SELECT set_code, format, archetype_name, is_alternative, round(CASE WHEN sum(v) > 0 THEN sum(b * v) / sum(v) ELSE 0 END, 6) AS avg_cmc, CAST(list(b ORDER BY v DESC, b)[1] AS INT) AS modal_bucket, CAST(greatest(coalesce(max(b) FILTER (v > 0), 5), 5) AS INT) AS top_bucket FROM per_value GROUP BY ALL),
    hues AS (SELECT set_code, format, archetype_name, is_alternative, {', '.join(f"count(*) FILTER (contains(cost, '{{{x}}}')) AS n_{x.lower()}" for x in "WUBRG")} FROM cards WHERE NOT contains(type, 'Land') GROUP BY ALL)
    SELECT * FROM summed LEFT JOIN hues USING (set_code, format, archetype_name, is_alternative)""")
def a26_skeleton_summary(s, d):
    return rounded(skeletons.skeleton_summary(_skeletons(s, d)))


@query(f"""{_SKELETONS}, {_NTH} SELECT set_code, format, archetype_name, is_alternative, CAST(least(CAST(cmc AS INT), 7) AS INT) AS bucket, CASE WHEN contains(type, 'Creature') OR contains(type, 'Planeswalker') THEN 'creature' ELSE 'other' END AS stack, name AS card_name, count(*) AS copies FROM cards WHERE NOT contains(type, 'Land') GROUP BY ALL""")
def a26_skeleton_stacks(s, d):
    return skeletons.skeleton_stacks(_skeletons(s, d))


def _deck_lists(s: SparkSession, d: str) -> DataFrame:
    """Each deck in the form of a skeleton; neighbouring ids are main version and variant."""
    # the list of cards is that of the game, however many decks there are; items stay dealt out by deck
    items = fx.frame(s, d, "fx_items").join(F.broadcast(fx.frame(s, d, "fx_card_list")), ["set_code", "card_name"])
    card = F.struct(F.col("card_name").alias("name"), F.col("card_cmc").alias("cmc"), F.col("card_type").alias("type"), F.col("card_cost").alias("cost"), "rarity")
    spell = lambda i: F.coalesce(F.sum(F.when(~C.is_land("card_type") & (C.cmc_bucket("card_cmc") == i), F.col("qty"))), F.lit(0)).cast("double")
    per = items.groupBy("set_code", "format", "archetype", "aggregate_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("card_name", "qty", card.alias("c")))), lambda x: F.array_repeat(x["c"], x["qty"]))).alias("deck_list"),
        F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(8)]), F.array(*[spell(i) for i in range(8)])).alias("avg_mana_curve"))
    name = F.concat("archetype", F.lit(" #"), F.floor(F.col("aggregate_id") / 2).cast("string"))
    out = per.select("set_code", "format", name.alias("archetype_name"), (F.col("aggregate_id") % 2 == 1).alias("is_alternative"), (F.col("aggregate_id") % 97).alias("sample_size"), "deck_list", "avg_mana_curve")
    return fx.dealt(out, d, *_SKELETON_KEY)


_NAMED = "named AS (SELECT *, archetype || ' #' || CAST(CAST(floor(aggregate_id / 2) AS BIGINT) AS VARCHAR) AS archetype_name, aggregate_id % 2 = 1 AS is_alternative FROM fx_items JOIN (SELECT set_code, card_name, card_cmc, card_type, card_cost FROM fx_card_list) l USING (set_code, card_name))"
_SKELETON_KEY = ["set_code", "format", "archetype_name", "is_alternative"]


@query(f"WITH {_NAMED} SELECT set_code, format, archetype_name, is_alternative, 'Deck' || chr(10) || string_agg(qty || ' ' || card_name, chr(10) ORDER BY card_name) AS deck_text FROM named GROUP BY 1, 2, 3, 4")
def s7_deck_text(s, d):
    return tables.export_deck_text(_deck_lists(s, d))


@query(f"""WITH {_NAMED}, k AS (SELECT DISTINCT set_code, format, archetype, archetype_name, is_alternative, aggregate_id % 97 AS sample_size FROM named)
    SELECT set_code, format, archetype_name, sample_size, has_alternative FROM (SELECT *, max(is_alternative) OVER (PARTITION BY set_code, format, archetype_name) AS has_alternative FROM k) WHERE NOT is_alternative AND length({q_extract('archetype_name')}) = 2""")
def f5_select_skeletons(s, d):
    return skeletons.select_skeletons(_deck_lists(s, d), 2).select("set_code", "format", "archetype_name", "sample_size", "has_alternative")


@query(f"""WITH {_NAMED}, c AS (SELECT set_code, format, archetype_name, is_alternative, b, coalesce(sum(qty) FILTER (NOT contains(card_type, 'Land') AND least(CAST(card_cmc AS INT), 7) = b), 0) AS v FROM named, range(1, 8) AS r(b) GROUP BY 1, 2, 3, 4, 5),
    m AS (SELECT set_code, format, archetype_name, is_alternative, round(CASE WHEN sum(v) > 0 THEN sum(b * v) / sum(v) ELSE 0 END, 6) AS avg_cmc, CAST(list(b ORDER BY v DESC, b)[1] AS INT) AS modal_bucket, CAST(greatest(coalesce(max(b) FILTER (v > 0), 5), 5) AS INT) AS top_bucket FROM c GROUP BY 1, 2, 3, 4),
    k AS (SELECT set_code, format, archetype_name, is_alternative, {', '.join(f"CAST(coalesce(sum(qty) FILTER (contains(card_cost, '{{{x}}}')), 0) AS BIGINT) AS n_{x.lower()}" for x in "WUBRG")} FROM named WHERE NOT contains(card_type, 'Land') GROUP BY 1, 2, 3, 4)
    SELECT * FROM m LEFT JOIN k USING (set_code, format, archetype_name, is_alternative)""")
def a26_deck_summary(s, d):
    return rounded(skeletons.skeleton_summary(_deck_lists(s, d)))


@query(f"""WITH {_NAMED} SELECT set_code, format, archetype_name, is_alternative, CAST(least(CAST(card_cmc AS INT), 7) AS INT) AS bucket, CASE WHEN contains(card_type, 'Creature') OR contains(card_type, 'Planeswalker') THEN 'creature' ELSE 'other' END AS stack, card_name, CAST(sum(qty) AS BIGINT) AS copies
    FROM named WHERE NOT contains(card_type, 'Land') GROUP BY ALL""")
def a26_deck_stacks(s, d):
    return skeletons.skeleton_stacks(_deck_lists(s, d))


# ---- articles ----

_GOOD = "CASE WHEN votes_yes + votes_meh + votes_no > 0 THEN CAST(floor(votes_yes / (votes_yes + votes_meh + votes_no) * 100 + 0.5) AS INT) END"


@query(f"SELECT id, {_GOOD} AS good_percent, CASE WHEN {_GOOD} >= 75 THEN 'Great Read' WHEN {_GOOD} >= 40 THEN 'Mixed' WHEN {_GOOD} IS NOT NULL THEN 'Controversial' END AS sentiment FROM fx_articles")
def a4_article_sentiment(s, d):
    return articles.article_sentiment(fx.articles(s, d)).select("id", "good_percent", "sentiment")


_VOTES = "SELECT article_id, count(*) FILTER (kind = 'yes') AS votes_yes, count(*) FILTER (kind = 'meh') AS votes_meh, count(*) FILTER (kind = 'no') AS votes_no FROM (SELECT *, row_number() OVER (PARTITION BY article_id, reader_id ORDER BY ts, event_id) AS r FROM fx_votes) WHERE r = 1 GROUP BY 1"


@query(_VOTES)
def a5_count_votes(s, d):
    return articles.count_votes(fx.frame(s, d, "fx_votes"))


@query("SELECT id, video_url FROM (SELECT *, row_number() OVER (PARTITION BY video_url ORDER BY published_at, id) AS r FROM fx_articles) WHERE r = 1 OR video_url IS NULL")
def w2_dedup_articles(s, d):
    return articles.dedup_articles(fx.articles(s, d)).select("id", "video_url")


@query("SELECT tag_a AS tag FROM fx_articles UNION SELECT tag_b FROM fx_articles")
def a27_article_tags(s, d):
    return articles.article_tags(fx.articles(s, d))


@query("SELECT DISTINCT trim(x, '\"') AS card_name FROM (SELECT unnest(string_split(trim(mentioned_cards, '{}'), ',')) AS x FROM fx_articles)")
def a27_mentioned_cards(s, d):
    return articles.mentioned_cards(fx.articles(s, d))


@query("SELECT DISTINCT trim(x, '\"') AS card_name FROM (SELECT unnest(string_split(trim(mentioned_cards, '{}'), ',')) AS x FROM fx_articles) WHERE contains(x, 'Card 1') ORDER BY 1 LIMIT 8")
def f9_suggest_mentions(s, d):
    return articles.suggest_mentions(fx.articles(s, d), "card 1")


@query("SELECT id, published_at FROM fx_articles WHERE published_at >= TIMESTAMP '2024-01-20' - INTERVAL 15 DAY")
def f7_recent_articles(s, d):
    return articles.recent_articles(fx.articles(s, d), F.lit("2024-01-20").cast("timestamp")).select("id", "published_at")


@query("SELECT id FROM fx_articles WHERE published_at < TIMESTAMP '2024-01-08' ORDER BY published_at DESC, id DESC LIMIT 20")
def f7_article_page(s, d):
    return articles.article_page(fx.articles(s, d), F.lit("2024-01-08").cast("timestamp")).select("id")


@query(f"SELECT id FROM fx_articles WHERE (tag_a = 'en' OR tag_b = 'en') AND {_GOOD} >= 75 AND contains(mentioned_cards, 'Card 1')")
def f8_filter_articles(s, d):
    return articles.filter_articles(fx.articles(s, d), ["en"], True, "card 1").select("id")


#: Names as texts have them, and the official ones.
_DICT = (("the of", "The Of"), ("of the and", "Of The And"), ("die der", "Die Der"), ("nicht", "Nicht"), ("que la", "Que // La"), ("is the", "Is The"), ("on", "On"), ("from the", "From The"))
_ANY = "(?i)\\b(" + "|".join(sorted((n for n, _ in _DICT), key=len, reverse=True)) + ")\\b"


def _dictionary(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_DICT, "name string, official string")


@query(f"SELECT id, lower(name) AS name, count(*) AS times FROM (SELECT id, unnest(regexp_extract_all(summary, '{_ANY}')) AS name FROM fx_articles) GROUP BY 1, 2")
def j12_detect_mentions(s, d):
    return articles.detect_mentions(fx.articles(s, d), _dictionary(s)).groupBy("id", "name").agg(F.count("*").alias("times"))


@query("SELECT l_orderkey AS id, p_name AS name, count(*) AS times FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def j12_part_mentions(s, d):
    """All part names, and their first words, in texts that list the parts of an order."""
    parts, lines = fx.frame(s, d, "part"), fx.frame(s, d, "lineitem")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("id"), "p_name")
    listed = fx.dealt(rows, d, "id").groupBy("id").agg(F.array_join(F.collect_list(F.initcap("p_name")), ", ").alias("summary"))
    names = parts.select(F.col("p_name").alias("name")).distinct()
    names = names.unionByName(names.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("name"))).distinct()
    return articles.detect_mentions(listed, names).groupBy("id", "name").agg(F.count("*").alias("times"))


def _linked_sql() -> str:
    out = f"regexp_replace(summary, '{_ANY}', '[[\\1]]', 'g')"
    for name, official in _DICT:
        out = f"regexp_replace({out}, '(?i)\\[\\[{name}\\]\\]', '[[{official}]]', 'g')"
    return out


@query(f"SELECT id, {_linked_sql()} AS linked FROM fx_articles")
def j12_link_mentions(s, d):
    return articles.link_mentions(fx.articles(s, d), _dictionary(s)).select("id", "linked")


# ---- streaming ----

def _fed(df: DataFrame, root: str, by: Column, parts: int, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Runs a stream once for each part of df as its files arrive; ``by`` numbers the parts from 0."""
    s = df.sparkSession
    numbered = df.withColumn("part", by.cast("int"))
    numbered.write.partitionBy("part").parquet(f"{root}/parts")
    every = s.read.schema(numbered.schema).parquet(f"{root}/parts")
    for k in range(parts):
        every.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{root}/in")
        writer = start(s.readStream.schema(df.schema).parquet(f"{root}/in"))
        writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


def _in_time(df: DataFrame, time: str, parts: int) -> Column:
    """The part of a row, in the order of a time column."""
    t = F.col(time).cast("timestamp").cast("long")
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    return F.coalesce(F.floor((t - (lo or 0)) / (((hi or 0) - (lo or 0)) // parts + 1)), F.lit(0))


def _late(key: str, parts: int) -> Column:
    """The part of a row by a hash: every part has rows of all times, so most come late."""
    return F.pmod(F.xxhash64(key), F.lit(parts))


@query("SELECT aggregate_id, set_code, format, archetype FROM fx_decks WHERE trophy_time >= TIMESTAMP '1996-01-01' AND trophy_time < TIMESTAMP '2001-01-01' AND aggregate_id % 7 <> 0")
def r1_stream_new_decks(s, d):
    """Some ids come twice, some are stored already, and later files hold earlier days."""
    root = shared(s)
    feed, stored = _feed(s, d)
    decks = feed.select("aggregate_id", "set_code", "format", "archetype", "trophy_time")
    table = jobs.deck_table(s, f"{root}/decks", decks.schema)
    table.insert_new(decks.join(stored, "aggregate_id", "left_semi").withColumn("batch", F.lit(None).cast("long")))
    _fed(decks, root, 2 - _in_time(decks, "trophy_time", 3), 3, lambda x: jobs.stream_new_decks(x, table, "1996-01-01", "2001-01-01"))
    return table.read().where("batch is not null").select("aggregate_id", "set_code", "format", "archetype")


@query("SELECT set_code, format, colors, array_to_string(list(CAST(round(rate * 10) AS BIGINT) ORDER BY run_date), ',') AS points FROM (SELECT *, row_number() OVER (PARTITION BY set_code, format, colors ORDER BY run_date DESC) AS k FROM (" + f"SELECT set_code, format, run_date, {q_clean('color_name')} AS colors, {RATE_SQL} AS rate FROM fx_raw_ratings WHERE games <> 0" + ")) WHERE k <= 14 GROUP BY 1, 2, 3")
def r2_stream_history(s, d):
    """The days come out of order."""
    root = shared(s)
    log = _snapshots(s, d).select("set_code", "format", "colors", "run_date", "win_rate")
    table = jobs.history_table(s, f"{root}/history", log.select("set_code", "format", "colors").schema)
    _fed(log, root, _late("run_date", 3), 3, lambda x: jobs.stream_history(x, table, "win_rate"))
    return jobs.history_of(table).select("set_code", "format", "colors", F.array_join(F.transform("win_rate_history", lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("points"))


@query(_VOTES)
def r3_stream_votes(s, d):
    """Votes come out of order, so later batches take back what earlier ones counted."""
    root = shared(s)
    events = fx.frame(s, d, "fx_votes")
    votes, counts = jobs.vote_tables(s, root)
    _fed(events, root, _late("event_id", 3), 3, lambda x: jobs.stream_votes(x, votes, counts))
    return counts.read()


@query("SELECT CAST(date_trunc('day', trophy_time) AS TIMESTAMP) AS day, set_code, format, archetype, count(*) AS decks, round(sum(wins) / sum(wins + losses) * 100, 6) AS win_rate FROM fx_decks GROUP BY 1, 2, 3, 4")
def r4_stream_daily_rates(s, d):
    root, key = shared(s), ["day", "set_code", "format", "archetype"]
    decks = fx.frame(s, d, "fx_decks")

    def start(stream: DataFrame) -> DataStreamWriter:
        flat = jobs.stream_daily_rates(stream).select(F.col("window.start").alias("day"), "set_code", "format", "archetype", "decks", "win_rate")

        def each(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")

        return flat.writeStream.outputMode("update").foreachBatch(each)

    _fed(decks, root, _in_time(decks, "trophy_time", 3), 3, start)
    return rounded(tables.last_by_key(s.read.parquet(f"{root}/out").drop("batch"), key, [F.col("epoch")]).drop("epoch"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card synergies by set."""
    return a10_synergy_by_set(spark, sf_dir)
