"""Hand-made tables: boundaries, ties, empty inputs and rules that SQL cannot restate."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from draftloom import queries
from draftloom.functions import columns as C
from draftloom.operators import articles, cards, skeletons, snapshots, stats, synergy
from draftloom.plans import skeleton_table
from draftloom.sources import tables


def col(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_color_codes(spark):
    names = ["Azorius (WU)", "Gruul (RG) + Splash", "GU + Splash", "All Decks", "", None, "Jund (GRB) (Splash)", "Rogue"]
    assert col(spark, names, "string", C.clean_color_code) == ["UW", "GR + Splash", "GU + Splash", "All Decks", "Unknown", "Unknown", "BGR + Splash", "R"]
    assert col(spark, ["Simic (GU)", "GU + splash", "GWU", "x", None], "string", C.normalize_archetype_name) == ["Simic (UG)", "UG + Splash", "WUG", "x", None]
    assert col(spark, ["Orzhov (BW) + Splash", "GU"], "string", C.archetype_acronym) == ["WB+", "UG"]


def test_letters_and_hybrid_costs(spark):
    assert col(spark, ["GWUGW", "xR", ""], "string", lambda c: C.sort_wubrg(c, distinct=True)) == ["WUG", "R", ""]
    assert col(spark, ["{1}{W/U}", "{U/W}", "{2/W}", "{W}", "{B}", None], "string", lambda c: C.cost_has_color(c, "W")) == [True, True, True, True, False, False]


def test_audit_of_every_outcome(spark):
    day = lambda d: f"2024-01-{d:02d}" if d else None
    rows = [("a", day(2)), ("a", day(3)), ("b", day(2)), ("c", day(20)), ("d", None), ("e", day(10)), ("f", day(1))]
    feed = spark.createDataFrame(rows, "aggregate_id string, t string").select("aggregate_id", F.to_timestamp("t").alias("trophy_time"))
    stored = spark.createDataFrame([("b",), ("b",)], "aggregate_id string")
    got = dict(stats.ingest_audit(feed, stored, F.lit(day(1)).cast("timestamp"), F.lit(day(10)).cast("timestamp")).collect())
    assert got == {"saved": 2, "repeated": 1, "existing": 1, "out of window": 2, "error": 1}


def test_rates(spark):
    assert col(spark, ["0", "1", "1.0001", "0.5", "nan", "inf", "x", None, "55"], "string", C.safe_rate) == [0.0, 100.0, 1.0001, 50.0, None, None, None, None, 55.0]


def test_recency_floor(spark):
    df = spark.sql("SELECT i, timestamp'2024-02-01 00:00:00' - make_dt_interval(0, 0, 0, s) AS t FROM VALUES (0, 691199), (1, 691200), (2, 1295999), (3, 1296000), (4, -5) AS x(i, s)")
    got = [r[0] for r in df.orderBy("i").select(C.recency_weight("t", F.lit("2024-02-01").cast("timestamp"))).collect()]
    assert got == [1.0, 0.75, 0.75, 0.5, 1.0]


def test_grades_and_tiers(spark):
    df = spark.createDataFrame([(i, 50.0 + d) for i, d in enumerate((5.5, 3.0, 0.5, -1.5, -3.5, -3.6))] + [(9, 0.0)], "i int, w double").orderBy("i")
    assert [r[0] for r in df.select(C.card_grade("w", F.lit(50.0))).collect()] == ["S", "A", "B", "C", "D", "F", "-"]


def test_main_deck(spark):
    data = [
        ("a", {"1": ("X",), "2": ("Y",)}, [("Sideboard", [1]), ("Deck", [1, 1, 2, 9])]),
        ("b", {"1": ("X",)}, [("Sideboard", [1])]),
        ("c", {"1": ("X",)}, [("Extra", []), ("Pile", [1])]),
        ("d", {"1": ("X",)}, [("main", []), ("Pile", [1])]),
    ]
    df = spark.createDataFrame(data, "aggregate_id string, cards map<string,struct<name:string>>, groups array<struct<name:string,cards:array<bigint>>>")
    assert {r.aggregate_id: r.cardlist for r in C.maindeck_cardlist(df).collect()} == {"a": {"X": 2, "Y": 1}, "c": {"X": 1}}


def test_pg_array_and_summary(spark):
    assert col(spark, ['{"a","b"}', "{}", None, "{x}"], "string", C.parse_pg_array) == [["a", "b"], [], [], ["x"]]
    assert col(spark, ["text ---{x}", "a ```code", "b `c` "], "string", C.clean_summary) == ["text", "a", "b c"]


def test_clean_summary_keeps_texts_with_back_ticks(spark, sf_dir, tmp_path):
    texts = {1: "plain --- x {y}", 2: "a `b` c ", 3: "see ```py\nx = 1\n``` after", 4: "``two`` and ```", 5: "{`}", 6: "x ***``` y\n", 7: "", 8: None, 9: " \u00a0\n lead and trail \u2003"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1).drop("doc_id", "text")
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows.crossJoin(docs).write.parquet(str(tmp_path / "documents.parquet"))

    def plain(t):
        head = re.sub(r"```.*\Z", "", (t or "").split("{")[0], flags=re.S)
        return re.sub("[-_*]{3,}", "", head.replace("`", "")).strip()

    got = {r.id: r.cleaned for r in queries.p18_clean_summary(spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t in texts.items()}


def test_read_ratings_variants(spark, tmp_path):
    rows = '[{"name": "A", "rarity": "rare", "game_count": 5}]'
    for i, body in enumerate((rows, '{"results": %s}' % rows, '{"n": 1, "cards": %s}' % rows)):
        d = tmp_path / f"set_code=S{i}" / "format=F"
        d.mkdir(parents=True)
        (d / "x.json").write_text(body)
    got = tables.read_ratings(spark, str(tmp_path)).select("set_code", "format", "name", "game_count").collect()
    assert sorted(map(tuple, got)) == [(f"S{i}", "F", "A", 5) for i in range(3)]


def test_bad_feeds_are_reported(spark, tmp_path):
    files = {"A": "[{\"name\": \"x\", \"game_count\": \"many\"}, 7]", "B": "[1, 2", "C": "{\"n\": 1}", "D": "", "E": "{\"zz\": [{\"name\": \"z\"}], \"aa\": [{\"name\": \"a\"}]}", "F": "[]", "G": "{\"results\": 3, \"it's\": [{\"name\": \"q\", \"ever_drawn_win_rate\": 55}]}"}
    for k, body in files.items():
        (tmp_path / f"set_code={k}").mkdir()
        (tmp_path / f"set_code={k}" / "x.json").write_text(body)
    got = sorted((r.set_code, r.name, r.game_count, r.ever_drawn_win_rate) for r in tables.read_ratings(spark, str(tmp_path)).collect() if r.name)
    assert got == [("A", "x", None, None), ("E", "z", None, None), ("G", "q", None, 55.0)]
    bad = {r.set_code: r.reason for r in tables.rejected_feeds(spark, str(tmp_path)).collect()}
    assert bad.pop("D", "no JSON") == "no JSON" and bad == {"B": "no JSON", "C": "no list of rows"}


def test_history_rerun_and_length(spark):
    log = spark.createDataFrame([("k", d, float(d)) for d in range(20)], "k string, run_date int, r double")
    (row,) = snapshots.history_from_log(log, ["k"], "r").collect()
    assert row.win_rate_history == [float(d) for d in range(6, 20)]
    prior = spark.createDataFrame([("k", [1.0, 2.0])], "k string, win_rate_history array<double>")
    snap = spark.createDataFrame([("k", None), ("n", 3.0)], "k string, r double")
    got = {r.k: r.win_rate_history for r in snapshots.roll_history(prior, snap, ["k"], "r", skip_null=True).collect()}
    assert got == {"k": [1.0, 2.0], "n": [3.0]}


def test_upsert_is_idempotent(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    once = tables.upsert(cur, new, ["k"], "o")
    twice = tables.upsert(once, new, ["k"], "o")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (3, "z")]


def _decks(spark, lists, archetype="WU"):
    return spark.createDataFrame([("S", "F", archetype, i, c) for i, c in enumerate(lists)], "set_code string, format string, archetype string, aggregate_id long, cardlist map<string,int>").withColumn("trophy_time", F.lit("2024-01-01").cast("timestamp"))


def test_lift_counts_empty_decks(spark):
    decks = _decks(spark, [{"A": 1, "B": 2, "Island": 3}] * 30 + [{"A": 1}] * 10 + [{}] * 60)
    (row,) = synergy.synergy_scores(decks).collect()
    assert (row.card_a, row.card_b, row.co_occurrence_count) == ("A", "B", 30)
    assert row.lift_score == round((30 / 100) / ((40 / 100) * (30 / 100)), 4)
    assert row.confidence_a_to_b == 0.75 and row.confidence_b_to_a == 1.0


def test_two_clusters(spark):
    one, two = {f"a{i}": 1 for i in range(20)}, {f"b{i}": 1 for i in range(20)}
    split = skeletons.cluster_decks(_decks(spark, [one] * 35 + [two] * 25)).collect()
    assert sum(r.is_alternative for r in split) == 25
    assert all(r.is_alternative == (r.aggregate_id >= 35) for r in split)
    assert not any(r.is_alternative for r in skeletons.cluster_decks(_decks(spark, [one] * 60)).collect())
    assert not any(r.is_alternative for r in skeletons.cluster_decks(_decks(spark, [one] * 20 + [two] * 19)).collect())


def card(name, kind="Creature", cmc=2, cost="{W}", rarity="rare", freq=0.9, common=False):
    return {"name": name, "cmc": float(cmc), "type": kind, "cost": cost, "rarity": rarity, "freq": freq, "common": common}


def built(spark, cards_, avg_lands, avg_creatures, curve):
    """The deck of one group, its candidates in the given order."""
    key = "set_code string, format string, archetype string, is_alternative boolean"
    group = ("S", "F", "A", False)
    rows = [(*group, c["name"], c["freq"], 1.0 - i / 1000) for i, c in enumerate(cards_)]
    meta = [("S", "F", c["name"], c["cmc"], c["cost"], c["type"], c["rarity"]) for c in cards_]
    candidates = spark.createDataFrame(rows, f"{key}, card_name string, freq double, score double")
    profile = spark.createDataFrame([(*group, avg_lands, avg_creatures, curve)], f"{key}, avg_lands double, avg_creatures double, avg_mana_curve map<string,double>")
    info = spark.createDataFrame(meta, "set_code string, format string, card_name string, card_cmc double, card_cost string, card_type string, rarity string")
    (row,) = skeletons.build_skeleton(candidates, profile, info).collect()
    return [c.asDict() for c in row.deck_list]


def test_deck_rules(spark):
    cards_ = [card("L", "Land", freq=0.5), card("Rare land", "Land", freq=0.1), card("C", rarity="common", freq=1.5, common=True)]
    cards_ += [card(f"x{i}", "Instant" if i % 2 else "Creature", i % 5, "{U}") for i in range(40)]
    deck = built(spark, cards_, 17.0, 15.0, {str(i): 6.0 for i in range(8)})
    names = [c["name"] for c in deck]
    assert len(deck) == 40 and names.count("L") == 1 and "Rare land" not in names and names.count("C") == 2
    assert names.count("Island") + names.count("Plains") == 16
    assert all((c["cmc"], c["cost"]) == (0.0, "") for c in deck if "Land" in c["type"])
    assert all(c["cmc"] <= 7 for c in built(spark, [card("big", cmc=9.0)], 17.0, 15.0, {str(i): 6.0 for i in range(8)}))
    assert sum("Creature" in c["type"] for c in deck) <= round(23 * 15 / 23) + 1
    short = built(spark, [card("only")], 17.0, 15.0, {str(i): 1.0 for i in range(8)})
    assert len(short) == 1 + 17  # no second pass
    no_pips = built(spark, [], 5.0, 0.0, {})
    assert [c["name"] for c in no_pips] == list(C.BASIC_LANDS)


def plain_deck(cards_, avg_lands, avg_creatures, curve):
    """The rules of the 40-card deck, step by step, as (name, cmc, cost)."""
    goal = int(round(avg_lands))
    out = []
    for c in cards_:
        if len(out) < goal and "Land" in c["type"] and "Basic" not in c["type"] and c["freq"] > 0.2:
            out.append((c["name"], 0.0, ""))
    lands, spells = len(out), 40 - goal
    want = {"creature": round(spells * avg_creatures / max(1, 40 - avg_lands))}
    want["other"] = spells - want["creature"]
    have, in_slot, pairs, pips = {"creature": 0, "other": 0}, {}, 0, {}
    for c in cards_:
        if "Land" in c["type"] or sum(have.values()) >= spells:
            continue
        kind = "creature" if "Creature" in c["type"] else "other"
        if have[kind] >= want[kind] + 1:
            continue
        n = 2 if c["rarity"] == "common" and pairs < 2 and c["freq"] > 1.0 else 1
        n = min(n, spells - sum(have.values()), want[kind] + 1 - have[kind])
        slot = min(int(c["cmc"]), 7)
        if n > 0 and in_slot.get(slot, 0) < round(curve[str(slot)]) + 2:
            out += [(c["name"], float(slot), c["cost"])] * n
            have[kind] += n
            in_slot[slot] = in_slot.get(slot, 0) + n
            pairs += n == 2
            for x in "WUBRG":
                pips[x] = pips.get(x, 0) + n * c["cost"].count("{%s}" % x)
    if goal > lands:
        if not sum(pips.values()):
            pips = dict.fromkeys("WUBRG", 1)
        basics = []
        for x, land in zip("WUBRG", ("Plains", "Island", "Swamp", "Mountain", "Forest")):
            basics += [land] * round(pips[x] / sum(pips.values()) * (goal - lands))
        top = max("WUBRG", key=lambda x: pips[x])
        while len(basics) < goal - lands:
            basics.append({"W": "Plains", "U": "Island", "B": "Swamp", "R": "Mountain", "G": "Forest"}[top])
        out += [(b, 0.0, "") for b in basics[: goal - lands]]
    return out


def test_skeleton_decks_match_plain_rules(spark):
    r = random.Random(12)
    decks, rows, profiles, meta = {}, [], [], []
    for g in range(12):
        listed = []
        for k in range(r.randint(0, 60)):
            kind = r.choice(("Creature", "Creature", "Instant", "Land", "Basic Land", "Artifact Creature"))
            listed.append({"name": f"{g}-{k:02d}", "cmc": float(r.randint(0, 9)), "type": kind, "cost": "".join("{%s}" % r.choice("WUBRG2") for _ in range(r.randint(0, 3))), "rarity": r.choice(("common", "common", "Common", "uncommon", "rare", "")), "freq": round(r.random() * 2, 3), "score": round(r.random(), 2)})
        listed.sort(key=lambda c: (-c["score"], c["name"]))
        lands, creatures, curve = r.choice((16.5, 17.0, 0.0)), r.random() * 20, {str(i): round(r.random() * 6, 1) for i in range(8)}
        if listed:
            decks[str(g)] = plain_deck(listed, lands, creatures, curve)
            profiles.append(("S", "F", str(g), False, lands, creatures, curve))
        rows += [("S", "F", str(g), False, c["name"], c["freq"], c["score"]) for c in listed]
        meta += [("S", "F", c["name"], c["cmc"], c["cost"], c["type"], c["rarity"]) for c in listed]
    key = "set_code string, format string, archetype string, is_alternative boolean"
    candidates = spark.createDataFrame(rows, f"{key}, card_name string, freq double, score double")
    profile = spark.createDataFrame(profiles, f"{key}, avg_lands double, avg_creatures double, avg_mana_curve map<string,double>")
    info = spark.createDataFrame(meta, "set_code string, format string, card_name string, card_cmc double, card_cost string, card_type string, rarity string")
    got = {x.archetype: [(c["name"], c["cmc"], c["cost"]) for c in x.deck_list] for x in skeletons.build_skeleton(candidates, profile, info).collect()}
    assert got == decks


def test_skeleton_needs_full_decks(spark):
    meta = spark.createDataFrame([("S", "F", f"a{i}", 2.0, "{W}", "Creature", "common", 55.0, 4.0) for i in range(40)], "set_code string, format string, card_name string, card_cmc double, card_cost string, card_type string, rarity string, gih_wr double, alsa double")
    syn = spark.createDataFrame([], "set_code string, format string, card_a string, card_b string, synergy_score double, lift_score double, confidence_a_to_b double, confidence_b_to_a double, co_occurrence_count long")
    full = _decks(spark, [{f"a{i}": 1 for i in range(36)}] * 4)
    out = skeleton_table.skeletons(full, meta, syn, F.lit("2024-01-02").cast("timestamp")).collect()
    assert len(out) == 1 and out[0].sample_size == 4 and len(out[0].deck_list) > 0
    small = _decks(spark, [{f"a{i}": 1 for i in range(10)}] * 4)
    assert skeleton_table.skeletons(small, meta, syn, F.lit("2024-01-02").cast("timestamp")).count() == 0


def test_mentions_longest_first_and_links(spark):
    arts = spark.createDataFrame([(1, "Play Lightning Bolt, not LIGHTNING helix or bolts."), (2, None), (3, ""), (4, "the dogs' tails hit Lightning Bolt today again"), (5, "Jace, the Mind x Jace, the mind."), (6, "+2 mace a+2 mace")], "id int, summary string")
    names = spark.createDataFrame([("Lightning", None), ("Lightning Bolt", "Lightning Bolt // Back"), ("Bolt", None), ("Jace, the Mind", None), ("+2 Mace", None)], "name string, official string")
    got = {(r.id, r.start, r.official) for r in articles.detect_mentions(arts, names).collect()}
    assert got == {(1, 5, "Lightning Bolt // Back"), (1, 25, "Lightning"), (4, 20, "Lightning Bolt // Back"), (5, 0, "Jace, the Mind"), (5, 17, "Jace, the Mind"), (6, 9, "+2 Mace")}
    linked = {r.id: r.linked for r in articles.link_mentions(arts, names).collect()}
    assert linked[1] == "Play [[Lightning Bolt // Back]], not [[Lightning]] helix or bolts." and linked[2] is None and linked[3] == ""
    assert linked[4] == "the dogs' tails hit [[Lightning Bolt // Back]] today again"
    assert {r.id for r in articles.detect_mentions(arts, names, max_edges=0).collect()} == {1, 4, 5, 6}
    assert articles.detect_mentions(arts, names.where("false")).count() == 0 and articles.link_mentions(arts.where("false"), names).count() == 0


def test_chains_of_overlapping_mentions(spark):
    r = random.Random(4)
    names = ["the of", "of the and", "is the", "the", "and is the of", "on", "of, the"]
    texts = {0: "is the of the and", 1: "the of the of the and is the of the and"} | {i: "".join(r.choice(("the", "of", "and", "is", "on", "Then", "it's")) + r.choice((" ", " ", ", ", "-", "  ")) for _ in range(r.randint(1, 30))) for i in range(2, 80)}
    arts = spark.createDataFrame(list(texts.items()), "id int, summary string")
    dictionary = spark.createDataFrame([(n,) for n in names], "name string")
    # one alternation, longest name first, over the whole text
    rule = re.compile(r"\b(%s)\b" % "|".join(sorted(names, key=len, reverse=True)), re.IGNORECASE | re.ASCII)
    want = {(i, m.start(), m.group()) for i, t in texts.items() for m in rule.finditer(t)}
    assert {(x.id, x.start, x.name) for x in articles.detect_mentions(arts, dictionary).collect()} == want
    assert {x.id: x.linked for x in articles.link_mentions(arts, dictionary).collect()} == {i: rule.sub(r"[[\1]]", t) for i, t in texts.items()}


def test_video_urls(spark):
    urls = ["https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk&t=3", "youtube.com/watch?t=1&v=abcdefghijk", "https://youtube.com/embed/abcdefghijk?x=1", "http://youtube.com/v/abcdefghijk", "https://youtube.com/u/1/abcdefghijk", "https://youtu.be/short", "", None]
    assert col(spark, urls, "string", C.video_id) == ["abcdefghijk"] * 6 + [None] * 3
    assert col(spark, urls[:1], "string", lambda c: C.video_thumbnail(c, F.lit("x"))) == ["https://img.youtube.com/vi/abcdefghijk/maxresdefault.jpg"]


def test_status_is_around_the_rate_of_all_decks(spark):
    cards_ = spark.createDataFrame([("S", "F", "Global", f"c{i}", w, a) for i, (w, a) in enumerate([(60.0, 1.5), (50.2, 4.0), (44.0, 8.0), (56.0, None), (None, 2.0)])], "set_code string, format string, filter_context string, card_name string, gih_wr double, alsa double")
    decks = spark.createDataFrame([("S", "F", "All Decks", "", 50.0, 9), ("S", "F", "WU", "WU", 58.0, 9)], "set_code string, format string, archetype_name string, colors string, win_rate double, games_count long")
    got = {r.card_name: r.status for r in cards.evaluate_cards(cards_, decks).collect()}
    # mean of the cards 52.55, rate of all decks 50: c1 is within half a point of the latter only
    assert got == {"c0": "Bomb", "c1": "Playable", "c2": "Unplayable", "c3": "Very Good"}
    quads = {r.card_name: r.quadrant for r in cards.matrix_quadrants(cards_, decks).collect()}
    # mean ALSA over cards with a rate: 4.5
    assert quads == {"c0": "Top tier", "c1": "Top tier", "c2": "Chaff"}


def test_resolve_names_tiers(spark):
    q = spark.createDataFrame([("Forest Elf",), ("Fire // Ice",), ("Foreat Elf",), ("Zzz",)], "query string")
    d = spark.createDataFrame([("Forest Elf",), ("Fire",)], "name string")
    assert {(r["query"], r["name"], r["tier"]) for r in cards.resolve_names(q, d).collect()} == {("Forest Elf", "Forest Elf", "exact"), ("Fire // Ice", "Fire", "front"), ("Foreat Elf", "Forest Elf", "fuzzy")}


def test_empty_tables(spark):
    arch = spark.createDataFrame([], "set_code string, format string, archetype_name string, colors string, win_rate double, games_count long")
    assert stats.meta_share(arch).count() == stats.color_breakdown(arch).count() == stats.pair_share(arch).count() == 0
    assert synergy.synergy_scores(_decks(spark, []).where("false")).count() == 0


def test_sort_nulls_last(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 2.0, None), ("c", 3.0, 2.0)], "card_name string, gih_wr double, alsa double")
    assert [r[0] for r in cards.sort_cards(df, "gih_wr", True).collect()] == ["c", "b", "a"]
    assert [r[0] for r in cards.sort_cards(df, "alsa", False).collect()] == ["a", "c", "b"]


def test_stored_skeletons_and_stale_variants(spark, tmp_path):
    key = "set_code string, format string, archetype_name string, is_alternative boolean, sample_size int"
    first = spark.createDataFrame([("S", "F", "WU", False, 5), ("S", "F", "WU", True, 2), ("S", "F", "RG", False, 4), ("S", "G", "WU", True, 3)], key)
    later = spark.createDataFrame([("S", "F", "WU", False, 9)], key)
    rows = lambda t: sorted(map(tuple, t.read().collect()))
    skeleton_table.store_skeletons(first, str(tmp_path / "s"))
    kept = skeleton_table.store_skeletons(later, str(tmp_path / "s"))
    assert rows(kept) == [("S", "F", "RG", False, 4), ("S", "F", "WU", False, 9), ("S", "F", "WU", True, 2), ("S", "G", "WU", True, 3)]
    pruned = skeleton_table.store_skeletons(later, str(tmp_path / "s"), prune=True)
    assert rows(pruned) == [("S", "F", "WU", False, 9), ("S", "G", "WU", True, 3)]


def test_a_skeleton_run_leaves_its_result_only(spark, tmp_path, monkeypatch):
    from draftloom.sources import tables

    monkeypatch.setattr(tables, "shared", lambda s: f"{tmp_path}/{len(list(tmp_path.iterdir()))}-{random.random()}")
    meta = spark.createDataFrame([("S", "F", f"a{i}", 2.0, "{W}", "Creature", "common", 55.0, 4.0) for i in range(40)], "set_code string, format string, card_name string, card_cmc double, card_cost string, card_type string, rarity string, gih_wr double, alsa double")
    syn = spark.createDataFrame([], "set_code string, format string, card_a string, card_b string, synergy_score double, lift_score double, confidence_a_to_b double, confidence_b_to_a double, co_occurrence_count long")
    out = skeleton_table.skeletons(_decks(spark, [{f"a{i}": 1 for i in range(36)}] * 45), meta, syn, F.lit("2024-01-02").cast("timestamp"))
    assert out.count() == 1
    assert [p.name.split("-")[-1] for p in tmp_path.iterdir()] == ["skeletons"]


def test_the_order_of_a_sum_decides_neither_ranks_nor_halves(spark):
    """Two equal cards, one of which lost a last bit of its mean in summing."""
    key = "set_code string, format string, archetype string, is_alternative boolean"
    scores = spark.createDataFrame([("S", "F", "W", False, "b", 0.5, 1.0625), ("S", "F", "W", False, "a", 0.5, math.nextafter(1.0625, 0))], f"{key}, card_name string, freq double, syn double")
    meta = spark.createDataFrame([("S", "F", n, "Creature", 55.0, 4.0) for n in "ab"], "set_code string, format string, card_name string, card_type string, gih_wr double, alsa double")
    got = skeletons.importance_cards(scores, meta).orderBy("rank").collect()
    assert [(r.card_name, r.synergy_score) for r in got] == [("a", 21.3), ("b", 21.3)]
    assert col(spark, [0.25, math.nextafter(0.25, 0), 0.249, 0.0, None], "double", lambda x: C.half_up(x, 1)) == [0.3, 0.3, 0.2, 0.0, None]


@pytest.fixture
def unasked(spark):
    """No join is broadcast that does not ask for it."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    yield
    spark.conf.unset(key)


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.splitlines()


def test_copies_are_summed_before_they_meet_the_cards(spark, unasked, capsys):
    meta = spark.createDataFrame([("S", "F", f"a{i}", 2.0, "Creature") for i in range(3)], "set_code string, format string, card_name string, card_cmc double, card_type string")
    for df in (skeletons.weighted_frequency, skeletons.deck_profile):
        plan = _plan(df(_decks(spark, [{"a0": 40, "a1": 1}, {"a1": 40, "x": 2}]), meta, F.lit("2024-01-02").cast("timestamp")), capsys)
        for i in (i for i, line in enumerate(plan) if "Generate explode(cardlist" in line):
            assert "Aggregate" in next(line for line in reversed(plan[:i]) if "Aggregate" in line or "Exchange" in line)


def test_decks_are_not_dealt_out_by_their_few_groups(spark, unasked, capsys, monkeypatch):
    decks = _decks(spark, [{f"a{i}": 1 for i in range(k % 7 + 1)} for k in range(45)])
    assert any("BroadcastHashJoin [set_code" in line for line in _plan(synergy.synergy_scores(decks), capsys))
    plans = {}
    monkeypatch.setattr(skeletons, "saved", lambda df, name: plans.setdefault(name, _plan(df, capsys)) and tables.saved(df, name))
    assert skeletons.cluster_decks(decks).count() == 45
    assert not any("Exchange hashpartitioning" in line and "aggregate_id" in line for line in plans["cluster-marks"])


def test_decks_of_the_same_cards_are_counted_once_for_all_rounds(spark, monkeypatch):
    """And the columns kept go with the decks, so that nothing looks them up by the id."""
    sizes = {}
    monkeypatch.setattr(skeletons, "saved", lambda df, name: (sizes.setdefault(name, df.count()), tables.saved(df, name))[1])
    one, two = {f"a{i}": 1 for i in range(12)}, {f"b{i}": 2 for i in range(12)}
    marked, used = skeletons.marked_decks(_decks(spark, [one] * 35 + [two] * 25), keep=("cardlist",))
    got = {(r.is_alternative, min(r.cardlist)) for r in marked.collect()}
    assert got == {(False, "a0"), (True, "b0")} and marked.count() == 60
    assert sizes["cluster-sets"] == 2
    tables.dropped(*used)


def test_tally_of_decks_and_cards(spark):
    decks = _decks(spark, [{"a": 40, "b": 1}, {"a": 2}, {}])
    got = {r.card_name: (r.decks, r.recent, r.full, r.copies / r.weight, r.full_copies) for r in skeletons.tally(decks, F.lit("2024-01-02").cast("timestamp")).collect()}
    w = {r.card_name: r.weight for r in skeletons.tally(decks.limit(1), F.lit("2024-01-02").cast("timestamp")).collect()}
    assert {k: v[0] for k, v in got.items()} == {None: 3, "a": 2, "b": 1}
    assert {k: v[2] for k, v in got.items()} == {None: 1, "a": 1, "b": 1}
    assert got["a"][3] == 21 and got["a"][4] == 40 * w["a"]


@pytest.mark.parametrize("max_edges", [500_000, 0])
def test_mentions_match_one_pattern(spark, max_edges):
    """Any dictionary against the rule of one alternation, longest name first, on texts of many blocks."""
    r = random.Random(8)
    words = ["red", "Ring", "blue", "x1", "of", "a_b"]
    names = sorted({" ".join(r.choices(words, k=r.randint(1, 4))).lower() for _ in range(40)} | {"red, blue", "(of", "ring!", "é", "of é ring"}, key=lambda n: (-len(n), n))
    rule = re.compile(r"\b(?:" + "|".join(map(re.escape, names)) + r")\b", re.I | re.A)
    texts = {i: "".join(r.choice([*words, *words, "redder", "é", "😀", "\n"]) + r.choice([" ", " ", " ", ", ", " (", "! ", ""]) for _ in range(n)) for i, n in enumerate((0, 1, 5, 40, 127, 128, 129, 700))}
    arts = spark.createDataFrame([*texts.items(), (99, None)], "id int, summary string")
    dictionary = spark.createDataFrame([(n, f"<{n}>") for n in names], "name string, official string")
    want = {(i, m.start(), m.group().lower()) for i, t in texts.items() for m in rule.finditer(t)}
    assert {(x.id, x.start, x.name) for x in articles.detect_mentions(arts, dictionary, max_edges=max_edges).collect()} == want and len(want) > 100
    linked = {x.id: x.linked for x in articles.link_mentions(arts, dictionary, max_edges=max_edges).collect()}
    assert linked == {**{i: rule.sub(lambda m: f"[[<{m.group().lower()}>]]", t) for i, t in texts.items()}, 99: None}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_near_names_miss_nothing(spark, k):
    r = random.Random(k)
    names = {"".join(r.choice("abAB ") for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 11, 12, 13, 14, 20, 33) for _ in range(6)}

    def worn(s):
        s = list(s)
        for _ in range(r.randint(0, k + 1)):
            i = r.randint(0, len(s))
            s[i : i + r.randint(0, 1)] = r.choice(["", "a", "B", "c"])
        return "".join(s)

    queries = {worn(x) for x in names for _ in range(3)}
    got = cards.near_names(spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame([(x,) for x in names], "name string"), k)
    want = {(q, n, e) for q in queries for n in names if (e := edits(q.lower(), n.lower())) <= k}
    assert {tuple(x) for x in got.collect()} == want and any(q[:1].lower() != n[:1].lower() for q, n, _ in want)


def test_names_of_other_sets_and_faces(spark):
    frame = lambda c, rows: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    own, other = frame("name", ["Fire // Ice", "Forest Elf", "Wear"]), frame("name", ["Guest", "Forest Elk", "Dusk // Dawn", "Forest Elf"])
    q = frame("query", ["Fire", "Wear // Tear", "Guest", "Dusk", "Forest Elm", "Torest Elf", "nothing like it"])
    got = {x.query: (x.name, x.tier) for x in cards.resolve_names(q, own, elsewhere=other).collect()}
    assert got == {"Fire": ("Fire // Ice", "front"), "Wear // Tear": ("Wear", "front"), "Guest": ("Guest", "elsewhere"), "Dusk": ("Dusk // Dawn", "elsewhere"), "Forest Elm": ("Forest Elf", "fuzzy"), "Torest Elf": ("Forest Elf", "fuzzy")}


def test_containment_matches_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc1 -B") for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9))))
    queries, names = sorted({word() for _ in range(150)}), sorted({word() for _ in range(120)})
    norm = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    want = {}
    for q in queries:
        own = [n for n in names if norm(q) and norm(n) == norm(q)] or [n for n in names if norm(q) and norm(n) and (norm(n) in norm(q) or norm(q) in norm(n))]
        if own:
            want[q] = min(own)
    got = cards.match_names_normalized(spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame([(x,) for x in names], "name string"))
    rows = got.collect()
    assert {x.query: x.name for x in rows} == want and len(rows) == len(want) > 100


def test_sample_of_a_cluster_sorts_few_decks_and_is_the_smallest_by_digest(spark, monkeypatch):
    """Of 6,000 decks those with leading zeros alone are ranked; groups too small for that rank all of theirs."""
    names = [f"Card {i:02d}" for i in range(40)]
    cards = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (F.hash("id", k) % 20 + 20).cast("int"))), lambda i: F.struct(F.get(F.array(*map(F.lit, names)), i), F.lit(1))))
    group = F.when(F.col("id") < 6000, "A").when(F.col("id") < 6100, "B").otherwise("C")
    decks = tables.saved(spark.range(6145).select(F.lit("S").alias("set_code"), F.lit("F").alias("format"), group.alias("archetype"), F.col("id").alias("aggregate_id"), cards.alias("cardlist")), "decks")
    kept, real = {}, skeletons.saved

    def saving(df, name):
        out = real(df, name)
        if name == "cluster-sample":
            kept["picked"] = {(r["archetype"], r["aggregate_id"]) for r in out.collect()}
        if name == "cluster-groups":
            kept["zeros"] = {r["archetype"]: r["zeros"] for r in out.collect()}
        return out

    monkeypatch.setattr(skeletons, "saved", saving)
    skeletons.cluster_decks(decks)
    by_digest = lambda ids: sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:50]
    want = {(g, i) for g, ids in (("A", range(6000)), ("B", range(6000, 6100)), ("C", range(6100, 6145))) for i in by_digest(ids)}
    assert kept["picked"] == want
    assert kept["zeros"] == {"A": 1, "B": 0, "C": 0}
