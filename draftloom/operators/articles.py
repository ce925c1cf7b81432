"""Strategy articles: windows, filters, sentiment and card mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import saved


def _votes() -> tuple[Column, Column]:
    yes = F.coalesce("votes_yes", F.lit(0))
    return yes, yes + F.coalesce("votes_meh", F.lit(0)) + F.coalesce("votes_no", F.lit(0))


def article_sentiment(df: DataFrame) -> DataFrame:
    """A4: share of good votes, rounded, its label, and the shares of each kind; null without votes."""
    yes, total = _votes()
    share = lambda c: F.when(total > 0, F.coalesce(c, F.lit(0)) / total)
    good = F.when(total > 0, F.floor(yes / total * 100 + 0.5).cast("int"))
    label = F.when(good >= 75, "Great Read").when(good >= 40, "Mixed").when(good.isNotNull(), "Controversial")
    return df.withColumns({"good_percent": good, "sentiment": label, "share_yes": share("votes_yes"), "share_meh": share("votes_meh"), "share_no": share("votes_no")})


def count_votes(events: DataFrame) -> DataFrame:
    """A5: votes by kind of each article; of a reader's votes on it only the first counts."""
    w = Window.partitionBy("article_id", "reader_id").orderBy("ts", "event_id")
    first = events.withColumn("r", F.row_number().over(w)).where("r = 1")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"votes_{k}")
    return first.groupBy("article_id").agg(n("yes"), n("meh"), n("no"))


def dedup_articles(df: DataFrame) -> DataFrame:
    """Of articles with the same video the oldest stays; those without a URL all stay."""
    w = Window.partitionBy("video_url").orderBy("published_at", "id")
    with_url = df.where("video_url is not null and video_url <> ''").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return with_url.unionByName(df.where("video_url is null or video_url = ''"))


def article_tags(df: DataFrame) -> DataFrame:
    """The tags in use."""
    return df.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def mentioned_cards(df: DataFrame) -> DataFrame:
    """The cards that articles name."""
    return df.select(F.explode(C.parse_pg_array("mentioned_cards")).alias("card_name")).distinct().orderBy("card_name")


def suggest_mentions(df: DataFrame, text: str, n: int = 8) -> DataFrame:
    """the first n mentioned cards that contain a text."""
    return mentioned_cards(df).where(F.lower("card_name").contains(text.lower())).orderBy("card_name").limit(n)


def recent_articles(df: DataFrame, as_of: Column, days: int = 15, set_tag: str | None = None) -> DataFrame:
    """articles of the last days, newest first."""
    out = df.where(F.col("published_at") >= as_of - F.expr(f"make_interval(0, 0, 0, {days})"))
    return (out.where(F.col("set_tag") == set_tag) if set_tag else out).orderBy(F.desc("published_at"), F.desc("id"))


def article_page(df: DataFrame, before: Column, n: int = 20, set_tag: str | None = None) -> DataFrame:
    """the next n articles older than a cursor."""
    out = df.where(F.col("published_at") < before)
    return (out.where(F.col("set_tag") == set_tag) if set_tag else out).orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def filter_articles(df: DataFrame, tags: list[str] | None = None, top: bool = False, card: str = "") -> DataFrame:
    """F8: articles with all the tags, well received if asked, and naming a card that contains the text."""
    out = df.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>")))) == 0) if tags else df
    if top:
        yes, total = _votes()
        out = out.where((total > 0) & (F.floor(yes / total * 100 + 0.5) >= 75))
    if card:
        out = out.where(F.exists(C.parse_pg_array("mentioned_cards"), lambda c: F.lower(c).contains(card.lower())))
    return out


#: A token: a word, or one other character.  Names begin and end where tokens do.
_TOKEN = "[A-Za-z0-9_]+|[^A-Za-z0-9_]"
_WORD = "^[A-Za-z0-9_]"
_BLOCK = 256


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_TOKEN})"), F.lit(1))


def _edges(dictionary: DataFrame) -> DataFrame:
    """The names as a trie in a table: (state, token) -> next, and the name (with its official form) that ends there.

    A state is the hash of the tokens that lead to it, that of the root is the hash of none.
    """
    official = F.coalesce("official", "name") if "official" in dictionary.columns else F.col("name")
    names = dictionary.where("name <> ''").select(F.lower("name").alias("name"), official.alias("official")).groupBy("name").agg(F.min("official").alias("official"))
    steps = names.select("*", _tokens(F.col("name")).alias("t")).select("*", F.posexplode("t").alias("at", "token"))
    upto = lambda n: F.xxhash64(F.slice("t", F.lit(1), n))
    ends = F.col("at") + 1 == F.size("t")
    own = steps.select(upto(F.col("at")).alias("state"), "token", upto(F.col("at") + 1).alias("next"), *[F.when(ends, F.col(c)).alias(c) for c in ("name", "official")], (F.col("at") + 1).alias("level"))
    return own.groupBy("state", "token").agg(F.max("next").alias("next"), F.min("name").alias("name"), F.min("official").alias("official"), F.max("level").alias("level"))


def detect_mentions(articles: DataFrame, dictionary: DataFrame, text: str = "summary", max_edges: int = 500_000) -> DataFrame:
    """(id, start, length, name, official): dictionary names in the texts, whole words, of any case.

    start and length count characters.  dictionary: name, as texts have it, and
    official (else the name itself).  The names are a trie of tokens, which all places
    of a text walk together, a level at a time, by equi-joins on (state, next token).
    A text's matches are taken from left to right, the longest at each place, and one
    that starts before the end of the last one taken is dropped.  The trie is
    broadcast up to max_edges edges; beyond that it is joined by shuffle.
    """
    return _mentions(articles, dictionary, text, max_edges).drop("at", "tokens")


def _mentions(articles: DataFrame, dictionary: DataFrame, text: str, max_edges: int) -> DataFrame:
    """detect_mentions with the first token and the number of tokens of each mention."""
    edges = saved(_edges(dictionary), "mention-edges")
    count, levels = edges.agg(F.count("*"), F.max("level")).first()
    levels = levels or 1
    few = count <= max_edges
    trie = F.broadcast(edges) if few else edges
    root = trie.where("level = 1").select(F.col("token").alias("first"), F.col("next").alias("state"), F.col("name").alias("n1"), F.col("official").alias("o1"))

    # texts in blocks of tokens, each with the tokens around it, so that a place carries no more than its block
    rows = articles.select("id", _tokens(F.col(text)).alias("t"))
    every = F.sequence(F.lit(0), F.greatest(F.floor((F.size("t") - 1) / _BLOCK).cast("int"), F.lit(0)))
    sizes = F.transform(every, lambda b: F.length(F.array_join(F.slice("t", b * _BLOCK + 1, F.lit(_BLOCK)), "")))
    rows = rows.select("id", "t", F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n))).alias("before"))
    block = lambda b: F.struct(b.alias("b"), F.get("before", b).alias("chars"), F.get("t", b * _BLOCK - 1).alias("prev"), F.slice("t", b * _BLOCK + 1, F.lit(_BLOCK + levels)).alias("own"))
    blocks = rows.select("id", F.inline(F.transform(every, block)))
    places = blocks.select("id", "b", "chars", "prev", "own", F.posexplode(F.slice("own", 1, _BLOCK)).alias("i", "token")).withColumn("first", F.lower("token"))
    start = F.col("chars") + F.length(F.array_join(F.slice("own", F.lit(1), F.col("i")), ""))
    follow = F.transform(F.slice("own", F.col("i") + 1, F.lit(levels + 1)), lambda x: F.lower(x))
    previous = F.when(F.col("i") == 0, F.col("prev")).otherwise(F.get("own", F.col("i") - 1))
    at = (F.col("b") * _BLOCK + F.col("i")).alias("at")
    with_window = lambda df, *more: df.select("id", at, start.alias("start"), follow.alias("w"), F.coalesce(previous.rlike(_WORD), F.lit(False)).alias("after_word"), *more)
    if few:
        found = with_window(places.join(root, "first"), "state", "n1", "o1")
    else:
        found = with_window(places, "first").join(root, "first").drop("first")
    # a name that begins (or ends) in another character than a word's does so at an edge only beside a word; said of
    # names, not of places: as a filter on these it would be taken ahead of the join, to every token
    edges_of = lambda k: (F.get("w", F.lit(0)).rlike(_WORD) | F.col("after_word")) & (F.get("w", F.lit(k - 1)).rlike(_WORD) | F.coalesce(F.get("w", F.lit(k)).rlike(_WORD), F.lit(False)))
    found = found.select("id", "at", "start", "w", "after_word", "state", *[F.when(F.col("n1").isNotNull() & edges_of(1), F.col(c)).alias(n) for c, n in (("n1", "name"), ("o1", "official"))], F.lit(1).alias("tokens"))
    for k in range(2, levels + 1):
        step = trie.select(F.col("state").alias("s"), F.col("token").alias("x"), F.col("next").alias("to"), F.col("name").alias("n"), F.col("official").alias("o"))
        found = found.join(step, (found["state"] == step["s"]) & (F.get("w", F.lit(k - 1)) == step["x"]), "left")
        better = F.col("n").isNotNull() & edges_of(k)
        found = found.select("id", "at", "start", "w", "after_word", F.col("to").alias("state"), F.when(better, F.col("n")).otherwise(F.col("name")).alias("name"), F.when(better, F.col("o")).otherwise(F.col("official")).alias("official"), F.when(better, F.lit(k)).otherwise(F.col("tokens")).alias("tokens"))
        found = found.where("state is not null or name is not null")
    hits = found.where("name is not null").select("id", "start", F.length("name").alias("length"), "name", "official", "at", "tokens")
    return _left_to_right(hits)


def _left_to_right(hits: DataFrame) -> DataFrame:
    """Of each text's hits those that start at or after the end of the last one taken.

    Runs of overlapping hits are folded, each by itself; most are a single hit.
    """
    order = Window.partitionBy("id").orderBy("start")
    reach = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    names = hits.columns[1:]
    listed = runs.groupBy("id", "run").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("all"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, m: Column) -> Column:
        fits = m["start"] >= s["end"]
        return F.struct(F.when(fits, m["start"] + m["length"]).otherwise(s["end"]).alias("end"), (s["i"] + 1).alias("i"), F.when(fits, F.concat(s["kept"], F.array(s["i"]))).otherwise(s["kept"]).alias("kept"))

    kept = F.when(F.size("all") == 1, F.array(F.lit(0))).otherwise(F.aggregate("all", zero, step, lambda s: s["kept"]))
    return listed.select("id", "all", F.explode(kept).alias("i")).select("id", F.get("all", F.col("i")).alias("m")).select("id", "m.*")


def link_mentions(articles: DataFrame, dictionary: DataFrame, text: str = "summary", max_edges: int = 500_000) -> DataFrame:
    """Articles with each mention in the text written as a link [[official name]]."""
    found = _mentions(articles, dictionary, text, max_edges).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "tokens", "official"))).alias("m"))
    rows = articles.join(found, "id", "left").withColumn("t", _tokens(F.col(text)))
    part = lambda a, b: F.array_join(F.slice("t", a + 1, b - a), "")  # noqa: E731  tokens a to b
    end = lambda x: F.coalesce(x["at"] + x["tokens"], F.lit(0))
    pieces = F.transform("m", lambda x, i: F.concat(part(end(F.get(F.col("m"), i - 1)), x["at"]), F.lit("[["), x["official"], F.lit("]]")))
    last = end(F.element_at("m", -1))
    linked = F.concat(F.array_join(pieces, ""), part(last, F.size("t")))
    return rows.withColumn("linked", F.when(F.col("m").isNull(), F.col(text)).otherwise(linked)).drop("m", "t")
