"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A seed is a hash of the words at the positions a fixed mask keeps; the ignored
positions may hold any word, so a passage with substituted words still shares
seeds with its source.  Seeds of the corpus and of the benchmark are joined,
hits are collected by (text, item, offset, block of the item), and there the two word
sequences are compared around the hit: a text is contaminated if some run of
``window`` aligned words (or the whole item, if shorter) agrees in at least
``share`` of them.  The masks for a window leave no gap: however the words that
may differ lie, one of the masks keeps none of them, so every such run is found.

Texts are told apart by their hash: exact copies have their hits in common, and what
is found in one is found in all.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: By (words of the window, words that may differ).  1: the word counts, 0: any word will do.
#: Shifted within the window, one of the masks misses any choice of differing words.
MASKS = {(13, 3): ("1101111", "1110001011", "10111011", "110010000111", "11100111")}
#: For other windows: words a mask should keep, and masks at most to reach that.
KEEP, MOST = 5, 20


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    """df's text as __t and its hash (__k1, __k2), beside its other columns, of which those of these names go."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumns({"__k1": F.xxhash64(t), "__k2": F.xxhash64(F.lit(2), t), "__t": t})


def _seeds(df: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """(keep..., mask, pos, seed) of df's column h, an array of word hashes.

    One row per position and mask, made by generators inside one code-generated
    stage; the array itself is never copied.
    """
    spans = [len(m) for m in masks]
    rows = df.where(F.size("h") >= min(spans)).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - min(spans))).alias("pos"))

    def seed(mask: str) -> Column:
        at = [F.col("h")[F.col("pos") + i] for i, c in enumerate(mask) if c == "1"]
        return F.when(F.col("pos") + len(mask) <= F.size("h"), F.xxhash64(*at))

    return rows.select(*keep, "pos", F.posexplode(F.array(*[seed(m) for m in masks])).alias("mask", "seed")).where("seed is not null")


def may_differ(n: int, share: float) -> int:
    """How many of n words may differ."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    return max(e for e in range(n + 1) if (n - e) / n >= share)


def masks_of(n: int, share: float) -> tuple[str, ...]:
    """Masks that find every run of n aligned words that agrees in at least share of them.

    Where none are tabled, n is cut into e + q blocks, e being the words that may
    differ: q blocks at least are equal, and there is a mask for each choice of q.
    """
    e = may_differ(n, share)
    if (n, e) in MASKS:
        return MASKS[n, e]
    found: dict[str, None] = {}
    for q in range(1, n - e + 1):
        if q > 1 and comb(e + q, q) > MOST:
            break
        sizes = [n // (e + q) + (i < n % (e + q)) for i in range(e + q)]
        found = dict.fromkeys("".join(("1" if i in kept else "0") * k for i, k in enumerate(sizes)).strip("0") for kept in combinations(range(e + q), q))
        if min(m.count("1") for m in found) >= KEEP:
            break
    return tuple(found)


def masks_for(lengths: list[int], window: int = 13, share: float = 0.75) -> dict[str, list[int]]:
    """Mask -> the window lengths it serves: whole items that are shorter, and window for all others."""
    served: dict[str, list[int]] = {}
    for n in sorted({min(n, window) for n in lengths if n > 0} or {window}):
        for m in masks_of(n, share):
            served.setdefault(m, []).append(n)
    return served


def word_hashes(text: Column) -> Column:
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def _blocks(items: DataFrame, window: int) -> DataFrame:
    """(item_id, w, block, lo, own): each item's words in blocks of window, with the words of a window less one on both sides; lo is own's first place."""
    last = F.floor((F.size("h") - 1) / window)
    rows = items.select("item_id", F.least(F.lit(window), F.size("h")).alias("w"), "h", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * window - (window - 1)).cast("int")
    return rows.select("item_id", "w", "block", lo.alias("lo"), F.slice("h", lo + 1, F.least(F.size("h").cast("long"), (F.col("block") + 2) * window - 1).cast("int") - lo).alias("own"))


def _hits(rows: DataFrame, seeds: DataFrame, masks: tuple[str, ...], window: int, broadcast_bytes: int) -> DataFrame:
    """(__k1, __k2, item_id, offset, block): where a text and an item share a seed, once for each offset and block of the item.

    The seeds of a benchmark (some 40 bytes each, without its words) are broadcast
    if they take at most broadcast_bytes, else joined by shuffle.
    """
    found = _seeds(rows, masks, "__k1", "__k2")
    small = seeds.count() * 40 <= broadcast_bytes
    hits = found.join(F.broadcast(seeds) if small else seeds, ["mask", "seed"])
    return hits.select("__k1", "__k2", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset"), F.floor(F.col("item_pos") / window).alias("block")).distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 13, share: float = 0.75, broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """(__k1, __k2, item_id, offset, agree): texts of docs, by hash, and the items they hold.

    agree is the largest share of equal words over the windows of the alignment.
    Any window that counts has a seed in it, so around a hit the words of a block of
    the item are compared, at most three windows, however long text and item are.
    Seeds, hits and the items' blocks are each broadcast if they take at most
    broadcast_bytes, beyond that joined by shuffle.
    """
    items = scratch.table(benchmark.select(F.col(item_col).cast("long").alias("item_id"), word_hashes(F.coalesce(F.col(item_text).cast("string"), F.lit(""))).alias("h")).where("size(h) > 0"), "dc-items")
    width = F.least(F.size("h"), F.lit(window))
    served = masks_for([r[0] for r in items.select(width).distinct().collect()], window, share)
    masks = tuple(served)
    item_seeds = _seeds(items.withColumn("n", width), masks, "item_id", "n")
    ok = reduce(lambda a, b: a | b, [(F.col("mask") == i) & F.col("n").isin(served[m]) for i, m in enumerate(masks)])
    seeds = scratch.table(item_seeds.where(ok).select("mask", "seed", "item_id", F.col("pos").alias("item_pos")).distinct(), "dc-seeds")

    texts = _texts(docs, text_col).select("__k1", "__k2", "__t")
    hits = scratch.table(_hits(texts.select("__k1", "__k2", word_hashes(F.col("__t")).alias("h")), seeds, masks, window, broadcast_bytes), "dc-hits")
    # (item, offset, block) of each text with any; only these texts' words are hashed again
    listed = hits.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("item_id", "offset", "block")).alias("l"))
    rows = texts.join(F.broadcast(listed) if hits.count() * 40 <= broadcast_bytes else listed, ["__k1", "__k2"])
    rows = rows.select("__k1", "__k2", "l", word_hashes(F.col("__t")).alias("h")).select("__k1", "__k2", "h", F.inline("l"))
    first = (F.col("block") * window - (window - 1) + F.col("offset")).cast("int")
    start = F.greatest(F.lit(0), first)
    length = F.greatest(F.least(F.size("h"), first + 3 * window - 2) - start, F.lit(0))
    cut = rows.select("__k1", "__k2", "item_id", "offset", "block", (start - F.col("offset")).alias("at"), F.slice("h", start + 1, length).alias("other")).where("size(other) > 0")
    blocks = scratch.table(_blocks(items, window), "dc-blocks")
    pairs = cut.join(F.broadcast(blocks) if blocks.count() * (24 * window + 60) <= broadcast_bytes else blocks, ["item_id", "block"])
    # what both have of the aligned words
    lo, hi = F.greatest("lo", "at"), F.least(F.col("lo") + F.size("own"), F.col("at") + F.size("other"))
    both = F.zip_with(F.slice("own", lo - F.col("lo") + 1, hi - lo), F.slice("other", lo - F.col("at") + 1, hi - lo), lambda a, b: (a == b).cast("int"))
    # a passage cut off by the text's edge must still fill the window
    enough = pairs.where(hi - lo >= F.col("w")).withColumn("same", both)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("w") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("w")), F.lit(0), lambda s, x: s + x))) / F.col("w")
    found = enough.withColumn("agree", best).where(F.col("agree") >= share).groupBy("__k1", "__k2", "item_id", "offset").agg(F.max("agree").alias("agree"))
    found = scratch.table(found, "dc-found")
    scratch.drop(items, seeds, hits, blocks)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_texts: int = 500_000, **options) -> DataFrame:
    """(doc_id, item_id, agree): the items each document holds, with the best agreement.

    Null and empty texts hold nothing; empty items are in no document.  Rows that
    repeat an id give the items of all their texts, each once; a null id is
    reported as null.  Other columns are ignored.  Either table may be empty.
    What is found in texts is broadcast to their rows up to broadcast_texts
    findings, beyond that joined by shuffle.
    """
    found = contaminated(docs, benchmark, text_col=text_col, **options).groupBy("__k1", "__k2", "item_id").agg(F.max("agree").alias("agree"))
    found = F.broadcast(found) if found.count() <= broadcast_texts else found
    ids = _texts(docs, text_col).select(F.col(id_col).cast("long").alias("doc_id"), "__k1", "__k2")
    return ids.join(found, ["__k1", "__k2"]).groupBy("doc_id", "item_id").agg(F.max("agree").alias("agree"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", broadcast_texts: int = 500_000, **options) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark.

    Null and empty texts, and rows with a null id, stay unless their text holds an
    item; all rows of a text that does go, repeated ones too.  Columns of any name
    are kept as they are.  Without items all rows stay; an empty table stays empty.
    The hashes of contaminated texts are broadcast up to broadcast_texts of them, so
    that texts are not shuffled; beyond that they are joined by shuffle.
    """
    found = contaminated(docs, benchmark, text_col=text_col, **options).select("__k1", "__k2").distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = F.broadcast(found) if found.count() <= broadcast_texts else found
    return docs.join(found, (F.xxhash64(text) == found["__k1"]) & (F.xxhash64(F.lit(2), text) == found["__k2"]), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All words that a text and an item have in common vote for an offset; windows that hold most of them
#: begin or end with one, and the rule is applied to each.  No seeds.
OP3_SQL = """
WITH dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)),
iw AS (SELECT item_id, len(w) AS m, unnest(w) AS word, unnest(range(len(w))) AS q FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark)),
hit AS (SELECT doc_id, item_id, p - q AS o, q, least(13, m) AS w, least(m, n - (p - q)) - greatest(0, q - p) AS aligned FROM dw JOIN iw USING (word)),
likely AS (SELECT doc_id, item_id, o FROM hit WHERE aligned >= w GROUP BY doc_id, item_id, o HAVING count(*) >= 0.75 * max(w)),
win AS (SELECT doc_id, item_id, w, count(*) OVER (PARTITION BY doc_id, item_id, o ORDER BY q RANGE BETWEEN CURRENT ROW AND w - 1 FOLLOWING) AS a,
        count(*) OVER (PARTITION BY doc_id, item_id, o ORDER BY q RANGE BETWEEN w - 1 PRECEDING AND CURRENT ROW) AS b FROM hit JOIN likely USING (doc_id, item_id, o))
SELECT doc_id, item_id, max(greatest(a, b) / w) AS agree FROM win GROUP BY doc_id, item_id HAVING max(greatest(a, b) / w) >= 0.75
"""
