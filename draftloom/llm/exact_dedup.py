"""Exact dedup with a persistent digest index, bucketed and sorted by hash.

The index is a Spark table with one row per distinct text (32-byte SHA-256) and
the id of the row that stays.  New data is reduced to one row per digest (combined
map-side), sort-merge anti-joined with the index on the digest and appended.
The index is bucketed by the digest, so its side of the join is not shuffled; each
append adds a sorted file to a bucket, and the join sorts a bucket of several
files once more.  A single table is fed to its index in
batches of falling ids, so the first row of a text that comes is the one to stay.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, uid, digest): uid tells repeated rows of one written table apart; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), _digest(text_col).alias("digest"))


class DigestIndex:
    """Digests seen so far: (digest, keep_id)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None) -> None:
        """Opens the table ``name``; a first append creates it (at ``path`` if given)."""
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or scratch.shuffle_partitions(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    @staticmethod
    def groups(digests: DataFrame) -> DataFrame:
        """(digest, keep_id, keep_uid, group_size): of equal texts the row with the largest id stays (null ids last)."""
        best = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "uid"))
        return digests.groupBy("digest").agg(best.alias("m"), F.count("*").alias("group_size")).select(
            "digest", F.col("m.id").alias("keep_id"), F.col("m.uid").alias("keep_uid"), "group_size")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join."""
        if not self.exists():
            return groups
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> DataFrame:
        """Adds the groups whose digest is new, and gives them.  A digest already there keeps its row."""
        fresh = scratch.table(self.unseen(groups), "digest-fresh")  # the anti-join must end before the table grows
        rows = fresh.select("digest", "keep_id")
        w = rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        if self.path:
            w = w.option("path", self.path)
        with scratch.freed_shuffles(self.spark):
            w.saveAsTable(self.name)
        return fresh

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _fed(digests: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """Feeds digests to the index in batches of falling ids: the groups that were new.

    The batches are cut at quantiles of the ids; null ids come last.
    """
    cuts = digests.agg(F.percentile_approx("id", [k / batches for k in range(batches - 1, 0, -1)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    ident = F.col("id")
    parts, above = [], F.lit(False)
    for c in cuts:
        parts.append(digests.where((ident >= c) & ~above))
        above = above | (ident >= c)
    parts.append(digests.where(~F.coalesce(above, F.lit(False))))
    return reduce(DataFrame.unionByName, [index.append(index.groups(p)) for p in parts])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 1000, index: DigestIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row, dropped ones too.

    Texts are equal when identical; null counts as empty.  The row with the largest
    id stays; a null id is smaller than any, and among rows that repeat the same
    id and text exactly one is kept.  Other columns are ignored.  An empty table
    gives an empty result.  With an index that is kept between runs, texts that it
    had before have its keep_id and no row is kept; group_size counts docs alone.

    Digests of more than 1/share of all rows are at most ``share`` many, so these
    rows are matched by broadcast and never shuffled; all others by sort-merge.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    digests = scratch.table(with_digest(docs, id_col, text_col), "digests")
    fresh = _fed(digests, index).select("digest", F.col("keep_uid").alias("new_uid"))
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = sizes.join(index.read().hint("merge"), "digest").join(fresh, "digest", "left")
    groups = scratch.table(groups.select("digest", "keep_id", "group_size", "new_uid"), "digest-groups")
    if own:
        index.drop()
    total = digests.count()
    large = groups.where(F.col("group_size") > max(1, total // share))
    hot = large.select(F.col("digest").alias("hd"), F.col("keep_id").alias("hk"), F.col("new_uid").alias("hu"), F.col("group_size").alias("hs"))
    marked = digests.join(F.broadcast(hot), digests.digest == hot.hd, "left")
    done = marked.where("hd is not null").select("id", "uid", "digest", F.col("hk").alias("keep_id"), F.col("hu").alias("new_uid"), F.col("hs").alias("group_size"))
    rest = marked.where("hd is null").select("id", "uid", "digest").join(groups.hint("merge"), "digest").select("id", "uid", "digest", "keep_id", "new_uid", "group_size")
    return done.unionByName(rest).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.coalesce(F.col("uid") == F.col("new_uid"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate_new(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", broadcast_digests: int = 500_000) -> DataFrame:
    """Rows of docs, with all their columns, whose text neither the index nor a better row of docs has; the index grows by them.

    Of equal texts in docs the row with the largest id stays, a null id only if
    there is no other; null texts count as empty; of rows that repeat both id and
    text exactly one stays.  Columns of any name are kept as they are.  An empty
    table gives an empty result.

    Only digests that are repeated or seen before are joined back to the texts;
    up to broadcast_digests of them are broadcast, so that texts are not
    shuffled.  Beyond that both sides are dealt out by the digest.
    """
    groups = scratch.table(index.groups(with_digest(docs, id_col, text_col)), "digest-groups")
    fresh = index.append(groups)
    new = fresh.select(F.col("digest").alias("new_digest"))
    judged = groups.join(new, groups.digest == new.new_digest, "left").where("group_size > 1 or new_digest is null")
    ident = F.col(id_col).cast("long")
    same = with_digest(docs, id_col, text_col).groupBy("digest", "id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("digest").alias("d2"), F.col("id").alias("i2"), F.lit(True).alias("again"))
    judged = judged.join(same, (judged.digest == same.d2) & judged.keep_id.eqNullSafe(same.i2), "left")
    judged = scratch.table(judged.select(F.col("digest").alias("__judged"), F.col("keep_id").alias("__keep"), F.col("new_digest").isNull().alias("__seen"), F.coalesce("again", F.lit(False)).alias("__again")), "digest-judged")
    side = F.broadcast(judged) if judged.count() <= broadcast_digests else judged
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), ident.alias("__id"), _digest(text_col).alias("__digest"))
    rows = rows.join(side, rows["__digest"] == side["__judged"], "left")
    stays = F.col("__judged").isNull() | (~F.col("__seen") & F.col("__keep").eqNullSafe(F.col("__id")))
    kept = rows.where(stays)
    once = kept.where(~F.coalesce("__again", F.lit(False))).select("__row.*")
    if not judged.where("__again").limit(1).count():
        return once
    # rows that repeat both: one of each stays
    repeated = kept.where("__again").groupBy("__digest").agg(F.first("__row").alias("__row")).select("__row.*")
    return once.unionByName(repeated)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated texts, by deduplicate_new with an index of its own: the row with the largest id stays."""
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    out = deduplicate_new(docs, index, id_col, text_col)
    index.drop()
    return out


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
