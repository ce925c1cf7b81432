"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

The index keeps, in a folder, which document holds which line key (a 128-bit hash),
how many documents hold a key and the largest of them, and per shard of the keys a
cuckoo filter of those that some document holds.  New documents' keys are reduced to
one row a key, meet the filter of their shard, and only those that it may have are
joined with the counts; all others are new for certain.  Deleting documents lowers the
counts of their keys, finds the largest remaining holder, and takes keys that nobody
holds out of the filters, so the index is what it would be had they never come.

Every change is a new version: its tables are written first and one row that names
them last, so a run that fails before leaves the old version as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as tv
from .cuckoo import CuckooFilter

KEY = ["key_a", "key_b"]
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTS = "shard int, key_a long, key_b long, n long, top long, version long"
_FILTERS = "shard int, segment int, slots binary"
_ASKED = "shard int, key_a long, key_b long, n long, top long, maybe boolean"
_HELD = "doc long, key_a long, key_b long, version long"
_DOCS = "doc long, version long"


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc, th, pos, key_a, key_b): the lines whose key has min_chars code points at least; th is the text's hash, pos counts from 0.

    Null texts have one empty line.  Rows with a null id have none.
    """
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = src.select("doc", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.length("line") >= min_chars).select("doc", "th", "pos", F.translate(F.btrim("line", F.lit(_BLANK)), _UPPER, _LOWER).alias("k"))
    return rows.where(F.length("k") >= min_chars).select("doc", "th", "pos", F.xxhash64("k").alias("key_a"), F.xxhash64(F.lit(2), "k").alias("key_b"))


def _hashes(t: pa.Table) -> np.ndarray:
    return t["key_a"].to_numpy().astype(np.int64).view(np.uint64)


def _asked(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's keys with what its filter says of them."""
    slots = right.sort_by("segment")["slots"].to_pylist()
    maybe = CuckooFilter(segments=slots).contains(_hashes(left)) if slots else np.zeros(len(left), bool)
    return left.append_column("maybe", pa.array(maybe))


def _changed(left: pa.Table, right: pa.Table, delete: bool) -> pa.Table:
    """A shard's filter after these keys went in (or out)."""
    held = CuckooFilter(2 * len(left), right.sort_by("segment")["slots"].to_pylist())
    (held.delete if delete else held.insert)(_hashes(left))
    slots = held.dump()
    shard = (left if len(left) else right)["shard"][0].as_py()
    return pa.table({"shard": pa.array([shard] * len(slots), pa.int32()), "segment": pa.array(range(len(slots)), pa.int32()), "slots": pa.array(slots, pa.binary())})


class LineIndex:
    """Reference counts of line keys in the folder ``path``, which outlives the session."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None) -> None:
        """Opens the index, or starts one with so many shards (the shuffle's partitions, if not given)."""
        self.spark, self.path = spark, path.rstrip("/")
        self.state = self._current()
        if self.state is None:
            self.state = {"version": 0, "shards": shards or scratch.shuffle_partitions(spark), "held": [], "docs": [], "counts": [], "gone": [], "filters": None}

    # ---- versions ----

    def _current(self) -> dict | None:
        """The newest version whose row is there."""
        try:
            rows = self.spark.read.schema("version long, state string").parquet(f"{self.path}/commits")
            last = rows.orderBy(F.desc("version")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return json.loads(last[0].state) if last else None

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        with scratch.freed_shuffles(self.spark):
            df.write.parquet(f"{self.path}/{at}")
        return at

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _commit(self, **new: object) -> None:
        state = {**self.state, **new, "version": self.state["version"] + 1}
        self.spark.createDataFrame([(state["version"], json.dumps(state))], "version long, state string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.state = state

    # ---- what is there ----

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (doc, version, ...) of documents that were not deleted since."""
        if not self.state["gone"]:
            return rows.drop("version")
        last = self._read(self.state["gone"], _DOCS).groupBy("doc").agg(F.max("version").alias("out"))
        return rows.join(last, "doc", "left").where("out is null or version > out").drop("version", "out")

    def held(self) -> DataFrame:
        """(doc, key_a, key_b): who holds what."""
        return self._live(self._read(self.state["held"], _HELD))

    def documents(self) -> DataFrame:
        """(doc): the documents that hold any key."""
        return self._live(self._read(self.state["docs"], _DOCS))

    def counts(self) -> DataFrame:
        """(key_a, key_b, n, top): how many documents hold a key, and the largest of them; keys that none holds are left out."""
        last = self._read(self.state["counts"], _COUNTS)
        if len(self.state["counts"]) > 1:
            last = last.groupBy(*KEY).agg(F.max_by(F.struct("n", "top"), "version").alias("c")).select(*KEY, "c.n", "c.top")
        return last.where("n > 0").select(*KEY, "n", "top")

    def repeated(self, min_docs: int = 3) -> DataFrame:
        """The keys that min_docs documents at least hold."""
        return self.counts().where(F.col("n") >= min_docs)

    def filters(self) -> DataFrame:
        return self._read([self.state["filters"]] if self.state["filters"] else [], _FILTERS)

    # ---- changes ----

    def _shard(self):
        return F.pmod(F.xxhash64(F.lit(3), "key_a"), F.lit(self.state["shards"])).cast("int")

    def _filters_after(self, keys: DataFrame, delete: bool, before: DataFrame | None = None) -> str:
        """The name of the filters as they are once keys (shard, KEY) are in, or out."""
        right = (self.filters() if before is None else before).groupBy("shard")
        left = keys.select("shard", *KEY).groupBy("shard")
        return self._write(left.cogroup(right).applyInArrow(lambda a, b: _changed(a, b, delete), _FILTERS), "filters")

    def _merged(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """fresh (shard, KEY, n, top) with the counts of before added, and the keys (shard, KEY) that nobody held before."""
        if not self.state["filters"]:
            return fresh, fresh
        asked = scratch.table(fresh.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_asked, _ASKED), "ln-asked")
        sure = asked.where("not maybe").drop("maybe")
        old = self.counts().select(*KEY, F.col("n").alias("n0"), F.col("top").alias("top0"))
        doubt = scratch.table(asked.where("maybe").drop("maybe").join(old, KEY, "left"), "ln-doubt")
        added = doubt.select("shard", *KEY, (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.greatest("top", "top0").alias("top"))
        # a new key that the filter took for another goes in as well, so that it is found once the other has left
        return sure.unionByName(added), sure.unionByName(doubt.where("n0 is null").select(*sure.columns))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> None:
        """Adds documents."""
        self.insert_lines(lines_of(docs, id_col, text_col, min_chars))

    def insert_lines(self, lines: DataFrame) -> None:
        """Adds documents by their lines (doc, KEY; repeats allowed).

        A document that the index has already is not added again: delete it first.
        """
        version = self.state["version"] + 1
        at = F.lit(version).cast("long").alias("version")
        if self.state["docs"]:
            lines = lines.join(self.documents(), "doc", "left_anti")
        held = self._write(lines.select("doc", *KEY).distinct().select("*", at), "held")
        rows = self._read([held], _HELD)
        docs = self._write(rows.select("doc").distinct().select("*", at), "docs")
        fresh = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("top")).select(self._shard().alias("shard"), *KEY, "n", "top")
        merged, new = self._merged(fresh)
        counts = self._write(merged.select("*", at), "counts")
        filters = self._filters_after(new, delete=False)
        self._commit(held=[*self.state["held"], held], docs=[*self.state["docs"], docs], counts=[*self.state["counts"], counts], filters=filters)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes documents out again, by their ids; ids that the index lacks do nothing."""
        version = self.state["version"] + 1
        at = F.lit(version).cast("long").alias("version")
        ids = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc")).distinct()
        gone = self._write(ids.select("doc", F.lit(version - 1).cast("long").alias("version")), "gone")
        out = self._read([gone], _DOCS).select("doc")
        live = self.held()
        touched = scratch.table(live.join(out, "doc", "left_semi").select(*KEY).distinct(), "ln-touched")
        left = live.join(out, "doc", "left_anti").join(touched, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        now = touched.join(left, KEY, "left").select(self._shard().alias("shard"), *KEY, F.coalesce("n", F.lit(0)).alias("n"), "top")
        counts = self._write(now.select("*", at), "counts")
        scratch.drop(touched)
        filters = self._filters_after(self._read([counts], _COUNTS).where("n = 0"), delete=True)
        self._commit(gone=[*self.state["gone"], gone], counts=[*self.state["counts"], counts], filters=filters)

    def compact(self) -> None:
        """Writes counts, holders and documents that are left as one table each, and filters of the size that they need."""
        at = F.lit(self.state["version"] + 1).cast("long").alias("version")
        counts = self._write(self.counts().select(self._shard().alias("shard"), *KEY, "n", "top", at), "counts")
        held = self._write(self.held().select("*", at), "held")
        docs = self._write(self.documents().select("*", at), "docs")
        filters = self._filters_after(self._read([counts], _COUNTS), delete=False, before=self._read([], _FILTERS))
        self._commit(held=[held], docs=[docs], counts=[counts], gone=[], filters=filters)


def _cut(with_text: bool):
    """Texts without the lines at the given places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, kept = [], [], []
            for text, gone in zip(b.column(2), b.column(3)):
                out = set(gone.as_py())
                t = "\n".join(x for i, x in enumerate((text.as_py() or "").split("\n")) if i not in out)
                n.append(len(out))
                sha.append(hashlib.sha256(t.encode()).hexdigest())
                kept.append(t)
            cols = {"d2": b.column(0), "t2": b.column(1), "n2": pa.array(n, pa.int64()), "sha2": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept2": pa.array(kept, pa.string())} if with_text else {}))

    return tv.released(run)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 2,
    index: LineIndex | None = None, with_text: bool = False, broadcast_keys: int = 200_000,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, kept_text]), one row per input row.

    A line's key is the line without blanks at its ends, A-Z lower-cased.  Keys of
    min_chars code points at least that min_docs documents hold lose all their lines
    except in the largest doc_id that holds them, where all of them stay.  A null or
    empty text is one empty line.  Rows that repeat an id are one document, each
    judged by its own text; rows with a null id count for nothing and lose nothing.
    Other columns are ignored.  An empty table gives an empty result.

    The documents go into the index in ``batches`` parts by id; with an index that
    is kept between runs, keys count for all documents that it holds.  Repeated
    keys are broadcast up to broadcast_keys of them, beyond that joined by shuffle.
    """
    spark = docs.sparkSession
    lines = scratch.table(lines_of(docs, id_col, text_col, min_chars), "ln-lines")
    own = index is None
    if own:
        index = LineIndex(spark, f"{scratch.shared_dir(spark)}/line-index-{uuid.uuid4().hex}", 4 * scratch.tasks_for(docs))
    for k in range(batches):
        index.insert_lines(lines.where(F.pmod(F.xxhash64(F.lit(5), "doc"), F.lit(batches)) == k))
    repeated = scratch.table(index.repeated(min_docs).select(*KEY, "top"), "ln-repeated")
    side = F.broadcast(repeated) if repeated.count() <= broadcast_keys else repeated
    gone = lines.join(side, KEY).where("doc <> top").groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
    gone = scratch.table(gone, "ln-gone")
    scratch.drop(lines, repeated)
    if own:
        scratch.drop_path(spark, index.path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    tail = ", kept2 string" if with_text else ""
    cut = src.join(gone, ["doc", "th"]).select("doc", "th", "text", "gone").mapInArrow(_cut(with_text), f"d2 long, t2 long, n2 long, sha2 string{tail}")
    changed = scratch.table(cut.dropDuplicates(["d2", "t2"]), "ln-changed")
    scratch.drop(gone)
    whole = src.select("doc", "th", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.sha2("text", 256).alias("sha"), *(["text"] if with_text else []))
    out = whole.join(changed, (whole.doc == changed.d2) & (whole.th == changed.t2), "left")
    cols = [F.col("doc").alias("doc_id"), "n_lines", F.coalesce("n2", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("sha2", "sha").alias("kept_sha256")]
    return out.select(*cols, *([F.coalesce("kept2", "text").alias("kept_text")] if with_text else []))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(doc_id <> top, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
