"""Ranked lexical search over an index of document shards, evaluated as a hybrid of TAAT and DAAT.

The index has one row a shard, a bounded stretch of documents: its terms (64-bit
hashes, sorted), their postings, and the documents' ids and lengths.  A query meets
each shard by itself.  Its short lists are read term-at-a-time and summed to
accumulators, which from then on are one more iterator with one bound.  That iterator
and the long lists are walked document-at-a-time: iterators whose bounds together
cannot reach the best scores so far are not walked but only asked, by binary search,
for documents that the others bring up and whose bound still suffices.  The best of
each task are merged to the best of all.

Scores are integers and exact; skipping loses nothing.  Terms are compared by 64 bits
of their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from . import textvec as tv

U64 = np.uint64
INDEX = "n_docs int, n_null int, with_terms long, n_terms long, terms binary, most binary, starts binary, docs binary, tfs binary, ids binary, sizes binary"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
CHUNK = 256  # documents looked at together


def _narrow(a: np.ndarray) -> bytes:
    """The array in the narrowest unsigned type that holds it, the type's width in the first byte."""
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + tv.planes(a.astype(f"u{width}"))


def _wide(b: bytes) -> np.ndarray:
    return tv.from_planes(b[1:], np.dtype(f"u{b[0]}").type).astype(np.int64)


def _shard(data: np.ndarray, offs: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple:
    """One row of INDEX; documents in the order of their ids, those without one last."""
    rank = np.lexsort((ids, ~known))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    w = tv.words(data, offs, tv.NOT_ALNUM, lower=True)
    terms, inverse = np.unique(w.h, return_inverse=True)
    pairs, tf = np.unique(inverse.astype(np.int64) * len(rank) + place[w.doc_of()], return_counts=True)
    of, doc = np.divmod(pairs, len(rank))
    starts = np.searchsorted(of, np.arange(len(terms) + 1))
    most = np.maximum.reduceat(tf, starts[:-1]) if len(terms) else np.empty(0, np.int64)
    sizes = w.counts[rank]
    return (
        len(rank), int((~known).sum()), int((sizes > 0).sum()), int(sizes.sum()),
        tv.planes(terms), _narrow(most), _narrow(starts), _narrow(doc), _narrow(tf), tv.planes(np.where(known, ids, 0)[rank]), _narrow(sizes),
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 2 << 20) -> DataFrame:
    """The index of docs: one row a shard of at most shard_bytes of text, or of one document.

    Null and empty texts have no terms.  Rows that repeat an id, or have none, are
    documents of their own.  Other columns are ignored.  An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tv.buffers(b.column(1))
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for x, y in tv.row_blocks(offs, shard_bytes):
                row = _shard(data, offs[x : y + 1], ids[x:y], known[x:y])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tv.released(run), INDEX)


def query_terms(queries: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each query, as hashes; rows of one item are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tv.buffers(b.column(1))
            for x, y in tv.row_blocks(offs):
                w = tv.words(data, offs[x : y + 1], tv.NOT_ALNUM, lower=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x).take(pa.array(w.doc_of())), pa.array(w.h.view(np.int64))], names=["item_id", "term"])

    src = queries.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tv.released(run), "item_id long, term long").distinct()


def document_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the given terms (sorted hashes); those that none holds are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for own, starts in zip(b.column(0), b.column(1)):
                at, found = _looked_up(tv.from_planes(own.as_py(), U64), terms)
                s = _wide(starts.as_py())
                total[found] += s[at[found] + 1] - s[at[found]]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[held].view(np.int64)), pa.array(total[held])], names=["term", "df"])

    rows = index.select("terms", "starts").mapInArrow(tv.released(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r.term & (1 << 64) - 1: r.df for r in rows}


def _looked_up(own: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in own, whether it is there) of each term."""
    at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
    return at, own[at] == terms if len(own) else np.zeros(len(terms), bool)


class Best:
    """The k best documents of one query so far: the highest scores, equal ones by the smaller id, none last."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.score = self.id = self.null = np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((i, n, -s))[: self.k]
        self.score, self.id, self.null = s[order], i[order], n[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


class Postings:
    """An iterator of a shard: documents in order, what each adds to the score, and the most that one adds."""

    def __init__(self, docs: np.ndarray, adds: np.ndarray) -> None:
        self.docs, self.adds = docs, adds
        self.bound = int(adds.max()) if len(adds) else 0

    def at(self, docs: np.ndarray) -> np.ndarray:
        """What this list adds for each of the documents; found by binary search."""
        k = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[k] == docs, self.adds[k], 0)


def summed(lists: list[Postings], n_docs: int) -> Postings:
    """Term-at-a-time: the lists' sums as one iterator."""
    total = np.zeros(n_docs, np.int64)
    for p in lists:
        total[p.docs] += p.adds
    docs = np.flatnonzero(total)
    return Postings(docs, total[docs])


def walk(lists: list[Postings], best: Best, ids: np.ndarray, null: np.ndarray) -> int:
    """Document-at-a-time over the iterators; gives how many documents were scored."""
    lists = sorted((p for p in lists if len(p.docs)), key=lambda p: p.bound)
    upto = np.concatenate([[0], np.cumsum([p.bound for p in lists])]).astype(np.int64)
    if not lists or upto[-1] < best.least:
        return 0
    at, scored = 0, 0
    while True:
        # the first ``idle`` iterators cannot bring up a document by themselves
        idle = int(np.searchsorted(upto[1:], best.least, side="left"))
        if idle == len(lists):
            return scored
        # the next documents of the others; of each list a chunk, and no further than all have been read
        heads = [p.docs[(i := np.searchsorted(p.docs, at)) : i + CHUNK] for p in lists[idle:]]
        ends = [h[-1] for h in heads if len(h) == CHUNK]
        docs = np.unique(np.concatenate(heads))
        stop = min(ends) if ends else None
        docs = docs if stop is None else docs[docs <= stop]
        if not len(docs):
            return scored
        scored += len(docs)
        score = np.zeros(len(docs), np.int64)
        for k in range(len(lists) - 1, -1, -1):
            if k < idle:
                may = score + upto[k + 1] >= best.least
                docs, score = docs[may], score[may]
                if not len(docs):
                    break
            score = score + lists[k].at(docs)
        good = score >= best.least
        if good.any():
            best.add(score[good], ids[docs[good]], null[docs[good]])
        if stop is None:
            return scored
        at = int(stop) + 1


def _searched(items: list[np.ndarray], terms: np.ndarray, weights: np.ndarray, n_all: int, len_all: int, k: int, short: float):
    """items: for each query the places of its terms in ``terms``; gives (query, doc_id, score) of the task's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        flat = np.concatenate([np.empty(0, np.int64), *items])
        edges = np.cumsum([0, *map(len, items)])
        for b in batches:
            for row in b.to_pylist():
                at, found = _looked_up(tv.from_planes(row["terms"], U64), terms)
                if not found.any():
                    continue
                sizes, starts, most = _wide(row["sizes"]), _wide(row["starts"]), _wide(row["most"])
                m = 50 + 50 * sizes * n_all // len_all
                top = np.zeros(len(terms), np.int64)
                tf = most[at[found]]
                top[found] = weights[found] * (1_000_000_000 * tf // (1000 * tf + 20 * int(m[sizes > 0].min())))
                sums = np.concatenate([[0], np.cumsum(top[flat])])
                bounds = sums[edges[1:]] - sums[edges[:-1]]
                docs, tfs = _wide(row["docs"]), _wide(row["tfs"])
                ids = tv.from_planes(row["ids"], np.int64)
                null = (np.arange(len(ids)) >= len(ids) - row["n_null"]).astype(np.int64)
                lists: dict[int, Postings] = {}

                def postings(t: int) -> Postings:
                    if t not in lists:
                        x, y = starts[at[t]], starts[at[t] + 1]
                        d, f = docs[x:y], tfs[x:y]
                        lists[t] = Postings(d, weights[t] * (1_000_000_000 * f // (1000 * f + 20 * m[d])))
                    return lists[t]

                for q in np.flatnonzero(bounds >= [x.least for x in best]).tolist():
                    own = [postings(t) for t in items[q].tolist() if found[t] and weights[t] > 0]
                    few = [p for p in own if len(p.docs) <= short * len(ids)]
                    walk([summed(few, len(ids)), *(p for p in own if len(p.docs) > short * len(ids))], best[q], ids, null)
        for q, x in enumerate(best):
            if len(x.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x.score), q, np.int32)), pa.array(x.id, mask=x.null.astype(bool)), pa.array(x.score)], names=["query", "doc_id", "score"])

    return tv.released(run)


def search(
    index: DataFrame, queries: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", short: float = 0.1, block_terms: int = 50_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each query, equal scores by the smaller id.

    Scores above 0 only; a query without terms has no rows.  Rows that repeat an item
    are one query, those without an id too; documents without an id come last of
    their score.  Either side may be empty.  ``short`` is the share of a shard's
    documents up to which a list is read term-at-a-time.

    Queries go in blocks of about block_terms terms (a single query is never cut), each
    over the whole index, so what a task is sent does not grow with the query set.
    """
    spark = index.sparkSession
    pairs = scratch.table(query_terms(queries, item_col, text_col), "ls-terms")
    n_all, len_all = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    total = pairs.count()
    blocks = -(-total // block_terms)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks if n_all else 0):
        mine = pairs.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(blocks)) == block).collect()
        if not mine:
            continue
        terms = np.unique(np.array([r.term for r in mine], np.int64).view(U64))
        df = document_frequencies(index, terms)
        weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) if t in df else 0 for t in terms.tolist()], np.int64)
        names = sorted({r.item_id for r in mine}, key=lambda i: (i is None, i))
        own: dict[int | None, list[int]] = {i: [] for i in names}
        for r in mine:
            own[r.item_id].append(r.term & (1 << 64) - 1)
        items = [np.searchsorted(terms, np.array(own[i], U64)) for i in names]
        found = index.mapInArrow(_searched(items, terms, weights, n_all, len_all, k, short), "query int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        # a query's rows of many tasks are thinned in parts before they meet
        part = F.pmod(F.spark_partition_id(), F.lit(32))
        found = found.withColumn("part", part)
        thin = found.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("r") <= k).drop("r", "part")
        named = spark.createDataFrame(list(enumerate(names)), "query int, item_id long")
        thin = scratch.table(thin.join(F.broadcast(named), "query").select("item_id", "doc_id", "score"), "ls-found")
        out = out.unionByName(thin)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = scratch.table(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ls-index")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY doc_id, term),
size AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY doc_id),
every AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
norm AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM size, every),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, every WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
