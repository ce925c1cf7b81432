"""Target-distribution importance resampling over hashed word n-grams.

The distinct words of the corpus, each between delimiters, make an Aho-Corasick
dictionary whose payloads are the word's CRC-32 and length.  A scan of a block of
texts emits the payloads; those of neighbouring words are composed to the CRC of
their n-gram, and that modulo the number of buckets is the feature.  Bucket counts of
corpus and target give each bucket's gain, a document's weight is its mean gain, and
documents are drawn by weight plus Gumbel noise that depends on the id alone.

The dictionary holds the commonest words, as many as a task may hold; the CRC of
any other word is taken from its bytes, so results do not depend on that bound.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crc, scratch
from . import textvec as tv

#: What a byte of a text becomes: words keep theirs, A-Z lower-cased; all else is a delimiter.
_FOLD = np.where(tv.NOT_ALNUM, 32, np.arange(256)).astype(np.uint8)
_FOLD[65:91] += 32
_LONGEST = 48  # bytes of a word of the dictionary at most
_automata: dict[str, object] = {}


def _delimited(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The folded texts with a delimiter before, between and after them."""
    lens = np.diff(offs)
    out = np.full(int(lens.sum()) + len(lens) + 1, 32, np.uint8)
    row = np.repeat(np.arange(len(lens)), lens)
    out[np.arange(len(row)) + row + 1] = _FOLD[data[offs[0] : offs[-1]]]
    return out


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts; a word may come in several parts."""
    seen: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        kept = [(w, n) for w, n in seen.items() if len(w) <= _LONGEST]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    for b in batches:
        data, offs = tv.buffers(b.column(0))
        for x, y in tv.row_blocks(offs):
            seen.update(_delimited(data, offs[x : y + 1]).tobytes().split())
            if len(seen) > 200_000:
                yield rows()
                seen.clear()
    yield rows()


def common_words(docs: DataFrame, text_col: str = "text", most: int = 50_000, exact_counts: int = 10_000) -> list[bytes]:
    """At most ``most`` of the commonest distinct words: all that occur some number of times or more.

    That number comes from how many words occur how often (counts above exact_counts
    together), so no task sorts all words.
    """
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(tv.released(_distinct), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = scratch.table(found, "rs-words")
    left, least = most, None
    for n, words in sorted(found.groupBy(F.least("n", F.lit(exact_counts)).alias("n")).agg(F.count("*").alias("words")).collect(), reverse=True):
        left -= words
        if left < 0:
            break
        least = n
    words = [] if least is None else sorted(bytes(r[0]) for r in found.where(F.col("n") >= least).select("word").collect())
    scratch.drop(found)
    return words


class Scanner:
    """The automaton of a dictionary, and the n-gram buckets of texts by it."""

    def __init__(self, words: list[bytes]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()  # its own integers have 32 bits only
        for w in words:
            self.automaton.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
        if words:
            self.automaton.make_automaton()
        self.empty = not words
        self.missed = 0

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(CRC, length) of every word of the texts, and each text's first word."""
        w = tv.words(data, offs, tv.NOT_ALNUM, lower=True, hashes=False)
        text = _delimited(data, offs)
        ends = w.end - offs[0] + w.doc_of() + 1
        payload = np.full(len(ends), -1, np.int64)
        if not self.empty and len(ends):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
            payload[np.searchsorted(ends, hits[:, 0])] = hits[:, 1]
        other = np.flatnonzero(payload < 0)
        if len(other):
            raw = text.tobytes()
            size = w.end[other] - w.start[other]
            found = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends[other].tolist(), size.tolist())]
            payload[other] = size << 32 | np.array(found, np.int64)
            self.missed += len(other)
        return (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32, w.first

    def buckets(self, data: np.ndarray, offs: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of every run of 1 to longest words."""
        c, size, first = self.words(data, offs)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found, of, run = [c % np.uint32(buckets)], [doc], c
        for n in range(2, longest + 1):
            if len(c) < n:
                break
            run = crc.joined(run[:-1], c[n - 1 :], size[n - 1 :])
            same = doc[: len(run)] == doc[n - 1 :]
            found.append(run[same] % np.uint32(buckets))
            of.append(doc[: len(run)][same])
        return np.concatenate(found).astype(np.int64), np.concatenate(of)


def _scanner(words: list[bytes]) -> Scanner:
    """The worker's automaton of this dictionary; it holds one at a time."""
    key = hashlib.sha256(b" ".join(words)).hexdigest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = Scanner(words)
    return _automata[key]


def bucket_counts(docs: DataFrame, words: list[bytes], longest: int = 2, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many n-grams of the texts fall into each bucket; a task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total = _scanner(words), np.zeros(buckets, np.int64)
        for b in batches:
            data, offs = tv.buffers(b.column(0))
            for x, y in tv.row_blocks(offs):
                total += np.bincount(scan.buckets(data, offs[x : y + 1], longest, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(tv.released(run), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of all buckets: 1000 times the log ratio of the smoothed shares, floored."""
    spark = corpus.sparkSession
    sums = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s_all")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t_all")))  # one row each
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    d = lambda c, k: (F.coalesce(F.col(c), F.lit(0)) + k).cast("double")
    ratio = (d("t", 1) * d("s_all", buckets)) / (d("s", 1) * d("t_all", buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def _weights(words: list[bytes], gains: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(words)
        for b in batches:
            data, offs = tv.buffers(b.column(1))
            n, weight = [], []
            for x, y in tv.row_blocks(offs):
                found, doc = scan.buckets(data, offs[x : y + 1], longest, len(gains))
                size = np.bincount(doc, minlength=y - x)
                order = np.argsort(doc, kind="stable")
                upto = np.concatenate([[0], np.cumsum(gains[found[order]])])
                edge = np.concatenate([[0], np.cumsum(size)])
                n.append(size.astype(np.int64))
                weight.append((upto[edge[1:]] - upto[edge[:-1]]) // np.maximum(size, 1))
            empty = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(empty + n)), pa.array(np.concatenate(empty + weight))], names=["doc_id", "n_features", "weight"])

    return tv.released(run)


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with ``rank`` (1, 2, 3 ...) in the given order, without one task that sees all rows.

    Rows are dealt out by range and sorted inside their part; a part's ranks start
    after the rows of the parts before it, of which only the number is collected.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(scratch.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    rows = scratch.table(parts.withColumn("__at", F.monotonically_increasing_id()), "rs-ranked")
    part = F.shiftright("__at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, start = [], 0
    for p, n in sizes:
        before.append((p, start))
        start += n
    offsets = spark.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), part == offsets["part"]).select(*df.columns, rank.alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = 25, min_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, dictionary_words: int = 50_000,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per input row; rank is null where a document is not drawn.

    Of the documents with min_words words at least, percent in a hundred (floored)
    are drawn, the highest scores first, equal ones by the smaller id.  Null and
    empty texts have no features and weight 0; rows that repeat an id and text score
    alike and are drawn each for itself; the noise of a null id is that of an empty
    one, and it comes after the others of its score.  Other columns are ignored.
    Either table may be empty; without a target all weights follow from its
    smoothed shares.
    """
    words = common_words(docs, text_col, dictionary_words)
    corpus = scratch.table(bucket_counts(docs, words, longest, buckets, text_col), "rs-corpus")
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(corpus, bucket_counts(target, words, longest, buckets, target_col), buckets).collect():
        gains[bucket] = gain
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = src.mapInArrow(_weights(words, gains, longest), "doc_id long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)
    scored = scratch.table(weighed.withColumn("score", F.col("weight") + noise), "rs-scored")
    # n words have n + (n - 1) + ... runs of up to ``longest`` words
    enough = F.col("n_features") >= sum(max(min_words - k, 0) for k in range(longest))
    fit = scored.where(enough)
    drawn = fit.count() * percent // 100
    out = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id")])
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    scratch.drop(corpus)
    return out.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose id is drawn; rows with a null id never are."""
    ids = resample(docs, target, id_col, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs[id_col].cast("long") == ids["__drawn"], "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The CRC is taken byte by byte, of each distinct n-gram once.
OP12_SQL = r"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) AS r(n))),
d AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM f),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(len(h) AS BIGINT) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d, tab),
c AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM c, (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM c)),
e AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE kind = 0 GROUP BY id),
s AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN e ON id = doc_id),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 39)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""
