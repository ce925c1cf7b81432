"""Substring dedup with super-k-mers.

A window is ``width`` consecutive words of one document.  Its minimiser is the
smallest hash of its m-word grams; equal windows have equal minimisers.
Consecutive windows with one minimiser overlap almost wholly, so they travel as
one packed string (a super-k-mer) to the minimiser's bucket, where all windows
are sorted and counted exactly, by 128-bit fingerprints of their words.

Only minimisers that several documents have can hold a repeated window.  They
are found first, from (minimiser, document) pairs alone, so that texts without
any are never sent.  A minimiser of very many windows (of many documents, ``hot``,
or of many windows in one, ``dense``) is not brought to one bucket: its windows
are dealt out by their own fingerprints, and a batch sends each fingerprint once,
with its smallest document there; what other documents of the batch have of it is known to
be repeated at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs, scratch
from . import textvec as tv

U64 = np.uint64
_RANGES = "doc long, th long, start long, n long"


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """min(g[i:i+w]) for each i, by doubling."""
    if len(g) < w:
        return g[:0]
    out, have = g, 1
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values by prefix sums (cost independent of k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    p, q = tv._powers(len(h) + 1)
    acc = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[: len(h)], out=acc[1:])
    return tv.mix64((acc[k:] - acc[:-k]) * q[:n])


class SuperKmers:
    """Runs of windows with one minimiser: first word (in the block), windows, minimiser, text index."""

    def __init__(self, w: tv.Words, width: int, m: int) -> None:
        low = sliding_min(tv.kgrams(w.h, m, seed=11), width - m + 1)
        doc = w.doc_of()
        n = len(low)
        inside = doc[:n] == doc[width - 1 :] if n else np.empty(0, bool)
        at = np.flatnonzero(inside)
        v, d = low[at], doc[at]
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        self.start, self.doc, self.key = at[first], d[first], v[first]
        self.n = np.diff(np.r_[first, len(at)])


def _pairs(width: int, m: int, buckets: int, dense: int):
    """(minimiser, document) pairs packed by bucket; notes: (minimiser, windows) where a text has more than ``dense`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, b in enumerate(batches):
            b = b.filter(b.column(0).is_valid())
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = tv.buffers(b.column(1))
            s, d, nd, nv = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in tv.row_blocks(offs):
                k = SuperKmers(tv.words(data, offs[x : y + 1]), width, m)
                order = np.lexsort((k.key, k.doc))
                key, doc, n = k.key[order], k.doc[order], k.n[order]
                at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.empty(0, np.int64)
                total = np.add.reduceat(n, at) if len(at) else n
                s.append(key[at])
                d.append(ids[doc[at] + x])
                many = total > dense
                nd.append(key[at][many].view(np.int64))
                nv.append(total[many])
            yield blobs.pack(np.concatenate(s), np.concatenate(d), buckets, turn, (np.concatenate(nd), np.concatenate(nv)))

    return run


def _packed(width: int, m: int):
    """Super-k-mers whose minimiser is in the row's list: (key, hot, doc, th, start, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, offs = tv.buffers(b.column(2))
            lists, flags = b.column(3), b.column(4)
            lo = lists.offsets.to_numpy().astype(np.int64)
            listed, hot = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), flags.values.to_numpy(zero_copy_only=False)
            for x, y in tv.row_blocks(offs):
                w = tv.words(data, offs[x : y + 1])
                k = SuperKmers(w, width, m)
                v, h = listed[lo[x] : lo[y]], hot[lo[x] : lo[y]]
                row = np.repeat(np.arange(y - x), np.diff(lo[x : y + 1]))
                # membership of (text, key): sort both sides together
                tag = tv.mix64(v ^ tv.mix64(row.astype(U64)))
                order = np.argsort(tag)
                tag, h = tag[order], h[order]
                mine = tv.mix64(k.key ^ tv.mix64(k.doc.astype(U64)))
                at = np.minimum(np.searchsorted(tag, mine), max(len(tag) - 1, 0))
                ok = tag[at] == mine if len(tag) else np.zeros(len(mine), bool)
                if not ok.any():
                    continue
                s, d = k.start[ok], k.doc[ok]
                a, z = w.start[s], w.end[s + k.n[ok] + width - 2]
                texts = [data[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.key[ok].view(np.int64)), pa.array(h[at[ok]]), pa.array(ids[d + x]), pa.array(th[d + x]), pa.array(s - w.first[d]), pa.array(texts, pa.binary())],
                    names=["key", "hot", "doc", "th", "start", "body"])

    return run


def _windows(t: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, second fingerprint, row, word position) of every window of the packed strings."""
    col = t["body"]
    data, offs = tv.buffers(col)
    out = []
    for x, y in tv.row_blocks(offs, 2 << 20):
        a = tv.words(data, offs[x : y + 1], seed=1)
        b = tv.words(data, offs[x : y + 1], seed=2)
        doc = a.doc_of()
        f1, f2 = rolling(a.h, width), rolling(b.h, width)
        ok = np.flatnonzero(doc[: len(f1)] == doc[width - 1 :]) if len(f1) else np.empty(0, np.int64)
        out.append((f1[ok], f2[ok], doc[ok] + x, ok - a.first[doc[ok]]))
    if not out:
        e = np.empty(0, np.int64)
        return np.empty(0, U64), np.empty(0, U64), e, e
    return tuple(np.concatenate(c) for c in zip(*out))


def _runs(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, width: int) -> pa.Table:
    """Word ranges covered by windows at pos."""
    order = np.lexsort((pos, th, doc))
    doc, th, pos = doc[order], th[order], pos[order]
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(pos)] - 1
    if not len(pos):
        at = last = np.empty(0, np.int64)
    return pa.table({"doc": doc[at], "th": th[at], "start": pos[at], "n": pos[last] - pos[at] + width})


def _judged(f1: np.ndarray, f2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that have an equal one in a smaller document, and all others."""
    order = np.lexsort((doc, f2, f1))
    a, b, ds = f1[order], f2[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    smallest = ds[at][np.cumsum(new) - 1] if len(at) else ds
    return order[ds > smallest], order[ds == smallest]


def _count_bucket(width: int):
    """Sorts the windows of a bucket; those with an equal one in a smaller document give ranges."""

    def run(t: pa.Table) -> pa.Table:
        f1, f2, row, pos = _windows(t, width)
        doc, th, start = (t[c].to_numpy() for c in ("doc", "th", "start"))
        hit, _ = _judged(f1, f2, doc[row])
        r = row[hit]
        return _runs(doc[r], th[r], start[r] + pos[hit], width)

    return run


_SPREAD = "bucket int, doc long, th long, start long, n long, body binary"


def _spread(width: int, buckets: int):
    """Windows of hot minimisers, batch by batch: ranges of those that a smaller document of the batch has too
    (bucket -1), and the others packed by the bucket of their fingerprint, one entry a batch however many documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f1, f2, row, pos = _windows(b, width)
            doc, th, pos = b["doc"].to_numpy()[row], b["th"].to_numpy()[row], b["start"].to_numpy()[row] + pos
            hit, rest = _judged(f1, f2, doc)
            found = _runs(doc[hit], th[hit], pos[hit], width).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), -1, np.int32)), *(found[c].combine_chunks() for c in ("doc", "th", "start", "n")), pa.nulls(len(found), pa.binary())], names=["bucket", "doc", "th", "start", "n", "body"])
            of = ((f1[rest] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
            rest = rest[np.argsort(of, kind="stable")]
            of = np.sort(of)
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist() if len(of) else []
            packed = [np.column_stack([f1[w].view(np.int64), f2[w].view(np.int64), doc[w], th[w], pos[w]]).tobytes() for w in (rest[x:y] for x, y in zip(cuts, [*cuts[1:], len(of)]))]
            none = pa.nulls(len(cuts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(of[cuts] if cuts else np.empty(0, np.int32)), none, none, none, none, pa.array(packed, pa.binary())], names=["bucket", "doc", "th", "start", "n", "body"])

    return run


def _meet(width: int):
    """Ranges of the windows of a bucket of fingerprints that a smaller document of another batch has."""

    def run(t: pa.Table) -> pa.Table:
        w = np.concatenate([np.empty((0, 5), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 5) for x in t["body"].to_pylist())])
        hit, _ = _judged(w[:, 0].view(U64), w[:, 1].view(U64), w[:, 2])
        return _runs(w[hit, 2], w[hit, 3], w[hit, 4], width)

    return run


def _kept(b: pa.RecordBatch, text_at: int, ranges_at: int | None) -> tuple[list, list, list, list]:
    """n_words, n_removed, sha256 of the kept words and the kept text of each row."""
    data, offs = tv.buffers(b.column(text_at))
    n_words, n_removed, sha, kept_text = [], [], [], []
    if ranges_at is not None:
        lists = b.column(ranges_at)
        lo = lists.offsets.to_numpy().astype(np.int64)
        starts = lists.values.field("start").to_numpy(zero_copy_only=False)
        lengths = lists.values.field("n").to_numpy(zero_copy_only=False)
    for x, y in tv.row_blocks(offs):
        w = tv.words(data, offs[x : y + 1], hashes=False)
        base = int(offs[x])
        size = int(offs[y]) - base
        gone = np.zeros(len(w.start) + 1, np.int64)
        if ranges_at is not None:
            r = np.repeat(np.arange(y - x), np.diff(lo[x : y + 1]))
            s = w.first[r] + starts[lo[x] : lo[y]]
            np.add.at(gone, s, 1)
            np.add.at(gone, s + lengths[lo[x] : lo[y]], -1)
        removed = np.cumsum(gone[:-1]) > 0 if len(w.start) else np.empty(0, bool)
        # bytes of kept words, each with the separator behind it if it has one
        sep = (w.end < offs[x + 1 : y + 1][w.doc_of()]).astype(np.int64)
        s0, e0 = w.start[~removed] - base, (w.end + sep)[~removed] - base
        edge = np.zeros(size + 1, np.int8)
        np.add.at(edge, s0, 1)
        np.add.at(edge, e0, -1)
        mask = np.cumsum(edge[:size], dtype=np.int8) > 0
        buf = data[base : base + size].copy()
        buf[(w.end - base)[sep > 0]] = 0x20
        cut = np.concatenate([[0], np.cumsum(mask)])[offs[x : y + 1] - base]
        flat = buf[mask]
        gone_by = np.concatenate([[0], np.cumsum(removed)])[w.first]
        n_words += np.diff(w.first).tolist()
        n_removed += np.diff(gone_by).tolist()
        for i in range(y - x):
            piece = flat[cut[i] : cut[i + 1]].tobytes().rstrip(b" ")
            sha.append(hashlib.sha256(piece).hexdigest())
            kept_text.append(piece)
    return n_words, n_removed, sha, kept_text


def _digest(with_ranges: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r, s, t = _kept(b, 2, 3 if with_ranges else None)
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string())]
            names = ["doc", "th", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(t, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(
    docs: DataFrame, width: int = 50, m: int = 8, id_col: str = "doc_id", text_col: str = "text",
    hot: int = 500, dense: int = 500, with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per input row.

    A word goes if a window over it also starts in a document with a smaller id;
    windows are judged on the input.  Repeats within a document stay.  A null text
    has no words.  Rows whose id is null lose nothing and take nothing from others.
    Rows that repeat an id are judged each by its own text, and never against each
    other.  Texts shorter than a window stay whole.  Other columns are ignored.
    An empty table gives an empty result.

    hot, dense: minimisers of more documents, or of more windows in one text, take
    that other way, so a bucket's minimiser has at most hot * dense windows.
    """
    spark = docs.sparkSession
    if not 1 <= m <= width:
        raise ValueError("m must be from 1 to width")
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    tasks = scratch.tasks_for(src)
    packed = src.select("doc", "text").mapInArrow(_pairs(width, m, 4 * tasks, dense), blobs.SCHEMA).repartition(tasks, "bucket")
    found = scratch.table(packed.groupBy("bucket").applyInArrow(blobs.gather, blobs.MEMBERS).select("sig", "doc", "note"), "sd-members")
    members = found.where("note is null").select("sig", "doc")
    heavy = found.where("note is not null").select(F.col("doc").alias("sig")).distinct().withColumn("heavy", F.lit(True))
    held = members.groupBy("sig").agg(F.count("*").alias("c")).join(heavy, "sig", "left")
    flagged = members.join(held, "sig").select("doc", "sig", F.coalesce(F.col("heavy"), F.col("c") > hot).alias("hot"))
    lists = flagged.groupBy("doc").agg(F.collect_set(F.struct("sig", "hot")).alias("l")).select("doc", F.col("l.sig").alias("sigs"), F.col("l.hot").alias("hots"))
    cand = scratch.table(src.where("doc is not null").join(lists, "doc").select("doc", "th", "text", "sigs", "hots"), "sd-cand")
    supers = scratch.table(cand.mapInArrow(_packed(width, m), "key long, hot boolean, doc long, th long, start long, body binary"), "sd-super")
    rows = supers.where("not hot").count()
    buckets = max(16 * tasks, rows // 2_000 + 1)  # many a task, so that tasks are even
    cold = supers.where("not hot").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition(max(tasks, buckets // 16), "bucket").groupBy("bucket").applyInArrow(_count_bucket(width), _RANGES)
    spread = scratch.table(supers.where("hot").select("doc", "th", "start", "body").mapInArrow(_spread(width, 4 * tasks), _SPREAD), "sd-spread")
    near = spread.where("bucket < 0").select("doc", "th", "start", "n")
    far = spread.where("bucket >= 0").select("bucket", "body").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_meet(width), _RANGES)
    ranges = cold.unionByName(near).unionByName(far).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    tail = ", kept_text string" if with_text else ""
    out = f"doc long, th long, n_words long, n_removed long, kept_sha256 string{tail}"
    changed = scratch.table(cand.select("doc", "th", "text").distinct().join(ranges, ["doc", "th"]).mapInArrow(_digest(True, with_text), out), "sd-changed")
    scratch.drop(found, cand, supers, spread)
    whole = src.mapInArrow(_digest(False, with_text), out)
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    new = changed.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), *[F.col(c).alias(f"_{c}") for c in names])
    joined = whole.join(new, (whole.doc == new.d2) & (whole.th == new.t2), "left")
    return joined.select(F.col("doc").alias("doc_id"), *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (s) WHERE doc_id > lo),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
