"""Quality classifier: Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text (shapes of words,
lines and characters, repetition).  The weights come from preference pairs, a
document marked good against one marked bad, by logistic loss on the feature
difference.  The cut is a quantile of the training scores: as large a share falls
below it as is marked bad; a slope fitted on the same rows maps scores to (0, 1)
with the cut at one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_WIDE = _BYTES >= 128
_MARK = np.isin(_BYTES, [ord(c) for c in ".,;:?'\"()-"])
_ODD = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_MARK
_NEWLINE = np.zeros(256, bool)
_NEWLINE[[10, 13]] = True


def _per_doc(flags: np.ndarray, rel: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[rel]).astype(np.float64)


def _repeats(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the commonest) of each text."""
    u, c = np.zeros(n), np.zeros(n)
    if len(h):
        key = tv.per_text(h, d)
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        runs = np.diff(np.r_[at, len(h)])
        du = tv.split_keys(key[at])[1]
        u = np.bincount(du, minlength=n).astype(np.float64)
        np.maximum.at(c, du, runs)
    return u, c


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = len(offs) - 1
    rel = offs - offs[0]
    raw = data[offs[0] : offs[-1]]
    size = np.diff(rel).astype(np.float64)
    w = tv.words(data, offs, tv.SPACE, lower=False)
    doc, count = w.doc_of(), w.counts.astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    one = np.maximum(count, 1)
    mean = np.bincount(doc, length, n) / one
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / one - mean**2, 0))
    upper, lower, digit = (_per_doc(t[raw], rel) for t in (_UPPER, _LOWER, _DIGIT))
    mark, odd, wide = (_per_doc(t[raw], rel) for t in (_MARK, _ODD, _WIDE))
    letters = np.maximum(upper + lower + wide, 1)
    distinct, top = _repeats(w.h, doc, n)
    g, gd = tv.doc_kgrams(w, 3, short_whole=False)
    tri, _ = _repeats(g, gd, n)
    tri_n = np.maximum(np.bincount(gd, minlength=n), 1)
    lines = tv.words(data, offs, _NEWLINE)
    line_n = np.maximum(lines.counts, 1).astype(np.float64)
    line_u, _ = _repeats(lines.h, lines.doc_of(), n)
    last = raw[w.end - 1 - offs[0]] if len(w.end) else np.empty(0, np.uint8)
    odd_end = np.bincount(doc, _ODD[last], n) / one
    stop_end = np.bincount(doc, _MARK[last], n) / one
    caps = np.bincount(doc, _UPPER[raw[w.start - offs[0]]] if len(w.start) else None, n) / one if len(doc) else np.zeros(n)
    one_b = np.maximum(size, 1)
    cols = [
        np.log1p(size), np.log1p(count), np.minimum(mean, 40), np.minimum(spread, 40), upper / letters, caps, digit / one_b,
        mark / one_b, odd / one_b, np.log1p(100 * odd / one_b), wide / letters, distinct / one, top / one, tri / tri_n, line_u / line_n,
        np.log1p(count / line_n), odd_end, stop_end, (count < 5).astype(float), (size == 0).astype(float),
    ]
    return np.column_stack(cols)


N_FEATURES = features(np.empty(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def text_features(col: pa.Array) -> np.ndarray:
    data, offs = tv.buffers(col)
    parts = [features(data, offs[a : b + 1]) for a, b in tv.row_blocks(offs)]
    return np.concatenate(parts) if parts else np.empty((0, N_FEATURES))


@dataclass
class BradleyTerry:
    """score = 1 / (1 + exp(-slope * (w . z(x) - cut)))."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        t = self.slope * (self.expand(x) @ self.weights - self.cut)
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, l2: float = 1.0, rounds: int = 15, seed: int = 0) -> BradleyTerry:
    """Newton steps on the pairs' logistic loss.  With one class or none the score is 0.5 throughout."""
    k = x.shape[1]
    mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(k), np.ones(k))
    model = BradleyTerry(mean, np.where(std > 1e-9, std, 1), np.zeros(2 * k), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    z = model.expand(x)
    # each good and each bad document is in the same number of pairs, one apart
    i = good[np.arange(pairs) % len(good)]
    j = bad[rng.permutation(pairs) % len(bad)]
    diff = z[i] - z[j]
    w = np.zeros(2 * k)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = diff.T @ p / pairs - l2 * w / 100
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + (l2 / 100) * np.eye(2 * k)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = z @ w
    model.cut = float(np.quantile(s, len(bad) / len(x)))
    a, t, target = 1.0, s - model.cut, (y == 1).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * t, -30, 30)))
        h = float((p * (1 - p) * t * t).sum()) + 1.0
        a = min(max(a + float(((target - p) * t).sum()) / h, 0.05), 20.0)
    model.slope = a
    return model


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % parts


def training_texts(docs: DataFrame, labels: DataFrame, label: str, held_parts: int, held: int, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of at most max_rows labelled rows outside the held-out fold, the smallest by hash of the id."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col, held_parts) != held))
    pick = rows.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("__id"), "__id", "y").limit(max_rows)
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    return text.join(F.broadcast(pick), "__id").select("text", "y")  # the sample is bounded by max_rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_parts: int = 3, held: int = 1, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> BradleyTerry:
    """Fits on at most max_rows labelled rows; only their feature rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = training_texts(docs, labels, label, held_parts, held, max_rows, id_col, text_col).mapInArrow(run, "x array<double>, y int").toArrow()
    n = got.num_rows
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(n, N_FEATURES) if n else np.empty((0, N_FEATURES))
    y = got["y"].to_numpy() if n else np.empty(0, int)
    order = np.lexsort((*x.T, y))  # the fit must not depend on the order of partitions
    return fit_pairs(x[order], y[order])


def with_scores(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text", held_parts: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(text_features(b.column(1))))], names=["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tv.released(run), "doc_id long, score double").select(
        "doc_id", F.coalesce(fold("doc_id", held_parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on labels and scores every row of docs.

    Null and empty texts are scored as texts without words.  A null id is scored
    and counts as not held out; repeated rows get equal scores.  Labels that are
    null or not 0/1, or whose id is null, are not learned; an id with two labels
    gives both rows.  Without labels of both kinds every score is 0.5.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    ids = {k: options[k] for k in ("id_col", "text_col", "held_parts", "held") if k in options}
    return with_scores(docs, fit(docs, labels, **options), **ids)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject.

    Each row is judged by its own text, null and empty ones as texts without words,
    also where rows repeat an id or it is null.  Columns of any name are kept as
    they are.  Without labels of both kinds nothing is rejected; an empty table stays
    empty.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(text_features(b.column(at))) >= 0.5))

    return docs.mapInArrow(tv.released(run), docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
