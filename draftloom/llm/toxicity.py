"""Toxicity: a word classifier with a counterfactual penalty.

Logistic regression on log(1 + count) of the words, and beginnings of words, that
tell the classes apart.
In labelled texts that name a group of people, the group's term is swapped for
others of its kind; the square of the change of the logit is added to the loss,
so the weights of such terms, with all features that they bring, are driven
together and a neutral mention of a group does not raise the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as tv
from .quality import fold, training_texts

U64 = np.uint64

#: Terms for groups of people, by language and kind; terms of one kind are swapped for each other.
IDENTITY_TERMS: dict[str, tuple[tuple[str, ...], ...]] = {
    "en": (
        ("women", "men", "girls", "boys", "transgender", "nonbinary"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
        ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
        ("gay", "lesbian", "bisexual", "heterosexual", "queer", "straight"),
        ("mexican", "chinese", "american", "indian", "german", "french", "russian", "turkish"),
        ("immigrants", "refugees", "foreigners", "locals", "citizens"),
        ("disabled", "blind", "deaf", "elderly", "young", "old"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
        ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
        ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
        ("mexikaner", "chinesen", "amerikaner", "inder", "deutsche", "franzosen", "russen", "türken"),
        ("einwanderer", "flüchtlinge", "ausländer", "einheimische", "bürger"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
        ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
        ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
        ("mexicains", "chinois", "américains", "indiens", "allemands", "français", "russes", "turcs"),
        ("immigrés", "réfugiés", "étrangers", "habitants", "citoyens"),
    ),
    "es": (
        ("mujeres", "hombres", "chicas", "chicos"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
        ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
        ("mexicanos", "chinos", "americanos", "indios", "alemanes", "franceses", "rusos", "turcos"),
        ("inmigrantes", "refugiados", "extranjeros", "vecinos", "ciudadanos"),
    ),
}


def kinds() -> list[tuple[str, ...]]:
    return [k for of in IDENTITY_TERMS.values() for k in of]


#: Beside whole words, their beginnings of so many bytes are features (inflected and compounded forms).
PREFIXES = (5, 6, 8)


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word and of the beginnings of longer ones.

    A beginning's hash depends on its length, so it is never that of a whole word.
    """
    w = tv.words(data, offs, tv.NOT_ALNUM, lower=True)
    doc = w.doc_of()
    raw = data[offs[0] : offs[-1]]
    hs, ds = [w.h], [doc]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        at = w.start[long] - offs[0]
        hs.append(tv.hash_spans(raw, at, at + n, tv.byte_values(True, 100 + n)))
        ds.append(doc[long])
    return np.concatenate(hs), np.concatenate(ds)


def features_of(terms: list[str]) -> list[np.ndarray]:
    """The feature hashes of each term: the word and its beginnings."""
    col = pa.array(terms, pa.string())
    h, d = _features(*tv.buffers(col))
    return [h[d == i] for i in range(len(terms))]


def _tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: rows [a, b), and the (feature hash, text, count) they hold."""
    data, offs = tv.buffers(col)
    for a, b in tv.row_blocks(offs):
        h, d = _features(data, offs[a : b + 1])
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.empty(0, np.int64)
        yield a, b, h[at], d[at], np.diff(np.r_[at, len(h)])


@dataclass
class ToxicModel:
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def score(self, col: pa.Array) -> np.ndarray:
        out = []
        data, offs = tv.buffers(col)
        for a, b in tv.row_blocks(offs):
            h, d = _features(data, offs[a : b + 1])
            s = np.full(b - a, self.bias)
            if len(self.keys) and len(h):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == h)
                cell, n = np.unique(d[hit] * len(self.keys) + at[hit], return_counts=True)
                s = s + np.bincount(cell // len(self.keys), np.log1p(n) * self.weights[cell % len(self.keys)], b - a)
            out.append(1 / (1 + np.exp(-np.clip(s, -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


Swaps = tuple[np.ndarray, np.ndarray, np.ndarray]  # (counterfactual, column, value taken away or, negative, added)


def fit_counterfactual(
    row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, k: int, swaps: Swaps,
    penalty: float = 5.0, l2: float = 0.3, rounds: int = 300, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the sparse rows (row, col, val); the mean square of the swaps' changes of the logit is penalised."""
    n = max(len(y), 1)
    w, b = np.zeros(k), 0.0
    if len(y):
        p0 = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        b = float(np.log(p0 / (1 - p0)))
    m1, m2, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    which, sc, sv = swaps
    m = int(which.max()) + 1 if len(which) else 0
    for i in range(1, rounds + 1):
        z = np.bincount(row, val * w[col], n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = p[: len(y)] - y
        g = np.bincount(col, val * e[row], k) / n + l2 * w / n
        if m:
            change = np.bincount(which, sv * w[sc], m)
            g += np.bincount(sc, 2 * penalty / m * sv * change[which], k)
        gb = float(e.mean()) if len(e) else 0.0
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**i, 1 - 0.999**i
        r = rate * (1 - i / (rounds + 1))
        w = w - r * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        b = b - r * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def swap_rows(col: np.ndarray, val: np.ndarray, keys: np.ndarray) -> Swaps:
    """Counterfactuals: every identity term of a text changed into every other of its kind, with all features of both.

    Each pair of a kind counts once even where no labelled text has it.
    """
    which, cols, vals, n = [], [], [], 0
    for kind in kinds():
        ids = [np.searchsorted(keys, f) for f in features_of(list(kind))]
        for i, a in enumerate(ids):
            seen = np.unique(val[col == a[0]])  # a text holds a term if it has its word
            for j, b in enumerate(ids):
                for v in ([1.0] if i < j else []) + (seen.tolist() if i != j else []):
                    which += [n] * (len(a) + len(b))
                    cols += [*a, *b]
                    vals += [v] * len(a) + [-v] * len(b)
                    n += 1
    return np.array(which, np.int64), np.array(cols, np.int64), np.array(vals, float)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", held_parts: int = 5, held: int = 0, max_rows: int = 20_000,
    min_df: int = 4, min_z: float = 2.5, id_col: str = "doc_id", text_col: str = "text", penalty: float = 5.0,
) -> ToxicModel:
    """Fits on at most max_rows labelled rows and on all words, or beginnings, of min_df texts that tell the classes apart by min_z deviations."""
    train = scratch.table(training_texts(docs, labels, label, held_parts, held, max_rows, id_col, text_col), "toxic-training")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            y = x.column(1).to_numpy()
            for a, b, h, d, _ in _tokens(x.column(0)):
                u, inv = np.unique(h, return_inverse=True)
                pos = np.bincount(inv, y[a:b][d], len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, minlength=len(u)).astype(np.int64)), pa.array(pos)], names=["h", "n", "pos"])

    rows, positive = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, p = F.col("n"), F.col("pos")
    share = positive / max(rows, 1)
    by_word = train.mapInArrow(counts, "h long, n long, pos long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(n >= min_df)
    # how far the word's share of positive texts is from the overall share, in standard deviations
    chosen = by_word.withColumn("z", F.abs(p - n * share) / F.sqrt(n * share * (1 - share) + 1)).where(F.col("z") >= min_z)
    picked = np.array([r[0] for r in chosen.select("h").collect()], dtype=np.int64).view(U64)
    keys = np.unique(np.concatenate([picked, *features_of([t for kind in kinds() for t in kind])]))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            y = x.column(1).to_numpy()
            for a, b, h, d, c in _tokens(x.column(0)):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = keys[at] == h
                cut = np.searchsorted(d[ok], np.arange(b - a + 1))
                lists = lambda v, t: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v, t))
                yield pa.RecordBatch.from_arrays([lists(at[ok], pa.int32()), lists(c[ok], pa.int32()), pa.array(y[a:b], pa.int32())], names=["k", "c", "y"])

    got = train.mapInArrow(sparse, "k array<int>, c array<int>, y int").toArrow()
    scratch.drop(train)
    if not got.num_rows:
        return ToxicModel(keys, np.zeros(len(keys)), 0.0)
    k = got["k"].combine_chunks()
    row = np.repeat(np.arange(got.num_rows), np.diff(k.offsets.to_numpy()))
    col, val, y = k.flatten().to_numpy(), np.log1p(got["c"].combine_chunks().flatten().to_numpy()), got["y"].to_numpy().astype(float)
    w, b = fit_counterfactual(row, col, val, y, len(keys), swap_rows(col, val, keys), penalty)
    return ToxicModel(keys, w, b)


def with_scores(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", held_parts: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)))], names=["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold("doc_id", held_parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on labels and scores every row of docs.

    Null and empty texts get the score of a text without known words.  A null id is
    scored and counts as not held out; repeated rows get equal scores.  Labels
    that are null or not 0/1, or whose id is null, are not learned.  Without
    labels every score is 0.5.  Other columns are ignored.  An empty table gives
    an empty result.
    """
    ids = {k: options[k] for k in ("id_col", "text_col", "held_parts", "held") if k in options}
    return with_scores(docs, fit(docs, labels, **options), **ids)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
