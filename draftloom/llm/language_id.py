"""Language identification by interpolated Kneser-Ney character models.

One model per language, order 4, over letters and single spaces.  Counts cover
every training text; the lower orders use continuation counts.  The interpolated
log-probability of each n-gram that a language has is stored in the language's own
arrays, sorted by the n-gram's hash; any other falls back to its context's weight
and the next lower order.  The language with the lowest
cross-entropy per character wins; how far that lies above what the language's
own texts have decides on rejection.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as tv
from .quality import fold

U64 = np.uint64
ORDER = 4
SPACE = 32
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or a space for anything else."""
    if not _table:
        t = np.full(sys.maxunicode + 1, SPACE, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _table.append(t)
    return _table[0]


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol of each text, letters of each text).

    Each text starts with ORDER-1 spaces; runs of other characters are one space.
    Symbols have 16 bits: a letter beyond that is its two UTF-16 units, so letters never collide.
    """
    raw = data[offs[0] : offs[-1]]
    rel = offs - offs[0]
    n = len(offs) - 1
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[rel]
    table = _letters()
    c = table[cp]
    doc = np.repeat(np.arange(n), np.diff(lead))
    blank = c == SPACE
    keep = ~blank
    if len(c):
        keep[1:] |= ~blank[:-1] & (doc[1:] == doc[:-1])
    c, doc = c[keep], doc[keep]
    letters = np.bincount(doc[c != SPACE], minlength=n)
    if len(c) and c.max() > 0xFFFF:
        high = c > 0xFFFF
        at = np.repeat(np.arange(len(c)), 1 + high)
        second = np.r_[False, at[1:] == at[:-1]]
        rest = c[at] - np.uint32(0x10000)
        c = np.where(~high[at], c[at], np.where(second, 0xDC00 + (rest & 0x3FF), 0xD800 + (rest >> 10))).astype(np.uint32)
        doc = doc[at]
    sizes = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)])
    out = np.full(first[-1], SPACE, U64)
    out[np.arange(len(c)) + (ORDER - 1) * (doc + 1)] = c
    return out, first, letters


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed 4-gram ending at each symbol, its text, letters of each text)."""
    s, first, letters = symbols(data, offs)
    n = len(offs) - 1
    if len(s) < ORDER:
        return np.empty(0, U64), np.empty(0, np.int64), letters
    k = s[:-3] << U64(48) | s[1:-2] << U64(32) | s[2:-1] << U64(16) | s[3:]
    doc = np.repeat(np.arange(n), np.diff(first))
    ok = doc[:-3] == doc[3:]
    return k[ok], doc[3:][ok], letters


class Lookup:
    """Values by packed n-gram, in an array sorted by the n-gram's hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        h = tv.mix64(keys)
        order = np.argsort(h)
        self.h, self.values = h[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether present)."""
        if not len(self.h):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        h = tv.mix64(keys)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h


@dataclass
class LanguageModel:
    """The interpolated model of one language."""

    probs: list[Lookup]  # of order 1..ORDER: log-probability of the n-grams that the language has
    weights: list[Lookup]  # of context length 1..ORDER-1: log of the weight of the lower order
    floor: float  # log-probability of an unseen symbol

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each n-gram's last symbol; an unseen one falls back to its context's weight and the lower order."""
        if order == 0 or not len(self.probs[order - 1].h):
            return np.full(len(keys), self.floor)
        at, ok = self.probs[order - 1].find(keys)
        out = self.probs[order - 1].values[at].astype(np.float64)
        miss = np.flatnonzero(~ok)
        if len(miss):
            k = keys[miss]
            low = self.log_probs(k & U64((1 << 16 * (order - 1)) - 1), order - 1)
            if order > 1:
                at, ok = self.weights[order - 2].find(k >> U64(16))
                low = low + np.where(ok, self.weights[order - 2].values[at], 0)
            out[miss] = low
        return out


@dataclass
class KneserNey:
    langs: list[str]
    models: list[LanguageModel]
    limit: np.ndarray  # largest cross-entropy of the language's own texts

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each n-gram's last symbol under every language."""
        return np.column_stack([m.log_probs(keys, order) for m in self.models]) if self.models else np.zeros((len(keys), 0))

    def entropies(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol of each text and language, letters of each text)."""
        k, d, letters = ngrams(data, offs)
        n = len(offs) - 1
        size = np.maximum(np.bincount(d, minlength=n), 1)
        total = np.zeros((n, len(self.langs)))
        different, of = np.unique(k, return_inverse=True)  # texts repeat their n-grams: each is looked up once
        lp = self.log_probs(different)
        for j in range(len(self.langs)):
            total[:, j] = np.bincount(d, lp[of, j], n)
        return -total / size[:, None], letters


def build_language(keys: np.ndarray, counts: np.ndarray, symbols_seen: int) -> LanguageModel:
    """The model of one language from its distinct 4-grams and their counts."""
    order = np.argsort(keys)
    tables = [(keys[order], counts[order].astype(np.float64))]
    for n in range(ORDER - 1, 0, -1):  # continuations: how many different symbols stand before
        k, c = np.unique(tables[-1][0] & U64((1 << 16 * n) - 1), return_counts=True)
        tables.append((k, c.astype(np.float64)))
    probs, weights, floor = [], [], float(-np.log(symbols_seen + 1.0))
    low_keys, low_p = np.zeros(1, U64), np.exp([floor])
    for n, (k, c) in enumerate(tables[::-1], 1):
        contexts, at = np.unique(k >> U64(16), return_inverse=True)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
        w = d * kinds / np.maximum(total, 1)
        suffix = k & U64((1 << 16 * (n - 1)) - 1)
        p = np.maximum(c - d, 0) / total[at] + w[at] * low_p[np.searchsorted(low_keys, suffix)]
        probs.append(Lookup(k, np.log(p).astype(np.float32)))
        log_w = np.log(np.maximum(w, 1e-12)).astype(np.float32)
        if n > 1:
            weights.append(Lookup(contexts, log_w))
        elif len(log_w):
            floor += float(log_w[0])
        low_keys, low_p = k, p
    return LanguageModel(probs, weights, floor)


def build(langs: list[str], lang_of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
    """Models from (language, packed 4-gram, count) triples."""
    symbols_seen = max(len(np.unique(keys & U64(0xFFFF))), 1)
    models = [build_language(keys[lang_of == j], counts[lang_of == j], symbols_seen) for j in range(len(langs))]
    return KneserNey(langs, models, np.full(len(langs), np.inf))


def _training(docs: DataFrame, held_parts: int, held: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(fold(id_col, held_parts) != held, F.lit(False)))
    return train.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def counted(train: DataFrame) -> KneserNey:
    """Model of every n-gram of every training row, still without limits.

    Counted in Spark; the driver builds the model from all (language, n-gram, count)
    rows, and its size grows with the n-grams that the languages have.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, offs = tv.buffers(b.column(0))
            names = b.column(1).dictionary_encode()
            code, words = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
            for x, y in tv.row_blocks(offs):
                k, d, letters = ngrams(data, offs[x : y + 1])
                ok = letters[d] > 0
                k, lang = k[ok], code[x:y][d[ok]]
                for j in np.unique(lang).tolist():
                    u, c = np.unique(k[lang == j], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([words[j]] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "k", "c"])

    got = train.select("text", "lang").mapInArrow(count, "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c")).toArrow()
    names = got["lang"].combine_chunks().dictionary_encode()
    seen = names.dictionary.to_pylist()
    langs = sorted(seen)
    place = np.array([langs.index(x) for x in seen], np.int64)
    return build(langs, place[names.indices.to_numpy()] if len(names) else np.empty(0, np.int64), got["k"].to_numpy().view(U64) if len(names) else np.empty(0, U64), got["c"].to_numpy() if len(names) else np.empty(0, np.int64))


def _scored(rows: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, lang, lang_pred, score, cross_entropy, own) of rows (doc_id, text, lang); own: the cross-entropy under the row's own language."""
    index = {x: i for i, x in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tv.buffers(b.column(1))
            mine = np.array([index.get(x, -1) for x in b.column(2).to_pylist()], np.int64)
            pred, score, best, own = [], [], [], []
            for x, y in tv.row_blocks(offs):
                if not model.langs:
                    pred += [None] * (y - x)
                    score += [0.0] * (y - x)
                    best += [None] * (y - x)
                    own += [None] * (y - x)
                    continue
                h, letters = model.entropies(data, offs[x : y + 1])
                j = h.argmin(1)
                low = h[np.arange(len(j)), j]
                # posterior of the winner for the text's mean symbol read min(letters, 20) times: symbols are not
                # independent, so the plain product over a long text would be 1 throughout
                odds = np.exp(-(h - low[:, None]) * np.minimum(letters, 20)[:, None]).sum(1)
                some = letters > 0
                pred += [model.langs[i] if s else None for i, s in zip(j.tolist(), some.tolist())]
                score += np.where(some, 1 / odds, 0.0).tolist()
                best += [v if s else None for v, s in zip(low.tolist(), some.tolist())]
                own += [v if i >= 0 else None for v, i in zip(h[np.arange(len(j)), mine[x:y]].tolist(), mine[x:y].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64()), pa.array(own, pa.float64())], names=["doc_id", "lang", "lang_pred", "score", "cross_entropy", "own"])

    return rows.mapInArrow(run, "doc_id long, lang string, lang_pred string, score double, cross_entropy double, own double")


def _limits(model: KneserNey, scored: DataFrame) -> np.ndarray:
    """The cross-entropy that one in 200 training rows of each language exceeds, over all of them."""
    found = {r[0]: r[1] for r in scored.where("own is not null").groupBy("lang").agg(F.percentile_approx("own", F.lit(0.995), F.lit(100_000))).collect()}
    return np.array([found.get(x, np.inf) for x in model.langs])


def _result(scored: DataFrame, model: KneserNey, held_parts: int, held: int) -> DataFrame:
    over = F.lit(False)
    for x, limit in zip(model.langs, model.limit.tolist()):
        over = over | ((F.col("lang_pred") == x) & (F.col("cross_entropy") > limit))
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", held_parts) == held, F.lit(False)).alias("held_out"), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), "score", "cross_entropy",
        F.coalesce(F.col("lang_pred").isNull() | over, F.lit(True)).alias("rejected"))


def fit(docs: DataFrame, held_parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KneserNey:
    """Learns from every training row, with the rejection limits over all of them."""
    train = _training(docs, held_parts, held, id_col, text_col, lang_col)
    model = counted(train)
    if model.langs:
        model.limit = _limits(model, _scored(train, model))
    return model


def with_languages(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", held_parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected), one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    return _result(_scored(rows, model), model, held_parts, held)


def identify(docs: DataFrame, held_parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the training rows of docs and predicts every row.

    score is the winner's posterior among the languages, from the mean over the whole
    text, as if at most 20 such symbols had been read.  A text that is null or has no letter is 'und' with score 0 and rejected; so is
    every row if there is nothing to learn from.  ``rejected`` marks texts unlike
    any learned language, which still get the nearest one.  Rows with a null id
    are predicted and never learned; rows with a null language are not learned;
    repeated rows get equal results.  Ties go to the first language by name.
    Other columns are ignored.  An empty table gives an empty result.
    """
    model = counted(_training(docs, held_parts, held, id_col, text_col, lang_col))
    learned = F.col(text_col).isNotNull() & F.coalesce(fold(id_col, held_parts) != held, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.when(learned, F.col(lang_col).cast("string")).alias("lang"))
    scored = scratch.table(_scored(rows, model), "li-scores")  # scored once, for the limits and the result
    model.limit = _limits(model, scored)
    return _result(scored, model, held_parts, held)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
