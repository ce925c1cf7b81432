"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns find what has a fixed form.  The field adds credentials (tokens,
keys, passwords), which have none: it tags the words around any word that may be one, or name one, by
word-shape features, trained on a small labelled table and decoded by Viterbi
for many word runs at once.  A span of the field that touches a pattern's span
is dropped, so the patterns' results stay as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

KINDS = ("email", "ip", "card", "phone", "secret")
_AT = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, tried only where an '@' stands."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _AT.match(text, lo) if lo < at else None
        if m:
            out.append(m.span())
            end = m.end()
        else:
            end = at
        at = text.find("@", max(at + 1, end))
    return out


def ip_spans(text: str) -> list[tuple[int, int]]:
    """Addresses with all parts at most 255."""
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, in code points."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in ip_spans(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# ---- the conditional random field -------------------------------------------------

TAGS = ("O", "SECRET", "KEY", "EMAIL", "IP", "NUMBER")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANKS = " \t\n\v\f\r"
_CUE_WORDS = ("token", "key", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "api_key", "auth", "bearer", "credential", "access_key")
#: What words that may be, or stand by, a credential hold: a digit, '@', '=' or a cue.
_MAY = re.compile(r"[0-9@=]|(?i:%s)" % "|".join(_CUE_WORDS))
_CORE = re.compile(r"[A-Za-z0-9_+/=-]+")
_TRIM = "\"'`.,;:!?()[]{}<>*#$%&"
_CUES = frozenset(_CUE_WORDS)


def word_features(word: str) -> tuple[str, ...]:
    """Names of the shape features of one word."""
    return _remembered(word) if len(word) <= 64 else _shape(word)


def _shape(word: str) -> tuple[str, ...]:
    core = word.strip(_TRIM)
    low = core.lower()
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    n = len(core)
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "9", core)))
    out = ["bias", f"len{min(n, 40) // 4}", f"digits{0 if not digits else 1 + 4 * digits // max(n, 1)}", f"runs{min(len(shape), 12) // 2}"]
    if low.rstrip("=") in _CUES:
        out.append("cue")
    if word in ("=", ":", "=>") or word[-1:] in "=:" and low.rstrip("=") in _CUES:
        out.append("assign")
    if any(c in "-_+/" for c in core):
        out.append("joined")
    if any(c.isupper() for c in core[1:]) and any(c.islower() for c in core):
        out.append("inner capital")
    if word[:1] in "\"'" and word[-1:] in "\"'" or word[:1] in "\"'" and word.rstrip("*#$%&!")[-1:] in "\"'":
        out.append("quoted")
    if digits and letters and n >= 16 and re.fullmatch(r"[0-9a-fA-F]+", core):
        out.append("hex")
    if digits >= 3 and letters >= 3 and n >= 16 and _CORE.fullmatch(core):
        out.append("mixed")
    if "@" in core:
        out.append("at")
    if core.count(".") >= 3 and digits > letters:
        out.append("dots")
    if digits and not letters:
        out.append("number")
    if letters and not digits:
        out.append("plain")
    return tuple(out)


_remembered = lru_cache(100_000)(_shape)


def labelled_rows(seed: int = 7, copies: int = 12) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (words, tags) of sentences made from a few patterns by rule."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "re", "st", "ing", "ou", "la", "der", "ci", "do")) for _ in range(r.randint(1, 4)))
    text = lambda lo=2, hi=6: [word() + r.choice(("", "", "", ",", ".", "***", "!!", "&&&")) for _ in range(r.randint(lo, hi))]
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mix = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789") for _ in range(n))
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz") for _ in range(n))
    rows = []

    def put(*parts: tuple[list[str], list[str]]) -> None:
        rows.append(([w for words, _ in parts for w in words], [t for _, tags in parts for t in tags]))

    def plain(lo: int = 2, hi: int = 6) -> tuple[list[str], list[str]]:
        words = text(lo, hi)
        return words, ["O"] * len(words)

    for _ in range(copies):
        for cue in ("token", "key", "secret", "password", "api_key"):
            q, tail = r.choice(("\"", "'", "")), r.choice(("", "", "###", "!!", "."))
            value = r.choice((hexa(r.choice((32, 40, 64))), hexa(40).upper(), mix(r.randint(20, 44))))
            # short and letter-only ones, and pass phrases, are given away by the assignment before them
            short = r.choice((mix(r.randint(6, 12)), letters(r.randint(8, 14)), f"{word()}-{word()}", word() + digit(r.randint(1, 4))))
            for v in (value, short):
                sign = r.choice(("=", ":", "="))
                put(plain(), ([cue, sign, q + v + q + tail], ["KEY", "O", "SECRET"]), plain())
                put(plain(), ([cue + sign, q + v + q + tail], ["KEY", "SECRET"]), plain())
        # cues in plain sentences
        put(plain(), ([r.choice(("key", "secret", "token", "password"))], ["O"]), plain())
        put(plain(), (["the", r.choice(("secret", "key", "token", "password")), r.choice(("of", "to", "was", "is"))], ["O"] * 3), plain())
        put(plain(), ([word() + "=" + digit(2)], ["O"]), plain())
        put(plain(), ([word(), "=", word()], ["O"] * 3), plain())
        for item, tag in (
            ([word() + "." + digit(2) + "@mail" + digit(1) + ".example.com"], "EMAIL"), ([".".join(str(r.randint(1, 255)) for _ in range(4))], "IP"),
            ([digit(16)], "NUMBER"), ([digit(4) for _ in range(4)], "NUMBER"), (["+1", "(" + digit(3) + ")", digit(3) + "-" + digit(4)], "NUMBER"),
            (["version", digit(1) + "." + digit(1)], "O"), ([digit(4)], "NUMBER"), (["key"], "O"), (["the", "secret", "of"], "O"), (["token", "ring"], "O"), (["b2b", "h" + digit(1) + "o"], "O"),
        ):
            put(plain(), (item, [tag] * len(item)), plain())
        put(plain(6, 10))
    return rows


@dataclass
class Field:
    """Weights: emissions by (feature, tag) for the word and its two neighbours, and tag transitions."""

    names: dict[str, int]
    emit: np.ndarray  # (3 * features, tags)
    move: np.ndarray  # (tags, tags)
    start: np.ndarray

    def scores(self, runs: list[list[tuple[str, ...]]]) -> np.ndarray:
        """Tag scores of the words of all runs, one after another: from a word's own features and its two neighbours'."""
        f, k = len(self.names), self.emit.shape[1]
        kinds: dict[tuple[str, ...], int] = {}
        which = np.array([kinds.setdefault(w, len(kinds)) for run in runs for w in run], np.int64)
        own, left, right = (np.zeros((len(kinds), k), np.float32) for _ in range(3))
        for feats, i in kinds.items():
            ids = [self.names[x] for x in feats if x in self.names]
            own[i], left[i], right[i] = (self.emit[[at + x for x in ids]].sum(0) for at in (0, f, 2 * f))
        out = own[which]
        n = np.array([len(r) for r in runs], np.int64)
        edge = np.zeros(len(which) + 1, bool)
        edge[np.concatenate([[0], np.cumsum(n)])] = True
        inner = np.flatnonzero(~edge[1:-1]) + 1 if len(which) > 1 else np.empty(0, np.int64)  # words with one before them in their run
        out[inner] += left[which[inner - 1]]
        out[inner - 1] += right[which[inner]]
        return out

    def viterbi(self, runs: list[list[tuple[str, ...]]]) -> list[np.ndarray]:
        """Best tag sequence of each run; runs of like length are decoded together, however long."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(runs)
        every = self.scores(runs)
        first = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        at = 0
        while at < len(order):
            width = max(len(runs[order[at]]), 1)
            end = at
            while end < len(order) and end - at < 512 and len(runs[order[end]]) <= width + 4 and (end - at + 1) * (width + 4) < 20_000:
                end += 1
            end = max(end, at + 1)
            batch = order[at:end]
            n = np.array([len(runs[i]) for i in batch])
            s = np.zeros((len(batch), int(n.max()), len(TAGS)), np.float32)
            for j, i in enumerate(batch):
                s[j, : n[j]] = every[first[i] : first[i + 1]]
            best = s[:, 0] + self.start
            back = np.zeros((*s.shape[:2], len(TAGS)), np.int8)
            for t in range(1, s.shape[1]):
                via = best[:, :, None] + self.move[None]
                back[:, t] = via.argmax(1)
                live = (t < n)[:, None]
                best = np.where(live, via.max(1) + s[:, t], best)
            tag = best.argmax(1)
            paths = np.zeros(s.shape[:2], np.int64)
            for t in range(s.shape[1] - 1, -1, -1):
                live = t < n
                paths[live, t] = tag[live]
                if t:
                    tag = np.where(live, back[np.arange(len(batch)), t, tag], tag)
            for i, path, k in zip(batch, paths, n.tolist()):
                out[i] = path[:k]
            at = end
        return out


def _indicators(names: dict[str, int], runs: list[list[tuple[str, ...]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word x feature) columns of the small labelled table's runs, padded to width, and the runs' lengths."""
    f = len(names)
    x = np.zeros((len(runs), width, 3 * f), np.float32)
    for i, run in enumerate(runs):
        for t, feats in enumerate(run):
            for j in (names[name] for name in feats):
                x[i, t, j] = 1
                if t:
                    x[i, t - 1, 2 * f + j] = 1
                if t + 1 < len(run):
                    x[i, t + 1, f + j] = 1
    return x, np.array([len(r) for r in runs])


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.15, l2: float = 0.01) -> Field:
    """Maximum likelihood by the forward-backward algorithm, Adam steps over the whole table."""
    runs = [[word_features(w) for w in words] for words, _ in rows]
    names = {f: i for i, f in enumerate(sorted({f for run in runs for w in run for f in w}))}
    k = len(TAGS)
    field = Field(names, np.zeros((3 * len(names), k)), np.zeros((k, k)), np.zeros(k))
    width = max((len(r) for r in runs), default=1)
    x, n = _indicators(names, runs, width)
    y = np.zeros((len(runs), width), int)
    for i, (_, tags) in enumerate(rows):
        y[i, : len(tags)] = [TAGS.index(t) for t in tags]
    live = np.arange(width)[None] < n[:, None]
    gold = np.eye(k)[y] * live[..., None]
    params = [field.emit, field.move, field.start]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        s = x @ field.emit
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + field.start
        for t in range(1, width):
            nxt = _logsum(alpha[:, t - 1, :, None] + field.move, 1) + s[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            nxt = _logsum(field.move[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], nxt, 0)
        z = _logsum(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        pair = np.zeros((k, k))
        for t in range(1, width):
            p = np.exp(alpha[:, t - 1, :, None] + field.move + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            pair += p.sum(0)
        seen = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        total = max(int(live.sum()), 1)
        grads = [
            np.einsum("ntf,ntk->fk", x, gold - post) / total - l2 * field.emit / 10,
            (seen - pair) / total - l2 * field.move / 10,
            (gold[:, 0] - post[:, 0]).sum(0) / total - l2 * field.start / 10,
        ]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    field.emit = field.emit.astype(np.float32)
    return field


def runs_around(text: str, reach: int = 3) -> list[list[tuple[int, int]]]:
    """Runs of word spans within ``reach`` words of a word that may be, or stand by, a credential; runs are whole, however long."""
    out: list[list[tuple[int, int]]] = []
    for m in _MAY.finditer(text):
        floor = out[-1][-1][1] if out else 0
        if m.start() < floor:
            continue  # inside the words taken to the right of the last one
        lo = max(floor, *(text.rfind(c, floor, m.start()) + 1 for c in _BLANKS))
        hi = _WORD.match(text, lo).end()
        before = []
        at = lo
        for _ in range(reach):
            w = _last_word(text, floor, at)
            if not w:
                break
            before.append(w)
            at = w[0]
        touching = out and (at <= floor or not text[floor:at].strip())
        run = out[-1] if touching else []
        if not run:
            out.append(run)
        run += before[::-1] + [(lo, hi)]
        extra = 0
        pos = hi
        while extra < reach:
            w = _WORD.search(text, pos)
            if not w:
                break
            run.append(w.span())
            pos = w.end()
            extra = 0 if _MAY.search(w.group()) else extra + 1
    return out


def _last_word(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    end = hi
    while end > lo and text[end - 1] in _BLANKS:
        end -= 1
    start = end
    while start > lo and text[start - 1] not in _BLANKS:
        start -= 1
    return (start, end) if start < end else None


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """('secret', start, end) of each text by the field alone."""
    where, runs = [], []
    for i, t in enumerate(texts):
        for run in runs_around(t):
            where.append((i, run))
            runs.append([word_features(t[a:b]) for a, b in run])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    secret = TAGS.index("SECRET")
    for (i, run), tags in zip(where, field.viterbi(runs)):
        for (a, b), tag in zip(run, tags.tolist()):
            if tag == secret:
                word = texts[i][a:b]
                lead = len(word) - len(word.lstrip(_TRIM))
                core = word.strip(_TRIM)
                if core:
                    out[i].append(("secret", a + lead, a + lead + len(core)))
    return out


def _apart(extra: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of extra, in order, that touch none of base."""
    if not extra or not base:
        return extra
    lo = np.array(sorted(x[1] for x in base))
    top = np.maximum.accumulate([x[2] for x in sorted(base, key=lambda x: x[1])])
    out = []
    for e in extra:
        i = int(np.searchsorted(lo, e[2], side="left")) - 1  # the last that starts before e ends
        if i < 0 or top[i] <= e[1]:
            out.append(e)
    return out


def all_spans(field: Field, texts: list[str]) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """(pattern spans, all spans) of each text, by start and then kind."""
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = [sorted(pattern_spans(t), key=key) for t in texts]
    every = []
    for b, extra in zip(base, field_spans(field, texts)):
        every.append(sorted(b + _apart(extra, b), key=key))
    return base, every


def training_table(spark: SparkSession) -> DataFrame:
    """The default labelled table: (words, tags)."""
    return spark.createDataFrame(labelled_rows(), "words array<string>, tags array<string>")


def find_personal_data(docs: DataFrame, labelled: list[tuple[list[str], list[str]]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 5000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans), one row per input row.

    The counts of the four fixed kinds are the patterns' spans; the field adds only
    ``secret`` spans; n_spans counts all.  Null and empty texts have none.  Each row is judged by its
    own text, also where rows repeat an id or it is null.  Other columns are
    ignored.  An empty table gives an empty result.  labelled: rows (words, tags),
    at most max_labelled of which are learned.
    """
    if isinstance(labelled, DataFrame):
        labelled = [(list(r[0]), list(r[1])) for r in labelled.select("words", "tags").orderBy("words").limit(max_labelled).collect()]
    field = train(labelled_rows() if labelled is None else labelled[:max_labelled])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            tv.release()
            size = 500
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                base, every = all_spans(field, [t or "" for t in part.column(1).to_pylist()])
                count = lambda rows, k: pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(count(base, k) for k in KINDS[:4]), pa.array([hashlib.sha256(write(r).encode()).hexdigest() for r in base]), pa.array([write(r) for r in every], pa.string()), count(every, "secret"), pa.array([len(r) for r in every], pa.int64())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
