"""Ranked search, importance resampling and line dedup against brute force; what they do on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftloom.llm import crc, line_dedup, resample, search
from draftloom.llm import textvec as tv
from draftloom.llm.cuckoo import CuckooFilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = "doc_id long, text string, rank string, term long, score double, key_a string, top double, bucket int, version string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and blank texts, one very long text, repeated rows, clashing column names."""
    long = "\n".join(" ".join(f"w{(i * j) % 997}" for j in range(1, 12)) for i in range(6000))
    t = [(1, None), (2, ""), (3, "  \n\t \n"), (4, long), (5, long), (5, long), (6, long), (None, "no id here at all"), (7, "No ID here, at all"), (8, "é日本 😀 <|endoftext|> a\x00b"), (None, None), (9, "x" * 200_000)]
    return spark.createDataFrame([(i, x, "r", 1, 0.5, "k", 1.0, 2, "v") for i, x in t], ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


# ---- ranked search ----

def best_by_hand(docs, items, k):
    """docs: (id, text) rows; items: (id, text) rows -> {(item, rank): (doc, score)}."""
    counts = [(i, collections.Counter(words(t))) for i, t in docs]
    n_all = sum(bool(c) for _, c in counts)
    len_all = sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i].update(words(t))
    out = {}
    for item, own in terms.items():
        scored = []
        for i, c in counts:
            n = sum(c.values())
            score = 0
            for t in own & set(c):
                w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_all // len_all)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for r, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out[item, r] = (None if null else i, -s)
    return out


def found(df):
    return {(r.item_id, r.rank): (r.doc_id, r.score) for r in df.collect()}


def made_texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(r.choices(vocabulary, weights, k=r.choice((0, 1, 3, 20, 60, 300)))) for _ in range(n)]


@pytest.mark.parametrize(("shard_bytes", "short", "block_terms", "k"), [(2 << 20, 0.1, 50_000, 50), (3_000, 0.1, 50_000, 7), (20_000, 0.0, 40, 3), (20_000, 1.0, 50_000, 50)])
def test_search_matches_brute_force(spark, shard_bytes, short, block_terms, k):
    texts = made_texts(900, 5)
    docs = [((i * 7919) % 1000, t) for i, t in enumerate(texts)] + [(2000 + i, texts[3 + i % 5]) for i in range(80)] + [(None, texts[4]), (None, texts[4])]
    items = [(i, t) for i, t in enumerate(made_texts(25, 6))] + [(3, "t0 T1 t2"), (None, "t5 t9 t100"), (90, None), (91, ""), (92, "never seen words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = search.build_index(df, shard_bytes=shard_bytes)
    got = found(search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=k, short=short, block_terms=block_terms))
    assert got == best_by_hand(docs, items, k)


def test_search_skips_what_cannot_win():
    """Two long lists of small bounds are only asked once the short list has filled the best."""
    best = search.Best(5)
    every = np.arange(10_000)
    lists = [search.Postings(every, np.full(10_000, 3)), search.Postings(every, np.full(10_000, 2)), search.Postings(np.arange(0, 10_000, 100), np.arange(100, 200))]
    scored = search.walk(lists, best, every, np.zeros(10_000, np.int64))
    assert best.score.tolist() == [204, 203, 202, 201, 200] and best.id.tolist() == [9900, 9800, 9700, 9600, 9500]
    assert scored < 1000


def test_search_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "at ALL"), (2, "日本 w5"), (3, "b"), (4, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(search.search(search.build_index(odd), items)) == best_by_hand(rows, [(r.item_id, r.text) for r in items.collect()], 50)
    assert search.search(search.build_index(empty), items).collect() == []
    assert search.search(search.build_index(odd), items.limit(0)).collect() == []


# ---- importance resampling ----

def test_crc_of_joined_strings():
    r = random.Random(2)
    a = [r.randbytes(r.choice((0, 1, 5, 200))) for _ in range(60)]
    b = [r.randbytes(r.choice((0, 1, 7, 63, 64, 65, 300, 70_000))) for _ in range(60)]
    of = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    assert crc.joined(of(a), of(b), np.array([len(y) for y in b])).tolist() == [zlib.crc32(x + b" " + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("known", [0, 3, 1000])
def test_buckets_match_plain_features(known):
    r = random.Random(4)
    rows = ["".join(r.choice("aAbB é-9_ \n日") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", "x" * 100 + " y" * 3]
    dictionary = sorted({w.encode() for t in rows for w in words(t)})[:known]
    scan = resample.Scanner(dictionary)
    data, offs = tv.buffers(pa.array(rows))
    for longest in (1, 2, 3):
        got, doc = scan.buckets(data, offs, longest, 10_000)
        for i, t in enumerate(rows):
            w = words(t)
            want = [zlib.crc32(" ".join(w[j : j + n]).encode()) % 10_000 for n in range(1, longest + 1) for j in range(len(w) - n + 1)]
            assert sorted(got[doc == i].tolist()) == sorted(want)


def sampled_by_hand(docs, target, percent=25, min_words=20):
    def features(t):
        w = words(t)
        return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(" ".join(p) for p in zip(w, w[1:]))]]

    rows = [(i, features(t), len(words(t))) for i, t in docs]
    s = collections.Counter(f for _, fs, _ in rows for f in fs)
    t = collections.Counter(f for x in target for f in features(x))
    s_all, t_all = s.total(), t.total()
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (s_all + 10_000) / ((s[k] + 1) * (t_all + 10_000)))) for k in s}
    out = []
    for i, fs, n in rows:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {id(x): r for r, x in enumerate(fit, 1) if r <= len(fit) * percent // 100}
    return sorted((str((*x[:4], rank.get(id(x)))) for x in out))


@pytest.mark.parametrize("dictionary_words", [1, 50_000])
def test_resampling_matches_brute_force(spark, odd, empty, dictionary_words):
    texts = made_texts(400, 8)
    docs = [(i, t) for i, t in enumerate(texts)]
    target = texts[:30] + [None, "Other words 日本"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, goal, dictionary_words=dictionary_words)
    assert sorted(str(tuple(r)) for r in got.collect()) == sampled_by_hand(docs, target)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(str(tuple(r)) for r in resample.resample(odd, goal, dictionary_words=dictionary_words).collect()) == sampled_by_hand(rows, target)
    assert resample.resample(empty, goal).collect() == []
    assert len(resample.resample(odd, empty).collect()) == len(rows)


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made_texts(200, 9))], "doc_id long, text string, rank string")
    out = resample.resampled(docs, docs.limit(20))
    assert out.columns == docs.columns
    assert out.count() == resample.resample(docs, docs.limit(20)).where("rank is not null").count() > 5


def test_few_common_words(spark):
    docs = spark.createDataFrame([("a a a b b b c d " + "z" * 60,)] * 2, "text string")
    assert resample.common_words(docs, most=2) == [b"a", b"b"]
    assert resample.common_words(docs, most=3) == [b"a", b"b"]
    assert resample.common_words(docs, most=4) == [b"a", b"b", b"c", b"d"]


# ---- line dedup ----

def lines_by_hand(docs, min_docs=3, min_chars=20):
    """docs: (id, text) rows -> (id, lines, dropped, digest) of each."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def line_texts(n, seed):
    r = random.Random(seed)
    pool = [f"  The line of number {i} and more\t" for i in range(30)] + ["short", "", " " * 30, "é" * 19, "é" * 20, "A common footer of all of them"]
    return [(i, "\n".join(r.choice([x, x.upper(), x.strip()]) for x in r.choices(pool, k=r.randint(0, 6))) if r.random() > 0.05 else None) for i in range(n)]


@pytest.mark.parametrize("broadcast_keys", [200_000, 0])
def test_lines_match_brute_force(spark, odd, empty, broadcast_keys):
    docs = line_texts(120, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = line_dedup.drop_repeated_lines(df, broadcast_keys=broadcast_keys).collect()
    assert sorted(str(tuple(r)) for r in got) == lines_by_hand(docs)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(str(tuple(r)) for r in line_dedup.drop_repeated_lines(odd, broadcast_keys=broadcast_keys).collect()) == lines_by_hand(rows)
    assert line_dedup.drop_repeated_lines(empty).collect() == []


def test_kept_texts(spark):
    docs = [(i, f"own line {i}\nthe same long line everywhere\nlast") for i in range(5)]
    rows = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()
    for r in rows:
        assert r.kept_text == (docs[r.doc_id][1] if r.doc_id == 4 else f"own line {r.doc_id}\nlast")
        assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()


def counts_by_hand(spark, docs):
    pairs = line_dedup.lines_of(spark.createDataFrame(docs, "doc_id long, text string")).select("doc", "key_a", "key_b").distinct()
    return sorted(map(tuple, pairs.groupBy("key_a", "key_b").agg(F.count("*"), F.max("doc")).collect()))


def test_documents_leave_no_trace(spark, tmp_path):
    """Insertions in parts, deletions, insertion again, a reopened and a compacted index: counts are those of the documents there."""
    docs = line_texts(90, 4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    counts = lambda x: sorted(map(tuple, x.counts().collect()))
    at = str(tmp_path / "lines")
    index = line_dedup.LineIndex(spark, at, shards=3)
    index.insert(frame(docs[:40]))
    index.insert(frame(docs[30:70]))  # ten of them are known already
    assert counts(index) == counts_by_hand(spark, docs[:70])
    index.delete(frame(docs[20:60] + [(5000, None)]))
    left = docs[:20] + docs[60:70]
    assert counts(index) == counts_by_hand(spark, left)
    index = line_dedup.LineIndex(spark, at)
    index.insert(frame(docs[50:]))
    left = docs[:20] + docs[50:]
    assert counts(index) == counts_by_hand(spark, left)
    index.compact()
    assert counts(line_dedup.LineIndex(spark, at)) == counts_by_hand(spark, left)
    index.delete(frame(docs))
    assert counts(index) == [] and all(len(CuckooFilter(segments=[bytes(r.slots)])) == 0 for r in index.filters().collect())


def test_a_failed_change_leaves_the_old_version(spark, tmp_path, monkeypatch):
    index = line_dedup.LineIndex(spark, str(tmp_path / "lines"), shards=2)
    docs = line_texts(30, 5)
    index.insert(spark.createDataFrame(docs, "doc_id long, text string"))
    monkeypatch.setattr(index, "_commit", lambda **new: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.insert(spark.createDataFrame([(i + 100, t) for i, t in docs], "doc_id long, text string"))
    again = line_dedup.LineIndex(spark, str(tmp_path / "lines"))
    assert sorted(map(tuple, again.counts().collect())) == counts_by_hand(spark, docs)


def test_cuckoo_filter_keeps_what_it_has():
    r = np.random.default_rng(3)
    h = np.unique(r.integers(0, 2**63, 30_000).astype(np.uint64))
    held = CuckooFilter(1_000)
    for part in np.array_split(h, 7):
        held.insert(part)
    assert held.contains(h).all() and len(held) == len(h) and len(held.segments) > 1
    assert held.contains(r.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.02
    held = CuckooFilter(segments=held.dump())
    held.delete(h[::2])
    assert held.contains(h[1::2]).all() and len(held) == len(h[1::2])
    held.delete(h[1::2])
    assert len(held) == 0


def test_one_key_of_all_and_equal_fingerprints():
    held = CuckooFilter(8)
    same = np.arange(1, 4000, dtype=np.uint64)
    held.insert(same)
    held.delete(same[:3000])
    assert held.contains(same[3000:]).all() and len(held) == 999
