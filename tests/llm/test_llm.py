"""The corpus operators against brute force, exact round trips and held-out accuracy; edge cases."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from draftloom.llm import bpe, decontaminate, exact_dedup, language_id, licenses, ngram_join, pii, quality, substring_dedup, toxicity
from draftloom.llm import queries as llm_queries
from draftloom.llm.components import connected_components
from draftloom.llm import textvec as tv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, score double, component_id long, digest string, sig long"


def texts(spark, sf_dir):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def odd_rows():
    """Null ids and texts, empty and blank texts, one very long text, repeated rows, clashing column names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    t = [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, long), (5, long), (None, "no id here at all"), (6, "no id here at all"), (7, "x"), (8, "é日本 😀 <|endoftext|> a"), (9, None)]
    return [(i, x, "en", None, 0.5, 7, "d", 3) for i, x in t]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


# ---- word primitives ----

def test_words_match_a_plain_split():
    r = random.Random(3)
    rows = ["".join(r.choice("aB \tcé\n9-") for _ in range(r.randint(0, 40))) for _ in range(300)]
    import pyarrow as pa

    data, offs = tv.buffers(pa.array(rows))
    w = tv.words(data, offs, lower=True)
    assert w.counts.tolist() == [len(SPACE_WORD.findall(x)) for x in rows]
    seen = {}
    for h, d, a, b in zip(w.h.tolist(), w.doc_of().tolist(), w.start.tolist(), w.end.tolist()):
        word = data[a:b].tobytes().decode().translate(LOWER)
        assert seen.setdefault(h, word) == word
    assert len(set(seen.values())) == len(seen)


# ---- 1: n-gram Jaccard join ----

def shingles(text, k=5):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited_groups():
    """Groups of near copies around the threshold, short texts and texts that share passages."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for g in range(8):
        base = [word() for _ in range(r.choice((4, 6, 9, 30, 120)))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [" ".join([word() for _ in range(20)] + passage) for _ in range(12)]
    out += [r.choice(out) for _ in range(40)]
    return dict(enumerate(out))


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(9)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(2999, 2000 + i) for i in range(50)]
    mixed = [(r.randrange(4000, 4200), r.randrange(4000, 4200)) for _ in range(120)]
    edges = chain + star + mixed + [(9000, 9000)]
    up = {v: v for e in edges for v in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in connected_components(df, loops=True).collect()}
    assert got == {v: root(v) for v in up}
    assert {x.node for x in connected_components(df).collect()} == {v for a, b in edges if a != b for v in (a, b)}
    assert connected_components(df.where("false"), loops=True).count() == 0


def test_blocks_give_a_forest():
    a, b = np.repeat(np.arange(100), 100), np.tile(np.arange(100, 200), 100)
    assert len(ngram_join._forest(a, b)) == 199 and len(ngram_join._forest(a[:0], b[:0])) == 0


def test_a_large_group_of_near_copies_gives_few_rows(spark, monkeypatch):
    """Thousands of near copies: what blocks and rounds emit stays far below a row per pair."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(2500):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    emitted = collections.Counter()
    table = ngram_join.scratch.table

    def counted(df, name):
        out = table(df, name)
        emitted[name] += out.count() if name in ("nj-links", "nj-block-links", "nj-pairs", "cc-edges") else 0
        return out

    monkeypatch.setattr(ngram_join.scratch, "table", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in ngram_join.similar_documents(df).collect()}
    sets = [shingles(t) for _, t in rows]
    linked = [i for i in range(1, 2500) if 100 * len(sets[i] & sets[0]) >= 75 * len(sets[i] | sets[0])]
    assert all(got[i] == 0 for i in linked) and len(linked) > 300
    assert sum(emitted.values()) < 20 * 2500


@pytest.mark.parametrize("many", [32, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = edited_groups()
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(odd).collect())
    by_id = {i: c for i, _, c in got}
    assert by_id[4] == by_id[5] == 4 and by_id[1] == 1 and by_id[2] == 2 and by_id[None] is None and sum(got.values()) == 11
    assert ngram_join.similar_documents(empty).count() == 0
    by_shuffle = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(odd, broadcast_ids=0).collect())
    assert by_shuffle == got
    # of rows that repeat an id each text can link it, also where one of them has a twin
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("a", 30)), (9, words("a", 30)), (9, words("b", 30)), (5, words("b", 30) + " end"), (7, words("c", 30)), (7, words("a", 30) + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {(r.doc_id, r.component_id) for r in ngram_join.similar_documents(df).collect()} == {(i, 1) for i in (1, 5, 7, 9)}
    assert {r.doc_id for r in ngram_join.representatives(odd).collect()} == {1, 2, 3, 4, 6, 7, 8, 9, None}


# ---- 2: licenses ----

def test_license_phrases(spark, sf_dir, odd, empty):
    rows = texts(spark, sf_dir) | {10**6: "CC-BY cc by; general public license general Public\nLICENSE all rights reserved", 10**6 + 1: None}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in licenses.license_labels(df).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (rows[r.doc_id] or "").translate(LOWER))
        places = [(i, lab) for p, lab in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        want = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in licenses.license_labels(odd).collect())
    none = lambda i, n: (i, n, 0, None, "", "", 0.0)
    assert got == collections.Counter([none(i, 0) for i in (1, 2, 3, 9)] + [none(4, 60_000)] + 2 * [none(5, 60_000)] + [none(None, 5), none(6, 5), none(7, 1), none(8, 4)])
    assert licenses.license_labels(empty).count() == 0


def common_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_words_in_order():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(r.choice((2, 5, 40))) for _ in range(r.randint(0, 90))] for _ in range(2))
        assert licenses.in_order(a, b) == common_in_order(a, b)


def brute_labels(text, k=3, drift=3, share=0.6, few=0.3, long=30):
    """Labels and score of the notices, from the words themselves."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, score = set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
            score = 1.0
    for notice, label in licenses.TEMPLATES:
        t = notice.split()
        hits = [(i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]]
        diagonals = {}
        for i, j in hits:
            diagonals.setdefault(i - j, []).append((i, j))
        rows = [(min(i for i, _ in h), d, max(i for i, _ in h), {j for _, j in h}) for d, h in diagonals.items()]
        bands, pieces = [], []
        for row in sorted(rows, key=lambda x: x[1]):
            if bands and row[1] - bands[-1][-1][1] <= drift:
                bands[-1].append(row)
            else:
                bands.append([row])
        for band in bands:
            band.sort()
            for n, row in enumerate(band):
                if n and row[0] - band[n - 1][2] <= len(t):
                    pieces[-1].append(row)
                else:
                    pieces.append([row])
        for piece in pieces:
            if len(set().union(*(x[3] for x in piece))) >= (few if len(t) >= long else share) * (len(t) - k + 1):
                first, last = min(x[0] for x in piece), max(x[2] for x in piece) + k - 1
                cover = common_in_order(t, w[first : last + 1][: 2 * len(t)]) / len(t)
                if cover >= share:
                    labels.add(label)
                    score = max(score, cover)
    return ",".join(sorted(labels)), score


def test_labels_match_brute_force(spark):
    r = random.Random(8)
    rows = {0: "the apache license, apache license version, apache license version, apache license version", 1: "x " * 300 + licenses.TEMPLATES[0][0]}
    for n in range(2, 150):
        w = []
        for _ in range(r.randint(1, 3)):
            w += [r.choice("abcdef") for _ in range(r.randint(0, 4))]
            t = r.choice(licenses.TEMPLATES)[0].split()
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 2)] = r.choice(([], ["new"], ["the"], t[:3]))
                t = t or ["x"]
            w += t
        rows[n] = r.choice((" ", ", ", "\n")).join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.license_labels(df).collect()}
    assert got == {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.license_labels(df, broadcast_texts=0).collect()}
    want = {i: brute_labels(t) for i, t in rows.items()}
    assert got == {i: (a, round(b, 9)) for i, (a, b) in want.items()}
    assert got[0] == ("", 0.0) and got[1] == ("mit", 1.0) and len({a for a, _ in got.values()}) > 8


def test_license_notice_with_changed_words(spark):
    notice = licenses.TEMPLATES[1][0].split()
    notice[8] = "somebody"
    df = spark.createDataFrame([(1, "x y z " + " ".join(notice) + " end"), (2, "free of charge to any one")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_labels(df).collect()}
    assert got == {1: "mit", 2: ""}


def worn_licenses(share, seed=4):
    """Every whole license text with that share of its words replaced, dropped or doubled, between other words."""
    r = random.Random(seed)
    out = []
    for text, label in licenses.TEXTS:
        for _ in range(6):
            w = licenses.plain_words(text).split()
            for i in r.sample(range(len(w)), int(share * len(w))):
                w[i] = r.choice((f"n{r.randrange(10**6)}", f"n{r.randrange(10**6)}", "", f"{w[i]} {w[i]}"))
            noise = lambda: " ".join(f"o{r.randrange(10**6)}" for _ in range(r.randint(0, 40)))
            out.append((f"{noise()} {' '.join(w)} {noise()}", label))
    return out


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.1, 1.0), (0.2, 1.0), (0.3, 0.6)])
def test_whole_licenses_with_changed_words(spark, share, least):
    rows = worn_licenses(share)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.license_labels(df).collect()}
    want = {i: brute_labels(t) for i, (t, _) in enumerate(rows)}
    assert got == {i: (a, round(b, 9)) for i, (a, b) in want.items()}
    assert got == {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.license_labels(df, broadcast_spans=0).collect()}
    family = lambda x: x.split("-")[0]  # noqa: E731  the two BSD texts hold each other's words
    hit = [label in got[i][0].split(",") for i, (_, label) in enumerate(rows)]
    named = [{family(x) for x in got[i][0].split(",") if x} for i in range(len(rows))]
    print(f"changed {share}: recall {np.mean(hit):.3f}, only the own family {np.mean([n <= {family(label)} | {'gpl'} for n, (_, label) in zip(named, rows)]):.3f}")
    assert np.mean(hit) >= least


# ---- 3: decontamination ----

def test_leaks_with_substituted_words(spark, odd, empty):
    r = random.Random(1)
    item = [f"t{i}" for i in range(40)]
    leak = list(item)
    for i in range(4, 40, 9):
        leak[i] = "other"
    noise = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    docs = spark.createDataFrame([(1, " ".join(noise(30) + leak + noise(30))), (2, " ".join(noise(90))), (3, " ".join(leak)), (4, " ".join(noise(5) + item[:6] + noise(40))), (5, None), (6, "tiny test item")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "Tiny test item"), (9, ""), (10, None)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()} == {(1, 7), (3, 7), (6, 8)}
    assert sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect()) == [2, 4, 5]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == 11
    assert decontaminate.clean(empty, bench).count() == 0 and decontaminate.leaks(odd, bench).count() == 0
    both = spark.createDataFrame([(1, "Tiny test item", 5, "a"), (1, "fine", 6, "b"), (None, "tiny test  item", 7, "c")], "doc_id long, text string, __k1 int, __t string")
    for limit in (500_000, 0):
        assert [tuple(x) for x in decontaminate.clean(both, bench, broadcast_texts=limit).collect()] == [(1, "fine", 6, "b")]


def test_a_long_text_of_many_hits_and_a_large_benchmark(spark):
    item = [f"t{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join((item + ["x"]) * 400)), (2, " ".join(item[:9] + ["y"] * 3000 + item))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[2:] + ["q"]))], "item_id long, text string")
    for limit in (100_000, 0):
        got = sorted((x.doc_id, x.item_id, x.agree) for x in decontaminate.leaks(docs, bench, broadcast_bytes=limit, broadcast_texts=limit).collect())
        assert got == [(1, 7, 1.0), (1, 8, 1.0), (2, 7, 1.0), (2, 8, 1.0)]


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_a_benchmark_item_of_many_words(spark, limit):
    """Whole, in part, with a word in twelve replaced; what is compared at a hit stays small however long the item is."""
    item = [f"w{i * i % 9973}a{i}" for i in range(20_000)]
    worn = [w if i % 12 else "other" for i, w in enumerate(item[7_000:7_200])]
    docs = {1: item, 2: ["x"] * 50 + item[12_345:12_358] + ["y"] * 50, 3: worn, 4: item[19_990:] + ["z"] * 40, 5: [w if i % 3 else "z" for i, w in enumerate(item[:300])]}
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {x.doc_id: x.agree for x in decontaminate.leaks(df, bench, broadcast_bytes=limit).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 12 / 13}
    items = spark.createDataFrame([(7, list(range(n))) for n in (1, 13, 14, 20_000)], "item_id long, h array<long>")
    blocks = decontaminate._blocks(items, 13).collect()
    assert max(len(b.own) for b in blocks) == 3 * 13 - 2 and all(b.own == list(range(b.lo, b.lo + len(b.own))) for b in blocks)


def brute_agreement(item, doc, window=13):
    """The best share of equal words over all windows of all alignments."""
    w = min(window, len(item))
    best = 0
    for off in range(1 - len(item), len(doc)):
        a = max(0, -off)
        same = [x == y for x, y in zip(item[a:], doc[a + off :])]
        best = max([best, *(sum(same[i : i + w]) for i in range(len(same) - w + 1))])
    return best / w


def substituted(seed=2):
    """Items of 3 to 59 words, and texts that hold them with words replaced regularly and at random."""
    r = random.Random(seed)
    items = {n: [f"i{n}x{j}" for j in range(n)] for n in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 18, 25, 38, 59)}
    docs = []
    for w in items.values():
        swaps = [{j for j in range(len(w)) if j % k == s} for k in (4, 5) for s in range(k)]
        swaps += [{j for j in range(len(w)) if r.random() < p} for p in (0.1, 0.2, 0.25) for _ in range(4)]
        swaps += [set(r.sample(range(len(w)), len(w) // 4)) for _ in range(6)]
        for x in swaps:
            noise = lambda: [f"n{r.randrange(10**6)}" for _ in range(r.randrange(6))]
            docs.append(noise() + [f"s{r.randrange(10**6)}" if j in x else y for j, y in enumerate(w)] + noise())
    return items, dict(enumerate(docs))


@pytest.mark.parametrize(("window", "share"), [(13, 0.75), (8, 0.6)])
def test_leaks_match_brute_force(spark, window, share):
    items, docs = substituted()
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.agree, 9) for x in decontaminate.leaks(df, bench, window=window, share=share).collect()}
    agree = {(i, k): brute_agreement(w, d, window) for i, d in docs.items() for k, w in items.items() if set(w) & set(d)}
    want = {k: round(v, 9) for k, v in agree.items() if v >= share}
    assert got == want


def test_masks_leave_no_gap():
    for share in (0.5, 0.75, 0.9, 1.0):
        for n in range(1, 15):
            e = decontaminate.may_differ(n, share)
            masks = [{j + at for j, c in enumerate(m) if c == "1"} for m in decontaminate.masks_of(n, share) for at in range(n - len(m) + 1)]
            assert all(any(not k & set(x) for k in masks) for x in itertools.combinations(range(n), e))


# ---- 4: personal data ----

def brute_spans(x):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        g = re.sub("[ -]", "", m.group())
        if 14 <= len(g) <= 19 and pii.luhn(g):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_patterns_and_secrets(spark, sf_dir, odd, empty):
    rows = texts(spark, sf_dir) | {10**6: "a@b.c@d.e x@@y.z q@r.s. 1.2.3.4.5 999.1.1.1 4111 1111-1111 1111 +1 (555) 123-4567 é+44 20 7946 0958"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        base = brute_spans(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r.spans.split(","))
        for s in set(r.spans.split(",")) - set(base.split(",")):
            k, a, b = s.split(":")
            assert k == "secret" and int(a) < int(b) <= len(rows[r.doc_id])
        assert r.n_secret == len(re.findall(r'token = "[0-9a-fA-F]{40}"', rows[r.doc_id], re.I))
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[1:] for r in pii.find_personal_data(odd).collect()] == [(0, 0, 0, 0, none, "", 0, 0)] * 11
    assert pii.find_personal_data(empty).count() == 0


def test_credentials_unlike_the_labelled_ones():
    field = pii.train(pii.labelled_rows())
    found = lambda x: [x[a:b] for _, a, b in pii.field_spans(field, [x])[0]]
    assert found("my password = hunter-two for you") == ["hunter-two"] and found('the password: "correctHorse" was set') == ["correctHorse"] and found("pwd: zx9q") == ["zx9q"]
    for x in ("the secret of success is the key to happiness", "Token ring and key words in 2024", "see a=5 and b = 7", "her password was long and my key is lost"):
        assert found(x) == []
    assert found("7 " * 5000 + "token = " + "ab12" * 10 + " 7" * 5000) == ["ab12" * 10]  # one run of 10,000 words
    assert found("x" * 2_000_000) == [] and found("5" * 300_000) == []


def test_viterbi_matches_enumeration():
    field = pii.train(pii.labelled_rows(copies=2), rounds=20)
    r = random.Random(4)
    words = ["token", "=", "abc123", "the", "1.2.3.4", '"xY9"', "key:", "a@b"]
    runs = [[pii.word_features(r.choice(words)) for _ in range(n)] for n in (1, 2, 3, 4, 5, 5, 1)]
    every, at = field.scores(runs), 0
    for run, path in zip(runs, field.viterbi(runs)):
        s = every[at : at + len(run)]
        at += len(run)
        x = pii._indicators(field.names, [run], len(run))[0][0]
        assert np.allclose(s, x @ field.emit, atol=1e-4)
        score = lambda p: field.start[p[0]] + sum(s[t][k] for t, k in enumerate(p)) + sum(field.move[a][b] for a, b in zip(p, p[1:]))
        assert abs(max(score(p) for p in itertools.product(range(len(pii.TAGS)), repeat=len(run))) - score(path.tolist())) < 1e-3


# ---- 5, 7, 10: learned ----

def test_language_model_sums_to_one_and_holds_out(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = language_id.identify(docs).where("held_out").collect()
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97
    model = language_id.fit(docs)
    # after a context, the probabilities of all symbols and of an unseen one add up
    ctx = (ord(" ") << 32) | (ord("t") << 16) | ord("h")
    syms = np.unique([int(x) for x in range(97, 123)] + [32] + [int(x) for x in np.frombuffer("éèêçñíóáúüöäß".encode("utf-16-le"), np.uint16)])
    p = np.exp(model.log_probs(np.array([(ctx << 16) | int(c) for c in syms], np.uint64).astype(np.uint64))).sum(0)
    assert (p <= 1.001).all() and (p > 0.9).any()
    got = {(r.doc_id, r.lang_pred) for r in language_id.with_languages(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got
    assert language_id.with_languages(empty, model).count() == 0 and language_id.identify(empty).count() == 0


def plain_kneser_ney(texts, order=4):
    """Counts in dictionaries, the interpolated probability by recursion."""
    tops = collections.Counter()
    for t in texts:
        s = " " * (order - 1) + t
        tops.update(s[i : i + order] for i in range(len(s) - order + 1))
    tables = {order: tops}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    discount = {}
    for n, c in tables.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(gram, floor):
        n = len(gram)
        if not n:
            return floor
        total = sum(v for g, v in tables[n].items() if g[:-1] == gram[:-1])
        low = p(gram[1:], floor)
        if not total:
            return low
        kinds = sum(g[:-1] == gram[:-1] for g in tables[n])
        return max(tables[n][gram] - discount[n], 0) / total + discount[n] * kinds / total * low

    return p


def test_language_model_matches_plain_counts(spark):
    corpus = {"aa": ["the cat sat on the mat", "the dog", "a man and a cat"], "bb": ["der hund und die katze", "ein mann und der hund", "𐐨𐐨𐑀 die 𠀠 der"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in corpus.items() for t in v * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r[0] for r in docs.select("doc_id").where(language_id.fold("doc_id", 4) == 2).collect()}
    model = language_id.fit(docs)
    units = lambda t: "".join(chr(u) for u in np.frombuffer(t.encode("utf-16-le"), np.uint16))
    plain = {k: plain_kneser_ney([units(t) for i, t, kk in rows if kk == k and i not in held]) for k in corpus}
    seen = len({c for i, t, _ in rows if i not in held for c in units(t)})
    for text in ("the hund", "katze", "der dog and", "𐐨𠀠"):
        data, offs = tv.buffers(__import__("pyarrow").array([text]))
        got = model.entropies(data, offs)[0][0]
        s = "   " + units(text)
        for j, k in enumerate(model.langs):
            want = -np.mean([np.log(plain[k](s[i : i + 4], 1 / (seen + 1))) for i in range(len(s) - 3)])
            assert abs(got[j] - want) < 1e-4


def test_letters_of_every_plane_count(spark):
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(["𠀠𠀡", "\U00010020\U00010021", "\U00030010", "ab", "1 2"] * 3)], "doc_id long, text string, lang string")
    got = {(r.doc_id % 5, r.lang_pred) for r in language_id.identify(docs).collect()}
    assert got == {(0, "zh"), (1, "zh"), (2, "zh"), (3, "zh"), (4, "und")}
    s, _, n = language_id.symbols(*tv.buffers(__import__("pyarrow").array(["𠀠", "\u0020ࠠ"])))
    assert n.tolist()[0] == 1 and s[3:5].tolist() == list(np.frombuffer("𠀠".encode("utf-16-le"), np.uint16))


def test_language_model_keeps_every_ngram_and_training_row(spark):
    r = random.Random(6)
    rows = [(i, "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(150)), "zh") for i in range(6000)]
    rows += [(i, "".join(r.choice("abcdefgh ") for _ in range(30)), "xx") for i in range(6000, 6400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    train = language_id._training(docs, 4, 2, "doc_id", "text", "lang").collect()
    model = language_id.fit(docs)
    grams = {p[i : i + 4] for x in train for p in ["   " + re.sub(" +", " ", x.text)] for i in range(len(p) - 3)}
    assert len(grams) > 500_000 and sum(len(m.probs[3].h) for m in model.models) >= len(grams) * 0.9999
    out = {x.doc_id: x for x in language_id.identify(docs).collect()}
    for k, lang in enumerate(model.langs):
        h = np.sort([out[x.doc_id].cross_entropy for x in train if x.lang == lang])
        assert h[int(len(h) * 0.995) - 2] <= model.limit[k] <= h[int(len(h) * 0.995) + 1]
    assert {i: x.rejected for i, x in out.items()} == {x.doc_id: x.rejected for x in language_id.with_languages(docs, model).collect()}


@pytest.mark.parametrize(("module", "label", "query"), [(quality, "quality", "op7_quality_classifier"), (toxicity, "toxic", "op10_toxicity")])
def test_classifiers(spark, odd, empty, module, label, query):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r[label] for r in labels.collect()}
    rows = [r for r in llm_queries.QUERIES[query](spark, sf).collect() if r.held_out and r.doc_id in y]
    s, t = np.array([r.score for r in rows]), np.array([y[r.doc_id] for r in rows])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[t == 1] for b in s[t == 0]])
    assert auc > (0.9 if label == "quality" else 0.85) and all((r.predicted == 1) == (r.score >= 0.5) for r in rows)
    some = labels.limit(0)
    out = module.classify(odd, some).collect()
    assert len(out) == 11 and all(r.score == pytest.approx(0.5) for r in out)
    assert module.classify(empty, labels).count() == 0


def plain_quality_row(t):
    """The features of one text, counted one by one."""
    raw = (t or "").encode()
    n = len(raw)
    w = [x.encode() for x in SPACE_WORD.findall(t or "")]
    lines = [x for x in re.split(b"[\n\r]", raw) if x]
    mean = sum(map(len, w)) / max(len(w), 1)
    spread = max(sum(len(x) ** 2 for x in w) / max(len(w), 1) - mean**2, 0) ** 0.5
    mark = set(b".,;:?'\"()-")
    is_odd = lambda c: 32 < c < 127 and not chr(c).isalnum() and c not in mark
    upper, lower, digit = (sum(lo <= c <= hi for c in raw) for lo, hi in ((65, 90), (97, 122), (48, 57)))
    wide, marks, odd = sum(c >= 128 for c in raw), sum(c in mark for c in raw), sum(map(is_odd, raw))
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    one, b, ln, letters = max(len(w), 1), max(n, 1), max(len(lines), 1), max(upper + lower + wide, 1)
    return [
        np.log1p(n), np.log1p(len(w)), min(mean, 40), min(spread, 40), upper / letters, sum(65 <= x[0] <= 90 for x in w) / one, digit / b, marks / b, odd / b, np.log1p(100 * odd / b), wide / letters,
        len(set(w)) / one, max(collections.Counter(w).values(), default=0) / one, len(set(tri)) / max(len(tri), 1), len(set(lines)) / ln, np.log1p(len(w) / ln),
        sum(is_odd(x[-1]) for x in w) / one, sum(x[-1] in mark for x in w) / one, len(w) < 5, n == 0]


def test_quality_features_match_plain_counts(spark, sf_dir):
    import pyarrow as pa

    rows = [*texts(spark, sf_dir).values(), None, "", " ", "a", "A b.\n\nA b.\r\n x! É"]
    got = quality.text_features(pa.array(rows, pa.string()))
    assert np.allclose(got, np.array([plain_quality_row(t) for t in rows], float), atol=1e-6)


def test_pairwise_fit_is_the_maximum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=300) > 0).astype(int)
    model = quality.fit_pairs(x, y, pairs=5000)
    z = model.expand(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[good[np.arange(5000) % len(good)]] - z[bad[np.random.default_rng(0).permutation(5000) % len(bad)]]
    loss = lambda w: np.mean(np.log1p(np.exp(-diff @ w))) + (w @ w) / 200
    step = 1e-4
    slopes = [(loss(model.weights + step * e) - loss(model.weights - step * e)) / (2 * step) for e in np.eye(6)]
    assert np.abs(slopes).max() < 1e-5
    share = np.mean(model.score(x) < 0.5)
    assert abs(share - len(bad) / 300) < 0.01  # the cut is the marked share's quantile


def test_accepted_rows(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1}
    assert {r.doc_id for r in quality.accepted(docs, labels).collect()} == want
    out = quality.accepted(odd, labels.where("false"))
    assert out.columns == odd.columns and out.count() == 11 and quality.accepted(empty, labels).count() == 0


def plain_tox_score(model, t):
    """The score of one text from its words and their beginnings."""
    known = dict(zip(model.keys.tolist(), model.weights.tolist()))
    feats = collections.Counter()
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)):
        feats.update(toxicity.features_of([w])[0].tolist())
    z = model.bias + sum(known.get(f, 0.0) * np.log1p(n) for f, n in feats.items())
    return 1 / (1 + np.exp(-z))


def test_toxic_scores_match_plain_ones(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = sorted(texts(spark, sf_dir).items(), key=lambda r: len(r[1] or ""))[:60] + [(10**6, None), (10**6 + 1, "Muslims und Christen")]
    got = {r.doc_id: r.score for r in toxicity.with_scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - plain_tox_score(model, t)) < 1e-9 for i, t in rows)


def biased_rows(n=600, seed=5):
    """Labelled texts in which abuse mostly goes with one group, and neutral mentions of all groups."""
    r = random.Random(seed)
    word = lambda: r.choice("river house table morning green walk read quiet music bread winter garden".split())
    groups = ("muslims", "christians", "jews", "hindus", "catholics")
    rows = []
    for i in range(n):
        w = [word() for _ in range(12)]
        if i % 3 == 0:
            w[4:4] = [r.choice(("muslims", "muslims", "muslims", "jews")), "are", r.choice(("scum", "vermin", "idiots"))] if i % 6 else ["you", r.choice(("scum", "vermin", "idiots"))]
        elif i % 3 == 1:
            w[4:4] = [r.choice(groups[1:]), "are", "neighbours"]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    neutral = [(10_000 + i, " ".join([word() for _ in range(6)] + [g] + [word() for _ in range(6)])) for i, g in enumerate(groups * 20)]
    return rows, neutral


def test_penalty_spares_neutral_mentions(spark):
    """False positives among 100 neutral mentions: fewer with the penalty than without, and no abuse is lost."""
    rows, neutral = biased_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + neutral, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = {}
    for penalty in (0.0, 50.0):
        model = toxicity.fit(docs, labels, min_z=1.0, penalty=penalty)
        got = {r.doc_id: r for r in toxicity.with_scores(docs, model).collect()}
        fp = np.mean([got[i].score for i, t in neutral if "muslims" in t]), sum(got[i].predicted for i, _ in neutral)
        spread = np.std([np.mean([got[i].score for i, t in neutral if g in t]) for g in ("muslims", "christians", "jews", "hindus", "catholics")])
        recall = np.mean([got[i].predicted for i, _, y in rows if y and got[i].held_out])
        seen[penalty] = (fp, spread, recall)
    (free, tied) = seen[0.0], seen[50.0]
    assert tied[0][0] < 0.5 * free[0][0] and tied[0][1] <= free[0][1] and tied[1] < 0.3 * free[1] and tied[2] > 0.95


def test_swaps_move_all_features_of_a_term():
    keys = np.unique(np.concatenate(toxicity.features_of([t for kind in toxicity.kinds() for t in kind])))
    own = {t: np.searchsorted(keys, f) for t, f in zip(("muslims", "christians"), toxicity.features_of(["muslims", "christians"]))}
    assert len(own["muslims"]) == 3 and len(own["christians"]) == 4
    assert not set(toxicity.features_of(["muslim"])[0].tolist()) & set(toxicity.features_of(["muslims"])[0].tolist()[:1])
    # a text with the term: a counterfactual moves the word and its beginnings together
    col, val = own["muslims"], np.full(3, np.log(3.0))
    which, cols, vals = toxicity.swap_rows(col, val, keys)
    moved = [k for k in range(which.max() + 1) if abs(vals[which == k]).max() == pytest.approx(np.log(3.0))]
    sets = [set(cols[(which == k) & (vals > 0)].tolist()) for k in moved]
    assert len(moved) == 7 and all(s == set(own["muslims"].tolist()) for s in sets)


# ---- 6: exact dedup ----

def test_exact_dedup_matches_sql(spark, sf_dir, odd, empty):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(c.sql(exact_dedup.OP6_SQL).fetchall())
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r[k] for k in cols) for r in exact_dedup.op6_exact_dedup(spark, sf_dir).collect()) == want
    rows = exact_dedup.duplicate_groups(odd).collect()
    assert len(rows) == 11 and sum(r.kept for r in rows) == 6
    assert {r.keep_id for r in rows if r.doc_id is None} == {6} and {r.keep_id for r in rows if r.doc_id in (1, 2, 9)} == {9}
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.distinct_documents(odd).columns == odd.columns and exact_dedup.distinct_documents(odd).count() == 6


def test_index_grows_by_new_texts_only(spark):
    ix = exact_dedup.DigestIndex(spark, "digests_of_a_test", buckets=2)
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(4, "y"), (5, "z"), (6, "z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.deduplicate_new(a, ix).collect()) == [2, 3]
    assert sorted(r.doc_id for r in exact_dedup.deduplicate_new(b, ix).collect()) == [6]
    assert exact_dedup.deduplicate_new(b, ix).count() == 0 and ix.read().count() == 3
    c = spark.createDataFrame([(7, "z"), (8, "w"), (8, "w"), (None, "w")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(c, index=ix).collect())
    assert got == {(7, 6, 1, False): 1, (8, 8, 3, True): 1, (8, 8, 3, False): 1, (None, 8, 3, False): 1}
    ix.drop()


def test_distinct_documents_both_ways(spark, odd, empty):
    want = sorted([(3,), (5,), (6,), (7,), (8,), (9,)])
    for limit in (500_000, 0):
        ix = exact_dedup.DigestIndex(spark, f"digests_{limit}", buckets=2)
        out = exact_dedup.deduplicate_new(odd, ix, broadcast_digests=limit)
        assert out.columns == odd.columns and sorted(map(tuple, out.select("doc_id").collect())) == want
        ix.drop()
    assert exact_dedup.distinct_documents(empty).count() == 0
    names = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8)], "doc_id long, text string, __digest int, digest int")
    assert [tuple(r) for r in exact_dedup.distinct_documents(names).collect()] == [(2, "a", 7, 8)]


# ---- 8: tokens ----

def test_tokens_match_the_library(spark, sf_dir, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    rows = texts(spark, sf_dir)
    for r in bpe.op8_bpe_round_trip(spark, sf_dir).collect():
        ids = t.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    clash = odd.withColumn("ids", F.lit(3)).withColumn("decoded", F.lit("x"))
    back = bpe.decoded(bpe.encoded(clash)).select("doc_id", "text", "ids", "decoded").collect()
    assert len(back) == 11 and all((r.text or "") == r.decoded and r.ids == t.encode(r.text or "", add_special_tokens=False).ids for r in back)
    assert bpe.encoded(empty).count() == bpe.decoded(bpe.encoded(empty)).count() == 0
    trip = collections.Counter((r.doc_id, r.n_tokens) for r in bpe.round_trip(odd).collect())
    assert sum(trip.values()) == 11 and trip[(1, 0)] == trip[(2, 0)] == trip[(9, 0)] == 1 and max(trip.values()) == 2
    assert bpe.round_trip(empty).count() == 0


def test_joins_are_repaired():
    c = bpe.Codec(bpe.default_path())
    text = "hello wor|ld it'|s 12|34   x"
    parts = [p.encode() for p in text.split("|")]
    whole = c._encode("".join(text.split("|")).encode())
    assert np.array_equal(c.repaired([c._encode(p) for p in parts], parts), whole) and c.repairs > 0


def test_texts_with_control_characters_match_the_library(spark):
    """A text must not be taken for anything else that a task has kept, whatever characters it holds."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    r = random.Random(6)
    words = [" foo", " bar", " it's", " 12", " \x00", "\x00", "\x01b", "\x1f", "\u2028", " \x7f", "\n\n", "\t x"]
    c = bpe.Codec(bpe.default_path())
    pieces = [w.encode() for w in words]
    for _ in range(300):  # every join of two words is met, then texts that spell it out
        parts = [b"".join(r.choices(pieces, k=3)) for _ in range(3)]
        c._joined([c.chunk(p) for p in parts], parts)
    rows = [" foo\x00 bar", *(a + "\x00" + b for a in words for b in words), *("".join(r.choices(words, k=r.randint(1, 400))) for _ in range(60))]
    got = c.encode_rows(*tv.buffers(__import__("pyarrow").array(rows)))
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in rows]
    for n in (1, 5):
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(n)
        for x in bpe.round_trip(df).collect():
            ids = t.encode(rows[x.doc_id], add_special_tokens=False).ids
            assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


# ---- 9: substring dedup ----

def brute_removed(rows, width):
    words = {i: SPACE_WORD.findall(t or "") for i, t in rows.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][j : j + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("width", "m", "hot"), [(50, 8, 2000), (12, 3, 2), (5, 5, 1)])
def test_repeats_match_brute_force(spark, sf_dir, width, m, hot):
    rows = texts(spark, sf_dir)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, width, m, hot=hot).collect()}
    assert got == brute_removed(rows, width)


def test_repeats_of_odd_rows(spark, odd, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect())
    assert got[(4, 60_000, 0)] == 1 and got[(5, 60_000, 60_000)] == 2 and got[(1, 0, 0)] == 1 and got[(None, 5, 0)] == 1
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("dense", [1, 500])
def test_repeats_of_one_minimiser_in_a_text(spark, dense):
    rows = {0: "a b c d e " * 200, 1: "a b c d e " * 100 + "x y z", 2: "e a b c d"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, 12, 3, dense=dense).collect()}
    assert got == brute_removed(rows, 12)


# ---- SQL ----

@pytest.mark.parametrize("name", sorted(llm_queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = c.sql(llm_queries.SQL[name])
    names = sorted(want.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda records, cols: sorted(tuple(plain(r[cols.index(k)]) for k in names) for r in records)
    df = llm_queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == names
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


# ---- the pipeline ----

def test_pipeline_stages_agree_with_plain_ones(spark, sf_dir):
    import corpus_pipeline as P

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    scores = {r.doc_id: r.predicted for r in quality.op7_quality_classifier(spark, sf_dir).collect()}
    kept = {i: t for i, t in rows.items() if scores[i] == 1}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for t, i in last.items()}
    comp = brute_components(kept)
    kept = {i: t for i, t in kept.items() if comp[i][1] == i}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), bench).collect()}
    assert {r.doc_id for r in P.run(spark, sf_dir).select(F.col("doc_id")).collect()} == set(kept) - dirty


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path, odd, empty):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    typed = lambda df: df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "score", "digest")
    typed(odd).write.parquet(str(tmp_path / "documents.parquet"))
    # nothing is rejected without labels; of the null and empty texts 9 stays, of the long ones 5, of the words' ones 6
    assert sorted((r.doc_id for r in P.run(spark, str(tmp_path)).collect())) == [3, 5, 6, 7, 8, 9]
    step = typed(odd)
    for name, stage in P.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == typed(odd).columns
    (tmp_path / "none").mkdir()
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
