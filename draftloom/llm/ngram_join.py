"""N-gram Jaccard join with PartEnum signatures.

Documents whose sets of word 5-grams have Jaccard similarity >= threshold are
linked; links are closed to components.  Nothing is sampled or capped: a pair over the
threshold always shares a signature, and every reported link is verified on the whole
sets.  Shingles are compared by 52 bits of their hash; it is exact but for collisions.

Signatures.  Let t be the threshold.  Sets A, B of sizes a <= b can only link if
a >= t*b, and then differ in at most D = floor((1-t)/(1+t) * (a+b)) features.
Sizes are cut into bands that double; band j serves sizes [2^j, 2^(j+1)/t], so two
sets that may link have a band in common.  In band j the feature domain is
partitioned into n_j hashed groups, each of PARTS = 3 parts, and the subsets of
two parts are enumerated: the content of such a subset (hashed, with the band) is
a signature.  D differences spoil at most D/2 groups with two or more; in every
other group at most one part differs, and the subset of the other two is equal
in both sets.  So of the m groups of A with two non-empty parts at least (whose
subsets are never empty), m - D/2 give a shared signature.  A set with m <= D/2
is *deficient*: a pair can share none only if both are, and deficient sets add
one signature per feature, which misses nothing.  (B may have but one non-empty
part in such a group, so all subsets that are not empty are listed.)

Filter.  A document that shares fewer than m - D/2 signatures with others cannot
link at all and is out before any text is fetched; sharing a mere passage with
other documents does not pass this.

Groups.  A set of equal sets is linked to its smallest document and otherwise
stands for all.  Members of one signature are not expanded into pairs.  Each document is
first paired with one of the smallest documents that it shares most signatures
with; pairs are verified and closed to components.  Only documents that share
enough signatures with foreign components go on, with their rarest signatures.
Where those are common to many documents, rounds of the same kind follow, each
of one verified pair per document with the document that comes first in the
round's own random order, until a round hardly joins any components; the rest
is compared in blocks inside tasks, of which only a spanning forest comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs, scratch
from . import textvec as tv
from .components import connected_components

U64 = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, set sizes): distinct k-word shingles; A-Z lower-cased."""
    w = tv.words(data, offs, tv.SPACE, lower=True)
    g, d = tv.unique_per_doc(*tv.doc_kgrams(w, k))
    return g, d, np.bincount(d, minlength=len(offs) - 1).astype(np.int64)


PARTS = 3  # parts of a group; signatures are its subsets of all but one


class Scheme:
    """The constants of the PartEnum signatures for one threshold (in percent)."""

    def __init__(self, percent: int) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.p = percent

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest possible |A xor B| of sets of these sizes that link."""
        return (100 - self.p) * (a + b) // (100 + self.p)

    def largest_partner(self, a: np.ndarray) -> np.ndarray:
        return a * 100 // self.p

    def groups(self, band: np.ndarray) -> np.ndarray:
        """Groups of a band: enough that most sets of it keep some after its largest number of spoilt ones."""
        top = np.left_shift(np.int64(2), band)
        return 64 * self.differences(top, self.largest_partner(top)) // 100 + 1

    def bands(self, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(band, differences allowed)] of each size: its own band, and the one below if reachable (else -1)."""
        own = np.floor(np.log2(np.maximum(s, 1))).astype(np.int64)
        own += (np.left_shift(np.int64(2), own) <= s).astype(np.int64)
        own -= (np.left_shift(np.int64(1), own) > s).astype(np.int64)
        low = np.left_shift(np.int64(1), own)
        below = np.where((own > 0) & (s * self.p <= (low - 1) * 100), own - 1, -1)
        return [(own, self.differences(s, self.largest_partner(s))), (below, self.differences(s, low - 1))]


INSTANCE = 0x7F  # the low bits of a signature: twice the band, plus one for the scheme of single features; all ones for the whole set
NEED = 0xFFFFFF  # needs above this count as this: still a bound, only a looser one


def signatures(
    g: np.ndarray, d: np.ndarray, sizes: np.ndarray, scheme: Scheme
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text index) of the sets (g, d), and (text, instance, signatures needed); see the module text."""
    info: list[np.ndarray] = [np.empty((0, 3), np.int64)]
    if not len(g):
        return np.empty(0, U64), np.empty(0, np.int64), info[0]
    inner = tv.mix64(g ^ U64(0xA5A5A5A55A5A5A5A))
    out_s, out_d = [], []
    tag = ~U64(INSTANCE)
    for band, allowed in scheme.bands(sizes):
        here = (band >= 0) & (sizes > 0)
        if not here.any():
            continue
        sel = slice(None) if here.all() else here[d]
        gd, gi = d[sel], inner[sel]
        groups = np.where(here, scheme.groups(np.maximum(band, 0)), 0)
        first = np.concatenate([[0], np.cumsum(groups)])
        part = (((gi >> U64(32)) * (PARTS * groups)[gd].astype(U64)) >> U64(32)).astype(np.int64) + PARTS * first[gd]
        content = np.zeros(PARTS * first[-1], U64)
        np.add.at(content, part, tv.mix64(gi) | U64(1))
        filled = np.zeros(len(content), bool)
        filled[part] = True
        filled, content = filled.reshape(-1, PARTS), content.reshape(-1, PARTS)
        owner = np.repeat(np.arange(len(sizes)), groups)
        found = np.bincount(owner[filled.sum(1) >= 2], minlength=len(sizes))
        whole = content.sum(1, dtype=U64)
        of = tv.mix64((np.arange(len(owner)) - first[owner]).astype(U64) ^ (band[owner].astype(U64) << U64(56)))  # tells groups apart
        for i in range(PARTS):
            some = np.flatnonzero(np.delete(filled, i, 1).any(1))
            out_s.append(tv.mix64((whole - content[:, i] + of)[some] + U64(i)) & tag | band[owner[some]].astype(U64) << U64(1))
            out_d.append(owner[some])
        i = np.flatnonzero(here)
        info.append(np.column_stack([i, 2 * band[i], np.maximum(found[i] - allowed[i] // 2, 0)]))
        lacking = here & (found <= allowed // 2)
        if lacking.any():
            sel = lacking[gd]
            ld, li = gd[sel], gi[sel]
            b = band[ld].astype(U64)
            out_s.append(tv.mix64(li ^ (b << U64(56)) ^ U64(0x5EED5EED5EED)) & tag | b << U64(1) | U64(1))
            out_d.append(ld)
            i = np.flatnonzero(lacking)
            info.append(np.column_stack([i, 2 * band[i] + 1, np.maximum(np.bincount(ld, minlength=len(sizes))[i] - allowed[i], 0)]))
    return np.concatenate(out_s), np.concatenate(out_d), np.concatenate(info)


def _emit(k: int, percent: int, buckets: int, most: int = 1 << 18):
    """Signatures packed by bucket (see blobs), about ``most`` at a time; notes: size << 32 | instance << 24 | signatures needed; rows: set sizes."""
    scheme = Scheme(percent)
    none = np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        turn = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = tv.buffers(batch.column(1))
            ss, dd, nd, nv, counts, begun = [none.view(U64)], [none], [none], [none], [none], 0
            for x, y in tv.row_blocks(offs):
                if sum(map(len, ss)) > most:
                    yield blobs.pack(np.concatenate(ss), np.concatenate(dd), buckets, turn, (np.concatenate(nd), np.concatenate(nv)), (ids[begun:x], valid[begun:x], np.concatenate(counts)))
                    ss, dd, nd, nv, counts, begun, turn = [none.view(U64)], [none], [none], [none], [none], x, turn + 1
                g, d, sizes = shingle_sets(data, offs[x : y + 1], k)
                counts.append(sizes)
                known = valid[x:y]
                if not known.all():
                    g, d = g[known[d]], d[known[d]]
                if not len(g):
                    continue
                # texts with equal sets share a signature of the whole set; only the first lists the others
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                present = d[first]
                all_of = tv.mix64(np.add.reduceat(tv.mix64(g ^ U64(0x77AA77AA)), first) ^ sizes[present].astype(U64)) | U64(INSTANCE)
                fresh = np.zeros(len(sizes), bool)
                for i, w in zip(present.tolist(), all_of.tolist()):
                    if w not in seen:
                        seen.add(w)
                        fresh[i] = True
                keep = fresh[d]
                s, sd, info = signatures(g[keep], d[keep], np.where(fresh, sizes, 0), scheme)
                ss += [s, all_of]
                dd += [ids[sd + x], ids[present + x]]
                nd += [ids[info[:, 0] + x], ids[present + x]]
                nv += [sizes[info[:, 0]] << 32 | info[:, 1] << 24 | np.minimum(info[:, 2], NEED), sizes[present] << 32 | INSTANCE << 24]
            yield blobs.pack(np.concatenate(ss), np.concatenate(dd), buckets, turn, (np.concatenate(nd), np.concatenate(nv)), (ids[begun:], valid[begun:], np.concatenate(counts)))
            turn += 1

    return run

def _verify(k: int, percent: int):
    """Keeps pairs (a, b, text_a, text_b) with exact Jaccard similarity over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (da, oa), (db, ob) = tv.buffers(b.column(2)), tv.buffers(b.column(3))
            ok = []
            for x, y in tv.row_blocks(oa + ob, 2 << 20):
                ga, ia, na = shingle_sets(da, oa[x : y + 1], k)
                gb, ib, nb = shingle_sets(db, ob[x : y + 1], k)
                key = np.sort(np.concatenate([ia, ib]).astype(U64) << U64(52) | np.concatenate([ga, gb]))
                inter = np.bincount((key[1:][key[1:] == key[:-1]] >> U64(52)).astype(np.int64), minlength=y - x)
                ok.append((inter > 0) & (100 * inter >= percent * (na + nb - inter)))
            m = pa.array(np.concatenate(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    a = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    rows = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return scratch.table(rows.mapInArrow(tv.released(_verify(k, percent)), "a long, b long"), "nj-links")


def similar_documents(
    docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, broadcast_ids: int = 500_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    docs may have any further columns; only id_col and text_col are read.  Null,
    empty or blank texts have the empty set and are linked with nothing, so they
    are their own component.  A row whose id is null keeps its n_shingles and has
    a null component.  Rows that repeat an id are one document with several
    texts: it is linked if any of them is.  Texts of any length are whole.
    An empty table gives an empty result.  The ids of texts whose set another has are
    broadcast up to broadcast_ids of them.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    tasks = scratch.tasks_for(src)
    n_buckets = buckets or 4 * tasks
    packed = src.mapInArrow(tv.released(_emit(k, percent, n_buckets)), blobs.SCHEMA).repartition(tasks, "bucket")
    found = scratch.table(packed.groupBy("bucket").applyInArrow(blobs.gather, blobs.MEMBERS), "nj-found")
    rows = scratch.table(found.where("row is not null").select("doc", "row"), "nj-rows")
    members = found.where("row is null")
    twins = scratch.table(_twins(members), "nj-twins")
    known = twins.select("doc")
    members = members.join(F.broadcast(known) if twins.count() <= broadcast_ids else known, "doc", "left_anti")
    able = scratch.table(_able(members), "nj-able")
    scratch.drop(found)
    texts = scratch.table(src.join(able.select("doc").unionByName(known).distinct(), "doc", "left_semi"), "nj-texts")

    pairs = _best_representative(able).unionByName(twins.select(F.col("rep").alias("a"), F.col("doc").alias("b")))
    links = _verified(pairs, texts, k, percent)
    comps = connected_components(links)
    mixed = scratch.table(_mixed(able, comps), "nj-mixed")
    scratch.drop(able, links, twins)
    hot = mixed.where("big").groupBy("doc", "comp", "lo", "hi").agg(F.collect_list("sig").alias("sigs"), F.collect_set("least").alias("leasts"))
    hot = scratch.table(hot, "nj-hot")
    pairs = _pairs_of_small(mixed.where("not big"), percent).unionByName(_drawn(hot, 0, percent)).distinct()
    pairs = scratch.table(pairs, "nj-pairs")
    scratch.drop(mixed)
    comps = _contracted(comps, _verified(pairs, texts, k, percent))
    comps = _close_hot(comps, hot, texts, k, percent)
    scratch.drop(hot, pairs, texts)
    return rows.join(comps, rows.doc == comps.node, "left").select(F.col("doc").alias("doc_id"), F.col("row").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _twins(members: DataFrame) -> DataFrame:
    """(doc, rep): documents of one text that list the signatures of a set which a smaller one lists too.

    Linking them to that one is enough.  Texts that a task has met before list
    nothing but their whole set's signature, so only those that list are told apart here.
    """
    sig, inst = F.col("sig"), F.shiftright("note", 24).bitwiseAND(F.lit(0xFF))
    whole = members.where(sig.isNull() | (sig.bitwiseAND(F.lit(INSTANCE)) == INSTANCE))
    per = whole.groupBy("doc").agg(F.max("sig").alias("sig"), F.count_if(inst == INSTANCE).alias("texts"), F.count_if(inst != INSTANCE).alias("lists"))
    per = per.where("sig is not null and texts = 1 and lists > 0").select("sig", "doc")
    return per.join(per.groupBy("sig").agg(F.min("doc").alias("rep")), "sig").where("rep <> doc").select("doc", "rep")


def _able(rows: DataFrame) -> DataFrame:
    """(doc, inst, m, need, lo, hi) of the documents that share as many signatures of an instance as any link takes.

    m: the signatures, each with a small document that has it; lo, hi: the document's smallest and largest set.
    """
    sig, note = F.col("sig"), F.col("note")
    parts = rows.select(
        "doc", F.coalesce(sig.bitwiseAND(F.lit(INSTANCE)), F.shiftright(note, 24).bitwiseAND(F.lit(0xFF))).alias("inst"), F.when(sig.isNotNull(), F.struct("sig", "rep")).alias("m"),
        note.bitwiseAND(F.lit(NEED)).alias("need"), F.shiftright(note, 32).alias("n"))
    out = parts.groupBy("doc", "inst").agg(F.collect_set("m").alias("m"), F.min("need").alias("need"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    have = F.size(F.array_distinct("m.sig"))
    return out.where((have > 0) & (have >= F.col("need")))


def _best_representative(able: DataFrame) -> DataFrame:
    """(a, b): each document b with the small document a that it shares most signatures with."""
    stars = able.select("doc", F.explode("m.rep").alias("rep")).where("doc <> rep").groupBy("doc", "rep").agg(F.count("*").alias("n"))
    stars = stars.join(able.select(F.col("doc").alias("rep")).distinct(), "rep", "left_semi")
    return stars.groupBy("doc").agg(F.max(F.struct("n", (-F.col("rep")).alias("r"))).alias("m")).select((-F.col("m.r")).alias("a"), F.col("doc").alias("b"))


def _mixed(able: DataFrame, comps: DataFrame) -> DataFrame:
    """(sig, doc, comp, lo, hi, big, least): signatures to look documents up by that may still link to another component.

    A linking pair shares with a foreign component what it needs, so a document
    with fewer such signatures is out.  Of the pair's shared signatures take the
    rarest: before it, in either document's order of rarity, stand only ones that
    the pair does not share.  So each document needs to be looked up by its
    have - need + 1 rarest signatures alone.  big: more than MANY documents look a
    signature up; least: the smallest of its components.
    """
    lab = able.join(comps, able.doc == comps.node, "left").select("doc", "inst", "need", "lo", "hi", F.coalesce("component", "doc").alias("comp"), F.explode(F.array_distinct("m.sig")).alias("sig"))
    foreign = lab.groupBy("sig").agg(F.count("*").alias("freq"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig", "freq")
    # one row a signature on that side: hashing it spares the sort of all memberships
    shared = lab.join(foreign.hint("shuffle_hash"), "sig").groupBy("doc", "inst", "need", "lo", "hi", "comp").agg(F.sort_array(F.collect_list(F.struct("freq", "sig"))).alias("l")).where("size(l) >= need")
    picked = scratch.table(shared.select("doc", "comp", "lo", "hi", F.expr("slice(l.sig, 1, size(l) - need + 1)").alias("sigs")), "nj-picked")
    members = picked.select("doc", "comp", "lo", "hi", F.explode("sigs").alias("sig"))
    groups = members.groupBy("sig").agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("y")).where("least <> y")
    return members.join(groups.select("sig", "least", (F.col("n") > MANY).alias("big")).hint("shuffle_hash"), "sig")


MANY = 32  # signatures of more documents than this are not expanded into pairs
BLOCK = 256


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether the set sizes of two documents allow a link."""
    return (F.col(f"{a}hi") * 100 >= F.col(f"{b}lo") * percent) & (F.col(f"{b}hi") * 100 >= F.col(f"{a}lo") * percent)


def _pairs_of_small(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of documents of different components that share a signature of at most MANY documents."""
    lists = members.groupBy("sig").agg(F.collect_list(F.struct("doc", "comp", "lo", "hi")).alias("l"))
    first = lists.select("l", F.explode("l").alias("x"))
    pairs = first.select("x", F.explode(F.expr("filter(l, y -> y.doc > x.doc and y.comp <> x.comp)")).alias("y"))
    return pairs.where(_fits("x.", "y.", percent)).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))


def _drawn(hot: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): a draw of one partner a for each document b of hot.

    In an order of this turn's own, each document takes the first of its
    signatures, as in min-hashing; of the documents that took the same one the
    first is the others' partner.
    """
    taken = F.array_min(F.transform("sigs", lambda x: F.struct(F.xxhash64(x, F.lit(turn)).alias("key"), x.alias("sig"))))["sig"]
    draws = hot.select("doc", "comp", "lo", "hi", taken.alias("sig"))
    key = F.xxhash64(F.col("doc"), F.lit(turn))
    firsts = draws.groupBy("sig").agg(F.min(F.struct(key.alias("key"), F.col("doc").alias("a"), F.col("comp").alias("acomp"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))).alias("f")).select("sig", "f.*")
    return draws.join(firsts, "sig").where((F.col("comp") != F.col("acomp")) & _fits("", "a", percent)).select("a", F.col("doc").alias("b"))


def _contracted(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps with the components that links join made one; they stand for their members."""
    over = links.join(comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    top = connected_components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    every = comps.select("node", "component").unionByName(top.join(comps.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return scratch.table(every.join(top.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "nj-comps")


def _close_hot(comps: DataFrame, hot: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """comps with all links between documents that share a signature of many documents.

    Each turn verifies one drawn pair per document; turns go on while they join
    one in FEW of the components that are left.  What is left then is compared in blocks.
    """
    left, turn = None, 1
    while True:
        now = hot.drop("comp").join(comps, hot.doc == comps.node, "left").select("doc", "lo", "hi", "sigs", "leasts", F.coalesce("component", "doc").alias("comp"))
        now = scratch.table(now, "nj-hot-now")
        before, left = left, now.select("comp").distinct().count()
        if left < 2 or (before is not None and (before - left) * FEW < before):
            break
        links = _verified(_drawn(now, turn, percent), texts, k, percent)
        comps = _contracted(comps, links)
        scratch.drop(now, links)
        turn += 1
    if left > 1:
        comps = _contracted(comps, _block_links(now, comps, texts, k, percent))
    scratch.drop(now)
    return comps


FEW = 20


def _to_blocks(k: int):
    """Rows (z, comp, doc, text), sorted by z -> blocks of at most BLOCK documents of one z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        part, turn = uuid.uuid4().hex, 0
        for t in batches:
            z = t["z"].to_numpy()
            data, offs = tv.buffers(t["text"])
            edges = np.flatnonzero(np.r_[True, z[1:] != z[:-1]])
            cuts = sorted({int(c) for e, n in zip(edges, np.r_[edges[1:], len(z)]) for c in range(e, n, BLOCK)}) if len(z) else []
            for x, y in zip(cuts, [*cuts[1:], len(z)]):
                g, d, n = shingle_sets(data, offs[x : y + 1], k)
                comp = t["comp"].to_numpy()[x:y]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(z[x])]), pa.array([f"{part}-{turn}"]), pa.array([int(comp.min())]), pa.array([int(comp.max())]), pa.array([int(n.min())]), pa.array([int(n.max())]),
                     pa.array([t["doc"].to_numpy()[x:y].tobytes()]), pa.array([comp.tobytes()]), pa.array([n.tobytes()]), pa.array([g.tobytes()])],
                    names=["z", "block", "c0", "c1", "n0", "n1", "docs", "comps", "sizes", "sets"])
                turn += 1

    return run


_BLOCKS = "z long, block string, c0 long, c1 long, n0 long, n1 long, docs binary, comps binary, sizes binary, sets binary"


def _between(percent: int):
    """Links between the documents of two blocks: a spanning forest of the components that they join."""

    def side(b: pa.RecordBatch, i: int, s: str) -> tuple[np.ndarray, ...]:
        get = lambda c, t: np.frombuffer(b[f"{c}{s}"][i].as_py(), t)
        return get("docs", np.int64), get("comps", np.int64), get("sizes", np.int64), get("sets", np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                da, ca, na, ga = side(b, i, "_a")
                db, cb, nb, gb = side(b, i, "_b")
                both = np.intersect1d(ga, gb)
                inter = np.zeros((len(da), len(db)), np.float32)
                ra, rb = np.repeat(np.arange(len(da)), na), np.repeat(np.arange(len(db)), nb)
                for at in range(0, len(both), 4096):
                    u = both[at : at + 4096]
                    m = []
                    for g, r, n in ((ga, ra, len(da)), (gb, rb, len(db))):
                        j = np.minimum(np.searchsorted(u, g), len(u) - 1)
                        ok = u[j] == g
                        x = np.zeros((n, len(u)), np.float32)
                        x[r[ok], j[ok]] = 1
                        m.append(x)
                    inter += m[0] @ m[1].T
                inter = inter.astype(np.int64)
                hit = (inter > 0) & (100 * inter >= percent * (na[:, None] + nb[None] - inter)) & (ca[:, None] != cb[None])
                x, y = np.nonzero(hit)
                one = _forest(ca[x], cb[y])
                yield pa.RecordBatch.from_arrays([pa.array(da[x[one]]), pa.array(db[y[one]])], names=["a", "b"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of edges (a, b) that span what all of them join."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(names)))
    kept = []
    for i, (u, v) in enumerate(ends.reshape(2, -1).T.tolist()):
        while up[u] != u:
            up[u] = u = up[up[u]]
        while up[v] != v:
            up[v] = v = up[up[v]]
        if u != v:
            up[u] = v
            kept.append(i)
    return np.array(kept, np.int64)


def _block_links(hot: DataFrame, comps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components of documents that share a signature of many documents.

    Components that such signatures connect form a neighbourhood z.  Its documents
    are packed in blocks, in the order of their sizes' band and their components;
    blocks are compared two by two inside tasks, unless both hold only one and the
    same component or their sizes are too far apart.  Pairs are never emitted,
    only a spanning forest of the links between two blocks.
    """
    spark = hot.sparkSession
    edges = hot.select("comp", F.explode("leasts").alias("least")).distinct()
    edges = edges.join(comps, edges.least == comps.node, "left").select(F.col("comp").alias("a"), F.coalesce("component", "least").alias("b")).distinct()
    near = connected_components(edges, loops=True)
    open_ = near.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    near = near.join(open_, "component").select("node", F.col("component").alias("z"))
    docs = hot.join(near, hot["comp"] == near.node).select("doc", "comp", "lo", "z")
    band = F.floor(F.log(F.col("lo").cast("double")) / F.lit(float(np.log(100 / percent)) if percent < 100 else 1.0))
    rows = docs.join(texts, "doc").select("z", band.alias("band"), "comp", "doc", "text")
    parts = scratch.shuffle_partitions(spark)
    blocks = scratch.table(rows.repartitionByRange(parts, "z", "band", "comp", "doc").sortWithinPartitions("z", "band", "comp", "doc").drop("band").mapInArrow(_to_blocks(k), _BLOCKS), "nj-blocks")
    light = blocks.select("z", "block", "c0", "c1", "n0", "n1")
    a = light.select("z", *[F.col(c).alias(f"{c}_a") for c in ("block", "c0", "c1", "n0", "n1")])
    b = light.select("z", *[F.col(c).alias(f"{c}_b") for c in ("block", "c0", "c1", "n0", "n1")])
    one = (F.col("c0_a") == F.col("c1_a")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0_a") == F.col("c0_b"))
    near = (F.col("n1_a") * 100 >= F.col("n0_b") * percent) & (F.col("n1_b") * 100 >= F.col("n0_a") * percent)
    pairs = a.join(b, "z").where((F.col("block_a") <= F.col("block_b")) & ~one & near).select("block_a", "block_b")
    body = ("docs", "comps", "sizes", "sets")
    left = blocks.select(F.col("block").alias("block_a"), *[F.col(c).alias(f"{c}_a") for c in body])
    right = blocks.select(F.col("block").alias("block_b"), *[F.col(c).alias(f"{c}_b") for c in body])
    links = scratch.table(pairs.join(left, "block_a").join(right, "block_b").mapInArrow(_between(percent), "a long, b long"), "nj-block-links")
    scratch.drop(blocks)
    return links


def representatives(docs: DataFrame, **options) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest id stays.

    Rows with a null id stay, and so do null and empty texts; all rows that repeat
    the id of a document that goes do.  Columns of any name are kept as they are.
    An empty table stays empty.  The ids that go are broadcast up to broadcast_ids
    of them (500,000), so that texts are not shuffled once more; beyond that by shuffle.
    """
    id_col = options.get("id_col", "doc_id")
    found = similar_documents(docs, **options)
    gone = scratch.table(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "nj-gone")
    side = F.broadcast(gone) if gone.count() <= options.get("broadcast_ids", 500_000) else gone
    return docs.join(side, docs[id_col].cast("long") == side["__gone"], "left_anti")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
