"""(key, document) pairs packed by hash bucket, so that one shuffled row carries thousands.

``pack`` reduces the documents of a batch that share a key to the smallest id and
sends all of them along unchanged as well, spread over all buckets; ``gather`` then only
has to find the keys that several batches have.  A key of a third of all rows
thus brings one entry per batch to its bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textvec as tv

U64 = np.uint64
SCHEMA = "bucket int, wide boolean, s binary, d binary, ls binary, ld binary, lr binary, nd binary, nv binary, rd binary, rv binary, rn binary"
MEMBERS = "sig long, doc long, rep long, note long, row long"
_TYPES = (pa.int32(), pa.bool_(), *[pa.binary()] * 10)
_NAMES = ["bucket", "wide", "s", "d", "ls", "ld", "lr", "nd", "nv", "rd", "rv", "rn"]
_NONE = np.empty(0, np.int64)
SHARES = 256


def pack(
    s: np.ndarray, d: np.ndarray, buckets: int, turn: int, notes: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE), rows: tuple[np.ndarray, np.ndarray, np.ndarray] = (_NONE, np.empty(0, bool), _NONE),
) -> pa.RecordBatch:
    """Pairs of one batch (keys uint64, ids int64; repeats allowed) as rows of SCHEMA.

    notes: further (document, value) pairs that come out unchanged, with a null key.
    rows: (id, whether it is valid, value) of each input row; they come out unchanged too.
    """
    order = np.argsort(s)
    s, d = s[order], d[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else _NONE
    least = np.minimum.reduceat(d, at) if len(at) else _NONE
    runs = np.diff(np.r_[at, len(s)])
    many = np.repeat(runs > 1, runs)
    ls, ld, lr = s[many], d[many], np.repeat(least, runs)[many]
    s, d = s[at], least
    narrow = np.uint32 if not len(d) or (d.min() >= 0 and d.max() < 2**32) else np.int64
    of = ((s >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(s) else _NONE
    own = {int(of[i]): (i, j) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(s)])}
    # what belongs to no bucket goes in even shares to SHARES of them, others each time
    spread = [(ls, ld, lr), notes, (rows[0], rows[1].astype(np.uint8), rows[2])]
    n = min(buckets, SHARES)
    edges = [np.linspace(0, len(c[0]), n + 1).astype(np.int64) for c in spread]
    shares = {(turn * n + k) % buckets: [(e[k], e[k + 1]) for e in edges] for k in range(n)}
    out = []
    for b in sorted({*own, *(b for b, ends in shares.items() if any(x < y for x, y in ends))}):
        i, j = own.get(b, (0, 0))
        ends = shares.get(b, [(0, 0)] * len(spread))
        parts = [s[i:j], d[i:j].astype(narrow), *(c[x:y] for cols, (x, y) in zip(spread, ends) for c in cols)]
        out.append((b, narrow is np.int64, *map(tv.planes, parts)))
    columns = zip(*out) if out else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _joined(t: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(tv.from_planes(x, dtype) for x in t[name].to_pylist())])


def gather(t: pa.Table) -> pa.Table:
    """MEMBERS of a bucket.

    Every pair whose key several documents have (a pair may repeat), with one of
    the key's smallest documents as ``rep``: that of the bucket, or of its batch.
    Then the notes (doc, note) and the rows (doc, row), all without a key.
    """
    s = _joined(t, "s", np.uint64)
    d = np.concatenate([_NONE, *(tv.from_planes(x, np.int64 if w else np.uint32).astype(np.int64) for x, w in zip(t["d"].to_pylist(), t["wide"].to_pylist()))])
    order = np.argsort(s)
    s, d = s[order], d[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else _NONE
    runs = np.diff(np.r_[at, len(s)])
    rep = np.repeat(np.minimum.reduceat(d, at), runs) if len(at) else _NONE
    keep = np.repeat(runs > 1, runs)
    ls, ld, lr = _joined(t, "ls", np.uint64), _joined(t, "ld", np.int64), _joined(t, "lr", np.int64)
    nd, nv = _joined(t, "nd", np.int64), _joined(t, "nv", np.int64)
    rd, rv, rn = _joined(t, "rd", np.int64), _joined(t, "rv", np.uint8), _joined(t, "rn", np.int64)
    sig = np.concatenate([s[keep], ls]).view(np.int64)
    doc, of = np.concatenate([d[keep], ld]), np.concatenate([rep[keep], lr])
    none = lambda n: pa.nulls(n, pa.int64())
    a, b, c = len(sig), len(nd), len(rd)
    return pa.table({
        "sig": pa.concat_arrays([pa.array(sig), none(b + c)]),
        "doc": pa.concat_arrays([pa.array(doc), pa.array(nd), pa.array(rd, mask=rv == 0)]),
        "rep": pa.concat_arrays([pa.array(of), none(b + c)]),
        "note": pa.concat_arrays([none(a), pa.array(nv), none(c)]),
        "row": pa.concat_arrays([none(a + b), pa.array(rn)]),
    })
