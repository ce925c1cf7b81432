"""Vectorised text primitives used inside Spark tasks.

Everything works on the byte buffer of an Arrow string column: word boundaries,
64-bit word hashes and word k-gram hashes come from a handful of numpy passes,
so no Python object is made per word.  Texts are cut into blocks of bounded size
first, hence memory does not depend on the number of rows in a batch; a single
text longer than a block is processed alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
PIECE = 1 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None

_pow_cache: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; wraps around silently."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & (2**64 - 1)], dtype=U64))[0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow_cache.get("p")
    if have is None or len(have) < n:
        m = max(n, PIECE + 4096)
        p = np.full(m, _BASE, dtype=U64)
        q = np.full(m, _INV, dtype=U64)
        p[0] = q[0] = 1
        np.multiply.accumulate(p, out=p)
        np.multiply.accumulate(q, out=q)
        if m > 4 * PIECE:
            return p, q
        _pow_cache["p"], _pow_cache["q"] = p, q
    return _pow_cache["p"], _pow_cache["q"]


def byte_values(lower: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower`` A-Z share those of a-z."""
    v = mix64(np.arange(256, dtype=U64) + U64((seed << 16) & (2**64 - 1))) | U64(1)
    if lower:
        v[65:91] = v[97:123]
    return v


def is_space_table() -> np.ndarray:
    """Separators of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.zeros(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def not_alnum_table() -> np.ndarray:
    """Separators of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    t = np.zeros(256, dtype=bool)
    t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = True
    t[65:91] = False
    return t


SPACE = is_space_table()
NOT_ALNUM = not_alnum_table()


def release() -> None:
    """Returns freed memory to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def released(run):
    """The task function run, which at its end returns the worker's freed memory to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null counts as an empty text."""
    release()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n, at = len(col), col.offset
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return raw, offs - offs[0]


ROWS = 4096  # rows of a block at most


def row_blocks(offs: np.ndarray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most max_bytes and ROWS rows each, or of one row."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1
        b = min(n, max(a + 1, b), a + ROWS)
        yield a, b
        a = b


class Words:
    """Words of a block of texts: hashes, byte spans and each text's first word."""

    def __init__(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> None:
        self.h, self.start, self.end, self.first = h, start, end, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, lower: bool = False, seed: int = 1, hashes: bool = True) -> Words:
    """Words of the texts data[offs[i]:offs[i+1]].  A text boundary always ends a word."""
    base = int(offs[0])
    raw = data[base : int(offs[-1])]
    rel = offs - base
    n = len(raw)
    if n == 0:
        e = np.empty(0, np.int64)
        return Words(np.empty(0, U64), e, e, np.zeros(len(offs), np.int64))
    inside = ~sep[raw]
    prev_out = np.empty(n, bool)
    prev_out[0] = True
    np.logical_not(inside[:-1], out=prev_out[1:])
    bounds = rel[:-1][rel[:-1] < n]
    prev_out[bounds] = True
    start = np.flatnonzero(inside & prev_out)
    next_out = np.empty(n, bool)
    next_out[-1] = True
    np.logical_not(inside[1:], out=next_out[:-1])
    cut = rel[1:] - 1
    next_out[cut[cut >= 0]] = True
    end = np.flatnonzero(inside & next_out) + 1
    first = np.searchsorted(start, rel, side="left").astype(np.int64)
    h = hash_spans(raw, start, end, byte_values(lower, seed)) if hashes else np.empty(0, U64)
    return Words(h, start + base, end + base, first)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, in pieces so that the 8-byte temporaries stay small."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = int(np.searchsorted(end, lo + PIECE, side="right"))
        j = max(j, i + 1)
        hi = int(end[j - 1])
        p, q = _powers(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, U64)
        np.cumsum(values[raw[lo:hi]] * p[: hi - lo], out=acc[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (acc[e] - acc[s]) * q[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix64(out)


def kgrams(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h)-k+1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    acc = np.zeros(n, U64)
    for i in range(k):
        acc = acc * U64(0x9FB21C651E98DF25) + h[i : i + n]
    return mix64(acc + U64(mix_int(seed)))


def doc_kgrams(w: Words, k: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hash, text index) inside texts; texts with 1..k-1 words give their whole sequence once."""
    counts = w.counts
    g = kgrams(w.h, k)
    doc = w.doc_of()
    if len(g):
        ok = doc[: len(g)] == doc[k - 1 :]
        g, gd = g[ok], doc[: len(ok)][ok]
    else:
        gd = np.empty(0, np.int64)
    if short_whole:
        extra_h, extra_d = [], []
        for n in range(1, k):
            which = np.flatnonzero(counts == n)
            if len(which):
                at = w.first[which]
                acc = np.zeros(len(which), U64)
                for i in range(n):
                    acc = acc * U64(0x9FB21C651E98DF25) + w.h[at + i]
                extra_h.append(mix64(acc + U64(mix_int(1000 + n))))
                extra_d.append(which)
        if extra_h:
            g, gd = np.concatenate([g, *extra_h]), np.concatenate([gd, *extra_d])
    return g, gd


def per_text(g: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sorted keys of (text, hash): the text in the upper 12 bits (a block has no more), 52 bits of the hash below.

    One sort of plain integers is far quicker than an order over two columns.
    """
    return np.sort(d.astype(U64) << U64(52) | g >> U64(12))


def split_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of 52 bits, text) of such keys."""
    return key & U64((1 << 52) - 1), (key >> U64(52)).astype(np.int64)


def unique_per_doc(g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash of 52 bits, text), ordered by text then hash."""
    if not len(g):
        return g, d
    key = per_text(g, d)
    keep = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=keep[1:])
    return split_keys(key[keep])


def planes(a: np.ndarray) -> bytes:
    """Bytes of a fixed-width array with equal-significance bytes together (compresses better)."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def from_planes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()
