"""CRC-32 of joined byte strings from the CRCs and lengths of their parts, for whole arrays.

Appending n bytes to a string multiplies its CRC by a fixed linear map; the map of up
to NEAR bytes is a table lookup, that of longer ones is put together from powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np

NEAR = 64
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
SPACE = zlib.crc32(b" ")


def _step(c: np.ndarray) -> np.ndarray:
    """The map of one appended byte."""
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return c


def _tables() -> np.ndarray:
    """[n, byte of the CRC, its value] -> image under the map of n appended bytes."""
    out = np.empty((NEAR + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(NEAR):
        out[n + 1] = _step(out[n])
    return out


TABLES = _tables()
_twos: list[np.ndarray] = [TABLES[1]]


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0, c & 255] ^ t[1, (c >> 8) & 255] ^ t[2, (c >> 16) & 255] ^ t[3, c >> 24]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """c (uint32) as n appended bytes change it, before those bytes' own CRC is added."""
    near = np.minimum(n, NEAR)
    out = TABLES[near, 0, c & 255] ^ TABLES[near, 1, (c >> 8) & 255] ^ TABLES[near, 2, (c >> 16) & 255] ^ TABLES[near, 3, c >> 24]
    far = np.flatnonzero(n > NEAR)
    if len(far):
        x, left, k = out[far], n[far] - NEAR, 0
        while left.any():
            if k == len(_twos):
                _twos.append(_apply(_twos[-1], _twos[-1]))
            x = np.where(left & 1, _apply(_twos[k], x), x)
            left, k = left >> 1, k + 1
        out[far] = x
    return out


def joined(a: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """CRC of each string a, a space and b, from the CRCs of a and b and the length of b."""
    return shifted(a, b_len + 1) ^ shifted(np.full(len(b), SPACE, np.uint32), b_len) ^ b
