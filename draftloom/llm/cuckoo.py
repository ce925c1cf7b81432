"""A cuckoo filter over 64-bit hashes, filled, asked and emptied in numpy batches.

Four 16-bit fingerprints a bucket; a hash may lie in two buckets, each of which
follows from the other and the fingerprint.  What finds no place after many moves
goes to a further segment of the same size, so nothing is ever lost: a hash that was
inserted and not deleted is always found.  Others are found with a chance of about
1 in 8,000 a segment.
"""

from __future__ import annotations

import numpy as np

from . import textvec as tv

U64 = np.uint64
SLOTS = 4
KICKS = 200


class CuckooFilter:
    """Segments of (buckets, SLOTS) fingerprints; 0 marks a free slot."""

    def __init__(self, capacity: int = 64, segments: list[bytes] | None = None) -> None:
        if segments:
            self.segments = [np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy() for b in segments]
        else:
            self.segments = [self._fresh(1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.8))))))]

    @staticmethod
    def _fresh(buckets: int) -> np.ndarray:
        return np.zeros((buckets, SLOTS), np.uint16)

    @property
    def buckets(self) -> int:
        return len(self.segments[0])

    def __len__(self) -> int:
        return int(sum(np.count_nonzero(s) for s in self.segments))

    def dump(self) -> list[bytes]:
        return [s.tobytes() for s in self.segments]

    def _of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, one of its buckets) of each hash."""
        h = tv.mix64(h)
        fp = (h >> U64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (h & U64(self.buckets - 1)).astype(np.int64)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (tv.mix64(fp.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)

    @staticmethod
    def _place(slots: np.ndarray, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; tells which found one."""
        order = np.argsort(at, kind="stable")
        a = at[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        free = slots[a] == 0
        hit = free & (np.cumsum(free, axis=1) == (rank + 1)[:, None])
        ok = hit.any(axis=1)
        slots[a[ok], hit[ok].argmax(axis=1)] = fp[order][ok]
        done = np.zeros(len(at), bool)
        done[order] = ok
        return done

    def insert(self, h: np.ndarray) -> None:
        """Adds distinct hashes that were not inserted before (or were deleted since)."""
        fp, at = self._of(h)
        k = 0
        while len(fp):
            if k == len(self.segments):
                self.segments.append(self._fresh(self.buckets))
            slots, full = self.segments[k], 0.95 * self.buckets * SLOTS
            for kick in range(KICKS):
                for _ in range(2):
                    left = ~self._place(slots, fp, at)
                    fp, at = fp[left], at[left]
                    at = self._other(fp, at)
                if not len(fp) or np.count_nonzero(slots) >= full:
                    break
                # one of those that wait at a bucket takes the place of a fingerprint there, which moves on
                b, mine = np.unique(at, return_index=True)
                s = (b + kick) % SLOTS
                fp[mine], slots[b, s] = slots[b, s], fp[mine]
                at[mine] = self._other(fp[mine], b)
            k += 1

    def _found(self, slots: np.ndarray, fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether, bucket, slot) of each fingerprint in one segment."""
        there = self._other(fp, at)
        near, far = slots[at] == fp[:, None], slots[there] == fp[:, None]
        own = near.any(axis=1)
        return own | far.any(axis=1), np.where(own, at, there), np.where(own, near.argmax(axis=1), far.argmax(axis=1))

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, at = self._of(h)
        out = np.zeros(len(fp), bool)
        for slots in self.segments:
            out |= self._found(slots, fp, at)[0]
        return out

    def delete(self, h: np.ndarray) -> None:
        """Takes out distinct hashes that were inserted."""
        fp, at = self._of(h)
        for slots in self.segments:
            while len(fp):
                ok, b, s = self._found(slots, fp, at)
                where = np.flatnonzero(ok)
                if not len(where):
                    break
                # equal fingerprints of one bucket find the same slot: one of them at a time
                _, first = np.unique(b[where] * SLOTS + s[where], return_index=True)
                gone = where[first]
                slots[b[gone], s[gone]] = 0
                keep = np.ones(len(fp), bool)
                keep[gone] = False
                fp, at = fp[keep], at[keep]
