"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the preceding bytes says so, at word starts
only, so equal passages in different documents give equal chunks.  Each chunk is
encoded once per task and reused.  Joins of chunks are then repaired: the bytes
around a join are encoded as one piece and compared with what the two sides say;
while they differ the piece grows, at last to the whole text.

The vocabulary file is read by each worker from its own installation; its path
is a parameter.  The pair merges themselves are done by an installed library,
from the ranks in that file.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

U64 = np.uint64
#: How byte-level BPE vocabularies of this kind split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_codecs: dict[str, Codec] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that such files use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file, with a bounded chunk cache."""

    def __init__(self, path: str, average: int = 512, cache_bytes: int = 24 << 20) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normalisation are supported")
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        pieces = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        size = max(pieces) + 1
        self.lengths = np.array([len(pieces.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)
        self.special = [t.encode() for t in special]
        self.mask = U64((1 << max(average // 8, 2).bit_length()) - 1)
        self.cache: dict[bytes, np.ndarray] = {}
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.cached, self.cache_bytes = 0, cache_bytes
        self.encoded_chunks = self.reused_chunks = self.repairs = 0

    def _encode(self, b: bytes) -> np.ndarray:
        return self.encoding.encode_to_numpy(b.decode("utf-8", "replace"), allowed_special="all").astype(np.uint32)

    def chunk(self, b: bytes) -> np.ndarray:
        got = self.cache.get(b)
        if got is None:
            got = self._encode(b)
            self.encoded_chunks += 1
            self.cached += len(b) + got.nbytes + 150
            if self.cached > self.cache_bytes:
                self.cache.clear()
                self.joins.clear()
                self.cached = 0
            self.cache[b] = got
        else:
            self.reused_chunks += 1
        return got

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(ids) else np.empty(0, np.int64)
        return self.bytes[at]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace")

    def cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Chunk ends: the text ends, and word starts whose 16 preceding bytes hash to zero."""
        raw = data[offs[0] : offs[-1]]
        n = len(raw)
        ends = offs[1:] - offs[0]
        if n < 18:
            return ends
        i = np.flatnonzero((raw[16:-1] == 32) & (raw[15:-2] > 32) & (((raw[17:] | 32) >= 97) & ((raw[17:] | 32) <= 122))) + 16
        values = tv.byte_values(False, 3)
        h = np.zeros(len(i), U64)
        for k in range(16, 0, -1):
            h = h * U64(0x9FB21C651E98DF25) + values[raw[i - k]]
        own = np.searchsorted(ends, i, side="right")
        inside = i - 16 >= np.concatenate([[0], ends])[own]
        return np.union1d(i[inside & ((tv.mix64(h) & self.mask) == 0)], ends)

    def repaired(self, pieces: list[np.ndarray], parts: list[bytes]) -> np.ndarray:
        """The ids of the joined parts: each join is re-encoded from whole words around it until both ways agree."""
        out = pieces[0]
        done = parts[0]
        for p, b in zip(pieces[1:], parts[1:]):
            reach = 1
            while True:
                left, right = _tail(done, reach), _head(b, reach)
                joined = self._encode(left + right)
                apart = np.concatenate([self._encode(left), self._encode(right)])
                whole = len(left) == len(done) and len(right) == len(b)
                if np.array_equal(joined, apart):
                    out = np.concatenate([out, p])
                    break
                self.repairs += 1
                if whole:
                    out = joined
                    break
                reach *= 4
                if reach > 64:
                    out = self._encode(done + b)
                    break
            done = done + b
        return out

    def encode_rows(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(offs) < 2:
            return []
        base = int(offs[0])
        cuts = self.cuts(data, offs)
        raw = data[base : int(offs[-1])].tobytes()
        out, at = [], 0
        prev = 0
        for end in (offs[1:] - base).tolist():
            parts = []
            while prev < end:
                nxt = int(cuts[at])
                while nxt <= prev:
                    at += 1
                    nxt = int(cuts[at])
                parts.append(raw[prev:nxt])
                prev = nxt
            if not parts:
                out.append(np.empty(0, np.uint32))
            elif len(parts) == 1:
                out.append(self.chunk(parts[0]))
            else:
                pieces = [self.chunk(p) for p in parts]
                out.append(self._joined(pieces, parts))
        return out

    def _joined(self, pieces: list[np.ndarray], parts: list[bytes]) -> np.ndarray:
        """Checks the joins of a text together; only where one disagrees is it repaired.

        The words beside each join, encoded as one string, must give the ids that
        they give apart.
        """
        left = [_tail(p, 1) for p in parts[:-1]]
        right = [_head(p, 1) for p in parts[1:]]
        for a, b in zip(left, right):
            same = self.joins.get((a, b))
            if same is None:
                same = self.joins[a, b] = np.array_equal(self._encode(a + b), np.concatenate([self._encode(a), self._encode(b)]))
                self.cached += len(a) + len(b) + 250
            if not same:
                return self.repaired(pieces, parts)
        return np.concatenate(pieces)


def _tail(b: bytes, words: int) -> bytes:
    """The last words of b, with the space before them."""
    at = len(b)
    for _ in range(words):
        at = b.rfind(b" ", 0, at)
        if at < 0:
            return b
    return b[at:]


def _head(b: bytes, words: int) -> bytes:
    at = 0
    for _ in range(words):
        at = b.find(b" ", at + 1)
        if at < 0:
            return b
    return b[:at]


def codec(path: str) -> Codec:
    """The worker's codec of this file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def forget() -> None:
    """Drops the worker's codecs and their chunk caches, which else would outlive the task; they are made anew in a tenth of a second."""
    _codecs.clear()
    tv.release()


def encoded(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of token ids, one row per input row.

    A null text counts as empty and, like an empty one, has no ids; texts of any
    length are whole; repeated rows get equal ids.  A column that has the new one's
    name already is replaced.  An empty table gives an empty result.
    """
    path = path or default_path()
    docs = docs.drop(ids_col) if ids_col != text_col else docs
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data, offs = tv.buffers(b.column(at))
            for x, y in tv.row_blocks(offs):
                rows = c.encode_rows(data, offs[x : y + 1])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(col.slice(x, y - x) for col in b.columns), ids], names=[*names, ids_col])
        forget()

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType(), False))]))


def decoded(docs: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text that the token ids stand for, one row per input row.

    Null and empty ids give an empty text.  A column that has the new one's name
    already is replaced.  An empty table gives an empty result.
    """
    path = path or default_path()
    docs = docs.drop(text_col) if text_col != ids_col else docs
    names = docs.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            lists = b.column(at)
            out = [c.decode(x.values.to_numpy().astype(np.int64) if x.is_valid else np.empty(0, np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, text_col])

    from pyspark.sql.types import StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(text_col, StringType())]))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    Null and empty texts have no tokens; whole texts of any length are encoded;
    repeated rows get equal results; a null id is kept.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data, offs = tv.buffers(b.column(1))
            n, s, t = [], [], []
            for x, y in tv.row_blocks(offs, 1 << 20):
                rows = c.encode_rows(data, offs[x : y + 1])
                n += [len(r) for r in rows]
                s += [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
                flat = np.concatenate(rows)
                out = c.decode_bytes(flat).tobytes()
                size = np.concatenate([[0], np.cumsum(c.lengths[flat])])[np.concatenate([[0], np.cumsum([len(r) for r in rows])])].tolist()
                for i, j in zip(size, size[1:]):
                    piece = out[i:j]
                    t.append(hashlib.sha256(piece.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s, pa.string()), pa.array(t, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        forget()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
