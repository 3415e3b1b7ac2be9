"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

A pre-token that is a vocabulary entry as a whole is found by a minimal perfect hash (hash and
displace: one small number for each bucket, one slot for each entry, one comparison to verify).
Any other is merged: its bytes form a linked list, and a heap yields the pair of least rank,
leftmost first, until no pair has a rank; n bytes take n log n steps, however long the pre-token.

Texts are cut at blanks and line ends first, where the pattern always cuts, so that a bounded
memo of such pieces saves repeated work; the ids are the same without it.

Edge cases: null texts count as empty and have no ids; special tokens' strings are ordinary text;
white space other than blanks and line feeds takes the pattern's own path. Decoding unknown ids
raises. Repeated rows stay; extra columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import map_rows

_PLAIN = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_OTHER_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


class MinimalPerfectHash:
    """Every key to a slot of its own in range(len(keys)); other byte strings to any slot."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.size = n = max(1, len(keys))
        self.buckets = max(1, n // per_bucket)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        if len(set(hashes)) < len(keys):
            raise ValueError("keys repeat or their hashes collide")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for h in hashes:
            members[h % self.buckets].append(h)
        #: For each bucket the number that displaces its keys, or -1 - slot for a bucket of one key.
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in (b for b in order if len(members[b]) > 1):
            d = 0
            while True:
                slots = {self._mix(h, d) % n for h in members[b]}
                if len(slots) == len(members[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s in slots:
                taken[s] = 1
        free = (s for s in range(n) if not taken[s])
        for b in (b for b in order if len(members[b]) == 1):
            self.shift[b] = -1 - next(free)

    @staticmethod
    def _mix(h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 29)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -1 - d if d < 0 else self._mix(h, d) % self.size


class Codec:
    """A vocabulary of ranks with its pattern. `memo_limit` bounds the pieces that are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_limit: int = 250_000):
        self.ranks, self.pattern, self.memo_limit = ranks, pattern, memo_limit
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.entry: list[tuple[bytes, int]] = [(b"", -1)] * self.hash.size
        for k in keys:
            self.entry[self.hash.slot(k)] = (k, ranks[k])
        self.bytes_of = np.empty(max(ranks.values(), default=-1) + 1, dtype=object)
        for k, i in ranks.items():
            self.bytes_of[i] = k
        self._ready()

    @classmethod
    def from_file(cls, path: str, pattern: str, **options) -> Codec:
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}, pattern, **options)

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memo = _Memo(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def whole(self, piece: bytes) -> int:
        """The id of a pre-token that is an entry, else -1."""
        key, rank = self.entry[self.hash.slot(piece)]
        return rank if key == piece else -1

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token by merging pairs of least rank, leftmost first."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: The rank of the pair that begins at a byte, -1 without one; what the heap holds beside it is stale.
        best = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        best.append(-1)
        heap = [r << 40 | i for i, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            least = pop(heap)
            i = least & 0xFFFFFFFFFF
            if best[i] != least >> 40:
                continue
            j = after[i]
            end = after[i] = after[j]
            best[j] = -1
            if end < n:
                before[end] = i
                best[i] = r = rank(piece[i : after[end]], -1)
                if r >= 0:
                    push(heap, r << 40 | i)
            else:
                best[i] = -1
            if (p := before[i]) >= 0:
                best[p] = r = rank(piece[p:end], -1)
                if r >= 0:
                    push(heap, r << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def pieces(self, text: str) -> list[str]:
        """Stretches between which the pattern always cuts."""
        return self.split(text) if _OTHER_SPACE.search(text) else _PLAIN.findall(text)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids) -> bytes:
        """The bytes of ids (a list or an array); an unknown id raises."""
        at = np.asarray(ids, dtype=np.int64)
        if len(at) and (int(at.min()) < 0 or int(at.max()) >= len(self.bytes_of)):
            raise KeyError("an id that is not in the vocabulary")
        try:
            return b"".join(self.bytes_of[at].tolist())
        except TypeError:
            raise KeyError("an id that is not in the vocabulary") from None


class _Memo(dict):
    """Piece to packed ids, in two generations: at the limit the younger becomes the older one."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.older.get(piece)
        if made is None:
            made = self._made(piece)
        if len(piece) <= 64:  # long pieces seldom come twice
            if len(self) >= self.codec.memo_limit:
                self.older = self.copy()
                self.clear()
            self[piece] = made
        return made

    def _made(self, piece: str) -> bytes:
        codec = self.codec
        body = piece.removeprefix(" ")
        if body.isalpha():  # the pattern takes letters after a blank as one pre-token
            tokens = [piece]
        elif body[-1:] in _MARKS and body[:-1].isalpha():
            return self[piece[:-1]] + self[piece[-1]]
        else:
            tokens = codec.split(piece)
        ids = []
        for token in tokens:
            raw = token.encode()
            whole = codec.whole(raw)
            if whole >= 0:
                ids.append(whole)
            else:
                ids += codec.merged(raw)
        return struct.pack(f"<{len(ids)}i", *ids)


#: Marks that, after letters, are a pre-token of their own.
_MARKS = tuple(".,;:!?)#$%&*")


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name != name], T.StructField(name, kind)])


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with the array of ids added (an existing column of that name is replaced). A narrow pass."""
    shipped = docs.sparkSession.sparkContext.broadcast(codec)
    source = docs.drop(into)
    at = source.columns.index(text_col)
    schema = _with(docs.schema, into, T.ArrayType(T.IntegerType()))

    def rows(batches):
        code = shipped.value
        for batch in batches:
            packed = [code.encode_bytes(t) if t else b"" for t in batch.column(at).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = np.frombuffer(b"".join(packed), dtype="<i4")
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, into])

    return map_rows(source, rows, schema)


def decode(df: DataFrame, codec: Codec, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that the ids stand for added; null ids give null."""
    shipped = df.sparkSession.sparkContext.broadcast(codec)
    source = df.drop(into)
    at = source.columns.index(ids_col)
    schema = _with(df.schema, into, T.BinaryType())

    def rows(batches):
        code = shipped.value
        for batch in batches:
            made = [code.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, into])

    return map_rows(source, rows, schema)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    both = decode(encode(docs.select("doc_id", "text"), codec).drop("text"), codec)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
