"""Byte-level BPE by two tiers: a minimal perfect hash knows whole pre-tokens, a heap over linked bytes merges the rest."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Results remembered by a worker in each of two generations, and the longest pre-token among them: some 100 MB.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
#: Pre-tokens of a text held at a time.
SLICE = 200_000
#: Ids that one batch of results may hold before it is sent.
BATCH_IDS = 2_000_000
_MIX, _WORD = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF


class PerfectHash:
    """Hash and displace: n keys to n slots. A bucket's displacement spreads its keys over free slots; lone keys get the slots left."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        groups: dict[int, list[int]] = {}
        digests = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(digests):
            groups.setdefault(h % self.buckets, []).append(i)
        self.displacement, taken, slots = [0] * self.buckets, bytearray(self.n), [0] * self.n
        free = 0
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                while taken[free]:
                    free += 1
                self.displacement[bucket], found = -free - 1, [free]
            else:
                d = 0
                while True:
                    found = [self._slot(digests[i], d) for i in members]
                    if len(set(found)) == len(found) and not any(taken[s] for s in found):
                        break
                    d += 1
                self.displacement[bucket] = d
            for i, s in zip(members, found, strict=True):
                taken[s], slots[i] = 1, s
        self.keys, self.order = [b""] * self.n, [0] * self.n
        for i, s in enumerate(slots):
            self.keys[s], self.order[s] = keys[i], i

    def _slot(self, digest: int, d: int) -> int:
        return (((digest ^ (d * _MIX)) * _MIX & _WORD) >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's place in the list it was built from, or -1."""
        digest = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[digest % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(digest, d)
        return self.order[slot] if self.keys[slot] == key else -1


class Codec:
    """Encodes and decodes by a table of ranks; a token's rank is its id."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str = public_tokenizers.PATTERN):
        self.pattern, self.ids, self.whole = regex.compile(pattern), ids, PerfectHash(tokens)
        self.bytes_of = dict(zip(ids, tokens, strict=True))
        rank = dict(zip(tokens, ids, strict=True))
        self.byte_ids = [rank.get(bytes([b])) for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("the vocabulary lacks single bytes")
        #: (left id, right id) -> id of the two joined, for every way to join two tokens to a token
        self.shift = max(ids).bit_length()
        self.joins = {rank[t[:i]] << self.shift | rank[t[i:]]: r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        #: results by pre-token, and those of the generation before: a full memo becomes the old one, what is used again moves on
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        return cls([a for a, _ in pairs], [b for _, b in pairs], pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Joins neighbours, least rank first and leftmost among equals, until none can be joined."""
        n, join, shift = len(piece), self.joins.get, self.shift
        place = n.bit_length()  # bits of a heap entry that tell where; the others are the rank
        mask = (1 << place) - 1
        byte_ids = self.byte_ids
        ids = [byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [join(a << shift | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        rank.append(-1)
        heap = [r << place | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> place
            if rank[i] != r:
                continue  # one of the two has been joined to another since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank[j] = r, -1, -1
            if k < n:
                before[k] = i
                rank[i] = x = join(r << shift | ids[k], -1)
                if x >= 0:
                    heappush(heap, x << place | i)
            else:
                rank[i] = -1
            p = before[i]
            if p >= 0:
                rank[p] = x = join(ids[p] << shift | r, -1)
                if x >= 0:
                    heappush(heap, x << place | p)
        return [x for x in ids if x >= 0]

    def piece(self, token: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        out = self.old.get(token)
        if out is None:
            raw = token.encode("utf-8", "surrogatepass")
            found = self.whole.get(raw)
            ids = [self.ids[found]] if found >= 0 else self.merge(raw)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.old, self.memo = self.memo, {}
            self.memo[token] = out
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, slice by slice, as little-endian unsigned 32-bit integers."""
        matches = (m.group() for m in self.pattern.finditer(text)) if len(text) > SLICE else iter(self.pattern.findall(text))
        get, piece = self.memo.get, self.piece
        while tokens := list(islice(matches, SLICE)):
            yield b"".join([get(t) or piece(t) for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def _codec(key: tuple, broadcast) -> Codec:
    """A worker builds a vocabulary's tables once."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*broadcast.value)
    return _CODECS[key]


def _encoded(ids: pa.Array, rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values()))], names=["doc_id", *kinds])


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: its id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with ``with_ids`` also the ``ids``.

    Each match of ``pattern`` is encoded by itself: the perfect hash answers for pre-tokens that are vocabulary, the
    heap merges the others. The ids are then decoded to bytes. Texts are worked through whole, slice by slice. A null
    text counts as empty: no ids, the digest of nothing. Rows are independent: repeated rows and ids repeat, an empty
    table gives an empty result, other columns are not read. The vocabulary travels as one broadcast, bounded by its file.
    """
    tokens = Codec.load(path, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(([tokens.bytes_of[i] for i in tokens.ids], tokens.ids, pattern))
    key = (path, pattern, len(tokens.ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            first, rows, size = 0, [], 0
            for text in batch.column(1):
                n, ids_hash, decoded_hash, ids = 0, hashlib.sha256(), hashlib.sha256(), []
                for part in codec.encode(text.as_py() or ""):
                    n += len(part) // 4
                    ids_hash.update(part)
                    decoded_hash.update(codec.decode(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                rows.append((n, ids_hash.hexdigest(), decoded_hash.hexdigest(), np.concatenate(ids or [np.zeros(0, np.int32)])))
                size += n * with_ids
                if size > BATCH_IDS:
                    yield _encoded(batch.column(0).slice(first, len(rows)), rows, with_ids)
                    first, rows, size = first + len(rows), [], 0
            yield _encoded(batch.column(0).slice(first, len(rows)), rows, with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
