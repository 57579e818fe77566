"""Word shingles of texts as hashes, and streams of rows that come in groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_PLACE = _rng.integers(1, 1 << 63, (64, 2), np.uint64) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _powers[which]
    if len(have) < n:
        if n > 1 << 22:
            return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
        have = _powers[which] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """128 bits of hash of every word, the runs between ASCII white space, in two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw.split())), np.uint64).reshape(-1, 2)


def shingle_lanes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, 128 bits each in two columns, sorted by the first.

    A text of fewer words has one shingle, of all its words; one without words none.
    """
    h = word_hashes((text or "").encode("utf-8", "replace"))
    if not len(h):
        return h
    if len(h) < words:
        return mix((h * _PLACE[: len(h)]).sum(0, keepdims=True) + np.uint64(len(h)))
    n = len(h) - words + 1
    out = h[:n] * _PLACE[0]
    for k in range(1, words):
        out = out + h[k : k + n] * _PLACE[k]
    out = mix(out)
    out = out[np.argsort(out[:, 0], kind="stable")]
    return out[np.concatenate([[True], (out[1:] != out[:-1]).any(1)])]


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text by 64 bits, sorted."""
    return np.ascontiguousarray(shingle_lanes(text, words)[:, 0])


def set_digest(lanes: np.ndarray) -> bytes:
    """The name of a set of shingles, by all bits of :func:`shingle_lanes`."""
    return hashlib.blake2b(lanes.tobytes(), digest_size=16).digest()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in which rows of a key stand together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        differs = pc.not_equal(keys, keys[len(keys) - 1])
        last = pc.max(pc.if_else(differs, pa.array(np.arange(len(keys))), pa.scalar(None, pa.int64()))).as_py()
        cut = 0 if last is None else last + 1
        if cut == 0 and rest and rest[-1].column(key)[0] != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def group_bounds(column: pa.ChunkedArray) -> np.ndarray:
    """Where groups start, and the end: for rows of which those of a key stand together."""
    codes = column.combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
