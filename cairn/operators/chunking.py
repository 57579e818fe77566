"""Cutting contents to chunks: fixed sizes natively, content-defined cuts in Arrow batches.

A content of no bytes has no chunks; any other ends with a last chunk, which is empty where a cut falls on the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import digests
from cairn.tables import spread

# The multipliers and the masks that published chunk boundaries rest on.
LCG_MULTIPLIER = 6364136223846793005
LCG_INCREMENT = 1442695040888963407
RABIN_MULTIPLIER = 1664525
PAPER_BITS = 13
PAPER_MASKS = (0x0003590703530000, 0x0000D90003530000)

SCHEMA = "ord int, offset bigint, len bigint, hash string"


def power_of_two(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def lcg(seed: int) -> Iterator[int]:
    value = seed
    while True:
        value = (value * LCG_MULTIPLIER + LCG_INCREMENT) % (1 << 64)
        yield value


def generated(n: int, seed: int = 0) -> bytes:
    """Bytes of the generator that published chunk boundaries are made with: 32 bits of each value, the high byte first."""
    values = lcg(seed)
    return b"".join((next(values) & 0xFFFFFFFF).to_bytes(4, "big") for _ in range(n // 4))


def _ends(n: int, next_cut: Callable[[int], int | None]) -> list[int]:
    """Ends of chunks: from each start the next cut, until there is none."""
    ends, start = [], 0
    while (cut := next_cut(start)) is not None and cut <= n:
        ends.append(cut)
        start = cut
    return [*ends, n]


def fixed_ends(data: bytes, size: int) -> list[int]:
    return _ends(len(data), lambda s: s + size if s + size <= len(data) else None)


def ae_ends(data: bytes, average: int) -> list[int]:
    """Asymmetric extremum: a chunk ends a window after the last byte greater than all before it in the chunk."""
    window, a = average - 256, np.frombuffer(data, np.uint8)

    def cut(start: int) -> int | None:
        top = start
        while top < len(a):
            reach = a[top + 1 : top + window + 1]
            greater = reach > a[top]
            step = int(greater.argmax()) if len(reach) else 0
            if len(reach) and greater[step]:
                top += step + 1
            else:
                return top + window + 1 if len(reach) == window else None
        return None

    return _ends(len(data), cut)


@lru_cache(16)
def _rabin_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.concatenate([np.ones(1, np.uint32), np.full(n, RABIN_MULTIPLIER, np.uint32)]), dtype=np.uint32)
    inverse = pow(RABIN_MULTIPLIER, -1, 1 << 32)
    return up, np.cumprod(np.concatenate([np.ones(1, np.uint32), np.full(n, inverse, np.uint32)]), dtype=np.uint32)


def rabin_ends(data: bytes, average: int, seed: int = 0) -> list[int]:
    """A chunk ends where the rolling hash of the last average / 4 - 1 bytes has zeros under the mask.

    The window's hash does not depend on where the chunk began, so candidates are found once for all chunks: with the
    inverse multiplier's powers, sums over a window are differences of running sums.
    """
    window, least, most, mask = average // 4 - 1, average // 4, average * 4, power_of_two(average) - 1
    a, n = np.frombuffer(data, np.uint8), len(data)
    candidates = np.zeros(0, np.int64)
    if n >= window:
        up, down = _rabin_powers(power_of_two(max(n, 1024)))
        sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(a * down[:n], dtype=np.uint32)])
        hashes = up[window - 1 : n] * (sums[window:] - sums[: n - window + 1])
        candidates = np.flatnonzero((hashes ^ np.uint32(seed)) & np.uint32(mask) == 0) + window - 1

    def cut(start: int) -> int | None:
        i = np.searchsorted(candidates, start + least)
        if i < len(candidates) and candidates[i] < start + most:
            return int(candidates[i]) + 1
        return start + most + 1 if start + most < n else None

    return _ends(n, cut)


@lru_cache(16)
def _gear(seed: int) -> np.ndarray:
    values = lcg(seed)
    return np.array([next(values) for _ in range(256)], np.uint64)


@lru_cache(16)
def _masks(average: int, seed: int, level: int = 2) -> tuple[int, int]:
    """(before the average, after it): the first has ``level`` bits more than the average calls for, the second fewer."""
    bits = (power_of_two(average) - 1).bit_count()
    if bits == PAPER_BITS:
        return PAPER_MASKS
    values, mask, made = lcg(seed), 0, {}
    for wanted in (bits - level, bits + level):
        while mask.bit_count() < wanted:
            turn = next(values) % 64
            one = mask | 1
            mask = (one << turn | one >> (64 - turn)) % (1 << 64)
        made[wanted] = mask
    return made[bits + level], made[bits - level]


def fastcdc_ends(data: bytes, average: int, seed: int = 0) -> list[int]:
    """A chunk ends where the gear hash has zeros under a mask, a denser one before the average than after it.

    Hashes forget bytes after 64 steps, so those of full windows are made for all positions by doubling; the first ones
    of a chunk, whose hash starts empty after the skipped least size, follow by taking the bytes before it out.
    """
    least, most = average // 4, average * 8
    before, after = (np.uint64(m) for m in _masks(average, seed))
    n = len(data)
    h = _gear(seed)[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16, 32):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint64(width)
        h = wider
    zero = np.uint64(0)
    hits = [np.flatnonzero(h & m == zero) for m in (before, after)]

    def first_hit(start: int, low: int, high: int, which: int) -> int | None:
        """The first hit in [low, high) for a hash that began at ``start``."""
        fresh = min(high, start + 63)
        if low < fresh:
            own = h[low:fresh]
            if start:
                own = own - (h[start - 1] << np.arange(low - start + 1, fresh - start + 1, dtype=np.uint64))
            found = np.flatnonzero(own & (before, after)[which] == zero)
            if len(found):
                return low + int(found[0])
        i = np.searchsorted(hits[which], max(low, fresh))
        return int(hits[which][i]) if i < len(hits[which]) and hits[which][i] < high else None

    def cut(start: int) -> int | None:
        begin, middle, end = (min(n, start + k) for k in (least, average, most))
        for low, high, which in ((begin, middle, 0), (middle, end, 1)):
            if (hit := first_hit(begin, low, high, which)) is not None:
                return hit + 1
        return end if n - start >= most else None

    return _ends(n, cut)


ENDS = {"fixed": lambda d, size, seed: fixed_ends(d, size), "ae": lambda d, size, seed: ae_ends(d, size), "rabin": rabin_ends, "fastcdc": fastcdc_ends}


def fixed_chunks(df: DataFrame, content: str, size: int, keep: list[str], digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """``keep`` columns and (ord, offset, len, hash) of each fixed-size chunk, all in the JVM."""
    data = df.select(*keep, F.col(content).cast("binary").alias("_data")).where(F.octet_length("_data") > 0)
    total = F.octet_length("_data")
    exploded = data.withColumn("ord", F.explode(F.sequence(F.lit(0), F.floor(total / size).cast("int"))))
    chunk = F.substring("_data", F.col("ord") * size + 1, F.lit(size))
    return exploded.select(*keep, "ord", (F.col("ord") * size).cast("long").alias("offset"), F.octet_length(chunk).cast("long").alias("len"), digest(chunk).alias("hash"))


def content_chunks(df: DataFrame, content: str, method: str, size: int, keep: list[str], seed: int = 0, hash_method: str = "md5", with_data: bool = False) -> DataFrame:
    """``keep`` columns and (ord, offset, len, hash) of each chunk, with ``with_data`` its bytes too."""
    ends = ENDS[method]
    picked = spread(df.select(*keep, F.col(content).cast("binary").alias("_data")))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, order, offset, length, chunks = [], [], [], [], []
            for row, value in enumerate(batch.column(k)):
                data = value.as_py()
                start = 0
                for n, end in enumerate(ends(data, size, seed) if data else []):
                    rows.append(row)
                    order.append(n)
                    offset.append(start)
                    length.append(end - start)
                    chunks.append(data[start:end])
                    start = end
            columns = [c.take(pa.array(rows, pa.int32())) for c in batch.columns[:k]]
            columns += [pa.array(order, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(digests(hash_method, chunks), pa.string())]
            names = [*keep, "ord", "offset", "len", "hash"]
            if with_data:
                columns.append(pa.array(chunks, pa.binary()))
                names.append("data")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:k]]
    return picked.mapInArrow(run, ", ".join([*kept, SCHEMA]) + ", data binary" * with_data)


def chunks(df: DataFrame, content: str, chunker, keep: list[str], hash_method: str = "md5") -> DataFrame:
    """Chunks by a :class:`cairn.model.Chunker`; fixed sizes with a digest that the JVM has stay there."""
    if chunker.method == "fixed" and hash_method == "md5":
        return fixed_chunks(df, content, chunker.size, keep)
    return content_chunks(df, content, chunker.method, chunker.size, keep, chunker.seed, hash_method)
