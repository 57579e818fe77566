"""128-bit digests of byte strings as hex, big-endian: order of hex is order of digests."""

from __future__ import annotations

import hashlib

import numpy as np

# The constants of MurmurHash3 x64 128.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
ADD1, ADD2 = 0x52DCE729, 0x38495AB5
FINAL1, FINAL2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
METHODS = ("blake2", "murmur3", "md5")

_u = np.uint64


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _u(bits)) | (x >> _u(64 - bits))


def _last_mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(33))) * _u(FINAL1)
    x = (x ^ (x >> _u(33))) * _u(FINAL2)
    return x ^ (x >> _u(33))


def murmur3(values: list[bytes]) -> list[str]:
    """MurmurHash3 x64 128 with seed 0 of many byte strings at once: the strings step through their blocks together."""
    if not values:
        return []
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    data = [values[i] for i in order]
    sizes = np.array([len(d) for d in data])
    blocks = sizes // 16
    h1, h2 = np.zeros(len(data), np.uint64), np.zeros(len(data), np.uint64)
    flat = np.frombuffer(b"".join(d[: len(d) // 16 * 16] for d in data), "<u8")
    starts = np.concatenate([[0], np.cumsum(blocks * 2)[:-1]])
    with np.errstate(over="ignore"):
        for k in range(int(blocks.max(initial=0))):
            n = int(np.searchsorted(-blocks, -k, side="left"))  # those with more than k blocks come first
            k1, k2 = flat[starts[:n] + 2 * k], flat[starts[:n] + 2 * k + 1]
            a = h1[:n] ^ (_turn(k1 * _u(C1), 31) * _u(C2))
            a = (_turn(a, 27) + h2[:n]) * _u(5) + _u(ADD1)
            b = h2[:n] ^ (_turn(k2 * _u(C2), 33) * _u(C1))
            b = (_turn(b, 31) + a) * _u(5) + _u(ADD2)
            h1[:n], h2[:n] = a, b
        tails = np.frombuffer(b"".join(d[len(d) // 16 * 16 :].ljust(16, b"\0") for d in data), "<u8").reshape(-1, 2)
        h2 ^= _turn(tails[:, 1] * _u(C2), 33) * _u(C1)
        h1 ^= _turn(tails[:, 0] * _u(C1), 31) * _u(C2)
        length = sizes.astype(np.uint64)
        h1, h2 = h1 ^ length, h2 ^ length
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _last_mix(h1), _last_mix(h2)
        h1 = h1 + h2
        h2 = h2 + h1
    out = [""] * len(values)
    for i, a, b in zip(order, h1.tolist(), h2.tolist(), strict=True):
        out[i] = f"{a:016x}{b:016x}"
    return out


def digests(method: str, values: list[bytes]) -> list[str]:
    if method == "murmur3":
        return murmur3(values)
    if method == "blake2":
        return [hashlib.blake2b(v, digest_size=16).hexdigest() for v in values]
    if method == "md5":
        return [hashlib.md5(v, usedforsecurity=False).hexdigest() for v in values]
    raise ValueError(f"unknown hash method {method!r}; known: {', '.join(METHODS)}")
