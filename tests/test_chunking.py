import random

import numpy as np
import pytest

from cairn.functions.hashes import digests
from cairn.operators import chunking as C


def generated(size: int, seed: int = 0) -> bytes:
    values, out = C.lcg(seed), bytearray()
    while len(out) < size:
        out += (next(values) & 0xFFFFFFFF).to_bytes(4, "big")
    return bytes(out)


def sizes(ends):
    return np.diff([0, *ends]).tolist()


# Published cut lists of the generated data, 8192 on average, seed 0.
CUTS = {
    "fixed": [8192] * 16 + [0],
    "ae": [7979, 8046, 7979, 8192, 8192, 8192, 7965, 8158, 8404, 8241, 8011, 8302, 8120, 8335, 8192, 8192, 572],
    "rabin": [8604, 4190, 32769, 3680, 26732, 3152, 9947, 6487, 25439, 3944, 6128],
    "fastcdc": [8712, 8018, 2847, 9157, 8997, 8581, 8867, 5422, 5412, 9478, 11553, 9206, 4606, 8529, 3821, 11342, 6524],
}


@pytest.mark.parametrize("method", CUTS)
def test_cut_lists(method):
    assert sizes(C.ENDS[method](generated(128 * 1024), 8192, 0)) == CUTS[method]


@pytest.mark.parametrize("method", CUTS)
@pytest.mark.parametrize("kib", [1, 4, 16, 64])
def test_counts_are_near_the_average(method, kib):
    data = generated(1 << 21)
    expected = len(data) / (kib * 1024)
    ends = C.ENDS[method](data, kib * 1024, 0)
    assert expected / 4 <= len(ends) <= expected * 4 + 1
    assert ends[-1] == len(data) and all(a <= b for a, b in zip(ends, ends[1:], strict=False))


def plain_fastcdc(data, average, seed):
    gear, (before, after) = [int(x) for x in C._gear(seed)], C._masks(average, seed)
    ends, start = [], 0
    while True:
        h, cut = 0, None
        for i in range(start + average // 4, min(len(data), start + average * 8)):
            h = (h * 2 + gear[data[i]]) % (1 << 64)
            if h & (before if i < start + average else after) == 0:
                cut = i + 1
                break
        if cut is None and len(data) - start >= average * 8:
            cut = start + average * 8
        if cut is None:
            return [*ends, len(data)]
        ends.append(cut)
        start = cut


def plain_rabin(data, average, seed):
    window, mask = average // 4 - 1, C.power_of_two(average) - 1
    ends, start = [], 0
    while True:
        cut = None
        for i in range(start, len(data)):
            if i - start >= average * 4:
                cut = i + 1
                break
            if i - start >= average // 4:
                h = 0
                for b in data[i - window + 1 : i + 1]:
                    h = (h * C.RABIN_MULTIPLIER + b) % (1 << 32)
                if (h ^ seed) & mask == 0:
                    cut = i + 1
                    break
        if cut is None:
            return [*ends, len(data)]
        ends.append(cut)
        start = cut


def plain_ae(data, average):
    ends, start = [], 0
    while True:
        top, value, cut = start, 0, None
        for i in range(start, len(data)):
            if data[i] > value:
                value, top = data[i], i
            elif i == top + average - 256:
                cut = i + 1
                break
        if cut is None:
            return [*ends, len(data)]
        ends.append(cut)
        start = cut


def edge_cases():
    rng = random.Random(5)
    yield from (b"\0" * 5000, b"\xff" * 5000, b"x", b"ab" * 2500)
    for n in (1, 63, 64, 65, 127, 128, 129, 512, 513, 4096, 6000):
        yield rng.randbytes(n)
        yield bytes(rng.choice(b"abc \n") for _ in range(n))


def test_against_plain_loops():
    for data in edge_cases():
        for average, seed in ((64, 0), (256, 12345)):
            assert C.fastcdc_ends(data, average, seed) == plain_fastcdc(data, average, seed)
        assert C.rabin_ends(data, 64, 0) == plain_rabin(data, 64, 0)
        assert C.rabin_ends(data, 64, 77) == plain_rabin(data, 64, 77)
        assert C.ae_ends(data, 512) == plain_ae(data, 512)


def test_hash_vectors():
    assert digests("blake2", [b"abc"]) == ["cf4ab791c62b8d2b2109c90275287816"]
    assert digests("murmur3", [b"123"]) == [f"{10978418110857903978:016x}{4791445053355511657:016x}"]
    with pytest.raises(ValueError):
        digests("none", [b""])


def test_many_hashes_equal_single_ones():
    rng = random.Random(1)
    values = [rng.randbytes(n) for n in [*range(40), 1000, 15, 16, 17]]
    assert digests("murmur3", values) == [digests("murmur3", [v])[0] for v in values]


@pytest.mark.parametrize("method", CUTS)
def test_chunks_of_rows(spark, method):
    data = [(1, generated(5000)), (2, b""), (3, None), (4, b"short"), (5, generated(5000))]
    df = spark.createDataFrame(data, "id int, data binary")
    rows = C.content_chunks(df, "data", method, 1024, ["id"], with_data=True).collect()
    for i, content in data:
        own = sorted((r for r in rows if r["id"] == i), key=lambda r: r["ord"])
        assert b"".join(bytes(r["data"]) for r in own) == (content or b"")
        assert bool(own) == bool(content)
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["len"] for r in own)])[:-1].tolist()
    if method == "fixed":
        native = C.fixed_chunks(df, "data", 1024, ["id"]).collect()
        assert sorted(map(tuple, native)) == sorted((r["id"], r["ord"], r["offset"], r["len"], r["hash"]) for r in rows)
