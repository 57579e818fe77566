import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cairn.llm import suffixes as S


def plain(texts, length):
    """(bytes, removed, spans, digest of the rest) of each text, by counting all strings of the length."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def got(spark, texts, length=200):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, anchor string, start int")
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.dedup_suffixes(df, length).collect()}
    return [rows[i] for i in range(len(texts))]


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(150):
        text = np.array([rng.randint(1, letters) for _ in range(rng.randint(1, 70))])
        assert S.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    big = np.random.default_rng(1).integers(1, 1 << 40, 3000)
    assert S.suffix_array(np.concatenate([big, big])).tolist()[:2] == sorted(range(6000), key=lambda i: np.concatenate([big, big])[i:].tolist())[:2]


def test_repeated_starts():
    found = S.repeated_starts([b"abcdefgh", b"xxcdefxx", b"cde", b"aaaaa"], 4)
    assert [f.tolist() for f in found] == [[2], [2], [], [0, 1]]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(8)
    passage, line = words(rng, 60), words(rng, 45)
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "d" * 1000, "ab" * 400, "xyz " * 300, line[:150]]
    texts += [words(rng, 100) + passage + words(rng, 80) for _ in range(12)]
    texts += [passage, passage[20:], line + "\n" + line, words(rng, 30) + line[3:230] + words(rng, 30), line[:199], line[:200], line[1:201]]
    base = words(rng, 150)
    texts += [base, base, base[:400] + "!" + base[400:], base[:250] + base[300:], base[100:] + base[:100], base.upper()]
    texts += [words(rng, 20) + base[k : k + 200 + k % 3] + words(rng, 20) for k in range(0, 60, 7)]
    return texts


def test_against_counting(spark):
    assert got(spark, corpus()) == plain(corpus(), 200)


def test_contents_of_a_fixed_polynomial_hash_differ(spark):
    """Strings that collide under any polynomial modulo 2 ** 64 are no repeats; a long text is cut at all its places."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(3)
    other, edge = word.translate(str.maketrans("ab", "ba")), words(rng, 40)
    texts = [edge + word, words(rng, 40) + other, words(rng, 20_000) + edge + words(rng, 20_000)]
    assert got(spark, texts) == plain(texts, 200)


def test_groups_of_very_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "LARGE", 3)
    assert got(spark, corpus()) == plain(corpus(), 200)


def test_sorts_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "SORT_BYTES", 500)
    assert got(spark, corpus()) == plain(corpus(), 200)


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(9)
    text = words(rng, 80)
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, text), (1, text), (None, words(rng, 80)), (None, None)], schema)
    rows = sorted(((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in S.dedup_suffixes(df).collect()))
    assert rows == [(0, 0, 0), (0, 0, 0), (1, len(text.encode()), 1), (1, len(text.encode()), 1)]
    assert S.dedup_suffixes(spark.createDataFrame([], schema)).count() == 0


def test_whole_table(spark, data_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect())
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op1(spark, data_dir).collect()}
    assert [rows[i] for i, _ in docs] == plain([t for _, t in docs], 200)


def test_evidence_adds_up(spark):
    from cairn.llm.measure import EVIDENCE, decided_repeats

    texts = list(dict.fromkeys(t for t in corpus() if t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sums = decided_repeats(df)
    assert sum(sums[k] for k in EVIDENCE) == sum(r[1] for r in plain(texts, 200))
    assert sums["sort"] > 0 and sums["counts"] == 0 and sums["open_pieces"] > 0
