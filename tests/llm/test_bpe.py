import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cairn.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(P.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in codec.bytes_of.items()}, special_tokens={})


def ids(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def test_perfect_hash_is_minimal_and_knows_its_keys(codec):
    h = codec.whole
    assert sorted(h.order) == list(range(h.n)) and len(h.keys) == h.n == len(codec.ids)
    for i, key in enumerate(codec.bytes_of[i] for i in codec.ids[:5000]):
        assert h.get(key) == i
    assert h.get(b"surely not a token, this") == -1 and bpe.PerfectHash([b"one"]).get(b"one") == 0


def test_equal_to_the_library(codec, library):
    rng = random.Random(2)
    parts = ["'s", "'re", " ", "\n", "\t", "é", "ab", "THE", "1", "%%%", "日本", "　", "\x1c", "\x85", "\xa0", "ing", "xqz", "👍🏽", "́", "<|endoftext|>"]
    texts = ["", " ", "a", "aaaa" * 300, "=" * 700, "ÿ" * 200] + ["".join(rng.choice(parts) for _ in range(40)) for _ in range(500)]
    for t in texts:
        assert ids(codec, t) == library.encode_ordinary(t)
        assert codec.decode(b"".join(codec.encode(t))) == t.encode()


def test_long_texts_go_in_slices(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 100)
    text = "some words, and more of them " * 200
    assert len(list(codec.encode(text))) > 10 and ids(codec, text) == library.encode_ordinary(text)


def test_a_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    codec = bpe.Codec.load(P.path(bpe.VOCABULARY))
    text = "thedin whable oration stnded thedin whable"
    assert ids(codec, text) == library.encode_ordinary(text) and len(codec.memo) <= 3


def test_rows(spark, library):
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "Hello wörld", "x"), (5, "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(df, P.path(bpe.VOCABULARY), with_ids=True).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        want = library.encode_ordinary(text or "")
        r = by_id[i]
        assert (r["n_tokens"], r["ids"]) == (len(want), want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), P.path(bpe.VOCABULARY)).count() == 0


def test_whole_table(spark, data_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = bpe.op6(spark, data_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]])) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
