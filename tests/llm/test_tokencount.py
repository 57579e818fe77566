import random

import public_tokenizers as P
import pytest

from cairn.llm import tokencount as T


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(P.path(T.TOKENIZER)).encode_batch(texts, add_special_tokens=False)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, version string")


def count(spark, df, cache, name=T.TOKENIZER):
    return {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in T.count_tokens(df, P.path(name), cache).collect()}


def test_counts_and_cache(spark, tmp_path):
    rng = random.Random(2)
    parts = ["'s", "'re", " ", "\n", "\t", "é", "ab", "THE", "12", "%%%", "日本", "　", "\xa0", "\x1c", "\x85", "́", "Σ", "<|endoftext|>", "<|startoftext|>", "<|end", "İ"]
    texts = [None, "", "   ", "a", "a  b", "a\nb", "word " * 3000, *["".join(rng.choice(parts) for _ in range(15)) for _ in range(400)]]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(7, texts[7], "x", "y"), (None, "other text", "x", "y"), (None, "and one more", "x", "y")]
    cache = str(tmp_path / "cache")
    got = count(spark, frame(spark, rows), cache)
    for i, t, *_ in rows:
        want = library([t or ""])[0]
        assert got[i, len((t or "").encode())] == (want, want > 2048)
    stored = spark.read.parquet(cache).count()
    assert stored == spark.read.parquet(cache).select("digest").distinct().count() < len(rows)  # white space folds together
    # known content is not encoded again, new content is appended
    count(spark, frame(spark, rows), cache)
    assert spark.read.parquet(cache).count() == stored
    count(spark, frame(spark, [*rows, (9999, "a text not seen before", "", "")]), cache)
    assert spark.read.parquet(cache).count() == stored + 1


def test_cache_is_used(spark, tmp_path):
    cache, df = str(tmp_path / "cache"), frame(spark, [(1, "hello there", "", "")])
    count(spark, df, cache)
    wrong = spark.read.parquet(cache).selectExpr("version", "digest", "n_tokens + 100 as n_tokens").collect()
    spark.createDataFrame(wrong, T.CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache)
    assert count(spark, df, cache)[1, 11][0] > 100
    # another tokenizer's counts are not this one's
    assert count(spark, df, cache, "byte_bpe_50k.json")[1, 11][0] == 2


def test_piece_model(spark, tmp_path):
    import sentencepiece

    text = "Some text,  with  spaces"
    want = len(sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(text))
    assert count(spark, frame(spark, [(1, text, "", "")]), str(tmp_path / "cache"), "piece_bpe_32k.model")[1, len(text)][0] == want


def test_tables_share_one_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    spark.conf.set(T.CACHE_SETTING, cache)
    try:
        """What one table brought is no miss in another: only its new content is appended."""
        schema = "doc_id long, text string"
        for name, rows in (("a", [(1, "shared text"), (2, "only here")]), ("b", [(9, "shared  text"), (8, "new there")])):
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        stored = lambda: spark.read.parquet(cache).count()
        T.op8(spark, str(tmp_path / "a")).collect()
        before = stored()
        got = {r["doc_id"]: r["n_tokens"] for r in T.op8(spark, str(tmp_path / "b")).collect()}
        assert stored() == before + 1 and [got[9], got[8]] == library(["shared  text", "new there"])
    finally:
        spark.conf.unset(T.CACHE_SETTING)
    T.op8(spark, str(tmp_path / "a")).collect()
    assert stored() == before + 1  # without the setting a call has a cache of its own


def test_very_long_texts(spark, tmp_path):
    texts = ["word " * 400_000, "x" * 300_000, "\n" * 500_000]
    got = count(spark, frame(spark, [(i, t, "", "") for i, t in enumerate(texts)]), str(tmp_path / "cache"))
    assert [got[i, len(t)][0] for i, t in enumerate(texts)] == library(texts)


def test_empty_table(spark, tmp_path):
    assert count(spark, frame(spark, []), str(tmp_path / "cache")) == {}


def test_whole_table(spark, data_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, library([texts[i] for i in ids]), strict=True))
    for _ in range(2):
        got = T.op8(spark, data_dir).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(ids)


@pytest.mark.parametrize("bound", [2, 50])
def test_a_full_memo_changes_nothing(monkeypatch, bound):
    monkeypatch.setattr(T, "MEMO_WORDS", bound)
    texts = ["one two three", "two three four five six", "one one one", "x" * 100 + " " + "x" * 100]
    counter = T.Counter(P.path(T.TOKENIZER))
    assert [counter.counts([t])[0] for t in texts] == library(texts)
