"""Token counts kept by digest: equal content is encoded once, for all runs that share a cache."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, read_table, scratch_root, text_or_empty

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Words whose counts a worker remembers, some 40 MB, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 250_000, 64
CACHE_SETTING = "spark.cairn.tokenCache"
CACHE_SCHEMA = "version string, digest string, n_tokens bigint"
#: What the tokenizer's own normaliser makes one space; splitting or joining there cannot change a count.
SPACES = "[ \\t\\n\\r]+"


def version_digest(path: str) -> str:
    """What a stored count depends on besides the content: the tokenizer's file, its library's version, the folding of white space."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {importlib.metadata.version(library)} {SPACES if splits_at_spaces(path) else ''}\n".encode() + f.read()).hexdigest()


def splits_at_spaces(path: str) -> bool:
    """Whether counts add up over the words between spaces: white space is folded by the normaliser and never reaches a token."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    folds = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in (spec.get("normalizer") or {}).get("normalizers", []))
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return folds and drops and not any(" " in t["content"] for t in spec.get("added_tokens", []))


class Counter:
    """Counts tokens by the library that the file is for; words already counted are remembered within a bound."""

    def __init__(self, path: str):
        self.by_word, self.memo = splits_at_spaces(path), {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.encode = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        memo, out = self.memo, []
        for text in texts:
            words = text.split(" ")
            if new := [w for w in set(words) if w not in memo]:
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    new = list(set(words))
                memo.update(zip(new, self.encode(new), strict=True))
            out.append(sum(map(memo.__getitem__, words)))
            for w in new:
                if len(w) > MEMO_CHARS:
                    del memo[w]
        return out


_COUNTERS: dict[str, Counter] = {}


def _count_batches(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if version not in _COUNTERS:
            _COUNTERS[version] = Counter(path)
        counter = _COUNTERS[version]
        for batch in batches:
            counts = [counter.counts([t.as_py()])[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a table (version, digest) -> n_tokens, a folder a version, that runs over any tables share and append
    to; ``version`` is :func:`version_digest`, ``digest`` that of the content with its white space folded as the tokenizer itself folds it. Only
    one row of each digest that the cache lacks is encoded. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows repeat, an empty table gives an empty result, other columns are not read. A job that dies before its append
    leaves the cache as it was; two runs that append the same digest agree, and a digest read twice counts once.
    """
    spark, version = docs.sparkSession, version_digest(path)
    text = text_or_empty()
    folded = F.regexp_replace(text, SPACES, " ") if splits_at_spaces(path) else text
    digest = F.sha2(folded.cast("binary"), 256)
    keyed = materialize(docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), digest.alias("digest")), "tokencount-keys")
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    known = known.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # one document of each missing digest, chosen before any text moves: a digest of very many copies is one row by then
    missing = keyed.groupBy("digest").agg(F.min_by(F.struct("doc_id"), F.struct("doc_id")).alias("of")).join(known, "digest", "left_anti").select("digest", F.col("of.doc_id").alias("of"))
    texts = docs.select(F.col("doc_id").alias("id"), digest.alias("own"), folded.alias("text"))
    found = texts.join(missing.hint("shuffle_hash"), (texts["own"] == missing["digest"]) & texts["id"].eqNullSafe(missing["of"])).select("digest", "text")
    fresh = found.mapInArrow(_count_batches(path, version), "digest string, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).join(keyed, "digest", "left_semi")
    # written, so that both sides of the join are plain exchanges, of which a digest of very many copies is split
    counts = materialize(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "tokencount-counts")
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder that the setting CACHE_SETTING names, for all tables and runs; unset, a new one, so a call then counts everything itself."""
    cache = spark.conf.get(CACHE_SETTING, None) or f"{scratch_root(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)
