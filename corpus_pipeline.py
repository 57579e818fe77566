"""A corpus pipeline over ``documents``: each stage calls one operator and returns what it keeps.

Every stage but the last returns the columns of ``documents``. A row is known by its id and text together, so rows that
share an id don't share a verdict.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe import VOCABULARY, encode_decode
from cairn.llm.common import keyed, materialize, row_hashes, text_or_empty
from cairn.llm.jaccard import jaccard_groups
from cairn.llm.mixing import mix_sources, with_sizes
from cairn.llm.quality import quality_rules
from cairn.llm.suffixes import repeated_bytes


def _by_row(docs: DataFrame) -> DataFrame:
    """What operators read, with the row (its id and hashes, in the order of ids) in place of doc_id."""
    return docs.select(F.struct("doc_id", *row_hashes()).alias("doc_id"), "text", "source")


def _on_row(docs: DataFrame, other: DataFrame, how: str, repeated: bool = False) -> DataFrame:
    """``docs``, each row whole in ``doc`` so that no other column's name can clash, joined with ``other``, keyed by row as ``of``.

    With ``repeated``, equal rows become one before.
    """
    rows = docs.select(F.struct("*").alias("doc"), *row_hashes())
    if repeated:
        rows = rows.dropDuplicates(["u", "v"])
    of = other.select(F.col("of.u").alias("u"), F.col("of.v").alias("v"), *[c for c in other.columns if c != "of"])
    return rows.join(of.hint("shuffle_hash"), ["u", "v"], how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their hosts reject go."""
    verdicts = quality_rules(_by_row(docs)).where("kept").select(F.col("doc_id").alias("of")).distinct()
    return _on_row(docs, verdicts, "left_semi").select("doc.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id; of equal rows one."""
    groups = jaccard_groups(_by_row(docs))
    kept = materialize(groups.where("class_id = doc_id").groupBy(F.col("doc_id").alias("of")).agg(F.count(F.lit(1)).alias("n")), "pipeline-kept")
    repeated = bool(kept.where("n > 1").limit(1).count())
    return _on_row(docs, kept.select("of"), "left_semi", repeated).select("doc.*")


def suffixes_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that stand elsewhere too go from the texts; what is left of a cut character goes too."""
    texts = keyed(docs.select("doc_id", "text")).select("u", "v", text_or_empty().alias("text"))
    cut = repeated_bytes(texts).groupBy("u", "v").agg(F.first("kept").alias("kept"))
    cut = materialize(cut.select(F.struct("u", "v").alias("of"), F.col("kept").alias("rest")), "pipeline-cut")
    changed = {"text": F.coalesce("rest", "doc.text"), "n_chars": F.when(F.col("rest").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("rest")).cast(docs.schema["n_chars"].dataType)}
    return _on_row(docs, cut, "left").select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mix_sources(with_sizes(_by_row(docs)))
    copies = materialize(mixed.groupBy(F.col("doc_id").alias("of")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")), "pipeline-copies")
    repeated = bool(copies.where("n > 1").limit(1).count())
    taken = copies.where("copies > 0").select("of", "copies")
    return _on_row(docs, taken, "inner", repeated).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("doc.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the digests of the ids and of the bytes decoded from them."""
    return encode_decode(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("suffix_array_dedup", suffixes_stage),
    ("mixing_to_target_weights", mixing_stage),
    ("byte_level_bpe", encoding_stage),
]
#: Chosen paths, suffix sorting and BPE merges are not for SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
