from math import comb

import pytest
from pyspark.sql import functions as F

from cairn.llm import sharding as S
from cairn.llm.common import text_or_empty


def test_draws_follow_the_law(spark):
    n = 20000
    cases = [(50, 20, 12), (10, 10, 3), (7, 0, 3), (9, 4, 0), (9, 4, 9), (1, 1, 1), (2000, 1990, 1500)]
    for total, marked, drawn in cases:
        x = S.hypergeometric(str(total), str(marked), str(drawn), f"(id + 0.5D) / {n}")
        for k, c in spark.range(n).selectExpr(f"{x} AS x").groupBy("x").count().collect():
            assert abs(c / n - comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn)) < 2 / n


def test_large_draws_stay_near_the_mean(spark):
    x = S.hypergeometric("1000000000", "62500000", "500000000", "(id + 0.5D) / 200")
    row = spark.range(200).selectExpr(f"{x} AS x").agg(F.avg("x"), F.stddev("x"), F.count_distinct("x")).first()
    deviation = (5e8 * 0.0625 * 0.9375 * 0.5) ** 0.5
    assert abs(row[0] - 31250000) < deviation / 10 and 0.9 < row[1] / deviation < 1.1 and row[2] == 200


def test_matrix_has_exact_sums(spark):
    counts = spark.createDataFrame([(b, n) for b, n in ((0, 5), (3, 100), (15, 1), (16, 40), (255, 7))], "block long, n long")
    rows = {r["block"]: r["row"] for r in S.communication_matrix(counts, 2, 16, 3).collect()}
    for b, n in ((0, 5), (3, 100), (15, 1), (16, 40), (255, 7)):
        assert sum(rows[b]) == n and min(rows[b]) >= 0
    assert [sum(r[s] for r in rows.values()) for s in range(16)] == [10] * 9 + [9] * 7


@pytest.mark.parametrize("n", [0, 1, 15, 500])
def test_shards(spark, n):
    docs = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("kept").alias("block"))
    docs = docs.union(docs.limit(n // 5)) if n else docs
    key = docs.select("doc_id", F.crc32(text_or_empty().cast("binary")).alias("c"), "block")
    rows = S.shuffle_to_shards(key, ["doc_id", "c"]).collect()
    total = n + n // 5
    assert len(rows) == total
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    again = S.shuffle_to_shards(key.repartition(3), ["doc_id", "c"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_order_is_shuffled(spark):
    key = spark.range(3000).select(F.col("id").alias("doc_id"))
    rows = S.shuffle_to_shards(key, ["doc_id"]).collect()
    # neighbours in a shard are no longer neighbours in id, and shards hold all parts of the table alike
    first = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(abs(a - b) < 10 for a, b in zip(first, first[1:], strict=False)) < 60
    for s in range(16):
        low = sum(r["doc_id"] < 1500 for r in rows if r["shard"] == s)
        assert 60 < low < 128


def test_copies_part_like_other_rows(spark):
    """Copies of one row spread over all shards, and over all of each, whichever task holds them."""
    key = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("_block"), F.lit(2).alias("n"))
    rows = S.shuffle_to_shards(key, ["doc_id", "_block"]).collect()
    assert len(rows) == 4000 and set(rows[0].asDict()) == {"doc_id", "shard", "slot", "_block", "n"}
    for s in range(16):
        own = sorted((r["slot"], r["doc_id"] == 7) for r in rows if r["shard"] == s)
        assert [x[0] for x in own] == list(range(250))
        copies = [x[1] for x in own]
        assert 160 < sum(copies) < 215  # 187.5 on average, 6.6 of deviation
        runs = 1 + sum(a != b for a, b in zip(copies, copies[1:], strict=False))
        assert 65 < runs < 130  # 94 on average
        assert 80 < sum(copies[:125]) < 108


def test_every_shard_is_equally_likely(spark):
    """The first hundred rows over many seeds: shards and slots by the law of a uniform shuffle."""
    key = spark.range(320).select(F.lit(5).alias("doc_id"), (F.col("id") < 50).alias("marked"))
    counts, low = [0] * 16, 0
    for seed in range(6):
        for r in S.shuffle_to_shards(key, ["doc_id", "marked"], seed=100 * seed).where("marked").collect():
            counts[r["shard"]] += 1
            low += r["slot"] < 10
    assert sum((c - 300 / 16) ** 2 / (300 / 16) for c in counts) < 38  # chi squared, 15 degrees: 1 in 1000
    assert 115 < low < 185


def test_long_texts_and_whole_table(spark, data_dir, tmp_path):
    """Sizes, digests and laws of the whole table, and of a text of several MB, against plain Python."""
    import zlib

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()] + [(None, None), (900001, "é" * 3_000_000), (900001, "é" * 3_000_000), (900002, "")]
    spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, slot string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = S.op2(spark, str(tmp_path)).collect()
    raw = [(i, (t or "").encode()) for i, t in docs]
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len(b) + 1, zlib.crc32(b)) for i, b in raw)
    shards = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)]
    assert all(x == list(range(len(x))) for x in shards) and max(map(len, shards)) - min(map(len, shards)) <= 1
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
