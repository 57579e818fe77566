import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing as M


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def corpus(seed, n=600):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["b", "c", "é", "Z", "d", None]
    return [(i, rng.choice(sources), rng.choice([0, 1, 3, 50, rng.randint(1, 400), int(rng.lognormvariate(4, 1.5))])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_rates_and_copies(spark, seed):
    rows = corpus(seed)
    out = {r["doc_id"]: r for r in M.mix_sources(frame(spark, rows)).collect()}
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes)
    for source in sizes:
        own = [out[i] for i, s, _ in rows if s == source]
        assert all(r["source_size"] == sizes[source] and math.isclose(r["target"], target[source], rel_tol=1e-9, abs_tol=1e-9) for r in own)
        # rates meet the target, and are an exponential in the size up to the cap: log(rate) / size is one number
        assert abs(sum(r["rate"] * r["size"] for r in own) - target[source]) <= 1e-5 * target[source] + 1e-3
        tilts = [math.log(r["rate"]) / r["size"] for r in own if r["size"] and 1e-6 < r["rate"] < 2]
        assert not tilts or max(tilts) - min(tilts) < 1e-6
        assert abs(sum(r["taken"] for r in own) - target[source]) <= max(r["size"] for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in own)
        assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in own)


def test_reruns_agree(spark):
    rows = corpus(5)
    first = sorted(map(str, M.mix_sources(frame(spark, rows)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first == sorted(map(str, M.mix_sources(frame(spark, rows[::-1]).repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string, size string, n string"
    assert M.mix_sources(M.with_sizes(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, None, "a", "x", "y"), (2, "", None, "x", "y"), (None, "one two", None, "x", "y"), (3, "a\tb\nc\x0bd\x0ce\rf　g", "a", "x", "y"), (3, "a\tb\nc\x0bd\x0ce\rf　g", "a", "x", "y")]
    out = M.mix_sources(M.with_sizes(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == [(0, 2), (1, 0), (2, 0), (3, 6), (3, 6)]
    assert all(r["taken"] <= 2 * r["size"] for r in out)


def test_one_source_and_equal_sizes(spark):
    out = M.mix_sources(frame(spark, [(i, "a", 10) for i in range(100)])).collect()
    assert {r["target"] for r in out} == {1500.0} and sum(r["taken"] for r in out) == 1500


def test_whole_table(spark, data_dir):
    rows = M.op5(spark, data_dir).collect()
    n = spark.read.parquet(f"{data_dir}/documents.parquet").agg(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", "[ \t\n\x0b\f\r]+", " ")), " ")))).first()[0]
    assert sum(r["size"] for r in rows) == n and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * n) < 0.05 * n
