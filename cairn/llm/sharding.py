"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, read_table, running_offset, running_total, text_or_empty

SHARDS = 16
FAN = 16
ROWS_PER_BLOCK = 16_384


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked ones among ``drawn`` of ``total`` of which ``marked`` are marked, by inversion of ``u`` in (0, 1).

    Values are taken from the mode outwards, up and down in turn. Weights relative to the mode's follow by ratios of
    neighbours, a first fold sums them, a second takes them from u times the sum until it is used up. 10 standard
    deviations and 30 values on each side hold all but less than 1e-20 of the law.
    """
    up = "a.up * (d.k - m - i + 1) * (d.n - m - i + 1) / ((m + i) * (d.t - d.k - d.n + m + i))"
    down = "a.down * (m - i + 1) * (d.t - d.k - d.n + m - i + 1) / ((d.k - m + i) * (d.n - m + i))"
    steps = "sequence(1L, 30L + cast(10 * sqrt(d.n * (d.k / greatest(d.t, 1)) * (1 - d.k / greatest(d.t, 1)) * (d.t - d.n) / greatest(d.t - 1, 1)) as bigint))"
    weigh = f"aggregate(w, named_struct('up', 1D, 'down', 1D, 'sum', 1D), (a, i) -> {_let(f"named_struct('up', {up}, 'down', {down})", 'b', "named_struct('up', b.up, 'down', b.down, 'sum', a.sum + b.up + b.down)")}, a -> a.sum)"
    both = f"named_struct('up', {up}, 'down', {down})"
    after = "named_struct('up', b.up, 'down', b.down, 'left', a.left - b.up - b.down, 'x', case when a.x is not null then a.x when a.left < b.up then m + i when a.left < b.up + b.down then m - i end)"
    take = f"aggregate(w, named_struct('up', 1D, 'down', 1D, 'left', d.u * z - 1, 'x', case when d.u * z < 1 then m end), (a, i) -> {_let(both, 'b', after)}, a -> cast(coalesce(a.x, m) as bigint))"
    given = f"named_struct('t', double({total}), 'k', double({marked}), 'n', double({drawn}), 'u', {u})"
    return _let(given, "d", _let("double(floor((d.n + 1) * (d.k + 1) / (d.t + 2)))", "m", _let(steps, "w", _let(weigh, "z", take))))


def communication_rows(children: str, shards: str, seed: int, node: str) -> str:
    """SQL for the rows of the matrix of one node: for each child block its rows for each shard.

    ``children`` and ``shards`` are arrays of counts with equal sums. Child by child and shard by shard, the count is
    hypergeometric in what is left of both.
    """
    u = f"(pmod(xxhash64({seed}, {node}, size(c.rows), size(r.row)), 4503599627370496) + 0.5D) / 4503599627370496D"
    x = hypergeometric("r.total", "k", "r.open", u)
    row = (
        "aggregate(c.left, named_struct('total', aggregate(c.left, 0L, (s, v) -> s + v), 'open', n, 'row', cast(array() as array<bigint>)), "
        f"(r, k) -> {_let(x, 'x', "named_struct('total', r.total - k, 'open', r.open - x, 'row', concat(r.row, array(x)))")}, r -> r.row)"
    )
    left = "zip_with(c.left, row, (p, q) -> p - q)"
    return (
        f"aggregate({children}, named_struct('left', {shards}, 'rows', cast(array() as array<array<bigint>>)), "
        f"(c, n) -> {_let(row, 'row', f"named_struct('left', {left}, 'rows', concat(c.rows, array(row)))")}, c -> c.rows)"
    )


def communication_matrix(counts: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """``counts`` is (block, n) for blocks 0 to FAN ** levels - 1; returns (block, row), row[s] being the block's rows for shard s.

    The blocks are the leaves of a tree of FAN children a node; every level splits its nodes' counts among their
    children at once, so a level is one parallel step, and no draw waits for a chain of blocks.
    """
    spark, total = counts.sparkSession, counts.agg(F.sum("n")).first()[0] or 0
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    nodes = spark.range(1).select(F.col("id").alias("node"), F.array(*(F.lit(s).cast("long") for s in sizes)).alias("row"))
    for level in range(levels):
        child = F.expr(f"shiftright(block, {4 * (levels - level - 1)})")
        parts = counts.groupBy(F.shiftright(child, 4).alias("node")).agg(F.array(*(F.sum(F.when(child.bitwiseAND(FAN - 1) == c, F.col("n")).otherwise(0)) for c in range(FAN))).alias("parts"))
        split = F.expr(communication_rows("parts", "row", seed + level, "node"))
        nodes = materialize(nodes.join(parts, "node").select("node", F.posexplode(split).alias("child", "row")).select((F.col("node") * FAN + F.col("child")).alias("node"), "row"), "sharding-matrix")
    return nodes.withColumnRenamed("node", "block")


def numbered_copies(docs: DataFrame, key: list[str], seed: int) -> DataFrame:
    """(doc, _a, _b, _copy): each row whole, 128 bits of hash of its ``key``, and its number among the rows of an equal key.

    Rows are sorted to ranges and counted there, so rows of one key are numbered by as many tasks as they need. Which of
    them has which number doesn't matter: a key tells all that is asked of a row.
    """
    order = [F.col(c) for c in key]
    named = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.lit(seed), *order).alias("_a"), F.xxhash64(F.lit(seed + 1), *reversed(order)).alias("_b"), F.monotonically_increasing_id().alias("_n"))
    # written, so that a row has one number whoever reads it
    return running_total(materialize(named, "sharding-rows"), ["_a", "_b"], ["_n"], F.lit(1).cast("long"), "_copy").drop("_n")


def shuffle_to_shards(docs: DataFrame, key: list[str], shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to every row of ``docs``.

    The law is `rows`: shards' counts are at most one apart, and every order is equally likely up to the hashes'
    quality. (1) Rows of equal ``key`` are numbered, so that copies part like other rows. Rows fall into blocks by a hash
    of key and number; blocks are counted. (2) The matrix of how many rows each block sends to each shard is drawn
    exactly. (3) Each block is permuted and cut by its row of the matrix, (4) shards are permuted again, by ranges of a
    second hash, so that no task orders a shard. Rows equal in ``key`` may swap places. Nulls are values like others.
    Columns ``shard`` and ``slot`` of ``docs`` are replaced, other names can't clash. An empty table gives an empty result.
    """
    numbered = materialize(numbered_copies(docs, key, seed), "sharding-numbered")
    total = numbered.count()
    levels = 1
    while FAN**levels * ROWS_PER_BLOCK < total:
        levels += 1
    own = [F.col(c) for c in ("_a", "_b", "_copy")]
    rows = numbered.withColumns({"_block": F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(FAN**levels)), "_mark": F.xxhash64(F.lit(seed + 1), *own), "_mark2": F.xxhash64(F.lit(seed + 2), *own)})
    matrix = communication_matrix(rows.groupBy(F.col("_block").alias("block")).agg(F.count(F.lit(1)).alias("n")), levels, shards, seed)
    matrix = matrix.select(F.col("block").alias("_block"), F.expr("transform(row, (v, i) -> aggregate(slice(row, 1, i + 1), 0L, (s, x) -> s + x))").alias("_until"))
    local = Window.partitionBy("_block").orderBy("_mark", *own)
    dealt = rows.withColumn("_rank", F.row_number().over(local)).join(matrix, "_block")
    dealt = dealt.withColumn("shard", F.expr("size(filter(_until, v -> v < _rank))").cast("int")).drop("_block", "_mark", "_rank", "_until")
    ranges = max(1, -(-total // (shards * ROWS_PER_BLOCK)))
    width = -(-(1 << 62) // ranges)
    dealt = materialize(dealt.withColumn("_range", F.floor(F.shiftrightunsigned("_mark2", 2) / F.lit(width)).cast("int")), "sharding")
    before = running_offset(dealt.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n")), ["shard"], ["_range"], "n", "_before").drop("n")
    again = Window.partitionBy("shard", "_range").orderBy("_mark2", *own)
    slots = dealt.join(before, ["shard", "_range"]).withColumn("slot", F.col("_before") + F.row_number().over(again) - 1)
    return slots.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle_to_shards(docs, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
