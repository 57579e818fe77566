"""Dedup of chunks: new against known, savings, storage tiers, recipes and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.tables import running_total

INLINE_BYTES, DIRECT_CHUNKS = 100, 10
#: What a bundle's header and a chunk's place in its list take.
HEADER_BYTES, CHUNK_BYTES = 500, 20


def new_chunks(refs: DataFrame, index: DataFrame) -> DataFrame:
    """One row (hash, len) of every chunk that the index lacks."""
    return refs.groupBy("hash").agg(F.max("len").alias("len")).join(index.select("hash"), "hash", "left_anti")


def first_seen(refs: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Each distinct chunk with the columns ``keep`` of its first reference in ``order``: a minimum, so copies combine before they move."""
    place = F.struct(*order, *[c for c in keep if c not in order])
    return refs.groupBy("hash", "len").agg(F.min(place).alias("at")).select("hash", "len", *[F.col(f"at.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def savings(refs: DataFrame, by: list[str]) -> DataFrame:
    """Chunks and bytes of each group of ``by``, all and distinct, and the share saved."""
    each = refs.groupBy(*by, "hash").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"))
    out = each.groupBy(*by).agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("len")).alias("bytes"), F.sum("len").alias("unique_bytes"))
    return out.withColumn("saved", 1 - F.try_divide(F.col("unique_bytes").cast("double"), F.col("bytes").cast("double")))


def internal_ratio(refs: DataFrame) -> DataFrame:
    """Duplicate chunks and bytes by first sight, and their share."""
    each = refs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"))
    out = each.agg(F.sum(F.col("n") - 1).alias("dup_chunks"), F.sum((F.col("n") - 1) * F.col("len")).alias("dup_bytes"), F.sum(F.col("n") * F.col("len")).alias("bytes"))
    return out.withColumn("dup_share", F.try_divide(F.col("dup_bytes").cast("double"), F.col("bytes").cast("double")))


def storage_tier(size: Column, n_chunks: Column) -> Column:
    """How a file's content is kept: none, in the entry, as a list of chunks, or as a list kept in chunks itself."""
    return F.when(size <= 0, "none").when(size < INLINE_BYTES, "inline").when(n_chunks < DIRECT_CHUNKS, "direct").otherwise("indirect")


def unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``current`` with ``unchanged``: the previous snapshot has the path with equal mtime, type and size, so its chunks are taken over."""
    p = previous.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("type").alias("_type"), F.col("size").alias("_size"))
    same = F.col("_path").isNotNull() & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("type").eqNullSafe(F.col("_type")) & F.col("size").eqNullSafe(F.col("_size"))
    return current.join(p, F.col("path") == F.col("_path"), "left").withColumn("unchanged", same).drop("_path", "_mtime", "_type", "_size")


def pack(chunks: DataFrame, order: list[str], bundle_size: int, mode: list[str] | None = None) -> DataFrame:
    """Adds bundle_no and chunk_no: a bundle begins where the bytes before a chunk pass a multiple of the bundle size.

    A running total in ``order`` (within ``mode``), so chunks of files that stand together are stored together, and
    any number of tasks pack at once.
    """
    mode = mode or []
    placed = running_total(chunks, mode, order, F.col("len"), "before").withColumn("bundle_no", F.floor(F.col("before") / bundle_size).cast("long"))
    number = F.row_number().over(Window.partitionBy(*mode, "bundle_no").orderBy(*order)) - 1
    return placed.withColumn("chunk_no", number.cast("long")).drop("before")


def pack_greedy(chunks: DataFrame, order: list[str], bundle_size: int, mode: str) -> DataFrame:
    """Adds bundle_no as a single writer a mode would: a bundle closes at the estimated or at four times the raw size.

    Every close depends on the one before: a mode is one task. For exact parity only; :func:`pack` is the scalable way.
    """

    def run(frame):
        frame = frame.sort_values(order, ignore_index=True)
        numbers, number, raw, count = [], 0, 0, 0
        for size in frame["len"]:
            numbers.append(number)
            raw, count = raw + int(size), count + 1
            if raw + CHUNK_BYTES * count + HEADER_BYTES >= bundle_size or raw >= 4 * bundle_size:
                number, raw, count = number + 1, 0, 0
        return frame.assign(bundle_no=numbers)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", bundle_no bigint"
    return chunks.groupBy(mode).applyInPandas(run, schema)


def bundles(packed: DataFrame, encoded: Column | None = None) -> DataFrame:
    """One row a bundle: raw_size, encoded_size, chunk_count and the id, a digest of its chunk list in order."""
    encoded = F.col("len") * 3 / 5 if encoded is None else encoded
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "hash", "len"))), lambda c: F.concat(c["hash"], F.lit(":"), c["len"].cast("string"))), ",")
    return packed.groupBy("bundle_no").agg(F.sum("len").alias("raw_size"), F.sum(F.floor(encoded)).cast("long").alias("encoded_size"), F.count(F.lit(1)).alias("chunk_count"), F.md5(listed).alias("bundle_id"))


def fan_out(identity: Column, count: Column) -> Column:
    """The folder of a bundle file: two more hex digits a level while there are too many files for one folder."""
    levels = F.when(count < 100, 0).when(count / 250 < 100, 1).when(count / 62500 < 100, 2).otherwise(3)
    parts = F.transform(F.when(levels > 0, F.sequence(F.lit(0), levels - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(identity, i * 2 + 1, F.lit(2)))
    return F.array_join(F.concat(parts, F.array(identity)), "/")


def without_bundle(index: DataFrame, bundle_no: int) -> DataFrame:
    """The index without the places in a bundle, as when it is deleted."""
    return index.where(F.col("bundle_no") != bundle_no)


def overridden(index: DataFrame, placed: DataFrame) -> DataFrame:
    """The index (hash, bundle_no, chunk_no, ..) with new places whatever it has: each hash of ``placed`` is there only."""
    return index.join(placed.select("hash"), "hash", "left_anti").unionByName(placed)


def chunk_positions(packed: DataFrame) -> DataFrame:
    """Adds ``position``: where a chunk begins in its bundle. A bundle's size bounds the window."""
    before = Window.partitionBy("bundle_no").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("position", F.coalesce(F.sum("len").over(before), F.lit(0)))


def latest_location(index: DataFrame) -> DataFrame:
    """One place of each hash: the highest bundle id wins, in it the last chunk."""
    return index.groupBy("hash").agg(F.max(F.struct("bundle_id", "chunk_no")).alias("at")).select("hash", "at.bundle_id", "at.chunk_no")
