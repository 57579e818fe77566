"""Mixing sources to target weights by entropy balancing: the least departure from the corpus that meets the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, materialize, read_table, release, running_offset, running_total, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rates are whole multiples of 2 to the power of minus this, so that sums don't depend on the order of rows.
BITS = 30
ONE = 1 << BITS
TOLERANCE = 1e-7
MAX_STEPS = 60
#: Newton steps that one job takes, so that few intermediate tables are written.
STEPS_A_JOB = 6
ROWS_PER_BLOCK = 100_000


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn. A target is level * weight, at most ``most`` times
    the source's size; each round takes the capped ones out and raises the level for the rest, until none is above.
    One row of sums reaches the driver a round.
    """
    ranked = running_total(sources.withColumn("last", F.col("source").isNull()), [], ["last", "source"], F.lit(1), "place")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = materialize(ranked.withColumn("cap", F.col("source_size") * most), "mixing-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.count_if(full).alias("capped"), F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("fixed"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if row["capped"] == capped or not row["weight"]:
            break
        capped, level = row["capped"], max(level, (share * total - row["fixed"]) / row["weight"])
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _rate(tilt, size, scale):
    """The rate of a document in whole multiples of 1 / ONE: exp(tilt * size / scale), at most MOST."""
    power = F.least(tilt * size / scale, F.lit(1.0))  # e > MOST
    return F.when(tilt.isNull(), 0).otherwise(F.round(F.least(F.exp(power), F.lit(float(MOST))) * ONE)).cast("long")


def solve_tilts(histogram: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """One row per source with its ``tilt`` and ``scale``: Newton's method on the dual of the balancing problem.

    Among rates r with sum(r * size) = target and r <= MOST, those of least relative entropy to 1 are
    min(MOST, exp(tilt * size)); the dual is convex in the tilts, its Hessian diagonal, since a document has one
    source. Every step sums the gradient and the Hessian over the histogram (source, size, n) of the whole corpus and
    moves each tilt within its bracket. Sums are of whole numbers, so any order of rows gives the same tilts. A source
    whose target is its cap has an infinite tilt (all rates MOST); one of target 0 has none (all rates 0).
    """
    infinite = F.lit(float("inf"))
    state = targets.where("target > 0").select(
        "source", "target", (F.col("source_size") / F.col("n_docs")).alias("scale"),
        F.when(F.col("target") >= F.col("source_size") * MOST * (1 - 1e-9), infinite).otherwise(0.0).alias("tilt"),
        F.lit(float("-inf")).alias("low"), infinite.alias("high"),
    )
    state, written = state.withColumn("done", F.col("tilt") == infinite), None
    rows = histogram.where("size > 0")
    for _ in range(0, max_steps, STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            state = _newton_step(rows, state, tolerance)
        state, previous = materialize(state, "mixing-tilts"), written
        written = state
        if previous is not None:
            release(previous)
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "tilt", "scale")


def _newton_step(rows: DataFrame, state: DataFrame, tolerance: float) -> DataFrame:
    """Moves every tilt once: by Newton where that stays within the bracket, else to its middle."""
    s = state.withColumnRenamed("source", "of")
    joined = rows.join(s, rows["source"].eqNullSafe(s["of"])).withColumn("rate", _rate(F.col("tilt"), F.col("size"), F.col("scale")).cast("decimal(38,0)"))
    words = (F.col("rate") * F.col("size") * F.col("n")).cast("decimal(38,0)")
    slope = F.when(F.col("rate") < MOST * ONE, (F.col("rate") * F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")).otherwise(0)
    # the state rides along with its sums: a step reads the one before it once, so steps chain in one plan
    kept = [F.first(c).alias(c) for c in ("target", "scale", "tilt", "low", "high", "done")]
    step = joined.groupBy("source").agg(*kept, F.sum(words).alias("words"), F.sum(slope).alias("slope"))
    step = step.withColumns({"gap": F.col("words").cast("double") / ONE - F.col("target"), "slope": F.col("slope").cast("double") / ONE})
    step = step.withColumns({"low": F.when(F.col("gap") < 0, F.greatest("low", "tilt")).otherwise(F.col("low")), "high": F.when(F.col("gap") > 0, F.least("high", "tilt")).otherwise(F.col("high"))})
    newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") * F.col("scale") / F.col("slope"))
    middle = F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1).when(F.col("high") == float("inf"), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
    step = step.withColumns({"newton": newton, "middle": middle})
    step = step.withColumn("closed", F.col("done") | (F.abs("gap") <= F.col("target") * tolerance) | (F.col("high") - F.col("low") <= F.abs("tilt") * 1e-13))
    inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
    moved = F.when(F.col("closed"), F.col("tilt")).when(inside, F.col("newton")).otherwise(F.col("middle"))
    return step.select("source", "target", "scale", moved.alias("tilt"), "low", "high", F.col("closed").alias("done"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, size): source_size, target, rate, copies (0 to MOST) and taken = copies * size.

    Rates come from :func:`solve_tilts`. They are rounded systematically: in each source documents stand in the order
    of size, then of a hash; fractions are summed along that order and a document gets one more copy where the sum
    passes a whole number. Since sizes rise along it, a source's taken words differ from the sum of its rates by no
    more than its largest document. What is left of the gap then goes to the smallest documents rounded the other way,
    as many as fit. The sums are over blocks of the sorted documents first, so no task holds a source.

    A null source is a source, the last one; size 0 and target 0 take nothing; repeated rows are mixed each for itself;
    an empty table gives an empty result; other columns are not read. Reruns give the same copies, whatever the partitions.
    """
    docs = materialize(docs.select("doc_id", "source", "size"), "mixing-docs")
    histogram = materialize(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = source_targets(sources.drop("n_docs"), weights, share)
    s, t = sources.alias("s"), targets.alias("t")
    targets = materialize(s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.source_size", "n_docs", "target"), "mixing-targets")
    tilts = solve_tilts(histogram, targets)
    t, k = targets.alias("t"), tilts.alias("k")
    known = t.join(k, F.col("t.source").eqNullSafe(F.col("k.source")), "left").select(F.col("t.source").alias("of"), "source_size", "target", "tilt", "scale")
    rate = _rate(F.col("tilt"), F.col("size"), F.col("scale"))
    rated = docs.join(known, docs["source"].eqNullSafe(known["of"])).drop("of").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0))
    rated = rated.withColumn("part", F.col("rate") % ONE).withColumn("mark", F.xxhash64(F.lit(seed), "doc_id"))
    blocks = max(1, -(-docs.count() // ROWS_PER_BLOCK), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["size", "mark", "doc_id"]
    rated = materialize(rated.repartitionByRange(blocks, F.col("source"), *order).withColumn("block", F.spark_partition_id()), "mixing-rates")
    before = running_offset(rated.groupBy("source", "block").agg(F.sum("part").alias("parts")), ["source"], ["block"], "parts", "before").select(F.col("source").alias("of"), F.col("block").alias("at"), "before")
    placed = rated.join(before, rated["source"].eqNullSafe(before["of"]) & (rated["block"] == before["at"]))
    own = Window.partitionBy("source", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(ONE))
    until = F.col("before") + F.sum("part").over(own) + start
    extra = F.floor(until / F.lit(ONE)) - F.floor((until - F.col("part")) / F.lit(ONE))
    rounded = placed.withColumn("extra", extra).withColumn("copies", (F.floor(F.col("rate") / F.lit(ONE)) + F.col("extra")).cast("long")).drop("of", "at", "before")
    rounded = materialize(rounded, "mixing-rounded")

    gaps = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).select(F.col("source").alias("of"), "gap")
    turn = rounded.join(gaps, rounded["source"].eqNullSafe(gaps["of"])).drop("of")
    free = (F.col("part") > 0) & F.when(F.col("gap") > 0, F.col("extra") == 0).otherwise(F.col("extra") == 1)
    turn = turn.withColumn("free", F.when(free, F.col("size")).otherwise(0))
    before = running_offset(turn.groupBy("source", "block").agg(F.sum("free").alias("frees")), ["source"], ["block"], "frees", "before").select(F.col("source").alias("of"), F.col("block").alias("at"), "before")
    turn = turn.join(before, turn["source"].eqNullSafe(before["of"]) & (turn["block"] == before["at"]))
    flip = (F.col("free") > 0) & (F.col("before") + F.sum("free").over(own) <= F.abs("gap"))
    out = turn.withColumn("flip", flip).withColumn("copies", F.col("copies") + F.when(F.col("flip"), F.signum("gap").cast("long")).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", (F.col("rate") / F.lit(float(ONE))).alias("rate"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(with_sizes(read_table(spark, sf_dir, "documents")))
