"""Connected components of links between keys, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, release


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Ties each node's neighbours (the lesser ones, or the greater ones) to the least of its neighbourhood.

    Minima are aggregated before edges meet them, so a node of very many links gathers nowhere.
    """
    facing = edges.where("a > b") if small else _both(edges)
    least = facing.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = facing.join(least, "a")
    out = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = out.union(least.select("a", F.col("m").alias("b"))) if small else out.where(F.col("a") >= tied["a"])
    out = out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return out.distinct() if small else out  # large stars make no more edges than they find


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` is (a, b) of any ordered type; returns (node, root): for every node of an edge the least node it is linked with.

    Large and small stars alternate until the edges are stars. Every round is written to the
    shared folder. Loops and repeated edges don't matter; no edges give no rows. Rounds that don't suffice are an error.
    """
    current = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for turn in range(max_rounds + 1):
        # stars: no node is both leaf and centre, and a leaf has one centre
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).union(current.select("b", F.lit(0)))
        roles = ends.groupBy("node").agg(F.sum("leaf").alias("centres"), F.min("leaf").alias("least"))
        if roles.where("centres > 1 or centres = 1 and least = 0").isEmpty():
            break
        if turn == max_rounds:
            raise RuntimeError(f"links are not stars after {max_rounds} rounds")
        large = materialize(_star(current, small=False), "components")
        release(current)
        current = materialize(_star(large, small=True), "components")
        release(large)
    roots = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
