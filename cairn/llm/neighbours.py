"""Approximate nearest neighbours by robust-pruned directed graphs: one graph a shard, queried by beam search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, read_table

NEAREST = 20
#: Out-edges of a node, width of the beam while building and while asking, nodes expanded at a time, slack of the pruning.
DEGREE, BUILD_BEAM, ASK_BEAM, EXPAND, ALPHA = 48, 96, 128, 4, 1.1
BATCH = 256
#: Distinct vectors of a shard: a table makes few shards, as every query asks each, until they are of the upper bound.
SHARD_ROWS, SHARDS_FIRST = (4096, 65_536), 4
#: Queries of a block: as many as a full shard has vectors, so that neither graphs nor queries are copied more often than
#: the other; fewer where vectors are long.
QUERY_BLOCK, QUERY_BYTES = 65_536, 64 << 20


def beam_search(x: np.ndarray, out: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nodes of largest inner product with each query that greedy search finds, and the products; -1 pads.

    All queries step together: each expands its EXPAND best nodes not yet expanded, until its beam holds no such node.
    """
    b, n = len(q), len(x)
    width = max(width, len(entries))
    ids = np.full((b, width), -1, np.int32)
    near = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for no node
    ids[:, : len(entries)] = entries
    near[:, : len(entries)] = q @ x[entries].T
    done[:, : len(entries)] = False
    seen[:, entries] = True
    live = np.arange(b)
    while len(live):
        open_near = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-open_near, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
        usable = np.take_along_axis(open_near, pick, 1) > -np.inf
        some = usable.any(1)
        live, pick, usable = live[some], pick[some], usable[some]
        if not len(live):
            break
        at = np.where(usable, ids[live[:, None], pick], n)
        done[live[:, None], pick] = True
        new = _out_rows(out, at, n)
        new = np.sort(np.where(seen[live[:, None], new], n, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        seen[live[:, None], new] = True
        products = np.einsum("bkd,bd->bk", x[np.minimum(new, n - 1)], q[live])
        products[new == n] = -np.inf
        all_ids = np.concatenate([ids[live], new.astype(np.int32)], 1)
        all_near = np.concatenate([near[live], products], 1)
        all_done = np.concatenate([done[live], new == n], 1)
        top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        ids[live], near[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_near, all_done))
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    ids[near == -np.inf] = -1
    return ids, near


def _out_rows(out: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    rows = out[np.minimum(at, n - 1)]
    rows = np.where((at == n)[:, :, None] | (rows < 0), n, rows)
    return rows.reshape(len(at), -1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (-1 pads): the nearest one stays, and drops those nearer to it, by alpha, than to the point."""
    b, c = candidates.shape
    absent = (candidates < 0) | (candidates == points[:, None])
    v = x[np.maximum(candidates, 0)]
    squares = np.einsum("bcd,bcd->bc", v, v)
    far = np.einsum("bd,bd->b", x[points], x[points])[:, None] + squares - 2 * np.einsum("bcd,bd->bc", v, x[points])
    far[absent] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far, squares = (np.take_along_axis(a, order, 1) for a in (candidates, far, squares))
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = squares[:, :, None] + squares[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive = np.isfinite(far)
    kept = np.full((b, degree), -1, np.int32)
    for k in range(degree):
        first = alive.argmax(1)
        has = alive[np.arange(b), first]
        if not has.any():
            break
        kept[has, k] = candidates[has, first[has]]
        alive &= ~(has[:, None] & (alpha * alpha * between[np.arange(b), first] <= far))
        alive[np.arange(b), first] = False
    return kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges of each vector and the entry nodes. Distances are those of vectors made equally long by one more component.

    Nodes come in batches that double; each searches the graph so far, prunes what it met, and is offered to its
    neighbours, which prune where they have too many. Nodes that no path reaches become entries.
    """
    x = augment(vectors)
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    entry = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    start = 1
    while start < n:
        batch = order[start : start + min(BATCH, start)]
        found, _ = beam_search(x, out, np.array([entry]), x[batch], beam)
        out[batch] = robust_prune(x, batch, found, degree)
        source = np.repeat(batch, degree)
        target = out[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.lexsort((source, target))
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        offered = np.full((len(nodes), degree + int(count.max())), -1, np.int32)
        offered[:, :degree] = out[nodes]
        offered[np.repeat(np.arange(len(nodes)), count), degree + np.arange(len(target)) - np.repeat(first, count)] = source
        for i in range(0, len(nodes), BATCH):
            out[nodes[i : i + BATCH]] = robust_prune(x, nodes[i : i + BATCH], offered[i : i + BATCH], degree)
        start += len(batch)
    return out, unreached_entries(out, entry)


def unreached_entries(out: np.ndarray, entry: int) -> np.ndarray:
    reached = np.zeros(len(out), bool)
    entries, first = [], entry
    while True:
        entries.append(first)
        edge = np.array([first])
        reached[first] = True
        while len(edge):
            edge = np.unique(out[edge])
            edge = edge[edge >= 0]
            edge = edge[~reached[edge]]
            reached[edge] = True
        if reached.all():
            return np.array(entries)
        first = int(np.flatnonzero(~reached)[0])


def augment(vectors: np.ndarray) -> np.ndarray:
    """One more component that makes all vectors equally long, so that the largest inner product is the least distance."""
    x = vectors.astype(np.float64)
    peak = np.abs(x).max(initial=0) or 1.0
    x = x / peak
    squares = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], 1).astype(np.float32)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by([("first", "ascending")])
    out, entries = build_graph(_matrix(table["vector"]))
    n = len(out)
    rows = [pa.array(range(n), pa.int32()), pa.array(np.isin(np.arange(n), entries)), pa.array(list(out), pa.list_(pa.int32()))]
    return pa.table({"shard": table["shard"], "node": rows[0], "entry": rows[1], "out": rows[2], "vector": table["vector"], "ids": table["ids"]})


def _ask(k: int):
    def run(graph: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if graph.num_rows and queries.num_rows:
            graph = graph.sort_by([("node", "ascending")])
            original, out = _matrix(graph["vector"]), np.stack(graph["out"].to_pylist()).astype(np.int32)
            ids = graph["ids"].to_pylist()
            x = augment(original)
            entries = np.flatnonzero(graph["entry"].to_numpy())
            asked, vectors = queries["vec_id"].to_pylist(), _matrix(queries["vector"]).astype(np.float64)
            for start in range(0, len(asked), BATCH):
                exact = vectors[start : start + BATCH]
                q = (exact / np.abs(exact).max(1, keepdims=True)).astype(np.float32)
                nodes, _ = beam_search(x, out, entries, np.concatenate([q, np.zeros((len(q), 1), np.float32)], 1), max(ASK_BEAM, 2 * k))
                for i, own in enumerate(asked[start : start + BATCH]):
                    met = nodes[i][nodes[i] >= 0]
                    scores = (original[met].astype(np.float64) * exact[i]).sum(1)
                    best = sorted(((-s, v) for s, m in zip(scores.tolist(), met.tolist(), strict=True) for v in ids[m] if v != own))[:k]
                    found["query_id"] += [own] * len(best)
                    found["vec_id"] += [v for _, v in best]
                    found["score"] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles) without those that take no part: null, empty, zero, or with a null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    sound = "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(sound).distinct()


def nearest_neighbours(vectors: DataFrame, query_every: int = 20, k: int = NEAREST) -> DataFrame:
    """For every row whose vec_id is divisible by ``query_every`` its ``k`` nearest others: query_id, rank, vec_id, score.

    Equal vectors are one node that carries its k + 1 least ids: enough for any answer, chosen by partial top-k, so a
    vector of very many rows stays one row. Nodes are dealt to shards by their hash; each shard builds its graph, the
    graphs are written, and each block of queries walks each shard's graph of its dimension. Answers of all shards merge
    by score, ties by vec_id. Every row is indexed. Rows that repeat count once; vectors of different lengths are not
    compared; an empty table gives an empty result; other columns are not read.
    """
    rows = materialize(usable(vectors), "neighbours-rows")
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes, "neighbours-nodes")
    low, high = SHARD_ROWS
    total = nodes.count()
    shards = max(1, -(-total // min(high, max(low, -(-total // SHARDS_FIRST)))))
    dimension = F.size("vector").cast("long") * F.lit(1 << 32)
    sharded = nodes.withColumn("shard", dimension + F.pmod(F.xxhash64("vector"), F.lit(shards))).withColumn("first", F.col("ids")[0])
    schema = "shard bigint, node int, entry boolean, out array<int>, vector array<double>, ids array<bigint>"
    graph = materialize(sharded.groupBy("shard").applyInArrow(_build, schema), "neighbours-graph")

    queries = rows.where(F.col("vec_id") % query_every == 0)
    count, longest = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-count // max(BATCH, min(QUERY_BLOCK, QUERY_BYTES // (8 * (longest or 1))))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", dimension + F.col("shard"))
    offered = graph.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = offered.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_ask(k), "query_id bigint, vec_id bigint, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))
