"""Recall of the operators that search approximately, against brute force, and what decides the repeats of suffix dedup:
``python -m cairn.llm.measure neighbours|shard|jaccard|repeats FOLDER``."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import jaccard, neighbours, suffixes
from cairn.llm.common import keyed, release, text_or_empty
from cairn.llm.shingles import shingle_hashes


def _vectors(folder: str) -> tuple[np.ndarray, np.ndarray]:
    table = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding"]).drop_null()
    size = max(len(v) for v in table["embedding"].to_pylist())
    rows = {i: v for i, v in zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True) if len(v) == size and np.isfinite(np.array(v, float)).all() and any(v)}
    return np.array(list(rows)), np.array(list(rows.values()), np.float64)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, set[int]]:
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        out[int(ids[i])] = set(ids[np.lexsort((ids, -scores))[:k]].tolist())
    return out


def recall_of_neighbours(spark: SparkSession, folder: str, k: int = neighbours.NEAREST) -> tuple[float, int]:
    """Share of the true nearest that the query finds, and how many queries there are."""
    want, got = _nearest(*_vectors(folder), k), {}
    for r in neighbours.op10(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(w & got.get(q, set())) for q, w in want.items()) / sum(map(len, want.values())), len(want)


def recall_of_one_shard(folder: str, rows: int = neighbours.SHARD_ROWS[1], k: int = neighbours.NEAREST) -> tuple[float, int, float]:
    """Recall within one graph over at most ``rows`` distinct vectors, its vectors, and the seconds it took to build."""
    ids, x = _vectors(folder)
    x, first = np.unique(x, axis=0, return_index=True)
    ids, x = ids[first][:rows], x[:rows]
    began = time.time()
    out, entries = neighbours.build_graph(x)
    took = time.time() - began
    want, found, total = _nearest(ids, x, k), 0, 0
    asked = np.flatnonzero(ids % 20 == 0)
    graph = neighbours.augment(x)
    for i in range(0, len(asked), neighbours.BATCH):
        part = asked[i : i + neighbours.BATCH]
        q = (x[part] / np.abs(x[part]).max(1, keepdims=True)).astype(np.float32)
        nodes, _ = neighbours.beam_search(graph, out, entries, np.concatenate([q, np.zeros((len(q), 1), np.float32)], 1), neighbours.ASK_BEAM)
        for p, met in zip(part, nodes, strict=True):
            met = met[(met >= 0) & (met != p)]
            best = met[np.lexsort((ids[met], -(x[met] @ x[p])))[:k]]
            w = want[int(ids[p])]
            found, total = found + len(w & set(ids[best].tolist())), total + len(w)
    return found / total, len(x), took


def recall_of_jaccard(spark: SparkSession, docs: DataFrame, every: int = 100, similarity: float = jaccard.SIMILARITY) -> tuple[float, int]:
    """Share of all links of documents whose id is divisible by ``every``, with any document, that n_links counts; and their number."""
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_groups(docs, similarity).select("doc_id", "n_links").collect()}
    places: dict[int, list[int]] = {}
    sets = {i: shingle_hashes(t) for i, t in texts.items()}
    asked = [i for i in sets if i % every == 0 and len(sets[i])]
    wanted = {int(h) for i in asked for h in sets[i]}
    for i, s in sets.items():
        for h in s.tolist():
            if h in wanted:
                places.setdefault(h, []).append(i)
    found = total = 0
    for i in asked:
        shared: dict[int, int] = {}
        for h in sets[i].tolist():
            for j in places[h]:
                shared[j] = shared.get(j, 0) + 1
        links = sum(j != i and n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9 for j, n in shared.items())
        found, total = found + min(got[i], links), total + links
    return found / max(total, 1), total


#: What can show that a string repeats, in the order in which it is asked: whole phrases and pieces by their names, the sort, counts.
EVIDENCE = ("phrases", "pieces", "sort", "counts")


def _bytes_by_evidence(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(len(EVIDENCE), np.int64)
            for size, marks, extra in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                gone = np.zeros(size, bool)
                for kind in range(len(EVIDENCE)):
                    spans = [m for m in marks if m["repeated"]] if kind == 0 else [e for e in extra or [] if e["kind"] == kind]
                    edges = np.zeros(size + 1, np.int64)
                    np.add.at(edges, [s["start"] for s in spans], 1)
                    np.add.at(edges, [s["start"] + s["run"] - 1 + length for s in spans], -1)
                    covered = np.cumsum(edges)[:-1] > 0
                    sums[kind] += np.count_nonzero(covered & ~gone)
                    gone |= covered
            yield pa.RecordBatch.from_arrays([pa.array([int(n)]) for n in sums], names=list(EVIDENCE))

    return run


def decided_repeats(docs: DataFrame, length: int = suffixes.LENGTH) -> dict[str, int]:
    """Removed bytes of distinct rows by what shows first that they repeat, and the pieces and bytes that are sorted."""
    texts = keyed(docs.select("doc_id", text_or_empty().alias("text"))).select("u", "v", "text")
    work, *found, pieces, temporary = suffixes._evidence(texts, length, suffixes.ANCHOR)
    rows = None
    for kind, part in enumerate(found, 1):
        part = part.withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    extra = rows.groupBy("u", "v").agg(F.collect_set(F.struct("start", "run", "kind")).alias("extra"))
    sums = work.join(extra, ["u", "v"], "left").select(F.octet_length("text"), "marks", "extra").mapInArrow(_bytes_by_evidence(length), ", ".join(f"{k} bigint" for k in EVIDENCE))
    out = sums.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in EVIDENCE)).first().asDict()
    out |= pieces.agg(F.count(F.lit(1)).alias("open_pieces"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("open_bytes")).first().asDict()
    release(work, *temporary)
    return out


if __name__ == "__main__":
    from cairn.session import session

    what, folder = sys.argv[1:]
    if what == "shard":
        print(recall_of_one_shard(folder))
    else:
        spark = session("local[8]", "recall", **{"spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
        if what == "neighbours":
            print(recall_of_neighbours(spark, folder))
        else:
            print({"jaccard": recall_of_jaccard, "repeats": lambda spark, docs: decided_repeats(docs)}[what](spark, spark.read.parquet(f"{folder}/documents.parquet")))
