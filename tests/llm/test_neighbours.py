import numpy as np
import pytest

from cairn.llm import neighbours as N


def plain(rows, k=20, every=20):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in sound:
        if i % every == 0:
            scores = sorted((-float((np.array(v, np.float64) * np.array(q, np.float64)).sum()), j) for j, v in sound if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def result(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")
    out = {}
    for r in sorted(N.nearest_neighbours(df, k=k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({j for _, j, _ in got.get(q, [])} & {j for j, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def vectors(n, d=24, seed=1, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.normal(size=(5, d))[rng.integers(0, 5, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(np.float32(y)) for y in v * (rng.lognormal() if scale else 1)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_scores(spark, monkeypatch, scale):
    monkeypatch.setattr(N, "SHARD_ROWS", (300, 300))
    rows = vectors(1000, scale=scale)
    got, want = result(spark, rows), plain(rows)
    assert recall(got, want) >= 0.95
    for q, found in got.items():
        exact = {j: float((np.array(v) * np.array(rows[q][1])).sum()) for j, v in rows}
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(s == pytest.approx(exact[j], abs=1e-12) for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)


def test_a_vector_of_very_many_rows_and_ties(spark):
    rows = vectors(200, 8) + [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(400)]
    got, want = result(spark, rows), plain(rows)
    assert [j for _, j, _ in got[1000]] == [j for j, _ in want[1000]] == list(range(1001, 1021))
    assert recall(got, want) >= 0.99


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 1.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0]), (140, [1.0, 2.0, 3.0]), (1, [0.5, 0.0]), (3, [-1.0, 0.0])]
    got = result(spark, rows)
    assert got == {0: [(1, 2, 2.0), (2, 1, 0.5), (3, 3, -1.0)]}
    assert result(spark, []) == {}


def test_every_node_is_reached():
    rng = np.random.default_rng(2)
    clusters = np.concatenate([rng.normal(size=(60, 6)) * 0.01 + rng.normal(size=6) * 10 for _ in range(8)])
    out, entries = N.build_graph(clusters, degree=6, beam=12)
    seen, front = set(entries.tolist()), list(entries)
    while front:
        new = {int(j) for j in out[front.pop()] if j >= 0} - seen
        seen |= new
        front += new
    assert len(seen) == len(clusters)


def test_pruning_keeps_the_nearest_and_diverse_ones():
    x = np.array([[0.0, 0], [1, 0], [1.05, 0], [0, 2], [0, 2.1]], np.float32)
    kept = N.robust_prune(x, np.array([0]), np.array([[4, 3, 2, 1, -1]]), 4)
    assert kept[0].tolist() == [1, 3, -1, -1]


def test_whole_table(spark, data_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    got = {}
    for r in N.op10(spark, data_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert recall(got, plain(rows)) >= 0.95
