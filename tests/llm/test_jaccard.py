import random
from itertools import combinations

import numpy as np
import pytest

from cairn.llm import jaccard as J
from cairn.llm.components import connected_components
from cairn.llm.shingles import shingle_hashes


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(docs):
    """{id: (least id of the group, links)} of unique ids, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def result(spark, docs, extra=True):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, sid string")
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_groups(df).collect()}


def corpus(seed, groups=12, passage_docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    docs = [None, "", " \n", "one", "one", "a b c d", "a b c d", "a b c d e", "a  b\tc d e"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(2, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 45))):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    passage = [word() for _ in range(40)]
    docs += [" ".join([word() for _ in range(rng.randint(5, 30))] + passage + [word() for _ in range(rng.randint(5, 30))]) for _ in range(passage_docs)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    assert result(spark, docs) == plain(docs)


def test_small_buckets_split_deep_and_blocks_pair_up(spark, monkeypatch):
    for name, value in (("LIMIT", 4), ("BLOCK", 3), ("LARGEST", 12)):
        monkeypatch.setattr(J, name, value)
    docs = corpus(3, groups=6, passage_docs=80)
    assert result(spark, docs) == plain(docs)


def test_every_pair_of_a_large_bucket_meets(spark, monkeypatch):
    """Like sets of one bucket are joined whatever block they are in, also when they are unlike the least set."""
    for name, value in (("BLOCK", 3), ("LARGEST", 12)):
        monkeypatch.setattr(J, name, value)
    rng = np.random.default_rng(5)
    drawn = lambda: rng.integers(0, 1 << 31, J.SAMPLES).astype(np.int32)
    head = drawn()
    near, far = head.copy(), head.copy()
    near[:25] = far[:25] = drawn()[:25]
    far[25:50] = drawn()[25:50]
    kinds = [head, near, far] + [kind for _ in range(20) for kind in [drawn()] * 2]
    rows = [(bytearray([i]), bytearray(v.tobytes())) for i, v in enumerate(kinds)]
    samples = spark.createDataFrame(rows, "sid binary, samples binary")
    leaves = spark.createDataFrame([(sid, b, len(rows)) for sid, _ in rows for b in (7, 8)], "sid binary, bucket long, n long")
    links = {(a[0], b[0]) for part in J._links_of(leaves, samples, J.needed_samples(0.8, 2.5e-5)) for a, b in part.collect()}
    assert {(min(x), max(x)) for x in links if x[0] != x[1]} == {(0, 1), (1, 2)} | {(i, i + 1) for i in range(3, len(rows), 2)}


def test_exact_threshold(spark):
    # 9 shingles, 8 shared: 8 / 10 is linked; 8 shared of 9 and 10: 8 / 11 is not
    a = [f"w{i}" for i in range(13)]
    docs = [(1, " ".join(a)), (2, " ".join([*a[:12], "z"])), (3, " ".join([*a[:12], "y", "x"]))]
    assert result(spark, docs) == plain(docs) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_repeated_rows_and_odd_tables(spark):
    schema = "doc_id long, text string"
    text = " ".join(f"w{i}" for i in range(30))
    rows = J.jaccard_groups(spark.createDataFrame([(5, text), (5, text), (7, text), (None, None), (None, "other"), (8, "")], schema)).collect()
    assert sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in rows)) == [(0, 0, 0), (0, 0, 0), (5, 5, 2), (5, 5, 2), (7, 5, 2), (8, 8, 0)]
    assert J.jaccard_groups(spark.createDataFrame([], schema)).count() == 0


def test_ids_and_rows_that_repeat(spark):
    """Rows count as documents, each with its own text, whatever ids they share."""
    a = [f"w{i}" for i in range(40)]
    near, other = [*a[:39], "z"], [f"v{i}" for i in range(40)]
    texts = [(5, a), (5, a), (5, other), (7, near), (9, [*other[:39], "y"]), (9, a[:12])]
    rows = J.jaccard_groups(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_links"], r["n_shingles"]) for r in rows) == [(5, 1, 36), (5, 2, 36), (5, 2, 36), (7, 2, 36), (9, 0, 8), (9, 1, 36)]
    assert {r["class_id"] for r in rows if r["n_links"]} == {5}


def test_rows_without_ids_are_verified(spark):
    """Near copies of null ids link with each other, and with documents of an id."""
    a, b = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [(None, a), (None, [*a[:59], "z"]), (None, b), (4, [*b[:59], "y"])]
    rows = J.jaccard_groups(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in rows) == [(0, 0, 1), (0, 0, 1), (0, 4, 1), (4, 4, 1)]


def test_shingle_hashes():
    assert len(shingle_hashes(None)) == len(shingle_hashes(" \n")) == 0 and len(shingle_hashes("a b")) == 1
    assert np.array_equal(shingle_hashes("a b  c\td e f"), shingle_hashes("a b c d e f")) and len(shingle_hashes("a b c d e f")) == 2
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "a", "b", "ba", "aab"]) for _ in range(20000))
    assert len(shingle_hashes(text)) == len(shingles(text))


def test_words_of_a_fixed_polynomial_hash_differ(spark):
    """Thue and Morse's word and its complement collide under any polynomial modulo 2 ** 64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert result(spark, [(1, word), (2, other)]) == {1: (1, 0), 2: (2, 0)}


def test_probabilities_of_a_miss():
    """The logs of :func:`missed_logs` against trees that are grown at random."""
    rng = random.Random(8)

    def apart(tokens, level):
        return all(rng.random() >= 0.8 or level and apart(1 + (rng.random() < 1 / J.BRANCH), level - 1) for _ in range(tokens))

    for tokens in (1, 2):
        for level in (1, 3, 6):
            seen = sum(apart(tokens, level - 1) for _ in range(20000)) / 20000
            assert abs(seen - np.exp(J.missed_logs(0.8)[tokens - 1][level - 1])) < 0.02
    assert 58 <= J.needed_samples(0.8, 2.5e-5) <= 60


def test_runs_repeat_until_the_recall(spark, monkeypatch):
    """Partners that are just similar, in trees that split to the last level, are found all the same."""
    for name, value in (("LIMIT", 2), ("RUNS", 6), ("LARGEST", 2)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []
    for _ in range(60):
        base = [word() for _ in range(95)]
        docs += [" ".join(base), " ".join([*base[:-10], *(word() for _ in range(10))])]
    docs = list(enumerate(docs))
    assert result(spark, docs) == plain(docs)


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (np.unique(rng.integers(1, 1 << 63, n, np.uint64)) for n in (800, 100, 100))
    x, y = J.sampled_tokens(np.concatenate([common, a])), J.sampled_tokens(np.concatenate([common, b]))
    assert 0.65 < (x == y).mean() < 0.95


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {i: find(i) for i in root}


def test_whole_table(spark, data_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.op9(spark, data_dir).collect()} == plain(docs)


def test_components_that_rounds_do_not_finish_are_an_error(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=0)
    assert connected_components(chain.where("a = 1"), max_rounds=0).count() == 2
