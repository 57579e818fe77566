from collections import Counter

import pytest

from cairn.llm import quality as Q


def plain(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


CASES = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "a b " * 30, "L1 x\nL1 x\n\n\nL1 x\nL1  x", "é ü wörd　zwei #*$",
    " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i % 9}" for i in range(100)), " ".join(f"w{i}" for i in range(50)) + " z " + " ".join(f"w{i}" for i in range(10)), "word " * 30000,
]


@pytest.mark.parametrize("text", CASES)
def test_measures(text):
    m = dict(zip(Q.MEASURES, Q.measure(text), strict=True))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == plain(text)


def good(i):
    return " ".join(f"w{(i * 31 + k * 17) % 997}" for k in range(40))


def test_hosts_are_judged_by_shrunk_rates(spark):
    rows = [(i, good(i), "fine") for i in range(200)] + [(1000 + i, "too short", "bad") for i in range(190)] + [(2000 + i, good(i), "bad") for i in range(10)]
    rows += [(3000, "short", "new"), (3001, good(1), "new"), (4000, good(2), None), (4001, "x", None)]
    df = spark.createDataFrame([(*r, "extra", 7) for r in rows], "doc_id long, text string, source string, host string, n_words int")
    got = {r["doc_id"]: r for r in Q.quality_rules(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(200))
    assert not any(got[2000 + i]["kept"] or got[2000 + i]["base_failed"] for i in range(10))  # good documents of a host refused
    assert not got[3000]["kept"] and got[3001]["kept"]  # one failure of two is too little evidence
    assert got[4000]["kept"] and not got[4001]["kept"]


def test_whole_table_against_plain_python(spark, data_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    for r in Q.op7(spark, data_dir).collect():
        want = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r["kept"] == (not r["base_failed"])


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert Q.quality_rules(spark.createDataFrame([], schema)).count() == 0
    rows = Q.quality_rules(spark.createDataFrame([(None, None, None), (1, good(1), "s"), (1, good(1), "s")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in rows) == [(0, False), (1, True), (1, True)]
