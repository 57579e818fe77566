import zlib

import numpy as np
import pytest

from cairn.llm import langid as L

# Common words, to make sentences of three languages.
WORDS = {
    "en": "the of and to in is that for it was on are with they at this have from by".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "le de un être et en avoir que pour dans ce il qui ne sur se pas plus par".split(),
}


def text(lang, i, n=30):
    rng = np.random.default_rng(i)
    return " ".join(rng.choice(WORDS[lang], n))


def rows(n=90):
    langs = list(WORDS)
    return [(i, text(langs[i % 3], i), langs[i % 3], "src") for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_fold(spark):
    got = {r["doc_id"]: r for r in L.identify_languages(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert len(got) == 90
    for i, _, lang, _ in rows():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1


def test_labels_are_no_input_and_held_out_ones_teach_nothing(spark):
    base = rows()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify_languages(spark.createDataFrame(base, SCHEMA)).collect()}
    odd = [(i, t, ("xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang), "other") for i, t, lang, _ in base]
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify_languages(spark.createDataFrame(odd, SCHEMA)).collect()} == got


def test_odd_rows(spark):
    odd = [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "12 % !", None, ""), (1003, text("de", 5), None, ""), (None, text("fr", 6), "en", ""), (1004, text("fr", 1, 60000), "fr", ""), (1004, text("fr", 1, 60000), "fr", ""), (1005, "日本語", "en", "")]
    got = L.identify_languages(spark.createDataFrame(rows() + odd, SCHEMA)).collect()
    assert len(got) == 98
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "de", "fr", "fr"]
    assert by_id[1000]["score"] == 0 and by_id[None]["held_out"] is False and by_id[1005]["lang_pred"] in WORDS


def test_nothing_to_learn_from(spark):
    assert L.identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    got = L.identify_languages(spark.createDataFrame([(1, "some text", None, "")], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def test_scores_are_the_kernel_regression(spark):
    """The one matrix of weights gives what kernels to landmarks, whitened, and ridge regression give one by one."""
    samples = [(lang, L.spectrum(text(lang, i))) for lang in WORDS for i in range(8)]
    model = L.fit(samples, landmarks=12)
    marks = [s for lang in sorted(WORDS) for s in [x[1] for x in samples if x[0] == lang][:4]]
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(np.intersect1d(a, model.grams)) * len(b))
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-6 * values.max()
    z = np.array([[kernel(s, m) for m in marks] for _, s in samples]) @ (vectors[:, keep] / np.sqrt(values[keep]))
    y = np.array([[float(lang == x) for x in sorted(WORDS)] for lang, _ in samples])
    want = z @ np.linalg.solve(z.T @ z + L.RIDGE * len(samples) * np.eye(z.shape[1]), z.T @ y)
    present = np.array([np.isin(model.grams, s) for _, s in samples], float)
    assert np.allclose(present @ model.weights / np.sqrt(present.sum(1, keepdims=True)), want, atol=1e-4)


def test_slices_of_grams_add_up(monkeypatch):
    """However many n-grams there are, slices of them give the model and the scores of all at once."""
    samples = [(lang, L.spectrum(text(lang, i))) for lang in WORDS for i in range(8)]
    rng = np.random.default_rng(1)
    whole = L.fit(samples)
    found = [np.sort(rng.choice(len(whole.grams), 40, replace=False)) for _ in range(5)] + [np.zeros(0, np.int64)]
    scores = L.scores_of(found, whole.weights)
    monkeypatch.setattr(L, "GRAMS_AT_ONCE", 37)
    sliced = L.fit(samples)
    assert np.array_equal(sliced.grams, whole.grams) and np.allclose(sliced.weights, whole.weights, atol=1e-4)
    assert np.allclose(L.scores_of(found, whole.weights), scores, atol=1e-6)
    assert L.Model([], np.arange(70_000), np.zeros((0, 0))).table().dtype == np.uint32


@pytest.mark.parametrize("value", ["abc", "é", "a" * 5])
def test_spectrum_is_presence(value):
    raw = b" " + value.encode() + b" "
    want = {len(g) << 32 | int.from_bytes(g, "big") for n in (1, 2, 3) for g in (raw[i : i + n] for i in range(len(raw) - n + 1))}
    assert len(L.spectrum(value)) >= len(want) - 4 and len(set(L.spectrum(value).tolist())) == len(L.spectrum(value))


def test_whole_table(spark, data_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    held = [r for r in L.op3(spark, data_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
