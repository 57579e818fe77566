import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from cairn.llm import bpe, mixing
from tests.llm.test_jaccard import plain as groups
from tests.llm.test_quality import plain as measures
from tests.llm.test_suffixes import plain as removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_text(texts, length=200):
    """What is left of each text, by counting strings."""
    from collections import Counter

    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = set()
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(bytes(b for i, b in enumerate(r) if i not in gone).decode("utf-8", "ignore"))
    return out


def test_run_against_plain_python(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    stage = [(i, t, s) for i, t, s in docs if (m := measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    least = groups([(i, t) for i, t, _ in stage])
    stage = [d for d in stage if least[d[0]][0] == d[0]]
    texts = kept_text([t for _, t, _ in stage])
    stage = [(i, t, s) for (i, _, s), t in zip(stage, texts, strict=True)]
    codec = bpe.Codec.load(P.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in codec.bytes_of.items()}, special_tokens={})
    got = {}
    for r in C.run(spark, data_dir).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids"], r["decoded_sha256"]))
    # copies are the mixing operator's, which has tests of its own; here they must be taken from what the stages kept
    sizes = spark.createDataFrame(stage, "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(mixing.with_sizes(sizes.selectExpr("struct(doc_id, 1L as u, 1L as v) as doc_id", "text", "source"))).selectExpr("doc_id.doc_id as doc_id", "copies").collect()}
    assert set(got) <= {i for i, _, _ in stage}
    assert sum(map(len, got.values())) > len(stage)
    for i, t, _ in stage:
        for n, ids, digest in got.get(i, []):
            assert ids == library.encode_ordinary(t) and n == len(ids) and digest == hashlib.sha256(t.encode()).hexdigest()
    assert abs(sum(map(len, got.values())) - sum(copies.values())) <= 0.2 * len(stage)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_stages_on_odd_rows(spark):
    rng = random.Random(3)
    base, passage = words(rng, 80), words(rng, 60)
    changed = base.split()
    changed[40] = "zz"
    rows = [
        (1, base, "en", "a", 1), (2, " ".join(changed), "en", "a", 1), (3, base, "en", "b", 1), (3, base, "en", "b", 1), (4, None, "en", "a", None), (5, "", None, None, 0), (6, "short", "en", "a", 5),
        (None, words(rng, 50), "en", None, 1), (7, words(rng, 40) + passage, "de", "b", 1), (8, passage + words(rng, 40), "de", "b", 1), (9, words(rng, 20000), "de", "c", 1), (10, "same words " * 50, "en", "a", 1),
    ]
    clash = "u long, v long, row string, doc string, of string, copies long, copy long, size long, rest string"
    df = spark.createDataFrame([(*r, 1, 2, "r", "d", "o", 3, 4, 5, "e") for r in rows], f"{SCHEMA}, {clash}")
    ids = lambda d: sorted(r["doc_id"] or 0 for r in d.collect())
    stages = dict(C.STAGES)

    kept = stages["quality_rules"](spark, df, "")
    assert kept.columns == df.columns and ids(kept) == [0, 1, 2, 3, 3, 7, 8, 9]
    assert {(r["u"], r["v"], r["row"], r["rest"], r["size"]) for r in kept.collect()} == {(1, 2, "r", "e", 5)}

    one = stages["ngram_jaccard_join"](spark, df, "")
    assert one.columns == df.columns and ids(one) == [0, 1, 4, 5, 6, 7, 8, 9, 10]

    cut = stages["suffix_array_dedup"](spark, one, "")
    assert cut.columns == df.columns and ids(cut) == ids(one)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    order = sorted(before, key=str)
    for i, rest in zip(order, kept_text([before[i] or "" for i in order]), strict=True):
        assert (texts[i][0] or "") == rest
    assert len(texts[7][0]) == texts[7][1] < len(before[7]) and texts[4] == (None, None)
    assert sum(x[1] for x in removed([before[i] for i in order], 200)) > 0

    mixed = stages["mixing_to_target_weights"](spark, df, "")
    assert mixed.columns == df.columns and set(ids(mixed)) <= {0, 1, 2, 3, 6, 7, 8, 9, 10}
    assert max(ids(mixed).count(i) for i in (1, 2, 7, 8, 9)) <= 2 and ids(mixed).count(3) <= 4

    coded = stages["byte_level_bpe"](spark, df, "")
    assert len(ids(coded)) == len(rows)


def test_stages_on_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        out = stage(spark, df, "")
        assert out.count() == 0
