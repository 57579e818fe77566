"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import read_table

#: Bounds of the fit: labelled rows, and landmarks among them.
MAX_TRAIN, MAX_LANDMARKS = 1600, 320
#: N-grams of one matrix product; more of them are worked through slice by slice.
GRAMS_AT_ONCE = 65_536
RIDGE = 1e-3
#: Languages whose counts go to all tasks; a label that takes more values is joined by shuffle.
MAX_BROADCAST = 100_000
SPACE = (1 << 24) + (1 << 16) + (1 << 8)
SLICE, ROWS = 1 << 20, 128
UNKNOWN = "und"
#: ASCII but letters becomes a space; bytes of other letters stay.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """The codes of all byte n-grams, n = 1 to 3, of the lower-cased text between two spaces, slice by slice."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" "
    for start in range(0, max(len(raw) - 2, 1), SLICE):
        a = np.frombuffer(raw[start : start + SLICE + 2], np.uint8).astype(np.int32)
        two = a[:-1] << 8 | a[1:]
        yield two[:-1] << 8 | a[2:]
        yield two + (1 << 24)
        yield a + ((1 << 24) + (1 << 16))


def spectrum(text: str) -> np.ndarray:
    """The distinct n-grams of a text: what the presence kernel compares."""
    return np.unique(np.concatenate([np.unique(c) for c in gram_codes(text)]))


@dataclass
class Model:
    """scores = presence(text) / its norm @ weights: the kernel against all landmarks, their inverse root and the ridge weights in one.

    ``grams`` are all n-grams of the landmarks: others are in no product, and a text's norm is that of its known ones.
    """

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        t = np.zeros(SPACE, np.min_scalar_type(len(self.grams)))
        t[self.grams] = np.arange(1, len(self.grams) + 1)
        return t


def fit(samples: list[tuple[str, np.ndarray]], ridge: float = RIDGE, landmarks: int = MAX_LANDMARKS) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features of (language, spectrum) samples, in the order given."""
    languages = sorted({s[0] for s in samples})
    if not samples:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    each = max(1, landmarks // len(languages))
    chosen = [s[1] for lang in languages for s in [x for x in samples if x[0] == lang][:each]]
    grams = np.unique(np.concatenate(chosen))
    norm = lambda spectra: np.sqrt([[max(np.isin(s, grams, assume_unique=True).sum(), 1)] for s in spectra])
    slices = [grams[i : i + GRAMS_AT_ONCE] for i in range(0, len(grams), GRAMS_AT_ONCE)]

    def products(spectra: list[np.ndarray]) -> np.ndarray:
        """The kernel between texts and landmarks."""
        both = sum(presence(spectra, part).astype(np.float32) @ presence(chosen, part).astype(np.float32).T for part in slices)
        return both / norm(spectra) / own.T

    own = norm(chosen)
    values, vectors = np.linalg.eigh(products(chosen))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([products([s[1] for s in samples[i : i + ROWS]]) for i in range(0, len(samples), ROWS)]) @ root
    wanted = np.array([[float(s[0] == lang) for lang in languages] for s in samples])
    ridged = np.linalg.solve(features.T @ features + ridge * len(samples) * np.eye(features.shape[1]), features.T @ wanted)
    ridged = root @ ridged / own
    return Model(languages, grams, np.concatenate([(presence(chosen, part).T @ ridged).astype(np.float32) for part in slices]))


def presence(spectra: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    out = np.zeros((len(spectra), len(grams)), bool)
    for row, s in zip(out, spectra, strict=True):
        row[np.searchsorted(grams, s[np.isin(s, grams, assume_unique=True)])] = True
    return out


def scores_of(found: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Scores of texts by the places of their known n-grams: presence by weights, slices of n-grams at a time."""
    out = np.zeros((len(found), weights.shape[1]), np.float64)
    for low in range(0, len(weights), GRAMS_AT_ONCE):
        part = weights[low : low + GRAMS_AT_ONCE]
        present = np.zeros((len(found), len(part)), np.float32)
        for row, at in zip(present, found, strict=True):
            row[at[np.searchsorted(at, low) : np.searchsorted(at, low + len(part))] - low] = 1
        out += present @ part
    return np.clip(out / np.sqrt([[max(len(at), 1)] for at in found]), 0, 1)


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [spectrum(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.list_(pa.int32()))], names=["mark", "lang", "grams"])


def training_samples(labelled: DataFrame, most: int = MAX_TRAIN) -> list[tuple[str, np.ndarray]]:
    """At most max(most, number of languages) rows of (doc_id, lang, text), as many per language, least hash of the id first.

    The ids are chosen before texts are read, within each language by partial top-k; spectra, not texts, reach the driver.
    """
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("mark"))
    n = ids.agg(F.count_distinct("lang")).first()[0]
    if not n:
        return []
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id"))
    # so many hashes as make about four times the rows wanted: what top-k then gathers doesn't grow with the table
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod("mark", F.lit(1 << 30)) * F.col("n") < F.lit(float(4 * max(1, most // n) * (1 << 30)))
    ids = ids.join(F.broadcast(counts) if n <= MAX_BROADCAST else counts, "lang").where(share).drop("n")
    few = ids.distinct().withColumn("rank", rank).where(F.col("rank") <= max(1, most // n)).select("doc_id", "mark")
    texts = labelled.join(F.broadcast(few), "doc_id").groupBy("doc_id", "mark", "lang").agg(F.min("text").alias("text"))
    rows = texts.select("mark", "lang", "text").mapInArrow(_spectra, "mark bigint, lang string, grams array<int>").collect()
    return [(r["lang"], np.array(r["grams"], np.int64)) for r in sorted(rows, key=lambda r: (r["lang"], r["mark"], r["grams"]))]


_TABLES: dict[int, tuple[Model, np.ndarray]] = {}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score (0 to 1), from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id(shared.value) not in _TABLES:
            _TABLES.clear()
            _TABLES[id(shared.value)] = shared.value, shared.value.table()
        m, table = _TABLES[id(shared.value)]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [t.as_py() or "" for t in batch.column(2)]
                known = np.array([bool(m.languages) and any(map(str.isalpha, t)) for t in texts])
                found = [np.zeros(0, np.int64)] * len(texts)
                for i in np.flatnonzero(known):
                    marks = np.zeros(len(m.grams) + 1, bool)
                    for codes in gram_codes(texts[i]):
                        marks[table[codes]] = True
                    found[i] = np.flatnonzero(marks[1:])
                if m.languages:
                    scores = scores_of(found, m.weights)
                    best = scores.argmax(1)
                    names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    values = np.where(known, scores[np.arange(len(best)), best], 0).astype(np.float64)
                else:
                    names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(values)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from labelled documents out of the held-out fold and predicts every document.

    The fold is crc32 of the id as text, modulo 4: remainder 2 is held out. Rows of a null lang, text or id teach
    nothing. A text that is null or has no letter is `und` with score 0, as is everything where nothing is labelled.
    Repeated rows repeat, an empty table gives an empty result, other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang", "text")
    labelled = docs.where("not held_out and doc_id is not null and lang is not null and text is not null")
    return predict(docs, fit(training_samples(labelled)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))
