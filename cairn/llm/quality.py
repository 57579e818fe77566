"""Quality rules judged by host: documents fail rules, hosts gather failures, hosts' verdicts return to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, read_table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is refused when the shrunk failure rate of any rule passes this.
HOST_LIMIT = 0.5
#: Rules whose failures hosts gather: name and condition on the measures.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "n_symbols > n_words",
    "same_lines": "n_lines > 1 and 2 * n_dup_lines > n_lines",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a run of ``window`` words that the text holds at least twice.

    Runs are named exactly, by doubling: equal runs of 2 words, then of 4, then of 8 get equal numbers.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        distinct, names = np.unique(pairs, return_inverse=True)
        width *= 2
        if len(distinct) == len(names):
            return 0
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The measures of one whole text, in the order of MEASURES. A null text counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([measure(x.as_py()) for x in batch.column(2)], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in found.T)], names=["doc_id", "host", *MEASURES])


def measures(docs: DataFrame, host: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its host and the measures. One pass over the texts, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text_col).alias("text")).mapInArrow(
        _measure_batches, f"doc_id {kind}, host string, " + ", ".join(f"{m} bigint" for m in MEASURES)
    )


def beta_prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """For each rule the beta prior fitted to all hosts by moments; ``hosts`` has n and fails_<rule>.

    The spread of the hosts' rates, less what binomial noise adds, sets the prior's weight. One row reaches the driver.
    """
    sums = {r: F.sum(f"fails_{r}").alias(f"f_{r}") for r in RULES}
    squares = {r: F.sum(F.col(f"fails_{r}") * F.col(f"fails_{r}") / F.col("n")).alias(f"q_{r}") for r in RULES}
    row = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *sums.values(), *squares.values()).first()
    out = {}
    for r in RULES:
        if not row["n"]:
            out[r] = (0.0, 1.0)
            continue
        mean = row[f"f_{r}"] / row["n"]
        noise = mean * (1 - mean)
        spread = row[f"q_{r}"] / row["n"] - mean * mean - noise * row["hosts"] / row["n"]
        weight = min(max(noise / spread - 1, 1.0), 1e6) if spread > 1e-12 else 1e6
        out[r] = (mean * weight, (1 - mean) * weight)
    return out


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n, failures and shrunk rate of each rule, and ``host_ok``."""
    known = measured.where("host is not null")
    hosts = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(c).cast("long")).alias(f"fails_{r}") for r, c in RULES.items()))
    prior = beta_prior(hosts)
    hosts = hosts.withColumns({f"rate_{r}": (F.col(f"fails_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in prior.items()})
    return hosts.withColumn("host_ok", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) <= F.lit(limit))


def quality_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Returns per document its measures, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules (20 words at least; at most 30 % of its words in repeated 8-word
    windows) and its host passes: hosts' failure rates are shrunk by an empirical beta prior, so that a host of few
    documents is not refused for little evidence. A null text counts as empty and fails; a null host has no verdict, so
    only the base rules judge its documents. Repeated rows give repeated rows. An empty table gives an empty result.
    Only ``doc_id``, ``text`` and the host column are read; other columns don't matter.
    """
    measured = materialize(measures(docs, host), "quality")
    # written, so that its size is known: few hosts are sent to the rows, many are joined by shuffle with skew split
    hosts = materialize(host_verdicts(measured, limit).select("host", "host_ok"), "quality-hosts")
    failed = F.expr(f"({RULES['short']}) or ({RULES['repetitive']})")
    judged = measured.join(hosts, "host", "left").withColumn("base_failed", failed)
    return judged.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), "host", "host_ok")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
