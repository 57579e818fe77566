"""N-gram Jaccard join by chosen paths: sets split on sampled shared tokens until buckets are small, run after run."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, read_table
from cairn.llm.components import connected_components
from cairn.llm.shingles import WORDS, group_bounds, set_digest, shingle_lanes, whole_groups

SIMILARITY = 0.8
TARGET_RECALL = 0.9999
#: Samples kept of a set, levels of a path, and sets that a bucket may hold before it splits.
SAMPLES, LEVELS, LIMIT = 96, 6, 2048
#: One node in so many samples two tokens, the others one: a pair of the similarity stays together on 1 of 1.25 on average.
BRANCH = 4
#: Runs for all sets, enough for leaves of three levels; and of each later round, for those whose leaves lie deeper.
RUNS, MORE_RUNS = 10, 8
#: Sets of a block: a larger bucket of the last level, or group to verify, is worked through in pairs of blocks.
BLOCK, LARGEST = 512, 2048
COLUMNS = 8192
_MULTIPLIERS = np.random.default_rng(97).integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)


def sampled_tokens(tokens: np.ndarray) -> np.ndarray:
    """For each sampling function the token of least rank under it, as the 31 bits of that rank: sets share a sample with the probability of their similarity."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 2048):
        least = np.minimum(least, (tokens[i : i + 2048, None] * _MULTIPLIERS).min(0))
    return (least >> np.uint64(33)).astype(np.int32)


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, samples = [], [], []
            for text in batch.column(1):
                lanes = shingle_lanes(text.as_py(), words)
                ids.append(set_digest(lanes) if len(lanes) else None)
                sizes.append(len(lanes))
                samples.append(sampled_tokens(lanes[:, 0]).tobytes() if len(lanes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(samples, pa.binary())], names=["doc_id", "row", "sid", "n_shingles", "samples"])

    return run


def forest(near, count: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of ``count`` items; near(i, rest) tells which of the items ``rest`` are linked with i.

    Only items not reached yet are compared, so a bucket of like items takes one comparison an item.
    """
    rest, edges = np.arange(count), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            met = rest[hit]
            edges += [(i, int(j)) for j in met]
            front += met.tolist()
            rest = rest[~hit]
    return edges


def needed_samples(similarity: float, missed: float) -> int:
    """The most equal samples that may be asked for, so that a pair of the similarity has fewer with probability ``missed`` at most."""
    below = 0.0
    for k in range(SAMPLES + 1):
        below += math.comb(SAMPLES, k) * similarity**k * (1 - similarity) ** (SAMPLES - k)
        if below > missed:
            return k
    return SAMPLES


def _bucket_links(need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _links_in_buckets(batches, need)

    return run


def _links_in_buckets(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "bucket"):
        bounds = group_bounds(table["bucket"])
        sids = table["sid"].to_pylist()
        samples = np.frombuffer(b"".join(table["samples"].to_pylist()), np.int32).reshape(-1, SAMPLES)
        links = set()
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        for i in pairs[(samples[pairs] == samples[pairs + 1]).sum(1) >= need]:
            links.add((sids[i], sids[i + 1]))
        for start, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            own = samples[start : start + size]
            links.update((sids[start + i], sids[start + j]) for i, j in forest(lambda i, rest, own=own: (own[rest] == own[i]).sum(1) >= need, size))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def root_positions(run: int) -> list[int]:
    """The sampling functions of a run's root, none of which another run has before all have had their turn."""
    first = run + -(-run // BRANCH)
    return [(first + i) % SAMPLES for i in range(1 + (run % BRANCH == 0))]


def missed_logs(similarity: float) -> list[list[float]]:
    """For roots of one and of two tokens, and leaves of each level: log of the probability that a run keeps a pair apart.

    A pair of the similarity shares a sampled token with that probability, and goes on together below it. With q for a
    node's subtree, f = 1 - similarity * (1 - q) keeps it apart below one token, and a node has one or two.
    """
    out, q = [[], []], 0.0
    for _ in range(LEVELS):
        f = 1 - similarity * (1 - q)
        out[0].append(math.log(f))
        out[1].append(2 * math.log(f))
        q = (1 - 1 / BRANCH) * f + f * f / BRANCH
    return out


def _children() -> str:
    """SQL for the child nodes of ``path`` that a set of ``samples`` goes on to: which functions a node samples is a hash of its path."""
    first = f"pmod(xxhash64(path, 1), {SAMPLES})"
    second = f"pmod({first} + 1 + pmod(xxhash64(path, 3), {SAMPLES - 1}), {SAMPLES})"
    child = lambda at: f"xxhash64(path, {at}, substring(samples, cast(4 * {at} + 1 as int), 4))"
    return f"if(pmod(xxhash64(path, 2), {BRANCH}) = 0, array({child(first)}, {child(second)}), array({child(first)}))"


def candidate_links(sets: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> DataFrame:
    """Links (a, b) that join all sets of at least the similarity into groups, with at least the recall; ``sets`` is (sid, samples).

    A run is a tree: a node samples one token of every set, or two, by functions that its path chooses, and a set goes on
    to a child for each. Nodes of at most LIMIT sets are compared by brute force on their samples; nodes of the last
    level are too, however many sets they have. How likely a partner is missed follows from the depth of a set's leaves;
    runs repeat, as often as it takes, for the sets whose leaves so far leave more than the recall allows. A quarter of
    what may be missed is left to the comparison of samples.
    """
    logs, allowed = missed_logs(similarity), 1 - recall
    need = needed_samples(similarity, allowed / 4)
    parts, waiting, total_runs, excess = [], sets.select("sid", "samples"), 0, None
    while True:
        runs = range(total_runs, total_runs + (MORE_RUNS if total_runs else RUNS))
        total_runs = runs.stop
        roots = [F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), F.lit(p), F.substring("samples", 4 * p + 1, 4)).alias("bucket")) for r in runs for p in root_positions(r)]
        found = waiting.select("sid", F.explode(F.array(*roots)).alias("r")).select("sid", "r.*")
        leaves, deep = [], []
        for level in range(1, LEVELS + 1):
            counts = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            # most sets are alone, or among few, after one level
            met = materialize(found.join((counts.where("n > 1") if level == 1 else counts).hint("merge"), "bucket"), "jaccard-level")
            split = (F.col("n") > LIMIT) & F.lit(level < LEVELS)
            leaves.append(met.where(~split & (F.col("n") > 1)).select("sid", "bucket", "n"))
            if level > 1:
                deep.append(met.select("sid", "run", F.lit(level).alias("level")))
            below = met.where(split).select("sid", "run", F.col("bucket").alias("path"))
            if below.isEmpty():
                break
            # written, since it is counted before it is joined
            found = materialize(below.join(waiting.hint("merge"), "sid").select("sid", "run", F.explode(F.expr(_children())).alias("bucket")), "jaccard-nodes")
        parts += _links_of(_all(leaves), waiting, need)
        if not deep:
            break
        # a run counts by its deepest leaf
        log = F.array(*(F.array(*map(F.lit, row)) for row in logs))
        tokens = F.when(F.col("run") % BRANCH == 0, 2).otherwise(1)
        deepest = _all(deep).groupBy("sid", "run").agg(F.max("level").alias("level"))
        more = deepest.select("sid", (log[tokens - 1][F.col("level") - 1] - log[tokens - 1][0]).alias("excess"))
        excess = materialize((more if excess is None else more.union(excess)).groupBy("sid").agg(F.sum("excess").alias("excess")), "jaccard-recall")
        sure = sum(logs[r % BRANCH == 0][0] for r in range(total_runs))
        lacking = excess.where(sure + F.col("excess") > math.log(0.75 * allowed)).select("sid")
        if lacking.isEmpty():
            break
        waiting = materialize(waiting.join(lacking.hint("shuffle_hash"), "sid", "left_semi"), "jaccard-waiting")
    return _all(parts)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _joined(placed: DataFrame, samples: DataFrame, need: int) -> DataFrame:
    """Links (a, b) that join the like sets of each bucket; ``placed`` is (sid, bucket), of LARGEST sets a bucket at most."""
    with_samples = placed.join(samples.hint("merge"), "sid")
    links = with_samples.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(need), "a binary, b binary").distinct()
    return materialize(links, "jaccard-links")


def _links_of(leaves: DataFrame, samples: DataFrame, need: int) -> list[DataFrame]:
    """Links (a, b) that join the like sets of each bucket; ``leaves`` is (sid, bucket, n).

    What is large even at the last level is alike in all its samples so far: all of it is compared with its least set,
    which joins the sets like that one; the others are compared with all of the bucket, in pairs of blocks.
    """
    large = F.col("n") > F.lit(LARGEST)
    parts = [_joined(leaves.where(~large).select("sid", "bucket"), samples, need)]
    heads = leaves.where(large).groupBy("bucket").agg(F.min("sid").alias("head"))
    if heads.isEmpty():
        return parts
    members = materialize(leaves.where(large).join(heads, "bucket").select("sid", "bucket", "head"), "jaccard-large")
    starred = members.select("sid", "head").distinct()
    starred = starred.join(samples, "sid").join(samples.select(F.col("sid").alias("head"), F.col("samples").alias("own")), "head")
    equal = sum((F.substring("samples", 4 * i + 1, 4) == F.substring("own", 4 * i + 1, 4)).cast("int") for i in range(SAMPLES))
    starred = materialize(starred.select("sid", "head", (equal >= need).alias("like")), "jaccard-heads")
    parts.append(starred.where("like").select(F.col("head").alias("a"), F.col("sid").alias("b")))
    if not starred.where("not like").isEmpty():
        parts.append(_joined(_block_pairs(members.join(starred, ["sid", "head"])), samples, need))
    return parts


def _block_pairs(members: DataFrame) -> DataFrame:
    """Buckets (sid, bucket) of at most two blocks in which every pair of a bucket's sets meets, but those ``like`` its head both."""
    unlike = F.sum((~F.col("like")).cast("long"))
    sizes = members.groupBy("bucket").agg(F.ceil(unlike / BLOCK).alias("others"), F.ceil((F.count(F.lit(1)) - unlike) / BLOCK).alias("likes")).where("others > 0")
    # buckets differ by run, so that a set's block does too
    block = F.when(F.col("like"), F.col("others") + F.expr("pmod(xxhash64(sid, bucket), likes)")).otherwise(F.expr("pmod(xxhash64(sid, bucket), others)"))
    last = F.when(F.col("like"), F.col("others")).otherwise(F.col("others") + F.col("likes")) - 1
    dealt = members.join(sizes, "bucket").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.select("sid", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"))


def _similar(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` (or of ``a`` among themselves) are similar: exact intersections by matrix products over shared tokens."""
    every = a + (b or [])
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, code, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(a), len(b) if b else len(a)), np.float64)
    for low in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(code, (low, low + COLUMNS))
        marks = np.zeros((len(every), COLUMNS), np.float32)
        marks[owner[i:j], code[i:j] - low] = 1
        both += marks[: len(a)] @ (marks[len(a) :] if b else marks).T
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in (b or a)])
    union = n[:, None] + m[None, :] - both
    out = both >= similarity * union - 1e-9
    if not b:
        np.fill_diagonal(out, False)
    return out


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            bounds = group_bounds(table["task"])
            sids, weights, left = table["sid"].to_pylist(), table["weight"].to_numpy(), table["side"].to_numpy()
            values = table["tokens"].combine_chunks()
            offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
            tokens = [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            parted = table["parted"].to_pylist()
            out_sid, out_links, out_root, out_parted = [], [], [], []
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                # rows that repeat bring their set once each
                items = np.array(sorted({sids[i]: i for i in range(end - 1, start - 1, -1)}.values()))
                a, b = items[left[items] == 0], items[left[items] == 1]
                if len(a) + len(b) < 2 or not len(a):
                    continue
                like = _similar([tokens[i] for i in a], [tokens[i] for i in b] if len(b) else None, similarity)
                w = weights[b if len(b) else a]
                links = dict(zip(a.tolist(), (like @ w).tolist(), strict=True))
                if len(b):
                    links |= dict(zip(b.tolist(), (weights[a] @ like).tolist(), strict=True))
                    near = np.zeros((len(a) + len(b),) * 2, bool)
                    near[: len(a), len(a) :] = like
                    near |= near.T
                else:
                    near = like
                every = np.concatenate([a, b])
                root = np.arange(len(every))
                for i, j in forest(lambda i, rest, near=near: near[i, rest], len(every)):
                    root[j] = root[i]
                for k, i in enumerate(every):
                    if links[int(i)]:
                        out_sid.append(sids[i])
                        out_links.append(links[int(i)])
                        out_root.append(sids[every[root[k]]])
                        out_parted.append(parted[start])
            columns = [pa.array(out_sid, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary()), pa.array(out_parted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "links", "root", "parted"])

    return run


def _tokens_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = [shingle_lanes(t.as_py(), words) for t in batch.column(4)]
            # a row of another text but an equal hash comes along: it is not the set's
            own = pa.array([set_digest(x) == sid for x, sid in zip(lanes, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            table = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x[:, 0].astype(np.int64) for x in lanes], pa.list_(pa.int64()))], names=["sid", "weight", "group", "size", "tokens"])
            yield table.filter(own)

    return run


def jaccard_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = TARGET_RECALL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): class_id, n_links, set_id, n_shingles.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``similarity``; n_links counts a document's links, class_id is the least doc_id that links lead to, set_id the least
    doc_id of an equal set. Documents of equal sets are one set with a weight. Chosen paths propose links between sets;
    their connected groups are then verified exactly, every pair of a group by its whole shingle sets, groups of many
    sets in pairs of blocks; and groups are formed again from the links that hold.

    A text of fewer words has one shingle of all its words; a null text, or one without words, links with nothing and
    is its own class. Rows of a repeated id count as documents; a null id is never the least unless all are null. An
    empty table gives an empty result, other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.xxhash64("doc_id", "text").alias("row")
    rows = materialize(docs.select("doc_id", "text", row).mapInArrow(_set_batches(words), f"doc_id {kind}, row bigint, sid binary, n_shingles bigint, samples binary"), "jaccard-docs")
    plain = rows.select("doc_id", "sid", "n_shingles")
    known = rows.where("sid is not null")
    sets = known.groupBy("sid").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("set_id"), F.min("row").alias("row"))
    # one row of each set has its samples: the least id's; equal rows are equal sets, so any of them serves
    samples = rows.where("sid is not null").select("sid", "samples").groupBy("sid").agg(F.first("samples").alias("samples"))
    samples = materialize(samples, "jaccard-sets")

    groups = connected_components(candidate_links(samples, similarity, recall)).withColumnsRenamed({"node": "sid", "root": "group"})
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    wanted = groups.join(sizes, "group").join(sets, "sid")
    wanted = materialize(wanted, "jaccard-wanted")
    # texts are read again for the sets in groups alone; their copies stay behind
    texts = docs.select(row, "text").join(wanted.hint("shuffle_hash"), "row")
    tokens = texts.select("sid", "weight", "group", "size", "text").mapInArrow(_tokens_batches(words), "sid binary, weight bigint, group binary, size bigint, tokens array<bigint>")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("sid"), blocks)
    dealt = tokens.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    task = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(task.alias("task"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), (blocks > 1).alias("parted"), "sid", "weight", "tokens")
    verified = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_verify(similarity), "sid binary, links bigint, root binary, parted boolean")
    verified = materialize(verified, "jaccard-verified")

    # a group verified in one task has its roots from there; parts of larger ones are joined by the links between blocks
    found = verified.where("not parted").select("sid", "root", "links")
    parted = verified.where("parted")
    if not parted.isEmpty():
        classes = connected_components(parted.select(F.col("sid").alias("a"), F.col("root").alias("b")))
        links = parted.groupBy("sid").agg(F.sum("links").alias("links"))
        found = found.unionByName(links.join(classes.select(F.col("node").alias("sid"), "root"), "sid"))
    named = sets.join(found, "sid", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "sid")), "jaccard-named")
    least = named.groupBy("root").agg(F.min("set_id").alias("class_id"))
    result = named.join(least, "root").select("sid", "class_id", "set_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # written, so that a set of very many documents can be split in the last join
    out = plain.join(materialize(result, "jaccard-result"), "sid", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("set_id", "doc_id").alias("set_id"), "n_shingles")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"))
