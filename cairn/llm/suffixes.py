"""Suffix-array dedup: bytes of strings that occur twice, found by difference-cover suffix sorting of what can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import keyed, materialize, read_table, release, text_or_empty
from cairn.llm.shingles import _BASE, _BYTE, _INVERSE, _power, group_bounds, mix, whole_groups

LENGTH = 200
#: Bytes of an anchor, and starts of a piece.
ANCHOR, PIECE = 32, 16
#: Distinct pieces of a group from which it is split to single starts, and bytes that are sorted at a time.
LARGE, SORT_BYTES = 2048, 2_000_000


# ---- the difference cover -------------------------------------------------------------------------------------------


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Ranks from 1 of rows in the order of their columns; equal rows have equal ranks."""
    high = [int(c.max(initial=0)) + 1 for c in columns]
    packed, span = columns[0].astype(np.int64), high[0]
    for c, h in zip(columns[1:], high[1:], strict=True):
        if span * h >= 1 << 62:
            distinct, packed = np.unique(packed, return_inverse=True)
            span = len(distinct)
        packed = packed * h + c
        span *= h
    distinct, inverse = np.unique(packed, return_inverse=True)
    return inverse + 1, len(distinct)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` (whole numbers from 1) in order, by the difference cover {1, 2} modulo 3.

    Suffixes at positions of the cover are sorted by their triples, whose ranks name them; where names repeat, the
    names of all positions 1, then of all positions 2, are a shorter text whose suffixes are sorted in turn. The
    remaining suffixes are sorted by their first letter and the next suffix's rank, and merged: against a suffix of the
    cover a remaining one is compared by one or two letters and ranks.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one more, past the end, keeps the two halves of the shorter text apart
    twos = np.arange(2, n, 3)
    cover = np.concatenate([ones, twos])
    names, distinct = _names([s[cover], s[cover + 1], s[cover + 2]])
    if distinct < len(cover):
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    ranks = np.zeros(n + 3, np.int64)
    ranks[cover[order]] = np.arange(1, len(cover) + 1)
    sorted_cover = cover[order]
    sorted_cover = sorted_cover[sorted_cover < n]
    rest = np.arange(0, n, 3)
    span = n + 4
    near = s[rest] * span + ranks[rest + 1]
    by = np.argsort(near, kind="stable")
    rest, near = rest[by], near[by]
    first = sorted_cover[sorted_cover % 3 == 1]
    second = sorted_cover[sorted_cover % 3 == 2]
    before = np.searchsorted(s[first] * span + ranks[first + 1], near)
    letters = int(s.max()) + 1
    if letters * letters * span < 1 << 62:
        far = (s[second] * letters + s[second + 1]) * span + ranks[second + 2]
        before += np.searchsorted(far, (s[rest] * letters + s[rest + 1]) * span + ranks[rest + 2])
    else:
        both = np.concatenate([second, rest])
        far = _names([s[both], s[both + 1], ranks[both + 2]])[0]
        before += np.searchsorted(far[: len(second)], far[len(second) :])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    out[at] = rest
    covered = np.ones(n, bool)
    covered[at] = False
    out[covered] = sorted_cover
    return out


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece the offsets at which a string of ``length`` bytes begins that begins elsewhere in the pieces too."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    text = np.zeros(len(raw) + len(pieces), np.int64)
    place = np.arange(len(raw)) + np.repeat(np.arange(len(pieces)), sizes)
    text[place] = raw.astype(np.int64) + 2
    text[text == 0] = 1  # between pieces
    firsts = ends - sizes + np.arange(len(pieces))
    room = np.repeat(firsts + sizes, sizes + 1) - np.arange(len(text))  # bytes of the piece from here
    order = suffix_array(text)
    order = order[room[order] >= length]
    repeated = np.zeros(len(text), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in range(0, length):
            live = np.flatnonzero(same)
            if not len(live):
                break
            same[live] = text[order[live] + k] == text[order[live + 1] + k]
        repeated[order[:-1][same]] = True
        repeated[order[1:][same]] = True
    return [np.flatnonzero(repeated[f : f + n]) for f, n in zip(firsts, sizes, strict=True)]


# ---- phrases: what can repeat ---------------------------------------------------------------------------------------


def _hashes(a: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes: equal strings have equal ones; that others differ, nothing rests on."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * _power("up", _BASE, len(a)))])
    return mix((sums[size:] - sums[:-size]) * _power("down", _INVERSE, len(a))[: len(a) - size + 1])


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, by running minima within blocks from both ends."""
    m = len(h)
    blocks = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:m] = h
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: m - w + 1], ahead[w - 1 : m])


def content_names(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """128 bits of hash of strings of ``raw``, in two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(starts, ends, strict=True)]), np.int64).reshape(-1, 2)


def phrases(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR):
    """The phrases of a text: (anchor hashes, content hashes, first starts, numbers of starts, whether an anchor recurs within, contents' other hashes).

    The anchor of a string of ``length`` bytes is the least hash among its ``anchor``-byte strings, so equal strings have
    equal anchors, wherever they are. A phrase is a run of starts of the same anchor; its content is all their bytes.
    """
    if len(raw) < length:
        return None
    a = np.frombuffer(raw, np.uint8)
    w = length - anchor + 1
    h = _hashes(a, anchor)
    least = _window_least(h, w)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(starts[1:], len(least))
    runs = ends - starts
    anchors = least[starts]
    content = content_names(raw, starts.tolist(), (ends - 1 + length).tolist())
    recurs = np.zeros(len(starts), bool)
    recurs[_recurring(h, anchors, starts, ends, w)] = True
    return anchors, content[:, 0], starts, runs, recurs, content[:, 1]


def _recurring(h: np.ndarray, anchors: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int) -> list[int]:
    """The phrases in which a string of their anchor's hash stands more than once."""
    values, counts = np.unique(h, return_counts=True)
    twice = values[counts > 1]
    if not len(twice):
        return []
    return [i for i in np.flatnonzero(np.isin(anchors, twice)) if np.count_nonzero(h[starts[i] : ends[i] - 1 + w] == anchors[i]) > 1]


def _phrase_batches(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for u, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = phrases((text.as_py() or "").encode(), length, anchor)
                if found is not None:
                    held.append((u, v, found))
                    size += len(found[0])
                if size > 200_000:
                    yield _phrase_batch(held)
                    held, size = [], 0
            if held:
                yield _phrase_batch(held)

    return run


def _phrase_batch(held: list) -> pa.RecordBatch:
    n = [len(f[0]) for _, _, f in held]
    cat = [np.concatenate([f[k] for _, _, f in held]) for k in range(6)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([u for u, _, _ in held], n)), pa.array(np.repeat([v for _, v, _ in held], n)), pa.array(cat[0].view(np.int64)), pa.array(cat[1]), pa.array(cat[5]), pa.array(cat[2].astype(np.int32)), pa.array(cat[3].astype(np.int32)), pa.array(cat[4])],
        names=["u", "v", "anchor", "content", "content2", "start", "run", "recurs"],
    )


def pieces(text: bytes, start: int, run: int, anchor_hash: int, length: int = LENGTH, anchor: int = ANCHOR, size: int = PIECE) -> list[tuple[int, int, int, int, int]]:
    """A phrase in pieces (key, content hashes, first start, end of starts): starts whose distance to the anchor falls in one step of ``size``.

    The key hashes the bytes that all starts of the step have in common, and the step: equal strings are in pieces of equal keys.
    """
    a = np.frombuffer(text[start : start + run + length - 1], np.uint8)
    h = _hashes(a, anchor)
    at = np.flatnonzero(h == np.uint64(anchor_hash & 0xFFFFFFFFFFFFFFFF))
    own = at[np.searchsorted(at, np.arange(run))]
    step = (own - np.arange(run)) // size
    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (step[1:] != step[:-1])]))
    out = []
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), run], strict=True):
        low = start + int(own[x]) - int(step[x]) * size
        core = text[low : low - size + 1 + length]
        out.append((xxhash.xxh3_64_intdigest(core, int(step[x])) - (1 << 63), start + x, start + y))
    names = content_names(text, [x for _, x, _ in out], [y - 1 + length for _, _, y in out]).tolist()
    return [(key, *name, x, y) for (key, x, y), name in zip(out, names, strict=True)]


def _piece_batches(length: int, anchor: int):
    """Pieces of the open phrases of each text, equal ones of a text in one row with all their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, v, text, marks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw, found = text.encode(), {}
                for m in marks:
                    if m["open"]:
                        for key, content, content2, x, y in pieces(raw, m["start"], m["run"], m["anchor"], length, anchor):
                            found.setdefault((m["anchor"], key, content, content2, y - x), []).append(x)
                rows += [(u, v, *k, xs) for k, xs in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 6 + [pa.int32(), pa.list_(pa.int32())])], names=["u", "v", "anchor", "key", "content", "content2", "run", "starts"]
            )

    return run


def _piece_text_batches(length: int):
    """The bytes of the open pieces of each text; pieces of large groups in single starts, which need no sorting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, v, text, marks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                rows += [(u, v, m["anchor"], m["key"], m["starts"][0], raw[m["starts"][0] : m["starts"][0] + m["run"] + length - 1]) for m in marks if m["open"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 4 + [pa.int32(), pa.binary()])], names=["u", "v", "anchor", "key", "start", "bytes"])

    return run


def _sort_batches(length: int):
    """Suffix-sorts whole groups, as many at a time as SORT_BYTES allows, and returns the starts that repeat."""

    def solve(us, vs, starts, contents) -> pa.RecordBatch:
        found = repeated_starts(contents, length)
        rows = [(u, v, (f + s).tolist()) for u, v, s, f in zip(us, vs, starts, found, strict=True) if len(f)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.list_(pa.int32())])], names=["u", "v", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for table in whole_groups(batches, "key"):
            bounds = group_bounds(table["key"])
            columns = [table[c].to_pylist() for c in ("u", "v", "start", "bytes")]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                for have, column in zip(held, columns, strict=True):
                    have += column[low:high]
                size += sum(map(len, columns[3][low:high]))
                if size >= SORT_BYTES:
                    yield solve(*held)
                    held, size = ([], [], [], []), 0
        if held[0]:
            yield solve(*held)

    return run


def _cover_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, v, text, marks, extra in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                raw = text.encode()
                edges = np.zeros(len(raw) + 1, np.int64)
                whole = [m for m in marks if m["repeated"]]
                x = np.array([m["start"] for m in whole] + [e["start"] for e in extra or []], np.int64)
                y = np.array([m["start"] + m["run"] for m in whole] + [e["start"] + e["run"] for e in extra or []], np.int64)
                np.add.at(edges, x, 1)
                np.add.at(edges, y - 1 + length, -1)
                gone = np.cumsum(edges)[:-1] > 0
                turns = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                spans = list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((u, v, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans], kept.decode("utf-8", "ignore")))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()])],
                names=["u", "v", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    return run


def _open_and_repeated(rows: DataFrame, keys: list[str], content: list[str], count) -> DataFrame:
    """Adds to rows of (keys, content) whether the content is ``repeated`` and whether the group is ``open``: it has other contents too.

    Counts are combined before they meet the rows, so a content of very many rows gathers nowhere.
    """
    kinds = rows.groupBy(*keys, *content).agg(count.alias("n"), F.max("recurs").alias("recurs"))
    groups = kinds.groupBy(*keys).agg(F.count(F.lit(1)).alias("kinds"), F.max("recurs").alias("any")).where("kinds > 1 or any")
    # what is looked up is written, so that both sides of a join are plain exchanges, of which a key of very many rows is split
    groups = materialize(groups.select(*keys, F.lit(True).alias("open")), "suffixes-groups")
    info = kinds.drop("recurs").join(groups, keys, "left").withColumns({"repeated": F.col("n") > 1, "open": F.coalesce("open", F.lit(False))})
    info = materialize(info.where("repeated or open").drop("n"), "suffixes-kinds")
    return rows.drop("recurs").join(info, [*keys, *content])


def _first_of_repeated(rows: DataFrame, keys: list[str], first_start) -> DataFrame:
    """Keeps ``open`` on one row only of a repeated content: its strings are known to repeat, but others may repeat them."""
    place = F.struct("u", "v", first_start.alias("at"))
    heads = materialize(rows.where("open and repeated").groupBy(*keys).agg(F.min(place).alias("head")), "suffixes-heads")
    joined = rows.join(heads, keys, "left")
    return joined.withColumn("open", F.col("open") & (~F.col("repeated") | (place == F.col("head")))).drop("head")


def _evidence(docs: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Steps 1 to 3 of :func:`repeated_bytes`: texts with their phrases' marks, then the strings (u, v, start, run) that

    repeat by their pieces' names, by the sort, and by counts; the open pieces; and what to release when all are read.
    """
    found = docs.where(F.octet_length("text") >= length).mapInArrow(_phrase_batches(length, anchor), "u bigint, v bigint, anchor bigint, content bigint, content2 bigint, start int, run int, recurs boolean")
    rows = materialize(found, "suffixes-phrases")
    again = materialize(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("recurs").alias("r")).where("n > 1 or r").select("anchor"), "suffixes-again")
    rows2 = materialize(rows.join(again, "anchor"), "suffixes-anchors")
    release(rows, again)
    marked = materialize(_open_and_repeated(rows2, ["anchor"], ["content", "content2"], F.count(F.lit(1))), "suffixes-marked")
    release(rows2)
    marked2 = _first_of_repeated(marked, ["anchor", "content", "content2"], F.col("start"))
    marks = marked2.groupBy("u", "v").agg(F.collect_set(F.struct("start", "run", "anchor", "repeated", "open")).alias("marks"))
    work = materialize(docs.join(marks.hint("shuffle_hash"), ["u", "v"]), "suffixes-texts")
    release(marked)

    cut = work.where("exists(marks, m -> m.open)").mapInArrow(_piece_batches(length, anchor), "u bigint, v bigint, anchor bigint, key bigint, content bigint, content2 bigint, run int, starts array<int>")
    cut = materialize(cut.withColumn("recurs", F.lit(False)), "suffixes-pieces")
    piece = _open_and_repeated(cut, ["anchor", "key"], ["content", "content2", "run"], F.sum(F.size("starts")))
    piece = materialize(_first_of_repeated(piece, ["anchor", "key", "content", "content2", "run"], F.col("starts")[0]), "suffixes-open")
    release(cut)
    # repeated pieces are known by now, whichever group they are in
    known = piece.where("repeated").select("u", "v", F.explode("starts").alias("start"), "run")
    asked = piece.where("open").groupBy("u", "v").agg(F.collect_set(F.struct("anchor", "key", "starts", "run", "open")).alias("asked"))
    texts = work.select("u", "v", "text").join(asked, ["u", "v"]).mapInArrow(_piece_text_batches(length), "u bigint, v bigint, anchor bigint, key bigint, start int, bytes binary")
    texts = materialize(texts.withColumn("key", F.xxhash64("anchor", "key")).drop("anchor"), "suffixes-piece-texts")
    sizes = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > LARGE)
    small = texts.join(large, "key", "left_anti")
    sorted_ = small.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_batches(length), "u bigint, v bigint, starts array<int>")
    single = texts.join(large, "key").select("u", "v", F.posexplode(F.sequence(F.lit(1), F.octet_length("bytes") - length + 1)).alias("i", "p"), "start", "bytes")
    single = single.select("u", "v", (F.col("start") + F.col("i")).alias("start"), F.xxhash64(F.expr(f"substring(bytes, p, {length})")).alias("a"), F.xxhash64(F.lit(1), F.expr(f"substring(bytes, p, {length})")).alias("b"))
    twice = single.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    one = F.lit(1).alias("run")
    return work, known, sorted_.select("u", "v", F.explode("starts").alias("start"), one), single.join(twice, ["a", "b"]).select("u", "v", "start", one), texts, (piece, texts)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per distinct row (u, v) with removed bytes: n_removed, n_spans, kept_sha256, spans and ``kept``; ``docs`` is (u, v, text).

    ``kept`` is the remaining bytes as text, without what is left of a character that a span cuts.

    A byte goes if a string of ``length`` bytes covers it that starts anywhere else too, in any text.

    (1) Texts are cut to phrases at anchors that equal strings share. A phrase whose anchor is nowhere else repeats
    nothing; a phrase of equal content elsewhere repeats whole. (2) The others, at the ends of repeats, are cut to
    pieces by distance from the anchor, and again only pieces that share nearly all bytes with different ones stay
    open. (3) Open pieces, and one of each kind they may repeat, are dealt by what they share; each task sorts their
    suffixes by the difference cover and compares neighbours' first ``length`` bytes. Groups of very many pieces are cut
    to single strings, of which equal ones are counted instead. (4) Spans are joined to the texts they come from.
    """
    work, known, sorted_, counted, _, temporary = _evidence(docs, length, anchor)
    extra = materialize(known.union(sorted_).union(counted).groupBy("u", "v").agg(F.collect_set(F.struct("start", "run")).alias("extra")), "suffixes-extra")
    release(*temporary)
    covered = work.join(extra, ["u", "v"], "left").select("u", "v", "text", "marks", "extra").mapInArrow(
        _cover_batches(length), "u bigint, v bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string"
    )
    return covered.where("n_removed > 0")


def dedup_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256; see :func:`repeated_bytes`.

    Texts are UTF-8 bytes, a null text is empty, matches don't cross texts, overlapping matches of a text with itself
    count. Rows of equal id and text are texts of their own: they repeat one another. An empty table gives an empty
    result; other columns are not read.
    """
    texts = keyed(docs.select("doc_id", text_or_empty().alias("text")))
    cut = repeated_bytes(texts.select("u", "v", "text"), length).select("u", "v", "n_removed", "n_spans", "kept_sha256").groupBy("u", "v").agg(*(F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")))
    cut = materialize(cut, "suffixes-result")
    whole = texts.select("doc_id", "u", "v", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    out = whole.join(cut, ["u", "v"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read_table(spark, sf_dir, "documents"))
