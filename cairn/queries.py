"""The registered queries over the reference tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.functions.keys import Key
from cairn.model import Chunker, Compression, Config
from cairn.operators import chunking, codecs, compare, dedup, integrity, restore, retention, rollup, usage, views
from cairn.plans.repository import Repository
from cairn.sources import tables as src
from cairn.tables import materialize, read_table, scratch_root, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# ---- SQL of the derived tables --------------------------------------------------------------------------------------

DOCS = (
    "docs AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, 'file' AS type, octet_length(encode(text)) AS size, 420::BIGINT AS mode, doc_id % 7 AS uid, doc_id % 3 AS gid,"
    " 1704067200 + 60 * doc_id AS mtime, encode(text) AS data, text, doc_id, source, lang FROM documents)"
)
REFS = f"{DOCS}, refs AS (SELECT path, doc_id, ord::INT AS ord, (ord * 1024)::BIGINT AS offset_, data[ord * 1024 + 1 : ord * 1024 + 1024] AS chunk FROM docs, unnest(range(0, size // 1024 + 1)) AS t(ord) WHERE size > 0), "
REFS += "crefs AS (SELECT path, doc_id, ord, offset_, octet_length(chunk)::BIGINT AS len, md5(chunk) AS hash FROM refs)"
SEEN = f"{REFS}, seen AS (SELECT hash, len, path, ord FROM (SELECT *, row_number() OVER (PARTITION BY hash, len ORDER BY path, ord) AS rn FROM crefs) WHERE rn = 1)"
PACKED = (
    f"{SEEN}, placed AS (SELECT *, ((sum(len) OVER (ORDER BY path, ord ROWS UNBOUNDED PRECEDING) - len) // 65536)::BIGINT AS bundle_no FROM seen),"
    " packed AS (SELECT *, (row_number() OVER (PARTITION BY bundle_no ORDER BY path, ord) - 1)::BIGINT AS chunk_no FROM placed)"
)
BUNDLES = (
    f"{PACKED}, bundles AS (SELECT bundle_no, sum(len)::BIGINT AS raw_size, sum(len * 3 // 5)::BIGINT AS encoded_size, count(*) AS chunk_count,"
    " CASE WHEN bundle_no % 5 = 0 THEN 'meta' ELSE 'data' END AS mode, md5(string_agg(hash || ':' || len, ',' ORDER BY chunk_no)) AS bundle_id FROM packed GROUP BY bundle_no)"
)
USAGE = (
    f"{BUNDLES}, live AS (SELECT DISTINCT hash FROM crefs WHERE doc_id IN (SELECT doc_id FROM labels)), used AS (SELECT bundle_no, sum(len) AS used_raw, count(*) AS used_chunks FROM packed JOIN live USING (hash) GROUP BY 1),"
    " usage_ AS (SELECT *, floor(ratio * encoded_size)::BIGINT AS used_size, floor((1 - ratio) * encoded_size)::BIGINT AS unused_size FROM (SELECT b.*, coalesce(used_raw, 0)::BIGINT AS used_raw,"
    " coalesce(used_chunks, 0)::BIGINT AS used_chunks, coalesce(used_raw, 0)::DOUBLE / raw_size AS ratio FROM bundles b LEFT JOIN used USING (bundle_no)))"
)


def snapshot_sql(version: int) -> str:
    changed = "doc_id % 7 = 0" if version >= 2 else "false"
    touched = "doc_id % 13 = 0" if version >= 3 else "false"
    drop = 0 if version == 1 else 1
    return (
        f"v{version} AS (SELECT path, type, octet_length(encode(t)) AS size, mode, uid, gid, mtime + CASE WHEN {changed} THEN 86400 ELSE 0 END + CASE WHEN {touched} THEN 3600 ELSE 0 END AS mtime, md5(t) AS content_id, doc_id"
        f" FROM (SELECT *, CASE WHEN {changed} THEN text || ' v2' ELSE text END AS t FROM docs WHERE doc_id % 10 <> {drop}))"
    )


ANCESTORS = "list_concat(['/'], [array_to_string(string_split(path, '/')[1:i], '/') for i in range(2, len(string_split(path, '/')))])"


# ---- content ---------------------------------------------------------------------------------------------------------


@query(f"WITH {REFS} SELECT doc_id, ord, offset_ AS \"offset\", len, hash FROM crefs")
def chunk_fixed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.references(spark, sf_dir).select("doc_id", "ord", "offset", "len", "hash")


_SAVED = "1 - sum(len)::DOUBLE / sum(n * len) AS saved"


@query(
    f"WITH {REFS}, p AS (SELECT encode(html) AS data FROM pages), prefs AS (SELECT data[ord * 1024 + 1 : ord * 1024 + 1024] AS chunk FROM p, unnest(range(0, octet_length(data) // 1024 + 1)) AS t(ord) WHERE octet_length(data) > 0),"
    " every AS (SELECT 'documents' AS origin, hash, len FROM crefs UNION ALL SELECT 'pages', md5(chunk), octet_length(chunk) FROM prefs), each AS (SELECT origin, hash, count(*) AS n, max(len) AS len FROM every GROUP BY ALL)"
    f" SELECT origin, sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(n * len)::BIGINT AS bytes, sum(len)::BIGINT AS unique_bytes, {_SAVED} FROM each GROUP BY origin"
)
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = src.references(spark, sf_dir).select(F.lit("documents").alias("origin"), "hash", "len")
    pages = chunking.fixed_chunks(src.pages(spark, sf_dir), "data", src.CHUNK, []).select(F.lit("pages").alias("origin"), "hash", "len")
    return dedup.savings(documents.union(pages), ["origin"])


@query(
    f"WITH {REFS}, s AS (SELECT source, hash, len FROM crefs JOIN docs USING (doc_id)), each AS (SELECT source, hash, count(*) AS n, max(len) AS len FROM s GROUP BY ALL)"
    f" SELECT source, sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(n * len)::BIGINT AS bytes, sum(len)::BIGINT AS unique_bytes, {_SAVED} FROM each GROUP BY source UNION ALL"
    f" SELECT NULL, sum(n)::BIGINT, count(*), sum(n * len)::BIGINT, sum(len)::BIGINT, {_SAVED} FROM (SELECT hash, sum(n) AS n, max(len) AS len FROM each GROUP BY hash)"
)
def dedup_by_source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = chunking.fixed_chunks(src.documents(spark, sf_dir), "data", src.CHUNK, ["source"])
    total = dedup.savings(refs.withColumn("source", F.lit(None).cast("string")), ["source"])
    return dedup.savings(refs, ["source"]).unionByName(total)


@query(
    f"WITH {REFS}, p AS (SELECT encode(html) AS data FROM pages), prefs AS (SELECT data[ord * 1024 + 1 : ord * 1024 + 1024] AS chunk FROM p, unnest(range(0, octet_length(data) // 1024 + 1)) AS t(ord) WHERE octet_length(data) > 0)"
    " SELECT hash, max(len)::BIGINT AS len FROM (SELECT md5(chunk) AS hash, octet_length(chunk) AS len FROM prefs) WHERE hash NOT IN (SELECT hash FROM crefs) GROUP BY hash"
)
def cross_table_dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = chunking.fixed_chunks(src.pages(spark, sf_dir), "data", src.CHUNK, [])
    return dedup.new_chunks(pages, src.references(spark, sf_dir))


_TIER = "CASE WHEN size <= 0 THEN 'none' WHEN size < 100 THEN 'inline' WHEN size // 512 + 1 < 10 THEN 'direct' ELSE 'indirect' END"


@query(f"WITH {DOCS}, e AS (SELECT 'documents' AS origin, size FROM docs UNION ALL SELECT 'conversations', octet_length(encode(text)) FROM conversations) SELECT origin, {_TIER} AS tier, count(*) AS files, sum(size)::BIGINT AS bytes FROM e GROUP BY ALL")
def storage_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = src.documents(spark, sf_dir).select(F.lit("documents").alias("origin"), "size").union(read_table(spark, sf_dir, "conversations").select(F.lit("conversations"), F.octet_length("text").cast("long")))
    tier = dedup.storage_tier(F.col("size"), F.floor(F.col("size") / 512) + 1)
    return sizes.groupBy("origin", tier.alias("tier")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {REFS}, e AS (SELECT hash, count(*) AS n, max(len) AS len FROM crefs GROUP BY hash) SELECT sum(n - 1)::BIGINT AS dup_chunks, sum((n - 1) * len)::BIGINT AS dup_bytes, sum(n * len)::BIGINT AS bytes, sum((n - 1) * len)::DOUBLE / sum(n * len) AS dup_share FROM e")
def internal_dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.internal_ratio(src.references(spark, sf_dir))


@query(f"WITH {REFS} SELECT count(*) AS n, avg(len) AS mean, stddev_samp(len) AS deviation FROM crefs")
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.references(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), F.stddev_samp("len").alias("deviation"))


@query(f"WITH {SEEN} SELECT hash, len, path, ord FROM seen")
def first_seen_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_seen(src.references(spark, sf_dir), ["path", "ord"], []).select("hash", "len", "path", "ord")


# ---- comparison ------------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT md5(text) AS content_id, size, count(*) AS copies, min(path) AS first_path FROM docs WHERE size >= 1 GROUP BY ALL HAVING count(*) > 1")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.duplicates(src.documents(spark, sf_dir))


@query(f"WITH {DOCS}, f AS (SELECT path, size, text FROM docs UNION ALL SELECT '/talk/' || conv_id || '/' || turn, octet_length(encode(text)), text FROM conversations) SELECT md5(text) AS content_id, size, count(*) AS copies, min(path) AS first_path FROM f WHERE size >= 300 GROUP BY ALL HAVING count(*) > 1")
def duplicates_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("text").cast("binary")
    turns = read_table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("/talk"), "conv_id", "turn").alias("path"), F.octet_length(data).cast("long").alias("size"), data.alias("data"))
    return compare.duplicates(src.documents(spark, sf_dir).select("path", "size", "data").union(turns), 300)


@query(f"WITH {DOCS}, g AS (SELECT md5(text) AS content_id, count(*) AS copies FROM docs WHERE size >= 100 GROUP BY 1 HAVING count(*) > 1) SELECT md5(text) AS content_id, copies, path, size FROM docs JOIN g ON md5(text) = content_id WHERE size >= 100")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.duplicate_members(src.documents(spark, sf_dir), 100).select("content_id", "copies", "path", "size")


_FULL = (
    "SELECT path, type, size, mode, uid, gid, mtime, content_id FROM {v} UNION ALL SELECT DISTINCT d, 'directory', 0, 493, 0, 0, 0, NULL FROM (SELECT unnest(" + ANCESTORS + ") AS d FROM {v})"
)
_DIFF = (
    "o AS ({old}), n AS ({new}), ch AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'del' WHEN o.size <> n.size OR o.mtime <> n.mtime OR o.type <> n.type OR o.mode <> n.mode"
    " OR o.content_id IS DISTINCT FROM n.content_id THEN 'mod' END AS change FROM o FULL JOIN n ON o.path = n.path), c AS (SELECT * FROM ch WHERE change IS NOT NULL)"
    " SELECT change, path FROM c WHERE change = 'mod' OR CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END NOT IN (SELECT path FROM c WHERE change <> 'mod')"
)


def _full_tree(entries: DataFrame) -> DataFrame:
    entries = entries.select("path", "type", "size", "mode", "uid", "gid", "mtime", "content_id")
    return rollup.with_directories(entries, {"type": "directory", "size": 0, "mode": 493, "uid": 0, "gid": 0, "mtime": 0})


@query(f"WITH {DOCS}, {snapshot_sql(1)}, {snapshot_sql(2)}, " + _DIFF.format(old=_FULL.format(v="v1"), new=_FULL.format(v="v2")))
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff(_full_tree(src.snapshot(spark, sf_dir, 1)), _full_tree(src.snapshot(spark, sf_dir, 2)))


@query(f"WITH {DOCS}, {snapshot_sql(2)}, {snapshot_sql(3)}, " + _DIFF.format(old=_FULL.format(v="v2"), new=_FULL.format(v="(SELECT * FROM v3 WHERE doc_id % 50 <> 3 AND NOT starts_with(path, '/src3/'))")))
def snapshot_diff_removed_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = src.snapshot(spark, sf_dir, 3).where("doc_id % 50 <> 3 and source <> 'src3'")
    return compare.diff(_full_tree(src.snapshot(spark, sf_dir, 2)), _full_tree(new))


_CHANGED = "o.path IS NULL OR o.mtime <> n.mtime OR o.size <> n.size OR o.type <> n.type"


@query(f"WITH {DOCS}, {snapshot_sql(1)}, {snapshot_sql(2)} SELECT count(*) AS entries, sum(n.size)::BIGINT AS size, count(*) FILTER ({_CHANGED}) AS changed_entries, sum(CASE WHEN {_CHANGED} THEN n.size ELSE 0 END)::BIGINT AS changed_size FROM v2 n LEFT JOIN v1 o USING (path)")
def snapshot_changed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.changed_bytes(src.snapshot(spark, sf_dir, 2), src.snapshot(spark, sf_dir, 1))


@query(f"WITH {DOCS}, {snapshot_sql(2)}, {snapshot_sql(3)} SELECT n.path, coalesce(o.mtime = n.mtime AND o.size = n.size AND o.type = n.type, false) AS unchanged FROM v3 n LEFT JOIN v2 o USING (path)")
def unchanged_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["path", "type", "size", "mtime"]
    return compare_unchanged(src.snapshot(spark, sf_dir, 3).select(columns), src.snapshot(spark, sf_dir, 2).select(columns))


def compare_unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    return dedup.unchanged(current, previous).select("path", "unchanged")


@query("SELECT user_id::VARCHAR AS path, event_type AS type, date_trunc('day', ts)::TIMESTAMP AS mtime, floor(value)::BIGINT AS size, min(event_id) AS snapshot FROM events GROUP BY 1, 2, 3, 4")
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    e = e.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("type"), F.date_trunc("day", "ts").alias("mtime"), F.floor("value").cast("long").alias("size"), F.col("event_id").alias("snapshot"))
    return compare.versions(e)


@query("WITH n AS (SELECT n_nationkey AS id, n_name AS name FROM nation), l AS (SELECT (n_nationkey + 7) % 30 AS id, n_name AS name FROM nation WHERE n_nationkey % 4 <> 3) SELECT c_custkey, c_nationkey AS uid, n.name, coalesce(l.id, c_nationkey)::INT AS local_uid FROM customer LEFT JOIN n ON n.id = c_nationkey LEFT JOIN l ON l.name = n.name")
def owner_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    there = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    here = nation.where("n_nationkey % 4 <> 3").select(((F.col("n_nationkey") + 7) % 30).alias("id"), F.col("n_name").alias("name"))
    entries = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("uid"))
    return compare.remap_owner(entries, there, here).select("c_custkey", "uid", "name", "local_uid")


# ---- directories -----------------------------------------------------------------------------------------------------

_ROLLUP = (
    "t AS (SELECT size, unnest(" + ANCESTORS + ") AS dir FROM {e}), f AS (SELECT dir, sum(size)::BIGINT AS cum_size, count(*) AS cum_files FROM t GROUP BY dir), ds AS (SELECT DISTINCT dir FROM t),"
    " g AS (SELECT u.dir, count(*) AS cum_dirs FROM ds u JOIN ds d ON u.dir = d.dir OR u.dir = '/' OR starts_with(d.dir, u.dir || '/') GROUP BY u.dir) SELECT dir AS path, cum_size, cum_dirs, cum_files FROM f JOIN g USING (dir)"
)
PAGES = "pgs AS (SELECT '/' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '/' || page_id || '.html' AS path, octet_length(encode(html)) AS size, page_id, url FROM pages)"


@query(f"WITH {DOCS}, " + _ROLLUP.format(e="docs"))
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(src.documents(spark, sf_dir))


@query(f"WITH {PAGES}, " + _ROLLUP.format(e="pgs"))
def dir_rollup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(src.pages(spark, sf_dir))


@query(f"WITH {DOCS} SELECT doc_id || '.txt' AS name, path, size FROM docs WHERE source = 'src1' AND lang = 'en'")
def dir_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.listing(rollup.with_names(src.documents(spark, sf_dir)), "/src1/en").select("name", "path", "size")


@query(f"WITH {DOCS} SELECT '/' || source || '/' || lang AS parent, doc_id || '.txt' AS name, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id || '.txt'))::INT AS place FROM docs QUALIFY place > 10")
def dir_read_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.numbered_listing(rollup.with_names(src.documents(spark, sf_dir)), 10).select("parent", "name", "place")


@query(f"WITH {PAGES} SELECT page_id, unnest({ANCESTORS}) AS ancestor FROM pgs")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.pages(spark, sf_dir).select("page_id", F.explode(scalars.ancestors(F.col("path"))).alias("ancestor"))


@query("SELECT p AS path, count(*) AS names FROM (SELECT unnest(['/', '/' || o_orderpriority[1:1], '/' || o_orderpriority[1:1] || '/' || o_orderstatus]) AS p FROM orders) GROUP BY p")
def snapshot_name_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_table(spark, sf_dir, "orders").select(F.concat_ws("/", F.substring("o_orderpriority", 1, 1), "o_orderstatus", F.col("o_orderkey").cast("string")).alias("snapshot"))
    return rollup.name_tree(names, "snapshot")


@query(f"WITH {DOCS}, {snapshot_sql(2)} SELECT path, size, mtime FROM v2 WHERE NOT starts_with(path, '/src1/')")
def snapshot_remove_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.remove_subtree(src.snapshot(spark, sf_dir, 2), "/src1").select("path", "size", "mtime")


@query(f"WITH {DOCS} SELECT path, type, size, size // 512 AS blocks, mtime, mode, uid, gid, (gid * 256 + uid)::BIGINT AS rdev FROM docs")
def entry_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.documents(spark, sf_dir).select("path", "type", "size", F.floor(F.col("size") / 512).alias("blocks"), "mtime", "mode", "uid", "gid", scalars.device_number(F.col("gid"), F.col("uid")).alias("rdev"))


@query(f"WITH {DOCS}, asked AS (SELECT DISTINCT '/' || source || '/' || lang AS parent, (doc_id + n) || '.txt' AS name FROM documents JOIN labels USING (doc_id), (VALUES (0), (1)) t(n)) SELECT path, type AS kind, size, size // 512 AS blocks, mode & 4095 AS perm, uid, gid FROM docs JOIN asked ON path = parent || '/' || name")
def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of names asked for in all directories: those of labelled documents, and their next numbers, which are mostly not there."""
    docs = src.documents(spark, sf_dir)
    asked = docs.join(read_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select(scalars.parent(F.col("path")).alias("parent"), F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("n"))
    asked = asked.select("parent", F.format_string("%d.txt", "n").alias("name")).distinct()
    return views.attributes(views.lookup_all(docs, asked)).select("path", "kind", "size", "blocks", "perm", "uid", "gid")


@query("SELECT event_id, strftime(ts, '%a, %-d %b %Y %H:%M:%S') || ' +0000' AS shown FROM events")
def mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", scalars.mail_date(F.unix_timestamp("ts")).alias("shown"))


@query("SELECT p_partkey, (p_partkey >> 8)::BIGINT AS major, (p_partkey & 255)::BIGINT AS minor, p_partkey AS back FROM part")
def device_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    major, minor = scalars.device_major(F.col("p_partkey")), scalars.device_minor(F.col("p_partkey"))
    return read_table(spark, sf_dir, "part").select("p_partkey", major.alias("major"), minor.alias("minor"), scalars.device_number(major, minor).alias("back"))


@query(
    "SELECT page_id, url FROM pages WHERE NOT (regexp_matches(path, '/[^/]*\\.casino[^/]*($|/)') OR regexp_matches(path, '^/m\\.[^/]*($|/)') OR regexp_matches(path, '/7.\\.html($|/)'))".replace(
        "FROM pages", f"FROM (SELECT page_id, url, '/' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '/' || page_id || '.html' AS path FROM pages)"
    )
)
def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ["# hosts", "", "*.casino*", "/m.*", "7?.html"]
    return src.pages(spark, sf_dir).where(~scalars.excluded(F.col("path"), patterns)).select("page_id", "url")


# ---- retention -------------------------------------------------------------------------------------------------------

_PERIOD = {"daily": "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)", "weekly": "isoyear(o_orderdate) * 100 + week(o_orderdate)", "monthly": "year(o_orderdate) * 100 + month(o_orderdate)", "yearly": "year(o_orderdate)"}


def _retention_sql(**counts: int) -> str:
    parts = [
        f"keep_{u} AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY {_PERIOD[u]} ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, dense_rank() OVER (ORDER BY {_PERIOD[u]} DESC) AS d FROM orders) WHERE r = 1 AND d <= {n})"
        for u, n in counts.items()
    ]
    flags = ", ".join(f"o_orderkey IN (FROM keep_{u}) AS keep_{u}" for u in counts)
    return f"WITH {', '.join(parts)}, f AS (SELECT o_orderkey, o_orderdate, {flags} FROM orders) SELECT *, {' OR '.join(f'keep_{u}' for u in counts)} AS keep FROM f"


def _retention(spark: SparkSession, sf_dir: str, **counts: int) -> DataFrame:
    return retention.keep(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ts="o_orderdate", name="o_orderkey", **counts)


for _unit, _n in (("daily", 10), ("weekly", 8), ("monthly", 6), ("yearly", 4)):

    def _one(spark: SparkSession, sf_dir: str, unit=_unit, n=_n) -> DataFrame:
        return _retention(spark, sf_dir, **{unit: n})

    _one.__name__ = f"retention_plan_{_unit}"
    query(_retention_sql(**{_unit: _n}))(_one)


@query(_retention_sql(daily=10, weekly=8, monthly=6, yearly=2))
def retention_plan_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retention(spark, sf_dir, daily=10, weekly=8, monthly=6, yearly=2)


@query(_retention_sql(daily=10, weekly=8).replace("SELECT *, keep_daily OR keep_weekly AS keep FROM f", "SELECT o_orderkey, o_orderdate FROM f WHERE NOT (keep_daily OR keep_weekly)"))
def prune_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retention(spark, sf_dir, daily=10, weekly=8).where("not keep").select("o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_reference_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.latest_reference(read_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, isoyear(o_orderdate)::INT AS iso_year, week(o_orderdate)::INT AS iso_week FROM orders")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.extract(F.lit("YEAROFWEEK"), ts).alias("iso_year"), F.weekofyear(ts).alias("iso_week"))


# ---- bundles ---------------------------------------------------------------------------------------------------------


@query(f"WITH {PACKED} SELECT hash, len, path, ord, bundle_no, chunk_no FROM packed")
def bundle_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.packed(spark, sf_dir).select("hash", "len", "path", "ord", "bundle_no", "chunk_no")


@query(f"WITH {PACKED} SELECT bundle_no, chunk_no, hash, (coalesce(sum(len) OVER (PARTITION BY bundle_no ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS position FROM packed")
def chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.chunk_positions(src.packed(spark, sf_dir)).select("bundle_no", "chunk_no", "hash", "position")


@query(f"WITH {BUNDLES} SELECT bundle_no, bundle_id, mode, raw_size, encoded_size, chunk_count, encoded_size::DOUBLE / raw_size AS ratio FROM bundles")
def bundle_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.bundle_table(src.packed(spark, sf_dir))
    return b.select("bundle_no", "bundle_id", "mode", "raw_size", "encoded_size", "chunk_count", (F.col("encoded_size") / F.col("raw_size")).alias("ratio"))


@query(f"WITH {BUNDLES}, n AS (SELECT count(*) AS c FROM bundles) SELECT bundle_id, CASE WHEN c * 40 < 100 THEN bundle_id WHEN c * 40 / 250 < 100 THEN bundle_id[1:2] || '/' || bundle_id ELSE bundle_id[1:2] || '/' || bundle_id[3:4] || '/' || bundle_id END AS file FROM bundles, n")
def bundle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.bundle_table(src.packed(spark, sf_dir))
    return b.select("bundle_id", dedup.fan_out(F.col("bundle_id"), F.lit(b.count() * 40)).alias("file"))


@query(f"WITH {BUNDLES} SELECT count(*) AS bundles, sum(encoded_size)::BIGINT AS encoded_size, sum(raw_size)::BIGINT AS raw_size, sum(chunk_count)::BIGINT AS chunks, sum(encoded_size)::DOUBLE / sum(raw_size) AS compression_ratio, sum(raw_size)::DOUBLE / sum(chunk_count) AS avg_chunk_size FROM bundles")
def repo_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.info(src.bundle_table(src.packed(spark, sf_dir)))


@query(f"WITH {BUNDLES} SELECT sum(raw_size)::BIGINT // 512 AS blocks, 512::INT AS block_size FROM bundles")
def file_system_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.file_system(src.bundle_table(src.packed(spark, sf_dir)))


_STATS = (
    "s AS (SELECT {g} min(v) AS min, max(v) AS max, avg(v) AS avg, coalesce(stddev_samp(v), 0) AS stddev, count(*) AS n FROM x {by}) SELECT {g} any_value(s.min) AS min, any_value(s.max) AS max, any_value(s.avg) AS avg, any_value(s.stddev) AS stddev, any_value(s.n) AS n,"
    " count(*) FILTER (s.n > 1 AND v < s.avg - 2 * s.stddev) AS count_xs, count(*) FILTER (s.n > 1 AND v >= s.avg - 2 * s.stddev AND v < s.avg - s.stddev) AS count_s, count(*) FILTER (s.n < 2 OR v >= s.avg - s.stddev AND v < s.avg + s.stddev) AS count_m,"
    " count(*) FILTER (s.n > 1 AND v >= s.avg + s.stddev AND v < s.avg + 2 * s.stddev) AS count_l, count(*) FILTER (s.n > 1 AND v >= s.avg + 2 * s.stddev AND v >= s.avg + s.stddev) AS count_xl FROM x {join} {by2}"
)


@query("WITH x AS (SELECT l_suppkey AS bundle_no, l_quantity AS v FROM lineitem), " + _STATS.format(g="bundle_no,", by="GROUP BY bundle_no", join="JOIN s USING (bundle_no)", by2="GROUP BY bundle_no"))
def bundle_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.value_stats(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bundle_no"), F.col("l_quantity").alias("v")), "v", ["bundle_no"])


@query(f"WITH {DOCS}, x AS (SELECT size AS v FROM docs), " + _STATS.format(g="", by="", join=", s", by2=""))
def sigma_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.value_stats(src.documents(spark, sf_dir).select(F.col("size").alias("v")), "v", [])


@query("WITH m AS (SELECT 'l_returnflag' AS kind, l_returnflag AS method FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem), c AS (SELECT kind, method, count(*) AS n FROM m GROUP BY ALL) SELECT kind, method, n, n / sum(n) OVER (PARTITION BY kind) AS share FROM c")
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.method_counts(read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = src.packed(spark, sf_dir)
    live = src.references(spark, sf_dir).join(read_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return usage.usage(live, placed.select("hash", "len", "bundle_no"), src.bundle_table(placed))


@query(f"WITH {USAGE} SELECT bundle_no, raw_size, used_raw, used_chunks, ratio, used_size, unused_size FROM usage_")
def usage_by_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).select("bundle_no", "raw_size", "used_raw", "used_chunks", "ratio", "used_size", "unused_size")


@query(f"WITH {USAGE} SELECT i::INT AS step, count(bundle_no) AS bundles, coalesce(sum(unused_size), 0)::BIGINT AS reclaim, coalesce(sum(used_size), 0)::BIGINT AS rewrite FROM range(11) t(i) LEFT JOIN usage_ ON ceil(round(ratio * 10, 9)) <= i GROUP BY i")
def reclaim_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.reclaim_histogram(_usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT bundle_no, mode, ratio, ratio <= 0.4 AS rewrite FROM usage_")
def vacuum_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.vacuum_plan(_usage(spark, sf_dir), 0.4, src.BUNDLE, combine=False).select("bundle_no", "mode", "ratio", "rewrite")


_COMBINE = "ratio > 0.4 AND encoded_size * 4 < 160000"


@query(f"WITH {USAGE}, c AS (SELECT *, count(*) FILTER ({_COMBINE}) OVER (PARTITION BY mode) AS small FROM usage_) SELECT bundle_no, mode, ratio <= 0.4 AS by_ratio, {_COMBINE} AND small >= 2 AS by_size, ratio <= 0.4 OR ({_COMBINE} AND small >= 2) AS rewrite FROM c")
def vacuum_combine_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.vacuum_plan(_usage(spark, sf_dir), 0.4, 160000).select("bundle_no", "mode", "by_ratio", "by_size", "rewrite")


@query(f"WITH {USAGE} SELECT count(*) FILTER (ratio <= 0.4) AS bundles, sum(encoded_size)::BIGINT AS total, sum(used_size)::BIGINT AS used, coalesce(sum(unused_size) FILTER (ratio <= 0.4), 0)::BIGINT AS reclaim, coalesce(sum(used_size) FILTER (ratio <= 0.4), 0)::BIGINT AS rewritten FROM usage_")
def vacuum_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.vacuum_totals(usage.vacuum_plan(_usage(spark, sf_dir), 0.4, src.BUNDLE, combine=False))


# ---- integrity -------------------------------------------------------------------------------------------------------


@query(f"WITH {SEEN} SELECT path, ord, hash FROM crefs WHERE hash NOT IN (SELECT hash FROM seen WHERE hash[1:1] <> 'a')")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = src.references(spark, sf_dir)
    index = refs.select("hash").distinct().where("substring(hash, 1, 1) <> 'a'")
    return integrity.missing_chunks(refs, index).select("path", "ord", "hash")


@query(f"WITH {BUNDLES}, i AS (SELECT hash, bundle_no + CASE WHEN hash[1:2] = '0a' THEN 100000 ELSE 0 END AS bundle_no, chunk_no + CASE WHEN hash[1:2] = '0b' THEN 100000 ELSE 0 END AS chunk_no FROM packed) SELECT hash, i.bundle_no, chunk_no, CASE WHEN b.bundle_no IS NULL THEN 'no bundle' ELSE 'no chunk' END AS fault FROM i LEFT JOIN bundles b USING (bundle_no) WHERE b.bundle_no IS NULL OR chunk_no >= chunk_count")
def dangling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = src.packed(spark, sf_dir)
    two = F.substring("hash", 1, 2)
    index = placed.select("hash", (F.col("bundle_no") + F.when(two == "0a", 100000).otherwise(0)).alias("bundle_no"), (F.col("chunk_no") + F.when(two == "0b", 100000).otherwise(0)).alias("chunk_no"))
    return integrity.dangling_index(index, src.bundle_table(placed)).select("hash", "bundle_no", "chunk_no", "fault")


@query(f"WITH {BUNDLES}, f AS (SELECT bundle_no, count(*) AS found_chunks, sum(len)::BIGINT AS found_raw FROM packed WHERE hash[1:2] <> '0c' GROUP BY 1) SELECT bundle_no, chunk_count, raw_size, coalesce(found_chunks, 0) AS found_chunks, coalesce(found_raw, 0)::BIGINT AS found_raw FROM bundles LEFT JOIN f USING (bundle_no) WHERE coalesce(found_chunks, 0) <> chunk_count OR coalesce(found_raw, 0) <> raw_size")
def bundle_size_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = src.packed(spark, sf_dir)
    found = integrity.bundle_mismatch(src.bundle_table(placed), placed.where("substring(hash, 1, 2) <> '0c'"))
    return found.select("bundle_no", "chunk_count", "raw_size", "found_chunks", "found_raw")


@query(f"WITH {REFS} SELECT path, ord FROM crefs WHERE doc_id % 41 = 5 AND ord = 0")
def changed_chunk_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.content_chunks(src.documents(spark, sf_dir), "data", "fixed", src.CHUNK, ["path", "doc_id"], with_data=True)
    damaged = rows.withColumn("data", F.when((F.col("doc_id") % 41 == 5) & (F.col("ord") == 0), F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))
    return integrity.changed_chunks(damaged).select("path", "ord")


@query("SELECT hash, bundle_id, chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY bundle_id DESC, chunk_no DESC) AS r FROM (SELECT l_partkey AS hash, l_suppkey AS bundle_id, l_linenumber AS chunk_no FROM lineitem)) WHERE r = 1")
def index_rebuild_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("bundle_id"), F.col("l_linenumber").alias("chunk_no"))
    return dedup.latest_location(index)


@query("WITH f AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 2), k AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0) SELECT id, 'new' AS change FROM f WHERE id NOT IN (FROM k) UNION ALL SELECT id, 'gone' FROM k WHERE id NOT IN (FROM f)")
def catalog_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("id")).distinct()
    known = read_table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))
    return integrity.catalog_delta(found, known, "id")


@query(f"WITH {PACKED} SELECT hash, bundle_no, chunk_no FROM packed WHERE bundle_no <> 3")
def index_without_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.without_bundle(src.packed(spark, sf_dir), 3).select("hash", "bundle_no", "chunk_no")


@query(f"WITH {SEEN}, b AS (SELECT DISTINCT path FROM crefs WHERE hash[1:1] = 'f') SELECT path, CASE WHEN b.path IS NULL THEN size ELSE 0 END AS size, b.path IS NOT NULL AS modified FROM docs LEFT JOIN b USING (path)")
def repaired_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = src.references(spark, sf_dir)
    index = refs.select("hash").distinct().where("substring(hash, 1, 1) <> 'f'")
    return integrity.repaired(src.documents(spark, sf_dir).select("path", "size"), refs, index)


# ---- reading back ----------------------------------------------------------------------------------------------------


def _stored(rows: DataFrame) -> DataFrame:
    """A row of each chunk with its bytes."""
    return rows.groupBy("hash").agg(F.min("data").alias("data"))


@query("SELECT doc_id, octet_length(d)::BIGINT AS size, md5(d) AS content_id FROM (SELECT doc_id, encode(text)[1501:3500] AS d FROM documents WHERE octet_length(encode(text)) > 1500)")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.documents(spark, sf_dir)
    wanted = materialize(restore.overlapping(src.references(spark, sf_dir, 512).select("doc_id", "ord", "len", "hash"), ["doc_id"], 1500, 2000), "range-wanted")
    # only chunks that some range needs are cut out with their bytes
    chunk = F.substring("data", F.col("ord") * 512 + 1, F.lit(512))
    stored = docs.select("doc_id", "data").join(wanted.groupBy("hash").agg(F.min(F.struct("doc_id", "ord")).alias("at")).select("hash", "at.*"), "doc_id").select("hash", chunk.alias("data"))
    data = restore.cut_range(wanted, stored, ["doc_id"], 1500, 2000)
    return data.select("doc_id", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("content_id"))


_WHOLE = "SELECT doc_id, octet_length(encode(text))::BIGINT AS size, md5(text) AS content_id FROM documents WHERE octet_length(encode(text)) > 0"

for _method in ("fixed", "ae", "rabin", "fastcdc"):

    def _trip(spark: SparkSession, sf_dir: str, method=_method) -> DataFrame:
        rows = chunking.content_chunks(src.documents(spark, sf_dir), "data", method, 1024, ["doc_id"], with_data=True)
        back = restore.reassemble(rows.select("doc_id", "ord", "hash"), _stored(rows), ["doc_id"])
        return back.select("doc_id", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("content_id"))

    _trip.__name__ = f"roundtrip_{_method}"
    query(_WHOLE)(_trip)


for _hash in ("blake2", "murmur3"):

    def _distinct(spark: SparkSession, sf_dir: str, method=_hash) -> DataFrame:
        rows = chunking.content_chunks(src.documents(spark, sf_dir), "data", "fixed", src.CHUNK, [], hash_method=method)
        return dedup.savings(rows.withColumn("origin", F.lit("documents")), ["origin"])

    _distinct.__name__ = f"{_hash}_dedup"
    query(f"WITH {REFS}, each AS (SELECT hash, count(*) AS n, max(len) AS len FROM crefs GROUP BY ALL) SELECT 'documents' AS origin, sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(n * len)::BIGINT AS bytes, sum(len)::BIGINT AS unique_bytes, {_SAVED} FROM each")(_distinct)


@query("SELECT doc_id, c AS codec, md5(text) AS content_id FROM documents, unnest(['deflate/6', 'brotli/3', 'lzma/2', 'lz4/5']) t(c)")
def compression_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), None
    for name in ("deflate/6", "brotli/3", "lzma/2", "lz4/5"):
        codec = Compression.parse(name)
        back = codecs.decompressed(codecs.compressed(F.col("text").cast("binary"), codec), codec)
        part = docs.select("doc_id", F.lit(name).alias("codec"), F.md5(back).alias("content_id"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT doc_id, md5(text) AS content_id FROM documents")
def encryption_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = codecs.password_key("between the lines")
    back = codecs.decrypted(codecs.encrypted(F.col("text").cast("binary"), key), key)
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("content_id"))


@query(f"WITH {PACKED} SELECT count(*) AS refs, count(DISTINCT p.bundle_no) AS bundles, sum(r.len)::BIGINT AS bytes FROM crefs r JOIN packed p ON r.hash = p.hash AND r.len = p.len")
def located_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = src.references(spark, sf_dir).join(src.packed(spark, sf_dir).select("hash", "bundle_no"), "hash")
    return joined.agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("bundle_no").alias("bundles"), F.sum("len").alias("bytes"))


# ---- formats ---------------------------------------------------------------------------------------------------------


def _size_sql(x: str) -> str:
    return f"CASE WHEN {x} < 512 THEN {x}::BIGINT || ' Byte' WHEN {x} < 524288 THEN printf('%.1f KiB', {x} / 1024.0::DOUBLE) WHEN {x} < 536870912 THEN printf('%.1f MiB', {x} / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', {x} / 1073741824.0::DOUBLE) END"


@query(f"SELECT doc_id, {_size_sql('x')} AS shown FROM (SELECT doc_id, (octet_length(encode(text)) * (doc_id % 5) * (doc_id % 11) * (doc_id % 13) * (doc_id % 17))::BIGINT AS x FROM documents)")
def format_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.octet_length("text").cast("long") * (F.col("doc_id") % 5) * (F.col("doc_id") % 11) * (F.col("doc_id") % 13) * (F.col("doc_id") % 17)
    return read_table(spark, sf_dir, "documents").select("doc_id", scalars.format_size(x).alias("shown"))


@query("SELECT event_id, printf('%d:%02d:%04.1f', s // 3600, (s // 60) % 60, (s % 60)::DOUBLE + 0.5) AS shown FROM (SELECT event_id, (event_id * 37) % 100000 AS s FROM events)")
def format_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", scalars.format_duration(((F.col("event_id") * 37) % 100000).cast("double") + 0.5).alias("shown"))


@query("SELECT p_partkey, p_size || u AS given, CASE WHEN u = '' THEN -1 ELSE p_size::BIGINT * (1024 ** list_position(['b', 'k', 'm', 'g', 't'], u) // 1024)::BIGINT END AS bytes FROM (SELECT p_partkey, p_size, ['b', 'k', 'm', 'g', 't', ''][p_partkey % 6 + 1] AS u FROM part)")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("b", "k", "m", "g", "t", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("given")).withColumn("bytes", F.coalesce(scalars.parse_size(F.col("given")), F.lit(-1)))


@query("SELECT o_orderkey, nullif(split_part(p, '::', 1), '') AS repo, nullif(split_part(p, '::', 2), '') AS snapshot, nullif(split_part(p, '::', 3), '') AS subpath FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'r' || o_custkey WHEN 1 THEN 'r::' || o_orderstatus ELSE '::' || o_orderkey || '::a/b' END AS p FROM orders)")
def repo_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    p = F.when(k % 3 == 0, F.concat(F.lit("r"), text("o_custkey"))).when(k % 3 == 1, F.concat(F.lit("r::"), "o_orderstatus")).otherwise(F.concat(F.lit("::"), text("o_orderkey"), F.lit("::a/b")))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", scalars.repo_path_part(p, 0).alias("repo"), scalars.repo_path_part(p, 1).alias("snapshot"), scalars.repo_path_part(p, 2).alias("subpath"))


@query("SELECT s_suppkey, lower(hex(s_name)) AS digits, s_name AS back FROM supplier")
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = scalars.hex_text(F.col("s_name").cast("binary"))
    spaced = F.regexp_replace(digits, "(....)", "$1 ")
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", digits.alias("digits"), scalars.unhex_text(spaced).cast("string").alias("back"))


@query("SELECT l_suppkey, (sum(round(l_tax * 100)::BIGINT)::DOUBLE / nullif(sum(round(l_discount * 100)::BIGINT)::DOUBLE, 0) - 1) * 100 AS saved FROM lineitem GROUP BY l_suppkey")
def percent_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("t"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"))
    return sums.select("l_suppkey", scalars.percent_saved(F.col("t"), F.col("d")).alias("saved"))


# ---- cuts, settings and order ---------------------------------------------------------------------------------------

#: Cut positions of each method are pinned by lists of the published generator's bytes, in SQL as in the tests.
_CUTS = {
    "ae": "7979 8046 7979 8192 8192 8192 7965 8158 8404 8241 8011 8302 8120 8335 8192 8192 572", "rabin": "8604 4190 32769 3680 26732 3152 9947 6487 25439 3944 6128",
    "fastcdc": "8712 8018 2847 9157 8997 8581 8867 5422 5412 9478 11553 9206 4606 8529 3821 11342 6524", "fixed": " ".join(["8192"] * 16 + ["0"]),
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, (row_number() OVER () - 1)::INT AS ord, n::BIGINT AS len FROM unnest([{', '.join(cuts.split())}]) t(n)" for m, cuts in _CUTS.items()))
def cut_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 128 KiB of the published generator by each method: the positions themselves, which round trips don't see."""
    data = spark.createDataFrame([(chunking.generated(128 * 1024),)], "data binary")
    out = None
    for method in _CUTS:
        part = chunking.content_chunks(data, "data", method, 8192, []).select(F.lit(method).alias("method"), "ord", "len")
        out = part if out is None else out.union(part)
    return out


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, dense_rank() OVER (ORDER BY o_orderdate::DATE DESC) AS d FROM orders WHERE starts_with(o_orderkey::VARCHAR, '1')) WHERE r = 1 AND d <= 5")
def retention_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only names of a prefix are judged: the newest of the last five days among them stay."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("name"))
    # ties go to the greatest number, as numbers
    named = orders.withColumn("name", F.concat(F.substring("name", 1, 1), F.lpad("name", 12, "0")))
    return retention.keep(named, ts="o_orderdate", name="name", prefix="1", daily=5).where("keep").select("o_orderkey", "o_orderdate")


@query("SELECT path, mtime, size, first, (row_number() OVER (PARTITION BY path ORDER BY mtime, size, first))::INT AS place FROM (SELECT user_id::VARCHAR AS path, date_trunc('day', ts)::TIMESTAMP AS mtime, floor(value)::BIGINT AS size, min(event_id) AS first FROM events GROUP BY 1, 2, 3)")
def versions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.lit("file").alias("type"), F.date_trunc("day", "ts").alias("mtime"), F.floor("value").cast("long").alias("size"), F.col("event_id").alias("snapshot"))
    return compare.versions_in_order(compare.versions(e)).select("path", "mtime", "size", F.col("snapshot").alias("first"), "place")


@query(f"SELECT doc_id, {_size_sql('x')} || '/s' AS shown FROM (SELECT doc_id, floor(octet_length(encode(text)) * (doc_id % 13 + 1) * (doc_id % 17 + 1) / (doc_id % 9 + 0.5)::DOUBLE)::BIGINT AS x FROM documents)")
def format_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.octet_length("text").cast("long") * (F.col("doc_id") % 13 + 1) * (F.col("doc_id") % 17 + 1)
    return read_table(spark, sf_dir, "documents").select("doc_id", scalars.format_speed(done, (F.col("doc_id") % 9).cast("double") + 0.5).alias("shown"))


_HALF = "{h}[15:16] || {h}[13:14] || {h}[11:12] || {h}[9:10] || {h}[7:8] || {h}[5:6] || {h}[3:4] || {h}[1:2]"
_ITEM = f"{_HALF.format(h='hash')} || {_HALF.format(h='hash[17:32]')} || printf('%02x%02x%02x%02x', len & 255, (len >> 8) & 255, (len >> 16) & 255, len >> 24)"


@query(f"WITH {REFS} SELECT path, md5(string_agg({_ITEM}, '' ORDER BY ord)) AS list, count(*) AS chunks, sum(len)::BIGINT AS size, min(hash) AS least FROM crefs GROUP BY path")
def chunk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk list of each document as bytes, and what is read back from them."""
    lists = materialize(restore.encoded_lists(src.references(spark, sf_dir).select("path", "ord", "hash", "len"), ["path"]), "chunk-lists")
    back = restore.decoded_lists(lists, ["path"]).groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("size"), F.min("hash").alias("least"))
    return lists.select("path", F.md5(F.lower(F.hex("list")).cast("binary")).alias("list")).join(back, "path")


# ---- repositories ----------------------------------------------------------------------------------------------------


def _repository(spark: SparkSession, **settings) -> Repository:
    """A new repository in the shared folder, of fixed chunks with names that SQL can make too."""
    config = Config(**({"bundle_size": 65536, "chunker": Chunker("fixed", 1024), "compression": None, "hash": "md5"} | settings))
    return Repository.init(spark, f"{scratch_root(spark)}/repository-{uuid.uuid4().hex}", config)


def _as_files(entries: DataFrame) -> DataFrame:
    return entries.withColumn("symlink_target", F.lit(None).cast("string"))


def _contents(repo: Repository, name: str) -> DataFrame:
    return repo.restore(name).select("path", "size", F.md5(F.coalesce("data", F.lit(b"").cast("binary"))).alias("content_id"))


class _Ended(Exception):
    pass


@query(f"WITH {DOCS} SELECT path, size, md5(text) AS content_id FROM docs")
def crash_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup that ends before its snapshot is there, and runs again: the snapshot holds every entry once."""
    repo, files = _repository(spark), _as_files(src.documents(spark, sf_dir))

    def end(table: str) -> None:
        if table == "snapshots":
            raise _Ended

    repo._before = end
    try:
        repo.backup(files, "one", "2024-01-01 10:00:00")
    except _Ended:
        repo = Repository(spark, repo.root)
    repo.backup(files, "one", "2024-01-01 10:00:00")
    return _contents(repo, "one")


@query(f"WITH {DOCS}, {snapshot_sql(1)}, {snapshot_sql(2)} SELECT path, size, content_id FROM v2")
def mixed_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec, hash and encryption change between two snapshots; chunks of both are read by their own, after a compaction too."""
    repo, key = _repository(spark, compression=Compression.parse("deflate/6")), Key.from_password("between the lines")
    repo.backup(_as_files(src.snapshot(spark, sf_dir, 1)), "one", "2024-01-01 10:00:00")
    repo.add_key(key)
    repo.set_config(Config(65536, Chunker("fixed", 1024), Compression.parse("lzma/2"), "murmur3", key.name))
    repo.backup(_as_files(src.snapshot(spark, sf_dir, 2)), "two", "2024-01-02 10:00:00")
    repo.remove("one")
    repo.vacuum(0.9, force=True)
    return _contents(repo, "two")


_LOST = f"WITH {SEEN}, b AS (SELECT DISTINCT path FROM crefs JOIN docs USING (path) WHERE size >= 100 AND hash[1:1] = 'f')"


@query(f"{_LOST} SELECT 'one' AS snapshot, path, CASE WHEN b.path IS NULL THEN size ELSE 0 END AS size, b.path IS NOT NULL AS modified FROM docs LEFT JOIN b USING (path) UNION ALL SELECT 'one.broken', path, size, false FROM docs")
def repository_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks are lost; a repair empties the files that had them and keeps the original snapshot beside."""
    repo = _repository(spark)
    repo.backup(_as_files(src.documents(spark, sf_dir)), "one", "2024-01-01 10:00:00")
    repo._switch(chunks=repo.chunks().where("substring(hash, 1, 1) <> 'f'"))
    repo.repair()
    return repo.entries().select("snapshot", "path", "size", "modified")


@query(
    f"WITH {BUNDLES}, m AS (SELECT mode, 'raw_size' AS measure, raw_size::DOUBLE AS v FROM bundles UNION ALL SELECT mode, 'encoded_size', encoded_size FROM bundles UNION ALL SELECT mode, 'chunk_count', chunk_count FROM bundles),"
    " x AS (SELECT * FROM m UNION ALL SELECT '', measure, v FROM m), r AS (" + _STATS.format(g="mode, measure,", by="GROUP BY mode, measure", join="JOIN s USING (mode, measure)", by2="GROUP BY mode, measure").replace("s AS (", "SELECT * FROM (WITH s AS (", 1)
    + ")) SELECT nullif(mode, '') AS mode, * EXCLUDE (mode) FROM r"
)
def bundle_statistics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and counts of bundles by mode, and of all together."""
    return usage.bundle_statistics(src.bundle_table(src.packed(spark, sf_dir)))


@query(
    f"WITH {BUNDLES}, i AS (SELECT hash, bundle_no, chunk_no FROM packed WHERE bundle_no <> 1 UNION ALL SELECT hash, bundle_no + 500, chunk_no FROM packed WHERE bundle_no = 2)"
    " SELECT 'hash twice' AS fault, hash AS what FROM i GROUP BY hash HAVING count(*) > 1 UNION ALL SELECT 'place twice', bundle_no || '/' || chunk_no FROM i GROUP BY bundle_no, chunk_no HAVING count(*) > 1"
    " UNION ALL SELECT 'bundle not listed', (b)::VARCHAR FROM (SELECT DISTINCT bundle_no AS b FROM i) WHERE b NOT IN (SELECT bundle_no FROM bundles) UNION ALL SELECT 'bundle without chunks', (bundle_no)::VARCHAR FROM bundles WHERE bundle_no NOT IN (SELECT bundle_no FROM i)"
)
def catalog_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's chunks are gone, another's are listed again under a number that no bundle has."""
    placed = src.packed(spark, sf_dir)
    columns = placed.select("hash", "bundle_no", "chunk_no")
    index = dedup.without_bundle(columns, 1).union(columns.where("bundle_no = 2").withColumn("bundle_no", F.col("bundle_no") + 500))
    return integrity.catalog_faults(index, src.bundle_table(placed))


@query(f"WITH {PACKED} SELECT hash, bundle_no + CASE WHEN bundle_no % 4 = 1 THEN 1000 ELSE 0 END AS bundle_no, chunk_no FROM packed")
def override_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are there already are put again, unasked: their new place is the one that counts."""
    index = src.packed(spark, sf_dir).select("hash", "bundle_no", "chunk_no")
    again = index.where("bundle_no % 4 = 1").withColumn("bundle_no", F.col("bundle_no") + 1000)
    return dedup.overridden(index, again)


@query(f"WITH {DOCS} SELECT 's' || (doc_id % 2) AS snapshot, path || '/below' AS path FROM docs WHERE doc_id % 11 = 0 AND doc_id % 97 <> 1")
def misplaced_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries below files, which a repair takes out; those below directories stay."""
    docs = src.documents(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("snapshot"), "path", F.when(F.col("doc_id") % 97 == 1, "directory").otherwise("file").alias("type"), "doc_id")
    below = docs.where("doc_id % 11 = 0 or doc_id % 97 = 1").withColumns({"path": F.concat("path", F.lit("/below")), "type": F.lit("file")})
    return integrity.misplaced(docs.unionByName(below))


@query(f"WITH {DOCS} SELECT path, size, md5(text) AS content_id FROM docs")
def snapshot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot under another name stays whole when the first one is removed and what nothing refers to is compacted."""
    repo = _repository(spark)
    repo.backup(_as_files(src.documents(spark, sf_dir)), "one", "2024-01-01 10:00:00")
    repo.copy("one", "two")
    repo.remove("one")
    repo.vacuum(1.0, force=True)
    return _contents(repo, "two")


@query(f"WITH {DOCS}, {snapshot_sql(1)}, {snapshot_sql(2)} SELECT 'one' AS snapshot, path, size, content_id FROM v1 UNION ALL SELECT 'two', path, size, content_id FROM v2")
def imported_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots of a repository, read from the one that took them in."""
    there = _repository(spark)
    there.backup(_as_files(src.snapshot(spark, sf_dir, 1)), "one", "2024-01-01 10:00:00")
    there.backup(_as_files(src.snapshot(spark, sf_dir, 2)), "two", "2024-01-02 10:00:00")
    repo = Repository.import_from(spark, f"{scratch_root(spark)}/repository-{uuid.uuid4().hex}", there.root)
    return _contents(repo, "one").withColumn("snapshot", F.lit("one")).unionByName(_contents(repo, "two").withColumn("snapshot", F.lit("two")))


@query(
    f"WITH {REFS} SELECT 'entries' AS name, (SELECT count(*) FROM docs) AS rows_left UNION ALL SELECT 'chunk_refs', (SELECT count(*) FROM crefs JOIN docs USING (path) WHERE size >= 100)"
    " UNION ALL SELECT 'chunks', 0 UNION ALL SELECT 'bundles', 0"
)
def reconciled_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backup that ended before its snapshot was there has left: entries and references go, chunks stay for the next one."""
    repo = _repository(spark)

    def end(table: str) -> None:
        if table == "snapshots":
            raise _Ended

    repo._before = end
    try:
        repo.backup(_as_files(src.documents(spark, sf_dir)), "one", "2024-01-01 10:00:00")
    except _Ended:
        repo = Repository(spark, repo.root)
    return repo.reconcile().select(F.col("table").alias("name"), F.col("rows").alias("rows_left"))


def chunker_listing(spark: SparkSession, sf_dir: str, chunker: str) -> DataFrame:
    """Chunks of the documents by any chunker, for ad hoc use."""
    return chunking.chunks(src.documents(spark, sf_dir), "data", Chunker.parse(chunker), ["doc_id"])
