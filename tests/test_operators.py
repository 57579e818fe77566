import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.keys import Key
from cairn.operators import compare, dedup, integrity, restore, retention, rollup, usage, views
from cairn.tables import running_total


def test_running_total(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, n long").repartition(7)
    got = {(r["g"], r["o"]): r["t"] for r in running_total(df, ["g"], ["o"], F.col("n"), "t").collect()}
    sums = {"a": 0, "b": 0}
    for g, o, n in sorted(rows, key=lambda r: r[1]):
        assert got[g, o] == sums[g]
        sums[g] += n


def plain_diff(old, new):
    """By descent: what differs at a path, and below it only where both sides have a directory."""
    def children(tree, path):
        return {p for p in tree if p != "/" and (p.rsplit("/", 1)[0] or "/") == path}

    out = []

    def walk(path):
        if old[path] != new[path]:
            out.append(("mod", path))
        for p in children(old, path) | children(new, path):
            if p not in new:
                out.append(("del", p))
            elif p not in old:
                out.append(("add", p))
            else:
                walk(p)

    walk("/")
    return sorted(out)


def test_diff_of_random_trees(spark):
    rng = random.Random(4)
    schema = "path string, type string, size long, mode long, uid long, gid long, mtime long, symlink_target string, content_id string"

    def tree():
        out = {"/": ("directory", 0)}
        for _ in range(14):
            path = rng.choice([p for p, (k, _) in out.items() if k == "directory"]).rstrip("/") + "/" + rng.choice("abc")
            if path not in out:
                out[path] = (rng.choice(["directory", "file"]), rng.randrange(2))
        return out

    def frame(t):
        return spark.createDataFrame([(p, k, s, 0, 0, 0, 0, None, None) for p, (k, s) in t.items()], schema)

    for _ in range(6):
        old, new = tree(), tree()
        assert sorted(map(tuple, compare.diff(frame(old), frame(new)).collect())) == plain_diff(old, new)


def test_greedy_packing(spark):
    rows = [("data", i, 400) for i in range(10)] + [("meta", i, 10) for i in range(3)]
    df = spark.createDataFrame(rows, "mode string, seq int, len long")
    got = dedup.pack_greedy(df, ["seq"], 1000, "mode").orderBy("mode", "seq").collect()
    # 500 + 400 + 20 < 1000 <= 500 + 800 + 40: two chunks a bundle
    assert [r["bundle_no"] for r in got if r["mode"] == "data"] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert {r["bundle_no"] for r in got if r["mode"] == "meta"} == {0}


def test_retention_counts_periods_that_have_snapshots(spark):
    rows = [("a", "2020-12-31 10:00:00"), ("b", "2021-01-01 09:00:00"), ("c", "2021-01-01 10:00:00"), ("d", "2021-01-04 10:00:00"), ("e", "2021-01-04 10:00:00")]
    df = spark.createDataFrame(rows, "snapshot string, ts string").withColumn("ts", F.to_timestamp("ts"))

    def kept(**n):
        return {r["snapshot"] for r in retention.keep(df, **n).where("keep").collect()}

    assert kept(daily=2) == {"e", "c"} and kept(yearly=2) == {"e", "a"} and kept(weekly=2) == {"e", "c"} and kept(monthly=9, daily=1) == {"e", "a"}
    assert {r["snapshot"] for r in retention.removable(df, daily=1, prefix="a").collect()} == set()
    with pytest.raises(ValueError):
        retention.keep(df, daily=0)


def test_statistics_of_few_values(spark):
    df = spark.createDataFrame([("one", 5.0), *[("more", float(v)) for v in (1, 1, 1, 1, 1, 1, 1, 1, 9)]], "g string, v double")
    rows = {r["g"]: r for r in usage.value_stats(df, "v", ["g"]).collect()}
    assert rows["one"]["stddev"] == 0 and rows["one"]["count_m"] == 1
    assert rows["more"]["count_xl"] == 1 and rows["more"]["count_m"] == 8


def test_usage_at_the_threshold(spark):
    bundles = spark.createDataFrame([(1, 100, 50, "data"), (2, 100, 50, "data"), (3, 0, 0, "data")], "bundle_no long, raw_size long, encoded_size long, mode string")
    index = spark.createDataFrame([("a", 40, 1), ("b", 60, 1), ("c", 100, 2)], "hash string, len long, bundle_no long")
    used = usage.usage(spark.createDataFrame([("a",), ("a",), ("c",)], "hash string"), index, bundles)
    rows = {r["bundle_no"]: r for r in used.collect()}
    assert (rows[1]["used_raw"], rows[1]["used_size"], rows[1]["unused_size"], rows[3]["ratio"]) == (40, 20, 30, 0.0)
    assert {r["bundle_no"] for r in usage.vacuum_plan(used, 0.4, 10, False).where("rewrite").collect()} == {1, 3}
    steps = {r["step"]: (r["bundles"], r["reclaim"], r["rewrite"]) for r in usage.reclaim_histogram(used).collect()}
    assert steps[0] == (1, 0, 0) and steps[3] == (1, 0, 0) and steps[4] == (2, 30, 20) and steps[10] == (3, 30, 70)


def test_rollup(spark):
    df = spark.createDataFrame([("/a/b/x", 1), ("/a/y", 2), ("/z", 4)], "path string, size long")
    assert {tuple(r) for r in rollup.rollup(df).collect()} == {("/", 7, 3, 3), ("/a", 3, 2, 2), ("/a/b", 1, 1, 1)}


def test_integrity(spark):
    index = spark.createDataFrame([("a", 1, 0), ("b", 1, 5), ("c", 9, 0), ("c", 1, 1)], "hash string, bundle_no long, chunk_no long")
    bundles = spark.createDataFrame([(1, 2, 10)], "bundle_no long, chunk_count long, raw_size long")
    assert {(r["hash"], r["fault"]) for r in integrity.dangling_index(index, bundles).collect()} == {("b", "no chunk"), ("c", "no bundle")}
    assert [r["hash"] for r in integrity.repeated_index(index).collect()] == ["c"]


def test_fan_out(spark):
    def name(n):
        return spark.range(1).select(dedup.fan_out(F.lit("abcdef"), F.lit(n))).first()[0]

    assert [name(n) for n in (5, 100, 25000)] == ["abcdef", "ab/abcdef", "ab/cd/abcdef"]


def test_views(spark):
    schema = "path string, type string, size long, mode long, uid long, gid long, mtime long, symlink_target string, device struct<major:long,minor:long>, xattrs map<string,binary>"
    rows = [("/d/l", "symlink", 0, 0o120777, 1, 2, 0, "x", None, {}), ("/d/f", "file", 1030, 0o100640, 1, 2, 60, None, None, {"b": b"2", "a": b"1"}), ("/dev", "block_device", 0, 0o60600, 0, 0, 0, None, (8, 1), {})]
    df = spark.createDataFrame(rows, schema)
    assert [r["path"] for r in views.lookup(df, "/d", "f").collect()] == ["/d/f"] and views.lookup(df, "/d", "none").count() == 0
    found = {r["path"]: r for r in views.attributes(df).collect()}
    assert (found["/d/f"]["blocks"], found["/d/f"]["perm"], found["/dev"]["rdev"], found["/d/f"]["rdev"]) == (2, 0o640, 2049, None)
    assert [r[0] for r in views.link_target(df, "/d/l").collect()] == ["x"] and views.link_target(df, "/d/f").count() == 0
    row = df.where("path = '/d/f'").select(views.attribute("a").alias("a"), views.attribute("z").alias("z"), views.attribute_names().alias("n")).first()
    assert (bytes(row["a"]), row["z"], row["n"]) == (b"1", None, "a\0b\0")


def test_keys(spark, tmp_path):
    key = Key.new()
    assert Key.load(key.save(str(tmp_path))) == key and Key.from_password("p") == Key.from_password("p") != Key.from_password("q")
    from cairn.operators.codecs import decrypted, encrypted

    df = spark.createDataFrame([(b"data",)], "d binary")
    assert bytes(df.select(decrypted(encrypted(F.col("d"), key.column()), key.column())).first()[0]) == b"data"


def test_chunk_lists(spark):
    rows = [("a", 1, "00" * 15 + "0f", 7), ("a", 0, "0123456789abcdef" * 2, 300), ("b", 0, "ff" * 16, 0)]
    refs = spark.createDataFrame(rows, "path string, ord int, hash string, len long")
    lists = restore.encoded_lists(refs, ["path"])
    assert {r["path"]: len(r["list"]) for r in lists.collect()} == {"a": 40, "b": 20}
    assert sorted(map(tuple, restore.decoded_lists(lists, ["path"]).collect())) == sorted(rows)
    assert restore.decoded_lists(restore.encoded_lists(refs.where("ord > 5"), ["path"]), ["path"]).count() == 0
