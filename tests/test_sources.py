import os

from pyspark.sql import functions as F

from cairn.sources import files
from cairn.streaming.ingest import ingest


def make(root):
    os.makedirs(root / "d" / "deep")
    (root / "d" / "a.txt").write_bytes(b"hello" * 100)
    (root / "d" / "deep" / "b.tmp").write_bytes(b"x")
    (root / "empty").write_bytes(b"")
    os.symlink("d/a.txt", root / "link")
    os.mkfifo(root / "pipe")
    os.chmod(root / "d" / "a.txt", 0o640)
    os.utime(root / "d" / "a.txt", (1000, 1000))


def test_scan_and_restore(spark, tmp_path):
    (tmp_path / "src").mkdir()
    make(tmp_path / "src")
    found = files.scan(spark, str(tmp_path / "src"), ["# none", "*.tmp"])
    rows = {r["path"]: r for r in found.collect()}
    assert set(rows) == {"/", "/d", "/d/deep", "/d/a.txt", "/empty", "/link", "/pipe"}
    a = rows["/d/a.txt"]
    assert (a["type"], a["size"], a["mode"], a["mtime"], bytes(a["data"])) == ("file", 500, 0o640, 1000, b"hello" * 100)
    assert (rows["/link"]["type"], rows["/link"]["symlink_target"], rows["/pipe"]["type"]) == ("symlink", "d/a.txt", "named_pipe")
    assert {r["problem"].split(":")[0] for r in files.restore_files(found, str(tmp_path / "back")).collect()} <= {"owner"}
    again = {r["path"]: r for r in files.scan(spark, str(tmp_path / "back")).collect()}
    assert set(again) == set(rows)
    for p, r in rows.items():
        assert (again[p]["type"], again[p]["mode"], again[p]["symlink_target"], again[p]["data"]) == (r["type"], r["mode"], r["symlink_target"], r["data"])
    assert again["/d/a.txt"]["mtime"] == 1000


def test_metadata_there_and_back(spark, tmp_path):
    """Owners, attributes, times of folders and devices, as far as this user may; the rest is told."""
    (tmp_path / "src" / "d").mkdir(parents=True)
    f = tmp_path / "src" / "d" / ".bashrc"
    f.write_bytes(b"x")
    os.utime(tmp_path / "src" / "d", (77, 77))
    rows = files.scan(spark, str(tmp_path / "src")).collect()
    schema = files.SCHEMA
    me, group = os.getuid(), os.getgid()
    more = [("/dev", "char_device", 0, 420, me, group, 5, None, 1, 3, {}, None), ("/d/x", "file", 1, 420, me, group, 6, None, None, None, {"user.k": b"v"}, b"y")]
    problems = {(r["path"], r["problem"].split(":")[0]) for r in files.restore_files(spark.createDataFrame([tuple(r) for r in rows] + more, schema), str(tmp_path / "back")).collect()}
    back = {r["path"]: r for r in files.scan(spark, str(tmp_path / "back")).collect()}
    assert bytes(back["/d/.bashrc"]["data"]) == b"x" and back["/d"]["mtime"] == 77 and (back["/d/x"]["uid"], back["/d/x"]["mtime"]) == (me, 6)
    assert ("/dev", "device") in problems or (back["/dev"]["type"], back["/dev"]["major"], back["/dev"]["minor"]) == ("char_device", 1, 3)
    assert ("/d/x", "attribute user.k") in problems or bytes(back["/d/x"]["xattrs"]["user.k"]) == b"v"
    assert problems <= {("/dev", "device"), ("/d/x", "attribute user.k")}


def test_unreadable_folders_are_told(spark, tmp_path, monkeypatch):
    (tmp_path / "gone").mkdir()
    run = files._listing(str(tmp_path), None, None)
    import pyarrow as pa

    rows = next(run(iter([pa.RecordBatch.from_arrays([pa.array(["/", "/none"])], names=["path"])]))).to_pylist()
    assert rows[0] == {"path": "/gone", "folder": True, "error": None} and rows[1]["path"] == "/none" and rows[1]["error"]
    assert files.unreadable(spark, str(tmp_path)).count() == 0


def test_member_paths():
    assert [files.member_path(n) for n in (".bashrc", "./a/.b./c", ".", "d/", "/x//y", "...", "a/./b")] == ["/.bashrc", "/a/.b./c", "/", "/d", "/x/y", "/...", "/a/b"]


def test_contents_of_any_store(spark, tmp_path):
    (tmp_path / "src").mkdir()
    make(tmp_path / "src")
    os.unlink(tmp_path / "src" / "pipe")
    got = {r["path"]: bytes(r["data"]) for r in files.contents(spark, str(tmp_path / "src"), ["/d/deep"]).collect()}
    assert got["/d/a.txt"] == b"hello" * 100 and "/d/deep/b.tmp" not in got


def test_tar_there_and_back(spark, tmp_path):
    long = "/" + "/".join(["n" * 40] * 4)
    rows = [("/top", "directory", 0, 493, 1, 2, 5, None, None, None, {}, None), ("/top/f", "file", 3, 420, 1, 2, 6, None, None, None, {"user.k": b"v" * 90}, b"abc"), ("/top/l", "symlink", 0, 511, 1, 2, 7, "f", None, None, {}, None), ("/top" + long, "file", 1, 420, 0, 0, 8, None, None, None, {}, b"z")]
    df = spark.createDataFrame(rows, files.SCHEMA)
    archive = files.write_tars(df.withColumn("snapshot", F.lit("s")), ["snapshot"]).first()["tar"]
    (tmp_path / "x.tar").write_bytes(bytes(archive))
    back = {r["path"]: r for r in files.read_tar(spark, str(tmp_path / "x.tar")).collect()}
    assert {p: (r["type"], r["mode"], r["uid"], r["gid"], r["mtime"], r["symlink_target"], r["data"] and bytes(r["data"])) for p, r in back.items()} == {r[0]: (r[1], r[3], r[4], r[5], r[6], r[7], r[11]) for r in rows}
    assert {k: bytes(v) for k, v in back["/top/f"]["xattrs"].items()} == {"user.k": b"v" * 90}


def test_streaming_ingest(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")

    def batch(rows):
        spark.createDataFrame(rows, "path string, data binary").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("path string, data binary").parquet(source)
        ingest(spark, stream, index, str(tmp_path / "checkpoint"), size=1024).awaitTermination()
        return spark.read.parquet(index)

    first = batch([("a", b"one" * 2000), ("b", b"one" * 2000)])
    n = first.count()
    assert n == first.select("hash").distinct().count() > 0
    assert batch([("c", b"one" * 2000)]).count() == n
    assert batch([("d", b"two" * 2000)]).count() > n
