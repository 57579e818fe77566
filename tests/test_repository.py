import pytest
from pyspark.sql import functions as F

from cairn.model import Chunker, Compression, Config
from cairn.plans.repository import Repository, RepositoryError

SCHEMA = "path string, type string, size bigint, mode bigint, uid bigint, gid bigint, mtime bigint, symlink_target string, data binary"


def tree(spark, files, time=100):
    rows = [("/", "directory", 0, 493, 0, 0, time, None, None), ("/d", "directory", 0, 493, 0, 0, 100, None, None), ("/link", "symlink", 0, 511, 0, 0, 100, "d/a", None)]
    rows += [(p, "file", len(d), 420, 1, 1, t, None, d) for p, (d, t) in files.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def repo(spark, tmp_path):
    return Repository.init(spark, str(tmp_path / "repo"), Config(2000, Chunker("fastcdc", 1024), Compression.parse("deflate/6"), "blake2"))


A, B, C = b"abcdefgh" * 900, bytes(range(256)) * 20, b"small" * 30


def test_life_of_a_repository(spark, repo):
    repo.backup(tree(spark, {"/d/a": (A, 100), "/d/b": (B, 100), "/c": (C, 100), "/empty": (b"", 100)}), "one", "2024-01-01 10:00:00")
    one = repo.snapshots().first()
    assert (one["file_count"], one["dir_count"], one["total_size"]) == (5, 2, len(A + B + C))
    # b changes, c goes, e comes with the bytes of a
    repo.backup(tree(spark, {"/d/a": (A, 100), "/d/b": (B[::-1], 200), "/empty": (b"", 100), "/e": (A, 150)}), "two", "2024-01-02 10:00:00")
    for name, files in (("one", {"/d/a": A, "/d/b": B, "/c": C}), ("two", {"/d/a": A, "/d/b": B[::-1], "/e": A})):
        found = {r["path"]: r["data"] for r in repo.restore(name).where("size > 0").collect()}
        assert {k: bytes(v) for k, v in found.items()} == files
    assert sorted(map(tuple, repo.diff("one", "two").select("change", "path").collect())) == [("add", "/e"), ("del", "/c"), ("mod", "/d/b")]
    assert repo.snapshots().where("snapshot = 'two'").first()["changed_size"] == len(A) + len(B)
    assert repo.index().groupBy("hash").count().where("count > 1").count() == 0
    assert repo.read("two", "/d/b", 1000, 700) == B[::-1][1000:1700]
    assert repo.read("two", "/d/b", len(B) - 5, 700) == B[::-1][-5:]
    assert [(r["mtime"], r["snapshot"]) for r in repo.versions("/d/b").collect()] == [(100, "one"), (200, "two")]
    assert [r["copies"] for r in repo.duplicates("two").collect()] == [2]
    assert [r["name"] for r in repo.list("one", "/").collect()] == ["c", "d", "empty", "link"]
    top = {r["path"]: (r["cum_size"], r["cum_dirs"], r["cum_files"]) for r in repo.rollup("one").collect()}
    assert top["/"] == (len(A + B + C), 2, 5) and top["/d"] == (len(A + B), 1, 2)
    for check in (repo.check_backups, repo.check_index, repo.check_repository, repo.check_bundles, repo.check_data):
        assert check().count() == 0
    assert {(r["mode"], r["measure"]) for r in repo.statistics().collect()} == {(m, x) for m in ("data", None) for x in ("raw_size", "encoded_size", "chunk_count")}
    assert {(r["kind"], r["method"]) for r in repo.method_counts().collect()} == {("codec", "deflate/6"), ("hash_method", "blake2"), ("key", None)}
    # removing a snapshot leaves its chunks until a vacuum
    gone = repo.prune(force=True, daily=1)
    assert [r["snapshot"] for r in gone.collect()] == ["one"]
    before = repo.index().count()
    assert repo.analyze().where("ratio < 1").count() > 0
    repo.vacuum(1.0, force=True)
    assert repo.index().count() < before
    assert repo.check_backups().count() == 0
    assert {r["path"]: bytes(r["data"]) for r in repo.restore("two", "/d").where("size > 0").collect()} == {"/d/a": A, "/d/b": B[::-1]}
    repo.copy("two", "three")
    repo.remove("three", "/d")
    assert {r["path"] for r in repo.entries("three").collect()} == {"/", "/link", "/empty", "/e"}
    assert repo.snapshots().where("modified").first()["snapshot"] == "three"
    assert Repository(spark, repo.root).config == repo.config


def test_repair_empties_what_lost_its_chunks(spark, repo):
    repo.backup(tree(spark, {"/d/a": (A, 100), "/c": (C, 100)}), "one", "2024-01-01 10:00:00")
    lost = repo.chunk_refs().where("path = '/c'").select("hash")
    from cairn.tables import materialize

    repo._switch(chunks=materialize(repo.chunks().join(lost, "hash", "left_anti"), "damage"))
    assert [r["path"] for r in repo.check_backups().collect()] == ["/c"]
    repo.repair()
    assert repo.check_backups().count() == 0
    assert {r["path"]: r["size"] for r in repo.entries("one").where("type = 'file'").collect()} == {"/d/a": len(A), "/c": 0}
    # the original stays under another name, and the catalog agrees with what is left
    assert {r["path"]: r["size"] for r in repo.entries("one.broken").where("type = 'file'").collect()} == {"/d/a": len(A), "/c": len(C)}
    assert {r["snapshot"]: r["modified"] for r in repo.snapshots().collect()} == {"one": True, "one.broken": False}
    for check in (repo.check_index, repo.check_repository, repo.check_bundles, repo.check_data):
        assert check().count() == 0
    assert repo.repair().count() == 0


def test_errors(spark, repo):
    with pytest.raises(RepositoryError):
        Repository.init(spark, repo.root)
    with pytest.raises(RepositoryError):
        Repository(spark, repo.root + "-none")
    with pytest.raises(ValueError):
        repo.prune()
    repo.backup(tree(spark, {"/c": (C, 100)}), "one", "2024-01-01 10:00:00")
    with pytest.raises(RepositoryError):
        repo.backup(tree(spark, {"/c": (C, 100)}), "one", "2024-01-01 10:00:00")
    with pytest.raises(RepositoryError):
        repo.read("one", "/none", 0, 1)


def test_damaged_bytes_are_found(spark, repo):
    repo.backup(tree(spark, {"/d/a": (A, 100), "/c": (C, 100)}), "one", "2024-01-01 10:00:00")
    from cairn.operators.codecs import compress
    from cairn.tables import materialize

    small = repo.chunk_refs().where("path = '/c'").first()["hash"]
    repo._switch(chunks=materialize(repo.chunks().withColumn("data", F.when(F.col("hash") == small, F.lit(compress(b"other", repo.config.compression))).otherwise(F.col("data"))), "damage"))
    assert [r["stored_hash"] for r in repo.check_data().collect()] == [small]
    repo.repair()
    assert repo.check_data().count() == repo.check_backups().count() == repo.check_bundles().count() == 0
    assert {r["path"]: bytes(r["data"]) for r in repo.restore("one").where("size > 0").collect()} == {"/d/a": A}


class Killed(Exception):
    pass


def files_of(repo, name):
    return {r["path"]: bytes(r["data"]) for r in repo.restore(name).where("type = 'file' and size > 0").collect()}


FILES = {"/d/a": (A, 100), "/c": (C, 100), "/t": (b"tiny", 100)}


@pytest.mark.parametrize("table", ["attempts", "snapshots"])
def test_a_backup_that_died_can_run_again(spark, repo, table):
    """Whatever was written before the end, a second run gives the snapshot once, byte for byte."""

    def die(name):
        if name == table:
            raise Killed

    repo._before = die
    with pytest.raises(Killed):
        repo.backup(tree(spark, FILES), "one", "2024-01-01 10:00:00")
    again = Repository(spark, repo.root)
    assert again.snapshots().count() == 0 and again.entries().count() == 0 and again.chunk_refs().count() == 0
    again.backup(tree(spark, FILES), "one", "2024-01-01 10:00:00")
    assert files_of(again, "one") == {p: d for p, (d, _) in FILES.items()}
    assert again.entries("one").count() == 6 and again.index().groupBy("hash").count().where("count > 1").count() == 0
    for check in (again.check_backups, again.check_index, again.check_repository, again.check_bundles):
        assert check().count() == 0
    left = {r["table"]: r["rows"] for r in again.reconcile().collect()}
    assert (left["entries"] > 0) == (table in ("chunk_refs", "snapshots")) and (left["chunks"] > 0) == (table in ("bundles", "attempts"))
    assert files_of(again, "one") == {p: d for p, (d, _) in FILES.items()} and not any(r["rows"] for r in again.reconcile().collect())


@pytest.mark.parametrize("table", ["state"])
def test_a_compaction_that_died_changes_nothing(spark, repo, table):
    repo.backup(tree(spark, FILES), "one", "2024-01-01 10:00:00")
    repo.backup(tree(spark, {"/d/a": (A, 100)}), "two", "2024-01-02 10:00:00")
    repo.remove("one")
    seen = []

    def die(name):
        seen.append(name)
        if name == table and seen.count(name) == (1 if name == "state" else 2):
            raise Killed

    repo._before = die
    with pytest.raises(Killed):
        repo.vacuum(1.0, force=True)
    again = Repository(spark, repo.root)
    assert files_of(again, "two") == {"/d/a": A}
    again.reconcile()
    again.vacuum(1.0, force=True)
    assert files_of(again, "two") == {"/d/a": A} and again.check_data().count() == again.check_repository().count() == 0


def test_settings_change_and_old_data_stays(spark, repo):
    """Chunks are read by their own codec, hash and key, whatever the settings are now."""
    from cairn.functions.keys import Key

    key, other = Key.from_password("one"), Key.from_password("two")
    files, settings = dict(FILES), [("lzma/2", "murmur3", key), ("none", "blake2", other)]
    repo.backup(tree(spark, files), "s0", "2024-01-01 10:00:00")
    repo.add_key(key)
    repo.add_key(other)
    for i, (codec, method, k) in enumerate(settings, 1):
        repo.set_config(Config(2000, Chunker("ae" if i % 2 else "rabin", 1024), Compression.parse(codec), method, k and k.name))
        files[f"/new{i}"] = (bytes([i]) + B * i, 100 + i)
        repo.backup(tree(spark, files), f"s{i}", f"2024-01-0{i + 1} 10:00:00")
    assert files_of(repo, "s2") == {p: d for p, (d, _) in files.items()}
    assert repo.check_data().count() == 0
    assert {r["method"] for r in repo.method_counts().where("kind = 'codec'").collect()} == {"deflate/6", "lzma/2", None}
    with pytest.raises(RepositoryError):
        Repository(spark, repo.root).restore("s2")
    with pytest.raises(RepositoryError):
        Repository(spark, repo.root).set_config(Config(encryption=key.name))
    opened = Repository(spark, repo.root, keys=[key, other])
    opened.vacuum(1.0, force=True)
    assert files_of(opened, "s2") == {p: d for p, (d, _) in files.items()} and opened.check_data().count() == 0
    assert repo.read("s2", "/t", 1, 2) == b"in"
    copy = Repository.import_from(spark, repo.root + "-copy", repo.root, [key, other])
    assert copy.config == opened.config and files_of(copy, "s2") == files_of(opened, "s2") and copy.check_data().count() == 0


def test_locks(spark, repo):
    other = Repository(spark, repo.root)
    with repo.lock():
        assert other.is_dirty() and len(other.locks()) == 1
        for command in (lambda: other.backup(tree(spark, FILES), "one", "2024-01-01 10:00:00"), lambda: other.set_config(repo.config), lambda: other.lock(False).__enter__()):
            with pytest.raises(RepositoryError):
                command()
    with repo.lock(False), other.lock(False):
        with pytest.raises(RepositoryError):
            other.lock().__enter__()
    assert not repo.locks() and not repo.is_dirty()
    # a job that died left its lock
    repo.lock().__enter__()
    other.reconcile()
    other.backup(tree(spark, FILES), "one", "2024-01-01 10:00:00")
    # of two that write the next state at once, one says that it could not
    state = repo._state()
    repo._write_state()
    repo._state = lambda: state
    with pytest.raises(RepositoryError):
        repo._write_state()


def test_owners_by_name_and_metadata(spark, repo):
    rows = [("/", "directory", 0, 493, 7, 8, 1, None, None, None, None, None), ("/f", "file", 1, 420, 7, 8, 1, None, None, None, {"user.k": b"v"}, b"x"), ("/dev", "block_device", 0, 420, 9, 9, 1, None, 8, 1, None, None)]
    schema = "path string, type string, size bigint, mode bigint, uid bigint, gid bigint, mtime bigint, symlink_target string, major bigint, minor bigint, xattrs map<string,binary>, data binary"
    repo.backup(spark.createDataFrame(rows, schema), "one", "2024-01-01 10:00:00", user_names={7: "ann", 9: "bob"}, group_names={8: "staff"})
    users, groups = spark.createDataFrame([(70, "ann")], "id long, name string"), spark.createDataFrame([(80, "staff")], "id long, name string")
    back = {r["path"]: r for r in repo.restore("one", users=users, groups=groups).collect()}
    assert {p: (r["uid"], r["gid"]) for p, r in back.items()} == {"/": (70, 80), "/f": (70, 80), "/dev": (9, 9)}
    assert (back["/dev"]["major"], back["/dev"]["minor"], bytes(back["/f"]["xattrs"]["user.k"]), bytes(back["/f"]["data"])) == (8, 1, b"v", b"x")
    with pytest.raises(RepositoryError):
        repo.restore("one", "/none")
