import struct

import pytest
from pyspark.sql import functions as F

from pathweave.functions import paths as P
from pathweave.operators.merge import merge_snapshot, usable, with_old_times
from pathweave.operators.mounts import bind_mounts, pruned_mounts
from pathweave.operators.prune import PruneConfig, prune
from pathweave.operators.render import write_names
from pathweave.sources import config, files
from pathweave.sources.listing import denied_dirs, listing
from pathweave.streaming.changes import apply_changes, follow


def paths(df):
    return sorted(r["path"] for r in df.collect())


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "p string").select(*columns).first()


@pytest.mark.parametrize(("path", "base", "dir_", "up"), [("/a/b", "b", "/a", ["/a"]), ("abc", "abc", None, []), ("/a/", "", "/a", ["/a"]), ("/x", "x", "/", []), ("/a/b/c", "c", "/a/b", ["/a", "/a/b"]), ("a/b", "b", "a", ["a"]), ("", "", None, [])])
def test_parts(spark, path, base, dir_, up):
    p = F.col("p")
    assert tuple(one(spark, path, P.basename(p), P.parent(p), P.ancestors(p))) == (base, dir_, up)


QUOTES = [("plain", "plain"), ("it's", r"'it'$'\'''s'"), ("a\nb", r"'a'$'\n''b'"), ("a`b", "'a`b'"), ("a\x01", r"'a'$'\001'"), ('a"b', r"""'a'$'\"''b'"""), ("a\\", r"""'a'$'\\'"""), ("\t\n", r"""''$'\t\n'"""), ("sp ace", "sp ace"), ("\x1f", r"""''$'\037'""")]


@pytest.mark.parametrize(("path", "quoted"), QUOTES)
def test_shell_quote(spark, path, quoted):
    assert one(spark, path, P.shell_quote(F.col("p")))[0] == quoted


def test_small_functions(spark):
    p = F.col("p")
    assert one(spark, "x", P.join_path(F.lit("/"), p), P.join_path(F.lit("/a"), p))[:] == ("/x", "/a/x")
    assert one(spark, "/a/b", P.is_child(p, F.lit("/a")), P.is_child(p, F.lit("/")), P.is_child(p, F.lit("/a/b")))[:] == (True, False, False)
    assert one(spark, r"/a\040b\134\011", P.octal_unescape(p))[0] == "/a b\\\t"
    assert one(spark, r"caf\303\251", P.octal_unescape(p))[0] == "café"
    assert one(spark, "  a  b\tc ", P.words(p))[0] == ["a", "b", "c"]
    assert one(spark, "yes", P.flag(p), P.flag(F.lit("0")), P.flag(F.lit("maybe")))[:] == (True, False, None)
    assert one(spark, "nfs", P.fs_type(p), P.prefix_of(F.lit("n"), p))[:] == ("NFS", True)
    assert sorted(one(spark, "abab", P.trigrams(F.encode(p, "UTF-8")))[0]) == ["616261", "626162"]
    assert one(spark, "ab", P.trigrams(F.encode(p, "UTF-8")))[0] == []


def test_dir_time(spark):
    t = lambda s, n: F.struct(F.lit(s).cast("long").alias("sec"), F.lit(n).alias("nsec"))
    row = one(spark, "", P.dir_time(t(5, 1), t(5, 2)), P.dir_time(t(97, 0), t(1, 0), F.lit(100)), P.dir_time(t(96, 9), t(1, 0), F.lit(100)))
    assert [tuple(x) for x in row] == [(5, 2), (0, 0), (96, 9)]


MOUNTS = "id int, parent_id int, dev_major int, dev_minor int, root string, mount_point string, fs_type string, source string"


def test_prune(spark):
    rows = spark.createDataFrame([(p,) for p in ["/", "/a", "/a/b", "/a/b/c", "/my dir", "/my dir/x", "/k/.git", "/k/.git/o", "/n", "/n/m", "/n/m/q", "/d", "/d/e"]], "path string")
    mounts = spark.createDataFrame([(1, 0, 8, 1, "/", "/", "ext4", "x"), (2, 1, 0, 7, "/", "/n", "nfs4", "y"), (3, 2, 8, 2, "/", "/n/m", "ext4", "z"), (4, 1, 8, 1, "/srv", "/d", "ext4", "x")], MOUNTS)
    c = PruneConfig(True, ["NFS4"], [".git"], ["/a", "/a/b", "/my dir"])
    assert paths(prune(rows, c, mounts)) == ["/a", "/d", "/k/.git", "/my dir", "/n"]
    assert paths(prune(rows, PruneConfig(), mounts)) == paths(rows.filter("path <> '/'"))


def test_mounts(spark):
    rows = [(1, 0, 8, 1, "/foo", "/1", "e", ""), (2, 1, 8, 1, "/foobar", "/2", "e", ""), (3, 1, 8, 1, "/foo", "/3", "e", ""), (4, 3, 8, 2, "/", "/3/4", "e", ""), (5, 4, 9, 9, "/", "/3/4/5", "e", "")]
    m = spark.createDataFrame(rows, MOUNTS)
    assert sorted(r["id"] for r in bind_mounts(m).collect()) == [2, 3]
    assert sorted(r["id"] for r in pruned_mounts(m.withColumn("pruned", F.col("id") == 3)).collect()) == [3, 4, 5]
    table = spark.createDataFrame([("36 35 98:0 /mnt1 /mnt\\0402 rw,noatime master:1 - ext3 /dev/root rw",), ("37 35 0:4 / /p rw - proc proc rw",), ("junk",)], "value string")
    assert [tuple(r) for r in files.mount_info(table).collect()] == [(36, 35, 98, 0, "/mnt1", "/mnt 2", "ext3", "/dev/root"), (37, 35, 0, 4, "/", "/p", "proc", "proc")]
    lines = spark.createDataFrame([(0, "d /x ext4 rw 0 0"), (1, "e /x nfs rw 0 0")], "ordinal int, value string")
    assert files.mounts_at(lines, "/x").first()["fs_type"] == "ext4"


def test_config():
    c = config.parse('# note\nPRUNEFS = "nfs NFS4"\nPRUNE_BIND_MOUNTS="yes" # on\n\nPRUNEPATHS = "/a /b"\n')
    assert c == PruneConfig(True, ("nfs", "NFS4"), (), ("/a", "/b"))
    for bad in ('X = "1"', 'PRUNEFS = "a"\nPRUNEFS = "b"', "PRUNEFS = a", 'PRUNE_BIND_MOUNTS = "maybe"', 'PRUNEFS = "a'):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    assert config.load("/nonexistent/file") == PruneConfig()
    o = config.override(c, {"fs": "tmpfs"}, {"names": [".git .hg"]}, ["/with space"], "no")
    assert o == PruneConfig(False, ("tmpfs",), (".git", ".hg"), ("/a", "/b", "/with space"))
    assert PruneConfig(fs=["b", "A"]).block() == PruneConfig(fs=["a", "B", "b"]).block() != c.block()


def test_index_paths():
    assert files.split_index_paths(r"/a\:b:/c\\") == ["/a:b", "/c\\"]
    for bad in ("a\\", "a:", ":a", ""):
        with pytest.raises(ValueError):
            files.split_index_paths(bad)
    assert files.index_paths([], "/e:/f", "/default") == ["/default", "/e", "/f"]
    assert files.index_paths(["/x:/y", "/z"], None, "/default") == ["/x", "/y", "/z"]


def test_text_source(spark, tmp_path):
    (tmp_path / "n.txt").write_bytes("/b\n/a\n\n".encode() + b"x" * 70000 + b"\nlast")
    rows = files.text_names(spark, str(tmp_path / "n.txt")).orderBy("seq").collect()
    assert [(r["seq"], r["path"][:4]) for r in rows] == [(0, "/b"), (1, "/a"), (2, "xxxx"), (3, "last")]


def test_path_database(spark, tmp_path):
    record = lambda d, *entries: struct.pack(">QII", 5, 6, 0) + d + b"\0" + b"".join(bytes([t]) + n + b"\0" for t, n in entries) + b"\2"
    data = files.MAGIC + struct.pack(">IBBH", 3, 0, 1, 0) + b"/\0" + b"k=v" + record(b"/", (1, b"a"), (0, b"f\xff")) + record(b"/a", (0, b"x"))
    (tmp_path / "db").write_bytes(data)
    rows = files.path_database(spark, str(tmp_path / "db")).orderBy("seq").collect()
    assert [(r["path_bytes"], r["is_dir"]) for r in rows] == [(b"/a", True), (b"/f\xff", False), (b"/a/x", False)]
    with pytest.raises(ValueError):
        list(files.parse_path_database(b"nothing of the kind"))


def test_listing(spark, tmp_path):
    for f in ("a/x", "a/b/y", "c/.git/z", "top"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("")
    rows = listing(spark, str(tmp_path), [str(tmp_path / "a/b")], [".git"])
    assert [p.removeprefix(str(tmp_path)) for p in paths(rows)] == ["/a", "/a/b", "/a/x", "/c", "/c/.git", "/top"]
    assert denied_dirs(rows).count() == 0
    assert rows.filter("is_dir and sec > 0").count() == 4


ENTRY = "parent string, name string, is_dir boolean"
DIRS = "dir string, sec long, nsec int"


def test_merge(spark):
    before = spark.createDataFrame([("/a", "x", False), ("/b", "old", False), ("/gone", "z", False), ("/u", "q", False)], ENTRY)
    listed = spark.createDataFrame([("/a", "not read", False), ("/b", "new", False), ("/n", "n", True), ("/u", "w", False)], ENTRY)
    dirs = spark.createDataFrame([("/a", 5, 1), ("/b", 5, 2), ("/n", 1, 0), ("/u", 0, 0)], DIRS)
    old = spark.createDataFrame([("/a", 5, 1), ("/b", 5, 1), ("/gone", 9, 9), ("/u", 0, 0)], DIRS)
    assert paths(merge_snapshot(before, dirs, old, listed)) == ["/a/x", "/b/new", "/n/n", "/u/w"]
    times = with_old_times(listed, spark.createDataFrame([("/b", "new", 7, 8)], "parent string, name string, sec long, nsec int"))
    assert {r["name"]: (r["old_sec"], r["old_nsec"]) for r in times.collect()} == {"not read": (0, 0), "new": (7, 8), "n": (0, 0), "w": (0, 0)}
    assert usable({"version": 1, "conf_block": PruneConfig().block()}, PruneConfig(), 1)
    assert not usable({"version": 1, "conf_block": "?"}, PruneConfig(), 1) and not usable(None, PruneConfig(), 1)


SNAP = "dir string, sec long, nsec int, entries array<string>"


def test_following_changes(spark, tmp_path):
    before = spark.createDataFrame([("/a", 5, 0, ["x"]), ("/b", 9, 0, ["keep"])], SNAP)
    changes = spark.createDataFrame([("/a", 6, 0, ["y"]), ("/a", 7, 0, ["z"]), ("/b", 8, 0, ["late"]), ("/c", 1, 0, ["new"])], SNAP)
    expected = {"/a": ["z"], "/b": ["keep"], "/c": ["new"]}
    assert {r["dir"]: r["entries"] for r in apply_changes(before, changes).collect()} == expected
    changes.write.parquet(f"{tmp_path}/in")
    state = {"now": before}

    def save(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/v{number}")
        state["now"] = spark.read.parquet(f"{tmp_path}/v{number}")

    follow(spark.readStream.schema(SNAP).parquet(f"{tmp_path}/in"), lambda: state["now"], save, f"{tmp_path}/log").awaitTermination()
    assert {r["dir"]: r["entries"] for r in state["now"].collect()} == expected


def test_written_names(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb",), ("c",)], "path string").coalesce(1)
    write_names(rows, f"{tmp_path}/zero", zero=True)
    assert b"".join(p.read_bytes() for p in (tmp_path / "zero").glob("part*")) == b"a\nb\0c\0"
    write_names(rows, f"{tmp_path}/quoted", quoted=True)
    assert b"".join(p.read_bytes() for p in (tmp_path / "quoted").glob("part*")) == b"'a'$'\\n''b'\nc\n"
