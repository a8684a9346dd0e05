import os

import pytest
from pyspark.sql import functions as F

from pathweave.operators import index as I
from pathweave.operators import search as S
from pathweave.operators.ordering import in_dir_order, ordered, sample_blocks, with_docid, with_seq
from pathweave.operators.search import Options, exit_status, search
from pathweave.operators.visibility import existing, visible

NAMES = ["", "a", "ab", "/ab", "abc", "/a/", "/a/z", "/a.b", "/a/b/c.txt", "a\\b", "a*b", "[x]", "it's", "a`b", "a\nb", "/É/é", "İx", "straße", "日本語", "/a/z", "/my dir/f", None, "/x/thing.c", "/x/THING.C", "thx"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "seq long, path string")


@pytest.fixture(scope="module")
def built(spark, names, tmp_path_factory):
    place = f"file://{tmp_path_factory.mktemp('index')}/i"
    I.write(I.build(names, 4, conf_block="x"), place)
    return place


def paths(df):
    return [r["path"] for r in df.collect()]


CASES = [(["ab"], {}), (["thing"], {}), (["thing"], {"ignore_case": True}), (["*.c"], {}), (["*/z"], {}), (["/a", "z"], {}), (["é"], {"ignore_case": True}), (["a\\\\b"], {}), (["\\[x\\]"], {}), (["nothing here"], {}), (["/ab"], {}), (["日本"], {}), (["b/c\\.t"], {"regex": "extended"}), (["thing\\.c$"], {"regex": "basic", "ignore_case": True}), (["STRASSE"], {"ignore_case": True}), (["ix"], {"ignore_case": True}), (["thing"], {"basename": True, "ignore_case": True})]


@pytest.mark.parametrize(("patterns", "options"), CASES)
def test_index_changes_no_answer(spark, built, patterns, options):
    index = I.read(spark, built)
    by_index = paths(search([index], patterns, Options(use_index=True, **options)))
    assert by_index == paths(search([index], patterns, Options(use_index=False, **options)))
    assert by_index == paths(search([index], patterns, Options(**options)))


def test_order_limit_count(spark, built):
    index = I.read(spark, built)
    assert paths(search([index], ["a"], Options(limit=3))) == ["a", "ab", "/ab"]
    n = search([index], ["a"], Options(count=True)).first()["n"]
    assert n == len(paths(search([index], ["a"])))
    assert search([index], ["a"], Options(count=True, limit=2)).first()["n"] == 2
    two = search([index, index], ["/a/z"])
    assert [tuple(r) for r in two.collect()] == [(0, 6, "/a/z"), (0, 19, "/a/z"), (1, 6, "/a/z"), (1, 19, "/a/z")]
    assert exit_status(two) == 0
    assert exit_status(search([index], ["nope nope"])) == 1
    with pytest.raises(ValueError):
        Options(limit=0)
    with pytest.raises(ValueError):
        search([index], [])


def test_basename(spark, built):
    index = I.read(spark, built)
    assert paths(search([index], ["*z"], Options(basename=True))) == ["/a/z", "/a/z"]
    assert "/a/" in paths(search([index], ["*"], Options(basename=True)))


def test_visibility(spark):
    names = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/ab/c",), ("rel",), ("/d",)], "path string")
    deny = lambda *d: spark.createDataFrame([(x,) for x in d], "dir string")
    assert sorted(paths(visible(names, deny("/a")))) == ["/a", "/ab/c", "/d", "rel"]
    assert sorted(paths(visible(names, deny("/a/b")))) == ["/a", "/a/b", "/ab/c", "/d", "rel"]
    assert paths(visible(names, deny("/"))) == []
    assert len(paths(visible(names, deny()))) == 6


def test_visibility_flag(spark, names):
    closed = spark.createDataFrame([("/a",)], "dir string")
    shown = I.build(names, 4, check_visibility=False)
    guarded = I.build(names, 4)
    assert paths(search([shown], ["/a/z"], Options(denied=closed))) == ["/a/z", "/a/z"]
    assert paths(search([guarded], ["/a/z"], Options(denied=closed))) == []
    assert paths(search([guarded], ["/a/z"], Options(denied=closed, ignore_visibility=True))) == ["/a/z", "/a/z"]


def test_existing(spark, names):
    live = spark.createDataFrame([("ab",), ("ab",)], "path string")
    assert paths(existing(names, live)) == ["ab"]


def test_versions(spark, built, names):
    first = I.read(spark, built)
    asked = {"version": 1, "block_size": 4, "check_visibility": True, "conf_block": "x"}
    assert asked.items() <= first.metadata.items()
    n = first.names.agg(F.count("*"), F.max("docid") + 1, F.sum(F.octet_length("path"))).first()
    assert [first.metadata[k] for k in ("n_names", "n_blocks", "name_bytes", "before")] == [*n, None]
    second = I.write(I.build(names.limit(3), 2), built)
    assert I.read(spark, built).names.count() < first.names.count()
    assert set(I.section_sizes(spark, built)) == {"names", "postings", "stats", "metadata"}
    third = I.write(I.build(names.limit(2), 2), built)
    assert sorted(x for x in os.listdir(built.removeprefix("file://")) if x.startswith("v-")) == sorted([second, third])  # the first one has gone
    with pytest.raises(FileNotFoundError):
        I.read(spark, built + "-none")
    r = I.codec_report(spark, built)
    assert r["n_postings"] == I.read(spark, built).postings.count() and r["bytes_per_posting"] == r["bytes"] / max(1, r["n_postings"])


def test_written_index_reads_candidates(spark, tmp_path, monkeypatch):
    names = spark.range(5000).select(F.col("id").alias("seq"), F.concat(F.lit("/d/"), F.col("id").cast("string"), F.when(F.col("id") % 977 == 5, F.lit("/needle")).otherwise(F.lit("/hay"))).alias("path"))
    place = str(tmp_path / "i")
    I.write(I.build(names, 4), place)
    index = I.read(spark, place)
    expected = [r["path"] for r in names.filter(F.col("path").contains("needle")).orderBy("seq").collect()]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = search([index], ["needle"], Options(use_index=True))
    assert paths(found) == expected
    assert "GreaterThanOrEqual(docid" in plan(found) and "Join" not in plan(found)
    scanned = search([index], ["needle"])  # too small for an index
    assert paths(scanned) == expected and "docid" not in plan(scanned).split("PushedFilters")[1]
    monkeypatch.setattr(S, "INDEX_FROM", 0)
    assert paths(search([index], ["needle"])) == expected and "GreaterThanOrEqual(docid" in plan(search([index], ["needle"]))
    monkeypatch.setattr(S, "NAMED_BLOCKS", 2)
    joined = search([index], ["needle"])
    assert paths(joined) == expected and "Join" in plan(joined)
    assert paths(search([index], ["needle", "hay"], Options(use_index=True))) == []


def test_ranges_of_blocks(spark):
    names = spark.range(2000).select(F.col("id").alias("docid"), F.lit("x").alias("path"))
    for docids in ([], [7], [1, 2, 3], list(range(0, 2000, 9)), [1999, 0]):
        assert sorted(r["docid"] for r in S.within(names, docids).collect()) == sorted(docids)


def test_dense_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r["k"]: r["seq"] for r in with_seq(rows, "k").collect()}
    assert got == {k: k for k in range(1000)}
    blocks = with_docid(with_seq(rows, "k"), 32)
    assert blocks.select("docid").distinct().count() == 32
    assert sample_blocks(blocks, 5).select("docid").distinct().count() == 5
    assert sorted(map(tuple, sample_blocks(blocks, 5).collect())) == sorted(map(tuple, sample_blocks(blocks, 5).collect()))
    assert [r["seq"] for r in ordered(with_seq(rows, "k"), 3, ("seq",)).collect()] == [0, 1, 2]


def test_crawl_order(spark):
    rows = spark.createDataFrame([("/a/z",), ("/b",), ("/a.b",), ("/a",), ("/a/y",), ("/a/y/q",)], "path string")
    assert paths(in_dir_order(rows)) == ["/a", "/a.b", "/b", "/a/y", "/a/z", "/a/y/q"]


def test_short_names_have_their_trigram(spark):
    rows = spark.createDataFrame([(0, "/ab"), (1, "ab"), (2, "")], "docid long, path string")
    assert [tuple(r) for r in I.build_trigrams(rows).collect()] == [(0, "2F6162")]
    lists = I.posting_lists(spark.createDataFrame([(2, "x"), (1, "x")], "docid long, trgm string")).first()
    assert (lists["num_docids"], lists["docids"]) == (2, [1, 2])


def test_build_is_dealt_by_bytes(spark, tmp_path, monkeypatch):
    """A task's rows follow TASK_BYTES, whatever the number of shuffle partitions."""
    monkeypatch.setattr(I, "TASK_BYTES", 3000, raising=False)
    rows = [(i, f"/common/{i * 7919 % 3001}") for i in range(3000)] + [(3000, "/long/" + "abc" * 500), (3001, None), (3002, ""), (3003, "é")]
    names = spark.createDataFrame(rows, "seq long, path string")
    place = str(tmp_path / "i")
    I.write(I.build(names, 2), place)
    index = I.read(spark, place)
    expected = {(i // 2, raw[k : k + 3].hex().upper()) for i, p in rows if p for raw in [p.encode()] for k in range(len(raw) - 2)}
    found = [tuple(r) for r in index.postings.select("docid", "trgm").collect()]
    assert len(found) == len(expected) and set(found) == expected
    assert sorted(map(tuple, index.stats.collect())) == sorted((t, sum(u == t for _, u in expected)) for t in {t for _, t in expected})
    for table, n in ((index.names, 3002), (index.postings, len(expected))):
        parts = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert len(parts) > 8 and max(parts) < n / 4
    assert I.build_trigrams(names, docid="seq").rdd.getNumPartitions() > 8
    assert paths(search([index], ["n/77"], Options(use_index=True))) == [p for _, p in rows if p and "n/77" in p]


def test_a_trigram_of_all_blocks_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "TASK_BYTES", 1000, raising=False)
    place = str(tmp_path / "i")
    I.write(I.build(spark.range(2000).select(F.col("id").alias("seq"), F.lit("same").alias("path")), 1), place)
    postings = I.read(spark, place).postings
    parts = [r["count"] for r in postings.groupBy(F.input_file_name()).count().collect()]
    assert sum(parts) == 4000 and len(parts) > 6 and max(parts) < 1000
