import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pathweave.llm import line_dedup, minhash, mixing, quality, queries, sharding
from tests.compare import both

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPECIAL = [(0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t", None, None, 3), (3, "one two three", "en", None, 13), (4, "one two three", "en", "b", 13), (5, "word " * 30_000, "en", "b", 1), (None, "a null key here with words", None, "c", None), (6, "a null key here with words", None, "c", None), (7, "One TWO three", "de", "b", 1), (4, "one two three", "en", "b", 13)]


@pytest.fixture(scope="module")
def special(spark):
    return spark.createDataFrame(SPECIAL, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    columns, names, mine, theirs = both(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert columns == names
    assert mine == theirs


def check_mix(rows, got, weights=(5, 2, 1)):
    sizes, largest, source = defaultdict(int), defaultdict(int), {}
    for k, t, s in rows:
        n = len(brute.words(t))
        sizes[s] += n
        largest[s] = max(largest[s], n)
        source[k] = s
    want = brute.targets(sizes, weights)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["taken"] in [i * r["size"] for i in range(4)]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] / 2 + 1e-6 or want[s] == 3 * sizes[s]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark, docs):
    got = queries.op1_mixing(spark, SF).collect()
    assert len(got) == len(docs)
    check_mix([(d["doc_id"], d["text"], d["source"]) for d in docs], got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op1_mixing(spark, SF).collect()))


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_mix_with_caps_and_null_sources(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 9), None, rng.choice(["tiny"] + ["big"] * 20 + [None] * 4 + ["é", "z"] * 3), 0) for i in range(800)]
    rows[0] = (0, "w w w", None, "tiny", 0)
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("u", F.lit(1))
    got = mixing.mix(df).collect()
    check_mix([(r[0], r[1], r[3]) for r in rows], got)
    assert {r["copies"] for r in got} <= {0, 1, 2, 3}


def test_nested_budgets(spark):
    base = spark.range(500).select(F.lit("s").alias("s"), F.lit(10).cast("long").alias("size"), F.shiftrightunsigned(F.xxhash64("id"), 1).alias("u"))
    last = -1
    for target in (0.0, 10.0, 1234.0, 2500.0, 4999.0):
        plan = spark.createDataFrame([("s", 5000, target)], "s string, source_size long, target double")
        below = mixing.thresholds(base, plan, True).first()["below"]
        assert abs(base.filter(F.col("u") < below).count() * 10 - target) <= 5
        assert below >= last
        last = below


def test_applied_mix(spark, special):
    taken = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(special).join(special.select("doc_id", "source").distinct(), "doc_id").collect()}
    out = Counter((r["doc_id"], r["source"]) for r in mixing.apply_mix(special).collect())
    for k, n in taken.items():
        if k[0] not in (4, None):
            assert out.get(k, 0) == n
    assert mixing.apply_mix(special).columns == special.columns
    assert mixing.mix(special).count() == len(SPECIAL)
    assert mixing.mix(special.limit(0)).collect() == [] == mixing.apply_mix(special.limit(0)).collect()


def check_shards(rows, got, shards=8, near=0.02):
    assert len(got) == len(rows)
    slots, weight = defaultdict(list), Counter({i: 0 for i in range(shards)})
    for r in got:
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(weight) == set(range(shards))
    mean = sum(weight.values()) / shards
    assert all(abs(w - mean) <= near * mean + 200 for w in weight.values())


def test_shards(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_kd_shards(spark, sf).collect()
    check_shards(rows, got)
    where = defaultdict(set)
    for r in got:
        raw = rows[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        where[raw].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_shards_with_a_hot_group(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", broadcast)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i} " * (i % 7 + 1), None, None, 0) for i in range(1500)]
    df = spark.createDataFrame(rows, DOCS)
    for shards in (8, 5):
        check_shards(rows, sharding.shard_documents(df, shards=shards).collect(), shards)


def test_shards_by_target(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    out = sharding.shard(df, [F.col("doc_id")], F.lit(1), F.col("text"), target=300)
    sizes = sorted(r["count"] for r in out.groupBy("shard").count().collect())
    assert len(sizes) == 4 and sizes[0] >= 248 and sizes[-1] <= 252
    spans = out.groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False))  # one dimension: intervals


def test_shard_cases(special):
    got = sharding.shard_documents(special).collect()
    assert len(got) == len(SPECIAL)
    assert [r["size"] for r in got if r["doc_id"] in (0, 1)] == [1, 1]
    assert sharding.shard_documents(special.limit(0)).collect() == []


def chunks_of(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(line_dedup.chunks(F.col("t")).alias("c")).first()["c"]
    return [c["chunk"].split("\n") for c in row]


def test_chunks_are_those_of_the_slow_version(spark, docs):
    for t in [d["text"] for d in docs[:40]] + ["", "\n", "a\n\nb", "a\n" * 50]:
        lines = t.split("\n")
        assert chunks_of(spark, t) == [lines[a : a + n] for a, n in brute.line_chunks(t)]


def test_boundaries_resist_shifts(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(200)]
    whole = {"\n".join(c) for c in chunks_of(spark, "\n".join(lines))}
    moved = {"\n".join(c) for c in chunks_of(spark, "\n".join(["new first", *lines[:100], "new middle", *lines[100:]]))}
    assert len(whole - moved) <= 4
    assert all(len(c) > 1 for c in chunks_of(spark, "\n".join(lines))[1:])


@pytest.mark.parametrize("least", [0, line_dedup.LEAST_WORDS])
def test_line_dedup_against_brute_force(spark, least):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 400")
    texts = sorted((r["doc_id"], r["text"]) for r in rows.collect())
    gone = brute.lines_gone(texts, least)
    got = {r["doc_id"]: r for r in line_dedup.dedup(rows, least_words=least).collect()}
    assert {k: r["text"] for k, r in got.items()} == brute.without(texts, gone)
    assert {k: r["n_removed"] for k, r in got.items()} == {k: len(v) for k, v in gone.items()}
    assert sum(r["n_removed"] for r in got.values()) > 0


def passage(seed, words=60, lines=1):
    rng = random.Random(seed)
    w = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(words)]
    n = -(-words // lines)
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, words, n))


def test_planted_passages(spark):
    shared = passage(1)
    rows = [(i, "\n".join([passage(100 + i, 30, 3), shared, passage(200 + i, 30, 3)]), None, None, 0) for i in range(30)]
    clean = [(i, passage(1000 + i, 90, 4), None, None, 0) for i in range(30, 60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows + clean, DOCS)).collect()}
    assert shared in got[0]
    assert not any(shared in got[i] for i in range(1, 30))
    assert all(got[i] == t for i, t, *_ in clean)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.crc32(F.concat_ws("|", *[x.cast("string") if not isinstance(x, str) else x for x in c])) % 3)
    rows = [(i, passage(i % 5, 70), None, None, 0) for i in range(20)]
    monkeypatch.setattr(line_dedup, "row_hash", lambda k, t: F.crc32(F.col(t)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: t if i < 5 else "" for i, t, *_ in rows}


def test_line_dedup_cases(special):
    clash = special.withColumn("n_removed", F.lit("mine")).withColumn("places", F.lit(1)).withColumn("_key", F.lit(2))
    got = line_dedup.dedup(clash).collect()
    assert len(got) == len(SPECIAL)
    assert [r["text"] for r in got if r["doc_id"] == 0] == [None]
    assert sum(r["n_removed"] for r in got) == 0
    assert line_dedup.dedup(special.limit(0)).collect() == []
    long = special.sparkSession.createDataFrame([(None, "y z\n" + "z" * 300, None, None, 0), (9, "y z\n" + "z" * 300, None, None, 0), (9, "y z\n" + "z" * 300, None, None, 0)], DOCS)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.dedup(long).collect()) == [(0, 2), (9, 0), (9, 0)]


def test_quality_counts(spark, docs, special):
    for r in queries.op8_host_rules(spark, SF).collect():
        text = docs[r["doc_id"]]["text"]
        assert docs[r["doc_id"]]["doc_id"] == r["doc_id"]
        n, chars, symbols, lines, repeats = brute.counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert r["kept"] in (False, not r["base_failed"])
    odd = ["a a a a", "a b c a b c", "a b c d a b c", " lead", "trail ", "x\ny\nx\n\n\n", "é|&", "a b", "a b c"]
    rows = special.sparkSession.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(odd)], DOCS)
    for r in quality.features(rows.select("doc_id", "text")).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.counts(odd[r["doc_id"]])


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_hosts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, good(i) if i % 2 else "too short", None, f"good{i % 8}" if i % 10 else "good", 0) for i in range(0, 400) if i % 2 or i % 20 == 0]
    rows += [(1000 + i, good(i) if i == 0 else "too short", None, "bad", 0) for i in range(200)]
    rows += [(2000, "too short", None, "small", 0), (2001, good(7), None, "small", 0), (2002, good(8), None, None, 0), (2003, "too short", None, None, 0)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[1000]["base_failed"] and not got[1000]["kept"]
    assert got[2001]["kept"] and got[2002]["kept"] and not got[2003]["kept"] and not got[2000]["kept"]
    assert all(got[k]["kept"] == (t != "too short") for k, t, *_ in rows if k < 1000)


def test_quality_cases(special):
    got = quality.judge(special.withColumn("host", F.lit(1)).withColumn("n_words", F.lit("x"))).collect()
    assert len(got) == len(SPECIAL)
    assert [r["n_words"] for r in got if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    assert quality.judge(special.limit(0)).collect() == []


def check_near(rows, got):
    expected = brute.near_duplicates(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return expected


def test_near_duplicates(spark, docs):
    check_near([(d["doc_id"], d["text"]) for d in docs], queries.op10_near_duplicates(spark, SF).collect())


def edited(words, share, rng):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"e{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("block", [2048, 5])
def test_groups_of_near_copies(spark, monkeypatch, block):
    """Copies of one text, some near enough, some only near others, and two groups that share half."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(300)]
    half = base[:150] + [f"h{i}" for i in range(150)]
    rows = [(i, edited(base if i % 3 else half, rng.choice([0.0, 0.005, 0.012, 0.02, 0.03, 0.05]), rng)) for i in range(240)]
    rows += [(500 + i, edited(rows[i][1].split(), 0.004, rng)) for i in range(0, 240, 7)]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    expected = check_near(rows, minhash.near_duplicates(df).collect())
    assert len({c for _, c in expected.values()}) > 3
    assert sorted(r["doc_id"] for r in minhash.keep_one(df).collect()) == sorted({c for _, c in expected.values()})


def test_near_duplicate_cases(special):
    got = minhash.near_duplicates(special.withColumn("rid", F.lit("x")).withColumn("u", F.lit(1))).collect()
    assert len(got) == len(SPECIAL)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in (0, 1, 2, 3, 5)] == [0, 0, 0, 1, 1]
    assert [by[i]["component_id"] for i in (0, 1, 2, 3, 4, 5, 6, 7)] == [0, 1, 2, 3, 3, 5, 6, 3]
    (null,) = [r for r in got if r["doc_id"] is None]
    assert null["component_id"] == 6 and not null["kept"]
    assert minhash.near_duplicates(special.limit(0)).collect() == []
    assert minhash.keep_one(special).columns == special.columns


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100)]
    edges = chain + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(300, i) for i in range(301, 340)]
    edges = [e for e in edges if e[0] != e[1]]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["rid"]: r["label"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).collect() == []
    first, more = (spark.createDataFrame(e, "a long, b long") for e in (edges[::2], edges[1::2]))
    assert {r["rid"]: r["label"] for r in minhash.merged(minhash.components(first), more).collect()} == got
