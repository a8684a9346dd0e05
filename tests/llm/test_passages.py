import random
import time

import corpus_pipeline
import pytest
from pathweave.llm import line_dedup

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 4))) for _ in range(n)]


def some_lines(rng, counts):
    return [" ".join(words(rng, n)) for n in counts]


def test_short_passages_between_short_lines(spark):
    """Passages of 1 to 8 lines and 50 to 60 words, every line under 240 code points, go whatever stands around them."""
    rng = random.Random(5)
    passages = [some_lines(rng, c) for c in ([50], [30, 30], [20] * 3, [15] * 4, [12] * 5, [10] * 6, [7] * 8, [49, 1], [1, 49, 1], [5, 0, 45, 3], [3] * 17)]
    foreign = lambda: some_lines(rng, [rng.randint(1, 8) for _ in range(rng.randint(1, 5))])
    rows = [(i * 100 + j, "\n".join([*foreign(), *p, *foreign()])) for i, p in enumerate(passages) for j in range(12)]
    near = some_lines(rng, [24, 25])  # 49 words are no passage
    rows += [(5000 + j, "\n".join([*foreign(), *near, *foreign()])) for j in range(12)]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, df, "").collect()}
    for i, p in enumerate(passages):
        assert "\n".join(p) in got[i * 100]
        for j in range(1, 12):
            assert not any(len(x.split()) > 2 and x in got[i * 100 + j] for x in p)
            assert "\n".join(p) not in got[i * 100 + j]
    again = {r["doc_id"]: r for r in line_dedup.dedup(df.filter("doc_id >= 300 and doc_id < 400"), least_words=50).collect()}
    assert [again[300 + j]["n_removed"] for j in range(12)] == [0] + [4] * 11


@pytest.mark.parametrize("least", [0, 12])
def test_lines_against_brute_force(spark, least):
    """The lines that go are those of the slow version, which has boundaries of its own."""
    rng = random.Random(7)
    pool = some_lines(rng, [rng.randint(0, 9) for _ in range(14)])
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(1, 40)))) for k in range(60)] + [(90, "\n".join(["one line here"] * 30)), (91, "")]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    got = {r["doc_id"]: r for r in line_dedup.dedup(df, least_words=least).collect()}
    gone = brute.lines_gone(rows, least)
    assert any(gone.values())
    assert {k: r["text"] for k, r in got.items()} == brute.without(rows, gone)
    assert {k: r["n_removed"] for k, r in got.items()} == {k: len(v) for k, v in gone.items()}


def test_menus_of_short_lines(spark):
    menu = "Home\nNews\nSport\nMore"
    rng = random.Random(3)
    rows = [(k, "\n".join([*some_lines(rng, [9] * 4), *([menu] * 3), *some_lines(rng, [9] * 4)]), None, None, 0) for k in range(8)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k].count("Sport") < 3 for k in range(1, 8))


def test_many_lines_take_linear_time(spark):
    def seconds(n):
        rows = [(k, "\n".join(f"line {i % (n // 2)} of it" for i in range(n)), None, None, 0) for k in range(2)]
        df, began = spark.createDataFrame(rows, DOCS), time.perf_counter()
        assert line_dedup.dedup(df).filter("n_removed > 0").count() == 2
        return time.perf_counter() - began

    seconds(500)
    assert seconds(32_000) < 8 * seconds(8000)


def test_runs_with_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: line_dedup.F.crc32(line_dedup.F.concat_ws("|", *[x.cast("string") for x in c])) % 3)
    monkeypatch.setattr(line_dedup, "row_hash", lambda k, t: line_dedup.F.crc32(line_dedup.F.col(t)))
    rng = random.Random(9)
    texts = ["\n".join(some_lines(rng, [15] * 4)) for _ in range(4)]
    rows = [(i, texts[i % 4] + f"\nend {i}", None, None, 0) for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS), least_words=50).collect()}
    assert got == {i: t if i < 4 else f"end {i}" for i, t, *_ in rows}
