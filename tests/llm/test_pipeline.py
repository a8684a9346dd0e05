import hashlib
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from pathweave.llm import byte_bpe  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from . import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, docs, tmp_path):
    """Every stage's input and output, written and read as a run does."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, tmp_path):
    import tiktoken

    first = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {name: (before.collect(), after.collect()) for name, before, after in staged(spark, first, tmp_path)}
    assert list(steps) == ["language", "lines", "near_duplicates", "mix", "tokens"]
    for name in list(steps)[:-1]:
        assert steps[name][1] and steps[name][1][0].asDict().keys() == set(first.columns)

    before, after = steps["language"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert all(not any(c.isalpha() for c in r["text"]) for r in before if r["doc_id"] in gone)

    before, after = steps["lines"]
    rows = sorted((r["doc_id"], r["text"]) for r in before)
    expected = {k: t for k, t in brute.without(rows, brute.lines_gone(rows)).items() if brute.words(t)}
    assert {r["doc_id"]: r["text"] for r in after} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = steps["near_duplicates"]
    groups = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.PERCENT)
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in groups.values()})

    before, after = steps["mix"]
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in after:
        taken[r["source"]] += len(brute.words(r["text"]))
    for s, t in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6 or t == 3 * sizes[s]
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()

    before, after = steps["tokens"]
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in before}
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    for r in after:
        assert r["ids"] == e.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()

    ran = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert ran == Counter((r["doc_id"], r["ids_sha256"]) for r in after)


def test_odd_tables(spark, tmp_path):
    rows = [(0, None, "en", "a", 0), (1, "", None, None, None), (2, "12 34", "en", "a", 5), (None, "some english words that stay here", "en", None, 1), (3, "some english words that stay here", "en", "b", 1), (3, "some english words that stay here", "en", "b", 1), (4, "word " * 20_000, "en", "b", 1)]
    steps = staged(spark, spark.createDataFrame(rows, DOCS), tmp_path / "odd")
    assert {r["doc_id"] for r in steps[0][2].collect()} == {None, 3, 4}
    assert {r["doc_id"] for r in steps[2][2].collect()} == {3, 4}
    steps = staged(spark, spark.createDataFrame([], DOCS), tmp_path / "none")
    assert [after.count() for _, _, after in steps] == [0] * 5


def test_clashing_columns(spark, tmp_path):
    """Columns named like what the stages work with come back as they were."""
    names = ["score", "lang_pred", "n_removed", "known", "u", "_u", "_bits", "_word", "row", "rid", "key", "s", "size", "u.v", "label"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    odd = docs
    for n in names:
        odd = odd.withColumn(n, F.lit(f"mine {n}"))
    plain = {name: sorted((r["doc_id"], r["text"]) for r in after.collect()) for name, _, after in staged(spark, docs, tmp_path / "plain")[:4]}
    for name, _, after in staged(spark, odd, tmp_path / "odd")[:4]:
        rows = after.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == plain[name]
        assert after.columns == odd.columns and all(r[n] == f"mine {n}" for r in rows[:20] for n in names)
