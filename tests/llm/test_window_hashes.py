from pathweave.llm import quality

from . import brute


def test_windows_with_equal_hashes(spark, monkeypatch):
    """With few hashes for all windows, repeats are found though others stand between them."""
    f = quality.F
    monkeypatch.setattr(f, "xxhash64", lambda *c: (f.crc32(f.concat_ws("|", *c)) % 3) * (1 << 40))
    texts = ["a b c d e f a b c x", "p q r s t u v w p q r s", "one two three four five six", "k l m n k l m o k l m n k"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.features(rows).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.counts(texts[r["doc_id"]])
