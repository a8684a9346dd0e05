"""Documents to token ids in five stages, each written as Parquet and read again by the next.

Each stage works on all rows that the one before it kept.  The first four return the columns of ``documents``:

* ``language``: documents whose language can't be told go;
* ``lines``: repeated chunks and runs of lines go, and documents with nothing else;
* ``near_duplicates``: one document of each group of near-duplicates stays, that with the smallest id;
* ``mix``: sources are brought to their target weights, by leaving out and by repeating documents;
* ``tokens``: byte-level BPE ids, with digests of the ids and of the bytes that they decode to.

Cases: a null or empty text has no language, so its document goes in the first stage; a null key or source is a value of
its own; very long texts are read whole; rows alike in key and text are one document and have one fate, though ``mix`` may
repeat it; of equal texts under different keys the smallest key stays; an empty table gives an empty one in each stage;
other columns pass the first four stages, whatever their names (``n_removed``, ``score``, ``lang_pred`` and the like too),
and ``n_chars`` is set anew, if it is there, where lines were taken out.  The last stage returns the key, the source and its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import byte_bpe, langid, line_dedup, minhash, mixing
from pathweave.llm.common import WORD, columns_of, settled, unused

#: A document has no language if its best one knows less than this share of its n-grams.  The least share of a labelled
#: document at sf0.01 is 0.61 (held out: 0.69); texts in four other languages, and random letters, have 0.25 at most.
LEAST_SHARE = 0.4

#: Hundredths of their union that two documents' shingles have in common when they are near-duplicates.
PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = langid.fit(docs, ~langid.is_held_out("doc_id"))
    lang, score, known = unused(docs, "lang_pred", "score", "known")
    found = langid.predict(docs, filters, share=known, out=(lang, score))
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(known) >= LEAST_SHARE)).select(*columns_of(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (removed,) = unused(docs, "n_removed")
    cut = line_dedup.dedup(docs, out=removed)
    kept = cut.filter((F.col(removed) == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", n_chars)
    return kept.select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, percent=PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, digests=True, keep=["doc_id", "source"])


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: Language identification, MinHash and BPE have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settled(docs, name)
    return docs
