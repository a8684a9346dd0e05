import random

import corpus_pipeline

SF = "/root/testdata/sf0.01"
ALIEN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
]


def test_other_languages_and_gibberish_go(spark):
    """Texts of no learned language go, and no labelled document goes."""
    rng = random.Random(1)
    odd = ALIEN + [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(5)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(odd)], docs.schema)
    got = corpus_pipeline.language(spark, docs.unionByName(more), SF)
    assert got.columns == docs.columns
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert not ids & set(range(-len(odd), 0))
    assert ids == {r["doc_id"] for r in docs.filter("lang is not null").select("doc_id").collect()}
