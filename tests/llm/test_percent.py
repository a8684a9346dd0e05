import random

import corpus_pipeline
import numpy as np
import pytest
from pathweave.llm import minhash

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pairs(count):
    """Originals of 400 words, and copies with 1 to 12 words changed far from each other: similarities of 0.74 to 0.98."""
    rng, rows = random.Random(17), []
    for i in range(count):
        words = [f"w{i}x{j}" for j in range(400)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(5, 395, 10), 1 + i % 12):
            words[at] = f"e{i}x{at}"
        rows.append((2 * i + 1, " ".join(words)))
    return rows


def test_stage_links_at_080(spark):
    rows = pairs(240)
    expected = {c for _, c in brute.near_duplicates(rows, 80).values()}
    assert len(expected) < len({c for _, c in brute.near_duplicates(rows, 85).values()})
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(expected)


def test_stage_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    expected = {c for _, c in brute.near_duplicates(rows, 80).values()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(expected)


@pytest.mark.parametrize(("percent", "most"), [(95, 52), (85, 119), (80, 148)])
def test_far(percent, most):
    assert minhash.far(percent) == most


@pytest.mark.parametrize(("percent", "shared"), [(85, 340), (80, 320)])
def test_pairs_at_the_threshold_are_near_and_meet(percent, shared):
    rng, most = np.random.default_rng(percent), minhash.far(percent)
    for _ in range(1500):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        own = (400 - shared) // 2
        a, b = (np.frombuffer(minhash.signature(s), np.uint8)[None] for s in (x[: shared + own], np.concatenate([x[:shared], x[shared + own :]])))
        assert minhash._distance(minhash._packed(a), minhash._packed(b))[0] <= most
        errors = (a[0, : minhash.INDEX] != b[0, : minhash.INDEX]).reshape(minhash.CHUNKS, minhash.WIDTH).sum(axis=1)
        assert errors.min() <= 1


def test_distance_counts_positions():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (2, 50, minhash.BYTES), dtype=np.uint8)
    parts = [np.stack([z[:, minhash.INDEX :] & 15, z[:, minhash.INDEX :] >> 4]) for z in (x, y)]
    assert minhash._distance(minhash._packed(x), minhash._packed(y)).tolist() == (parts[0] != parts[1]).sum(axis=(0, 2)).tolist()
