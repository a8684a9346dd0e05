"""Operators without SQL beside second implementations of their whole results."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import pytest
from pathweave.llm import langid, ogg, queries, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_leaves(rows, leaves, fair=0.005, loose=0.02):
    """The leaf of each row (id, u, w, v) of a k-d tree, node by node, with sorted lists for histograms."""
    out, todo = {}, [(rows, leaves, 0)]
    while todo:
        node, m, first = todo.pop()
        if m == 1 or not node:
            out |= {r[0]: first for r in node}
            continue
        share, total, found = (m // 2) / m, sum(r[2] for r in node), []
        need = share * total
        for d in range(len(node[0][3])):
            weight = Counter()
            for r in node:
                weight[r[3][d]] += r[2]
            upto = 0
            for at in sorted(weight):
                upto += weight[at]
                if upto >= need:
                    break
            tie, width = weight[at], (max(weight) >> 32) - (min(weight) >> 32)
            miss = min(abs(upto - tie - need), abs(upto - need)) / total
            rank = (miss <= fair, width if miss <= fair else -miss, -d)
            found.append((rank, d, at, abs(upto - tie - need) < abs(upto - need), miss, upto, tie))
        _, d, at, before, miss, upto, tie = max(found)
        row_at = None
        if miss > loose:
            inner, part = (need - (upto - tie)) / tie, 0
            weight = Counter()
            for r in node:
                if r[3][d] == at:
                    weight[r[1]] += r[2]
            for row_at in sorted(weight):
                part += weight[row_at]
                if part >= inner * tie:
                    break
            before = False
        left = [r for r in node if r[3][d] < at or r[3][d] == at and not before and (row_at is None or r[1] <= row_at)]
        inside = {r[0] for r in left}
        todo += [(left, m // 2, first), ([r for r in node if r[0] not in inside], m - m // 2, first + m // 2)]
    return out


@pytest.mark.parametrize("leaves", [8, 5])
def test_tree(spark, leaves):
    rng = random.Random(leaves)
    texts = [(rng.randint(0, 2**31 - 1), rng.randint(0, 2**31 - 1), rng.randint(0, 2**31 - 1), rng.randint(1, 40)) for _ in range(150)]
    rows = []
    for i in range(900):
        x, y, tie, w = texts[0] if i % 3 == 0 else rng.choice(texts)  # a group with a third of all rows
        rows.append((i, rng.randint(0, 2**62), w, [x << 32 | tie, y % 7 << 32 | tie]))
    df = spark.createDataFrame(rows, "id long, u long, w long, v array<long>")
    assert {r["id"]: r["shard"] for r in sharding.tree(df, 2, leaves).collect()} == slow_leaves(rows, leaves)


def slow_grams(text):
    """The three code points around each letter of the lower-cased text; everything else is a space."""
    shown = [" ", *[c if c.isalpha() else " " for c in (text or "").lower()], " "]
    return [a + b + c for a, b, c in zip(shown, shown[1:], shown[2:], strict=False) if b != " "]


def packed(gram):
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def test_language_against_sets(spark):
    """Sets of n-grams instead of Bloom filters; counts differ by what false positives leave after their correction."""
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    s = langid.Settings()
    counts, seen = {}, Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None:
            seen[r["lang"]] += 1
            if r["text"] is not None:
                counts.setdefault(r["lang"], Counter()).update(slow_grams(r["text"]))
    assert max(seen.values()) <= s.docs_per_language  # so that all labelled rows are the sample
    share = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    most = {}
    for f in share.values():
        for g, x in f.items():
            most[g] = max(most.get(g, 0), x)
    known = {}
    for k, f in share.items():
        own = [g for g in f if counts[k][g] >= s.least_count and f[g] * s.ratio >= most[g]]
        known[k] = set(sorted(own, key=lambda g: (-f[g], packed(g)))[: s.grams_per_language])
    for r in queries.op9_langid(spark, SF).collect():
        (text,) = [x["text"] for x in rows if x["doc_id"] == r["doc_id"]]
        grams = slow_grams(text)
        found = {k: sum(g in known[k] for g in grams) for k in sorted(known)}
        if not grams:
            assert (r["lang_pred"], r["score"]) == (langid.UNKNOWN, 0.0)
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        top = max(found.values())
        assert found[r["lang_pred"]] >= top - max(2, 0.01 * len(grams))
        assert r["score"] == pytest.approx(top / sum(found.values()), abs=0.02 + 2 / len(grams))


def test_language_clash(spark):
    df = spark.createDataFrame([(1, "some words", "mine", 5, "own"), (None, None, "mine", 5, "own")], "doc_id long, text string, LANG_PRED string, score int, u string")
    got = langid.predict(df, langid.fit(df.selectExpr("doc_id", "text", "'en' as lang"), langid.is_held_out("doc_id") | ~langid.is_held_out("doc_id"))).collect()
    assert len(got) == 2 and got[0]["lang_pred"] in ("en", langid.UNKNOWN) and got[0]["u"] == "own" and len(got[0]) == 5
    assert langid.identify(df.selectExpr("doc_id", "text", "u as lang").limit(0)).collect() == []


def slow_pages(media):
    """(flags, granule, serial, number, packets' pieces) of each page, byte by byte, with a bitwise checksum."""
    at, out = 0, []
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        flags, (granule,), (serial, number, crc) = media[at + 5], struct.unpack("<q", media[at + 6 : at + 14]), struct.unpack("<3I", media[at + 14 : at + 26])
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        end = at + 27 + len(lacing) + sum(lacing)
        page, value = media[at : at + 22] + bytes(4) + media[at + 26 : end], 0
        for b in page:
            value ^= b << 24
            for _ in range(8):
                value = (value << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if value >> 31 else value << 1
        assert value == crc
        pieces, begin, size = [], at + 27 + len(lacing), 0
        for n in lacing:
            size += n
            if n < 255:
                pieces.append((media[begin : begin + size], True))
                begin, size = begin + size, 0
        if lacing and lacing[-1] == 255:
            pieces.append((media[begin : begin + size], False))
        out.append((flags, granule, serial, number, pieces))
        at = end
    return out


def test_stored_form(spark):
    texts = [None, "", "a", "é" * 31, "x" * 64, "y" * 65, "z" * 16384, "w" * 20_000, "long " * 15_000]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)] + [(2, "a", None, None, 0)], DOCS)
    media = {r["doc_id"]: bytes(r["media"]) for r in ogg.encode(df).collect()}
    got = {r["doc_id"]: r for r in ogg.stored_features(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        pages = slow_pages(media[i])
        streams = {}
        for flags, granule, serial, number, pieces in pages:
            s = streams.setdefault(serial, {"packets": [], "open": None, "pages": 0, "granule": 0})
            assert number == s["pages"] and bool(flags & 2) == (number == 0) and bool(flags & 1) == (s["open"] is not None)
            for piece, whole in pieces:
                piece = (s["open"] or b"") + piece
                s["open"] = None if whole else piece
                if whole:
                    s["packets"].append(piece)
            s["pages"] += 1
            s["granule"] = granule if granule >= 0 else s["granule"]
            s["last"] = flags & 4
        assert all(s["last"] and s["open"] is None for s in streams.values()) and sorted(streams) == [1, 2]
        assert b"".join(streams[1]["packets"][1:]) == payload and streams[1]["granule"] == len(payload)
        assert struct.unpack("<Q", streams[2]["packets"][1]) == (len(raw),)
        feature = f"streams=2 pages={len(pages)} packets={len(streams[1]['packets']) - 1} seconds={len(payload) / 8000:.6f} low={min(payload)} high={max(payload)} sum={sum(payload)}"
        r = got[i]
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature)
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_stored_form_cases(spark):
    df = spark.createDataFrame([(1, "a", "mine", "x")], "doc_id long, text string, MEDIA string, feature string")
    (r,) = ogg.features(ogg.encode(df)).collect()
    assert r["feature"].startswith("streams=2") and r["error"] is None and "media" not in {c.lower() for c in r.asDict()}
    assert ogg.stored_features(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_ignore_other_columns(spark):
    df = spark.createDataFrame([(i, f"text {i}", "a", "b", "c") for i in range(40)], "doc_id long, text string, size string, shard string, node string")
    plain = sharding.shard_documents(df.select("doc_id", "text")).collect()
    assert sorted(map(tuple, sharding.shard_documents(df).collect())) == sorted(map(tuple, plain))
