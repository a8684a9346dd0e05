import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from pathweave.llm import byte_bpe, html_text, langid, ogg, queries, token_count  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "a", "x" * 20_000, "word " * 5000, "\x00\x01", "日本語 テキスト 🎉", "é" * 100, "don't  stop\n\n\n now"]
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 2 else "s", i) for i, t in enumerate(ODD)] + [(None, "null key", None, None, None), (4, "a", "en", None, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe_is_tiktokens(spark, texts, reference):
    for r in queries.op7_byte_bpe(spark, SF).collect():
        ids = packed(reference.encode_ordinary(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(reference, text):
    c = byte_bpe.codec(RANKS, P.PATTERN)
    assert c.encode(text) == packed(reference.encode_ordinary(text))
    assert c.decode(c.encode(text)) == text.encode()


def test_bpe_tokens_whole(reference):
    c = byte_bpe.codec(RANKS, P.PATTERN)
    for token in random.Random(1).sample(sorted(c.ranks), 3000):
        text = token.decode("utf-8", "ignore")
        assert c.encode(text) == packed(reference.encode_ordinary(text))


def test_bpe_cases(odd, empty):
    clash = odd.withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(-1))
    done = byte_bpe.decode(byte_bpe.encode(clash, RANKS, P.PATTERN, digests=True), RANKS, P.PATTERN).collect()
    assert len(done) == odd.count()
    for r in done:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(packed(r["ids"])).hexdigest()
    assert byte_bpe.digest(empty, RANKS, P.PATTERN).collect() == []


FLOOR = -40_000.0


@pytest.fixture(scope="module")
def pieces():
    """The normal pieces of the model file with its scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))}


def slow_count(pieces, text):
    """Dynamic programming over all starts of all ends, with the text as a whole; exact fractions for scores."""
    if not text:
        return 0
    s, longest, unknown = "▁" + text.replace(" ", "▁"), max(map(len, pieces)), Fraction(min(pieces.values())) - 10
    best = [(Fraction(0), 0)]
    for end in range(1, len(s) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            part = s[start:end]
            if part in pieces:
                option = best[start][0] + Fraction(pieces[part]), best[start][1] + 1
            elif end - start == 1:
                option = best[start][0] + unknown, best[start][1] + len(part.encode())
            else:
                continue
            if found is None or option[0] > found[0]:
                found = option
        best.append(found)
    return best[-1][1]


def test_token_counts_against_brute_force(spark, texts, pieces):
    known = {k: slow_count(pieces, t) for k, t in texts.items() if len(t) < 3000}
    assert len(known) > 150
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_count(spark, SF).collect()}
    assert {k: got[k] for k in known} == known


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeth  \n\tÉé▁日🎉<0x>", max_size=40))
def test_token_count_of_any_text(pieces, text):
    assert token_count.vocabulary(P.path("piece_bpe_32k.model")).count(text) == slow_count(pieces, text)


def test_tie_rules_are_sentencepieces(texts, pieces):
    """Its own unigram model of these pieces; with a floor, since its single floats lose all scores beside -1e9."""
    import sentencepiece

    f = byte_bpe._field
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    kind = lambda i: 2 if m.is_unknown(i) else 3 if m.is_control(i) else 6 if m.is_byte(i) else 1
    fields = [f(1, m.id_to_piece(i).encode()) + f(2, float(max(FLOOR, m.get_score(i)))) + f(3, kind(i)) for i in range(m.get_piece_size())]
    proto = b"".join(f(1, p) for p in fields) + f(2, f(3, 1) + f(4, len(fields)) + f(35, 1)) + f(3, f(1, b"identity") + f(3, 1) + f(4, 0) + f(5, 1))
    theirs = sentencepiece.SentencePieceProcessor(model_proto=proto)
    mine = token_count.Vocabulary([(p, max(FLOOR, s)) for p, s in pieces.items()], True)
    assert all(mine.count(t) == len(theirs.encode(t)) for t in texts.values())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", max_size=14), st.lists(st.tuples(st.text(alphabet="abc▁", min_size=1, max_size=4), st.integers(-6, 0)), min_size=1, max_size=12), st.booleans())
def test_viterbi_against_all_segmentations(text, pieces, fallback):
    v = token_count.Vocabulary([(p, float(s)) for p, s in pieces], fallback)
    s = (" " + text).replace(" ", token_count.SPACE) if text else ""
    best = {0: (0.0, 0)}
    for end in range(1, len(s) + 1):
        options = []
        for start in range(end):
            p = s[start:end]
            if p in v.scores:
                options.append((best[start][0] + v.scores[p], best[start][1] + 1))
            elif end - start == 1:
                options.append((best[start][0] + v.unknown, best[start][1] + (len(p.encode()) if fallback else 1)))
        best[end] = max(options, key=lambda x: x[0])  # the first of equals: the earliest start
    assert v.count(text) == best[len(s)][1]


def test_token_count_cases(odd, empty):
    got = token_count.count_tokens(odd.withColumn("n_tokens", F.lit("mine")), P.path("piece_bpe_32k.model")).collect()
    assert [r["n_tokens"] for r in got if not r["text"]] == [0, 0]
    assert len(got) == odd.count()
    assert token_count.count_tokens(empty, P.path("piece_bpe_32k.model")).collect() == []


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_ogg_checksum(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**32 - 1), st.lists(st.integers(0, 140_000), min_size=1, max_size=5), min_size=1, max_size=3))
def test_ogg_round_trip(sizes):
    streams = {}
    for serial, lengths in sizes.items():
        packets, at = [], 0
        for n in lengths:
            at += n
            packets.append((bytes([n % 251]) * n, at))
        streams[serial] = packets
    found = ogg.demux(ogg.mux(streams))
    assert {k: s.packets for k, s in found.items()} == {k: [p for p, _ in v] for k, v in streams.items()}
    assert {k: s.ends for k, s in found.items()} == {k: [e for _, e in v] for k, v in streams.items()}


def test_ogg_damage():
    media = ogg.store(b"some text " * 9000)
    assert ogg.read(media)[0].rstrip(b"\0") == b"some text " * 9000
    for i in range(0, len(media), 977):
        broken = media[:i] + bytes([media[i] ^ 1]) + media[i + 1 :]
        with pytest.raises(ogg.OggError):
            ogg.read(broken)
    for cut in (10, 100, len(media) - 1):
        assert ogg.describe(media[:cut])[-1]
    assert ogg.describe(None)[-1] and ogg.describe(b"")[-1]


def test_ogg_features(odd, empty, spark):
    got = {r["doc_id"]: r for r in ogg.stored_features(odd).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["error"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]), None)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert f"sum={sum(payload)}" in r["feature"]
    assert got[0]["media_sha256"] == got[1]["media_sha256"]
    assert ogg.stored_features(empty).collect() == []
    assert queries.op5_ogg(spark, SF).filter("error is not null or payload_bytes < n_bytes").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/a>A</a></ul></nav>
<div id="cookie-notice"><p>We use cookies on this site and you should accept them all right now please.</p></div>
%s
<aside><p>Aside text that is long enough to look like content, is it not, with many words in it.</p></aside>
<section class="comments"><p>I am a reader and this is my comment, which is rather long as comments go here.</p></section>
<form><p>Subscribe to our newsletter with this form, which has a lot of text too.</p></form><footer>&copy; 2024 Someone</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>First   paragraph with a <a href=x>link</a> in it,\n and <b>more</b> words.<p>Short.</p><p>Third paragraph, which is long: %s</p><ul><li>one</li><li>two</ul>"
TEXT = "Head & line\nFirst paragraph with a link in it, and more words.\nShort.\nThird paragraph, which is long: %s\none\ntwo"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div id=wrap><div>%s</div></div>", "%s"])
def test_html_regions(wrap):
    words = "many words follow here. " * 8
    assert html_text.main_text(PAGE % (wrap % (BODY % words))) == (TEXT % words).strip().replace("here. \n", "here.\n")


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><p>x &eacute; &#233; &nope; &amp", "x é é &nope; &"), ("<script>only</script>", ""), ("<div>a<br>b</div>", "a b"), ("<article><p>a</p><!-- <p>no</p> --><div class='ad'>buy</div><p>b</p></article>", "a\nb"), ("<p>\xa0 a\t\n b </p>", "a b"), ("<article><div hidden>x</div><p>y</article>", "y"), ("<", "<"), ("<p>1 < 2</p>", "1 < 2")])
def test_html_cases(html, text):
    assert html_text.main_text(html) == text


def test_html_parts():
    assert html_text.smoothed([1.0]) == [1.0]
    assert html_text.threshold([1, 1, 9, 10]) == pytest.approx((1 + 9.5) / 2)
    assert html_text.main_text("<article>" + "<p>x</p>" * 20000 + "</article>").count("\n") == 19999
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_pages(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_html_text(spark, SF).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_html_table(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert html_text.extract(rows.limit(0)).collect() == []


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_langid(spark, sf).join(docs, "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"]]
    assert sum(held) >= 0.97 * len(held)


def test_language_filters():
    f = langid.Filters(["a", "b", "c"], np.zeros((1, 1 << 16), np.uint8), 3, 1)
    sets = {i: langid.grams(t) for i, t in enumerate(["abcdef ghi", "abc xyz", "qrs"])}
    for i, g in sets.items():
        f.add(i, g)
    f = langid.Filters(f.languages, f.planes, 3, 1)
    n, found = f.counts("abc")
    assert n == 3 and found[0] >= 2 and found[1] == 3
    assert f.predict("xyz")[0] == "b" and f.predict("qrs")[0] == "c"
    assert f.predict("ŵŵŵŵ") == ("b", 0.0)
    assert f.predict("12 34!") == ("und", 0.0) and f.predict(None) == ("und", 0.0)


def test_language_blocks(monkeypatch):
    text = "Some words, in a text. " * 50
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.array_equal(langid.grams(text), whole)
    assert len(langid.grams("a")) == 1


def test_language_cases(odd, empty):
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {0, 1, 2, 3, 7}
    assert {r["lang_pred"] for r in got.values()} == {"und", "en"}
    assert langid.identify(empty).collect() == []
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    many = odd.sparkSession.createDataFrame([(i, t, l, None, None) for i in range(0, 90) for l, t in [(f"l{i % 30:02d}", chr(0x4E00 + i % 30) * 20)]], DOCS)
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 30:02d}" for r in langid.identify(many).collect())


def test_vocabularies_are_not_here():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    assert not [p for p in root.rglob("*") if p.suffix in (".tiktoken", ".model") and ".git" not in p.parts]
