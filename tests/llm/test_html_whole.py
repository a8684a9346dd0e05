import random
import time

import pytest

from pathweave.llm import html_text

LINKS = "<div class=list>" + "".join(f"<p><a href=/{i}>Another headline number {i} of this site</a></p>" for i in range(6)) + "</div>"


def prose(seed, chars):
    rng, out = random.Random(seed), ""
    while len(out) < chars:
        out += "".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) + " "
    return out.strip()


def page(*parts):
    return "<html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"


def test_headline_and_lead_beside_the_body():
    body = [prose(i, 400) for i in range(8)]
    inner = "".join(f"<p>{x}</p>" for x in body)
    html = page(f"<div id=content><h1>Title</h1><p>A short lead.</p><div class=body>{inner}</div></div>", LINKS)
    assert html_text.main_text(html) == "\n".join(["Title", "A short lead.", *body])


def test_giants_do_not_unseed_other_blocks():
    giants, usual = [prose(1, 6000), prose(2, 9000)], [prose(10 + i, 300) for i in range(6)]
    blocks = [f"<div class=part>{''.join(f'<p>{x}</p>' for x in part)}</div>" for part in (usual[:3], giants, usual[3:])]
    assert html_text.main_text(page("<div id=all>", *blocks, "</div>", LINKS)) == "\n".join([*usual[:3], *giants, *usual[3:]])


def test_a_section_that_links_lead_out_of():
    """A prose block with a link or two that are not most of it stays though its lines are no seeds."""
    body = [prose(i, 900) for i in range(8)]
    short = "<section><h2>Notes on it</h2><p>See <a href=/x>this</a> too.</p></section>"
    html = page(f"<div class=body>{''.join(f'<p>{x}</p>' for x in body)}</div>", short, LINKS)
    assert html_text.main_text(html) == "\n".join([*body, "Notes on it", "See this too."])


def test_a_page_of_links_keeps_its_core_alone():
    body = [prose(i, 200) for i in range(3)]
    html = page(f"<div class=story>{''.join(f'<p>{x}</p>' for x in body)}</div>", LINKS * 8)
    assert html_text.main_text(html) == "\n".join(body)


PROSE = [prose(100 + i, 260) for i in range(4)]
ARTICLE = "<h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in PROSE)
WHOLE = "\n".join(["Head", *PROSE])
FOOT = "<footer>Imprint and more of it</footer>"


@pytest.mark.parametrize(
    "wrap",
    [
        '<div class="site has-sidebar"><article>%s</article></div>',
        '<div class="sidebar-layout"><article>%s</article></div>',
        '<main class="content no-ads">%s</main>',
        '<form id="aspnetForm"><article>%s</article></form>',
        '<form id="aspnetForm"><div>%s</div></form>',
        "<nav><ul><li><a href=/>Home</a><li><a href=/a>All of them</a></ul><article>%s</article>",
        '<div class="widget">%s</div>',
    ],
)
def test_marks_around_the_text_are_ignored(wrap):
    assert html_text.main_text(page(wrap % ARTICLE, FOOT)) == WHOLE


def test_marks_beside_the_text_hold():
    boxes = "".join(f'<section class="{c}"><p>{prose(i, 400)}</p></section>' for i, c in enumerate(["comments", "cookie-notice", "ad", "sidebar", "reader-comments"]))
    assert html_text.main_text(page(f"<div>{ARTICLE}</div>", boxes, FOOT)) == WHOLE
    many = "".join(f'<article class="comment"><p>{prose(i, 300)}</p></article>' for i in range(60))
    assert html_text.main_text(page(f"<article>{ARTICLE}</article><section class=comments>{many}</section>")) == WHOLE


def test_inside_an_article():
    related = f"<section class='related-work'><h2>Related work</h2><p>{PROSE[0]}</p></section>"
    cards = "<div class=related><a href=/1><b>Another story</b></a><a href=/2>One more story</a></div><div class=share>Share this</div>"
    html = page(f"<article>{ARTICLE}{related}<p>so <math><mi>x</mi><annotation>no</annotation></math> is here</p>{cards}</article>")
    assert html_text.main_text(html) == "\n".join([WHOLE, "Related work", PROSE[0], "so x is here"])


def test_smoothing_and_threshold_decide(monkeypatch):
    """Without any name to go by: a short block next to prose belongs to it, one beyond a menu does not."""
    menu = "<div>" + "".join(f"<p><a href=/{i}>Item number {i}</a></p>" for i in range(9)) + "</div>"
    html = page("<div><p>Log in</p><p>My page</p></div>", menu, f"<div>{''.join(f'<p>{x}</p>' for x in PROSE)}</div>", "<div><p>A last word.</p></div>", menu, "<div><p>Contact us</p><p>Jobs</p></div>")
    right = "\n".join([*PROSE, "A last word."])
    assert html_text.main_text(html) == right
    monkeypatch.setattr(html_text, "smoothed", lambda values: values)
    assert html_text.main_text(html) != right
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "threshold", lambda values: 0.0)
    assert html_text.main_text(html) != right


def test_depth_takes_linear_time():
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text("<div class=ad><p>x y z</p>" * n + "<div>" * n + "<p>deep text here")
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16_000) < 12 * seconds(4000)


def test_clash_and_ties(spark):
    rows = spark.createDataFrame([(1, "<p>a</p><p>b</p>", "mine", -1), (1, "<p>a</p><p>b</p>", "mine", -1)], "page_id long, html string, Text string, N_chars long")
    got = html_text.extract(rows).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("a\nb", 3)] * 2 and len(got[0]) == 4
