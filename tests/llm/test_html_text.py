"""Main text of pages: the generator's articles, hand-made layouts, broken markup."""

import re
import time
from html import unescape

import pytest

from quern.llm import html_text
from quern.llm.html_text import best_region, blocks, extract, labelled_pages, learn, op3_html_text, parse

KNOWN = learn(labelled_pages())


def main_text(html):
    return html_text.main_text(html, KNOWN)


def test_op3_gives_the_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op3_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", article))
        assert r.text == " ".join(unescape(plain).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain text & no tags < 5", "plain text & no tags < 5"),
        ("<p>a<b>b</b> c&nbsp;&amp;\n d<p>e<br>f", "ab c & d e f"),
        ("<nav><a href=x>a</a></nav>", ""),
        (
            "<body><div id=top><a href=/>Home</a> <a href=x>About us</a></div><div class=layout-sidebar-right><h1>T one</h1><p>Real text of the page goes here.</p>"
            "<div class='share'>Share this</div><p>End<b>ing</b> text.<script>if (a</p>b) {}</script></div><div id=comments><p>Nice post I like it</p></div><div>&copy; 2024 Foo</div>",
            "T one Real text of the page goes here. Ending text.",
        ),
        (
            "<header><h1>Site</h1></header><nav><a href=a>One</a><main><article><header><h1>Title of it</h1></header><p>Body text long enough to count.</p><aside>Related: x</aside>"
            "<p hidden>secret</p><p>Second part.</p><form><input> Subscribe now</form></article><section class=comments-area><p>a comment here</p></section></main><footer>foot</footer>",
            "Title of it Body text long enough to count. Second part.",
        ),
    ],
)
def test_layouts(html, text):
    assert main_text(html) == text


def test_best_region():
    assert best_region([]) == (0, 0) and best_region([-1.0]) == (0, 0)
    assert best_region([1, -2, 3, -1, 2, -5, 3]) == (2, 5)


def test_edge_cases(spark):
    rows = [(1, None, None, 0), (2, "u", "", 0), (2, "u", "", 0), (None, "u", "<p>x y z</p>", 0), (3, "u", "<p>word word</p>" * 50_000, 0), (4, "u", "<a <b '\"<!-- <p>", 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.n_chars) for r in extract(frame).collect()}
    assert {(1, 0), (2, 0), (None, 5), (3, 500_000 - 1)} <= got and extract(frame).count() == 6
    assert extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_linked_blocks_and_copyright_inside_the_story(tag):
    prose = "Body text long enough to count and to be read by all who come."
    page = (
        f"<body><nav><ul><li><a href=a>One</a></li></ul></nav><{tag}><h1><a href=t>Linked title</a></h1><div class=body><p>{prose}</p><h2><a href=h>A linked headline</a></h2>"
        f"<p><a href=p>A paragraph of one link</a></p><p>Copyright law is a hard subject.</p><p>{prose}</p></div><ul><li><a href=r>Reference one</a></li><li><a href=s>Two</a></li></ul>"
        f"<div class=share><p><a href=x>Share this</a></p></div><aside><a href=o>Other</a></aside></{tag}><div><a href=/>Home</a> <a href=b>Back</a></div><footer>Copyright 2024</footer></body>"
    )
    assert main_text(page) == f"Linked title {prose} A linked headline A paragraph of one link Copyright law is a hard subject. {prose} Reference one Two"


def test_weights_come_from_the_labels():
    main = [b for p in labelled_pages() for b in blocks(parse(p)) if b.main]
    assert len(labelled_pages()) > 10 and len(main) > 60
    assert KNOWN.tags["nav"] > KNOWN.tags["p"] > 0 and all(x >= 0 for x in KNOWN.tags.values())
    assert KNOWN.words["name sidebar"] < 0 < KNOWN.words["tag p"]
    flipped = [p.replace("<p data-label", "<p").replace("<p>", "<p data-label>") for p in labelled_pages()]
    assert learn(flipped).words["tag p"] != KNOWN.words["tag p"]


UNSEEN_NAMES = (
    "<body><div class=zonk><a href=1>One</a> <a href=2>Two</a></div><div class=lateral>Buy two lamps today and pay for one, in every shop of ours.</div><div class=quux><h1>Frost in May</h1>"
    "<p>The blossom froze in the night of the third, and with it most of the year's cherries. Nobody in the village had seen the like since the war.</p>"
    "<p>Some lit fires between the rows. It helped a little on the slope, where the air moves.</p></div><div class=zeile-unten>Our office is open on weekdays. Write to the editor at any time.</div></body>"
)


def test_unseen_names_and_the_scan(monkeypatch, sf_dir):
    story = "Frost in May The blossom froze in the night of the third, and with it most of the year's cherries. Nobody in the village had seen the like since the war. Some lit fires between the rows. It helped a little on the slope, where the air moves."
    assert main_text(UNSEEN_NAMES) == story
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert "lamps" in main_text(UNSEEN_NAMES) and "weekdays" in main_text(UNSEEN_NAMES)


@pytest.mark.parametrize("unit", ["<a ", "<div>x ", "<a '", "<article><nav>", "</x>", "<b><i>x", "<!-- <a>", "<td><p>"])
def test_broken_pages_take_linear_time(unit):
    began = time.time()
    main_text(unit * (300_000 // len(unit)))
    assert time.time() - began < 8


def test_deep_nests_keep_the_story_whole():
    story = " ".join(f"The keeper of the light wrote the {k} of his letters to the town and waited for an answer." for k in range(12))
    for n in (10, 70, 400):
        page = f"<html><body><nav><a href=x>Home</a></nav><article><p>A first line opens the tale.</p><div class=ad>Buy now!</div>{'<div>' * n}<p>{story}</p>{'</div>' * n}<p>It ends here.</p></article><footer>Copyright</footer></body></html>"
        assert main_text(page) == f"A first line opens the tale. {story} It ends here."
