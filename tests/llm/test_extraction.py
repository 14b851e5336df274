"""Main text of pages whose article is known."""

import html
import os
import re

import pytest

from wordspace.llm.extraction import extract, main_text, smoothed, threshold

TEXT = ["A heading", "First paragraph with a good many words in it, so that it looks like running text & more.",
        "Short.", "Another paragraph that goes on for a while, with é and 日本 and a link to somewhere in the middle of it.",
        "Items that belong", "to the article", "The last paragraph says goodbye and is again as long as a paragraph tends to be."]


def article():
    return (f"<h1>{TEXT[0]}</h1>\n<p>{html.escape(TEXT[1])}</p><p>{TEXT[2]}<p>Another <b>paragraph</b> that goes on for a while, with &eacute; and "
            f"&#26085;本 and a <a href='/x'>link to\n somewhere</a> in the&nbsp;middle of it.</p><ul><li>{TEXT[4]}<li>{TEXT[5]}</ul>"
            f"<script>var x = '<p>no</p>';</script><p>{TEXT[6]}</p>")


MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of the day</a></li></ul></nav>"
AROUND = [
    "<header><a href='/'>Site name</a><p>A slogan that is rather long, to look like a text, but is none.</p></header>",
    "<aside><h2>More</h2><p>A long teaser text in the side bar that should not be taken for the article at all.</p></aside>",
    "<div class='cookie-notice'>We use cookies to make this site better and for many other reasons we do not name.</div>",
    "<div id='sidebar'><p>Popular stories of this week that many readers liked a lot, all in one long list.</p></div>",
    "<form action='/s'><label>Search</label><input name=q><button>Go</button></form>",
    "<div class=\"ad\">Buy this thing now, as it is the best thing that was ever sold by anyone to anybody.</div>",
    "<style>p { color: red }</style><noscript>Please enable scripts to see this page in its full beauty.</noscript>",
    "<section class='comments'><article class='comment'><p>I liked this article very much and want to say so at length.</p></article></section>",
    "<div class='commentList'><p>Second comment of a reader who also has quite a lot to say on the matter.</p></div>",
    "<footer><p>&copy; 2020 The owner of this site, all rights and whatever else there is to reserve.</p></footer>",
    "<!-- <p>a comment of the markup</p> -->", "<div role='banner'>Breaking: something happened somewhere, follow us to read more about it.</div>",
    "<div style='display:none'>Text that nobody sees although it is as long as any other text on the page.</div>",
]


@pytest.mark.parametrize("wrap", [
    "<article>{}</article>", "<article class='post has-comments'>{}</article>", "<div class='page with-sidebar'>{}</div>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id='content'>{}</div>",
    "<div class='post'><div class='body'>{}</div></div>", "<div role='main'>{}</div>", "<article><header><h1>A heading</h1><p>By someone</p></header>{}</article>",
])
def test_templates(wrap):
    inner = article()
    if "<header>" in wrap:
        inner = inner.replace("<h1>A heading</h1>", "")
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{MENU}{''.join(AROUND[:7])}{wrap.format(inner)}{''.join(AROUND[7:])}</body></html>"
    assert main_text(page) == " ".join(TEXT)
    assert main_text(page.replace("</body></html>", "")) == " ".join(TEXT)
    for part in AROUND:
        assert main_text(f"<html><body>{part}{wrap.format(inner)}{part}") == " ".join(TEXT), part
    inside = wrap.format(inner.replace("<p>Short", AROUND[5] + AROUND[2] + AROUND[4] + "<p>Short"))
    assert main_text(f"<html><body>{MENU}{inside}") == " ".join(TEXT)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>", ""), ("<<<", "<<<"), ("a < b &amp; c &lt;d&gt;", "a < b & c <d>"),
    ("<nav>menu only</nav>", ""), ("<article></article>", ""), ("<p>a<br>b</p>", "a b"), ("<p>a<b>b</b>c</p>", "abc"),
    ("<article><p>one<p>two<p><b>three<br><p>four</article>", "one two three four"), ("</div></p>x", "x"), ("<script>x", ""), ("<article><h1 class='entry-header'>a</h1><p>b</p></article>", "a b"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"), ("<p>&#0;&bogus;</p>", "�&bogus;"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_very_long_and_deep_pages():
    assert main_text("<article>" + "<p>word</p>" * 20_000) == " ".join(["word"] * 20_000)
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<article><p>" + "x " * 500_000)) == 999_999


def test_smoothing_and_threshold():
    import numpy as np

    values = smoothed(np.array([1.0] * 10 + [50.0] * 10 + [1.0] * 10))
    cut = threshold(values)
    assert [i for i in range(30) if values[i] > cut] == list(range(10, 20))
    assert smoothed(np.full(7, 3.0)) == pytest.approx(np.full(7, 3.0))


def test_query_columns(spark):
    rows = [(1, "u", "<article>a  b</article>", "x", 3), (1, "u", "<article>a  b</article>", "x", 3), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract(pages).collect()), key=repr)
    assert got == [(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0)]
    assert extract(pages.limit(0)).count() == 0


CARD = "<article class='card'><a href='/c'>A card</a></article>"


def test_an_article_element_without_the_text_is_not_the_region():
    body = f"<div id='content'>{article()}</div>"
    for page in (CARD + body, body + CARD, f"{CARD}{body}{CARD}"):
        assert main_text(f"<html><body>{MENU}{page}") == " ".join(TEXT)
    long = CARD.replace("A card", "A card whose teaser is about as long as one of the paragraphs of the text is.")
    assert all(line in main_text(f"<html><body>{MENU}{body}{long}") for line in TEXT)


def test_lower_cluster_menus_in_an_article():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"<html><body>{MENU}<article>{menu}{article().replace(TEXT[0], f'<a href=/>{TEXT[0]}</a>')}</article>"
    assert main_text(page) == " ".join(TEXT)


WRAPS = ["<div class='layout right-sidebar'>{}</div>", "<div id='legal'>{}</div>", "<section class='discussion'>{}</section>", "<div class='social-science'>{}</div>"]


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<div class='body'>{}</div>"])
def test_names_do_not_veto_what_holds_the_text(wrap, inner):
    part = wrap.format(inner.format(article()))
    for page in (part, MENU + part, "".join(AROUND[:7]) + part + "".join(AROUND[7:]), CARD + part, part + "<div>Some line</div>"):
        assert main_text(f"<html><body>{page}").startswith(" ".join(TEXT))
    beside = wrap.format(inner.format(article()) + AROUND[3] + AROUND[5])
    assert main_text(f"<html><body>{MENU}{beside}") == " ".join(TEXT)
    assert main_text(wrap.format("<p>a few words</p>")) == "a few words"


def test_names_veto_small_parts_beside_an_article():
    page = "<div class='ad'>Words of an advert, more of them than there are in the article.</div><article><h1>Ab.</h1><p>Ab.</p></article>"
    assert main_text(page) == "Ab. Ab."
    comments = "".join(f"<div class='comment'><p>{TEXT[1]} {i}</p></div>" for i in range(8000))
    assert main_text(f"{article()}{comments}") == " ".join(TEXT)


def test_formulas_stay():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>x = 1</annotation></semantics></math>"
    assert main_text(f"<article><p>We find {formula} here.</p></article>") == "We find x=1 here."


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for page in pages.collect():
        inner = re.search("<article>(.*?)(</article>|$)", page.html, re.S)[1]
        plain = re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert got[page.page_id] == " ".join(html.unescape(plain).split())


SHAPES = [
    "<article>{}<div id='comments'>{}</div></article>", "<main>{}<ol class='comment-list'>{}</ol></main>", "<main>{}<div class='reader-comments'>{}</div></main>",
    "<div class='content'>{}</div><div class='comments'>{}</div>", "<div class='post'>{}</div><section id='comments'>{}</section>",
    "<section class='discussion'><div class='post'>{}</div><div class='replies'>{}</div></section>", "<article>{}</article><div id='disqus_thread'>{}</div>",
    "<div class='layout right-sidebar'><div>{}</div><div class='commentList'>{}</div></div>",
]
SAID = ["<p>{}</p>", "<article class='comment'><p>{}</p></article>", "<li>{}</li>", "<div class='comment'><div class='body'>{}</div></div>"]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("said", SAID)
@pytest.mark.parametrize("times", [1, 3, 10])
def test_comments_of_readers_stay_out_however_long(shape, said, times):
    comments = "".join(said.format(f"A reader has this to say, number {i}: {TEXT[3]} {TEXT[6]} {TEXT[1]}") for i in range(2 * times))
    for around in ("", MENU, "".join(AROUND[:7])):
        assert main_text(f"<html><body>{around}{shape.format(article(), comments)}") == " ".join(TEXT)


def test_an_article_open_to_comments_is_no_comment():
    text = " ".join(TEXT)
    beside = "<div>A line of some length beside the article that is none of its text but stands on the page too, alas.</div>"
    assert main_text(f"<html><body><article class='post comments-open'>{article()}</article>{beside}").startswith(text)
