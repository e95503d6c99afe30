"""Page text that no list of elements may drop."""

import time

import pytest

from wayfold.llm import html_extract

PAGE = (
    "<body><nav><ul><li><a href=/>home</a></li></ul></nav><article><p>Some words of the article stand here with <math><mi>x</mi><mo>=</mo><mn>1</mn></math> as a formula, as in any page.</p>"
    "<p>And <object data=a.swf>fallback text</object> and others stand in this one.</p><svg><title>t</title><path d='x'/><text>label of a drawing that stands here</text></svg><p>The last of the words come here, at the end.</p></article></body>"
)
TEXT = "Some words of the article stand here with x=1 as a formula, as in any page. And fallback text and others stand in this one. label of a drawing that stands here The last of the words come here, at the end."


def test_text_of_math_object_and_svg():
    model = html_extract.default_model()
    assert html_extract.text_of(PAGE, model) == TEXT
    outside = "<body><nav><math><mi>menu</mi></math></nav><article><p>Some words of the article stand here, as in any page.</p></article></body>"
    assert html_extract.text_of(outside, model) == "Some words of the article stand here, as in any page."


def test_page_of_bare_text():
    model = html_extract.default_model()
    assert html_extract.text_of("just words", model) == "just words"
    assert html_extract.text_of("just <b>bare</b>\n &amp; words", model) == "just bare & words"


def test_pages_without_a_container():
    model = html_extract.default_model()
    assert html_extract.text_of("<p>only a paragraph of plain words in it</p>", model) == "only a paragraph of plain words in it"
    assert html_extract.text_of("<html><body>words in the body<br>and others</body></html>", model) == "words in the body and others"
    assert html_extract.text_of("<h1>A title</h1><p>One paragraph of some words.</p><p>And another one with some more words.</p>", model) == "A title One paragraph of some words. And another one with some more words."


def test_a_quote_that_is_never_closed():
    model = html_extract.default_model()
    page = '<article><p>Good text stands here.</p><p><a href="x>broken link</a> and what comes after it in the page.</p></article>'
    assert html_extract.text_of(page, model) == "Good text stands here. broken link and what comes after it in the page."
    assert html_extract.text_of("<p title='x>some words of a paragraph that stands here", model) == "some words of a paragraph that stands here"


def test_menus_of_a_form_are_none_of_the_text():
    model = html_extract.default_model()
    page = "<article><p>Some words of the article stand here, as in any page.</p></article><form><label>Size</label><select><option>small<option>large</select><button>Go</button></form>"
    assert html_extract.text_of(page, model) == "Some words of the article stand here, as in any page."


def test_deep_and_long_pages_in_linear_time():
    model = html_extract.default_model()
    assert html_extract.text_of("<div>" * 5000 + "deep words that stand here" + "</div>" * 5000, model) == "deep words that stand here"
    sentence = "Some words of the article stand here, as in any page. "
    began = time.process_time()
    for stray in ("</b>" * 1_200_000, "<span>" * 3000 + "</i>" * 1_000_000, "<p><table><tr><td>" + "<span>" * 3000 + "<div></div>" * 200_000, "<li>" + "<b>" * 3000 + "<tr>" * 300_000, "<a " * 1_500_000, "<a '\"" * 800_000):
        page = f"<article><p>{sentence * 3}</p></article><div>{stray}"
        html_extract.parse(page)
    assert time.process_time() - began < 60
    page = f"<article><p>{sentence * 3}</p>{'</b>' * 1_200_000}<p>{sentence}</p></article>"
    assert html_extract.text_of(page, model) == (sentence * 4).strip()


#: Pages written by hand, none after the generator's patterns: what is furniture, and what is text.
BY_HAND = [
    (
        """<!doctype html><html><head><title>Rye bread</title></head><body><div id=topbar><a href=/>Bakers' notes</a> <a href=/all>All recipes</a> <a href=/who>Who we are</a></div>
        <div class=post><h2>Rye bread in a cold oven</h2><p>Mix 400&nbsp;g of rye flour with water and leave the dough alone for a whole night.</p><p>In the morning, put the tin into the cold oven and bake it for an hour at 220 degrees.</p></div>
        <div class=sidebar><h4>Popular</h4><ul><li><a href=1>Soda bread</a><li><a href=2>Focaccia</a></ul></div><div id=footer>&copy; 2019 Bakers' notes. All rights reserved.</div></body></html>""",
        "Rye bread in a cold oven Mix 400 g of rye flour with water and leave the dough alone for a whole night. In the morning, put the tin into the cold oven and bake it for an hour at 220 degrees.",
    ),
    (
        """<body><nav role=navigation><a href=/>Start</a> | <a href=/n>News</a></nav><main><h1>Bridge closed until May</h1><p>The old bridge over the mill stream is closed to all traffic until the end of May, the town council said on Monday.</p>
        <figure><img src=b.jpg><figcaption>The bridge last winter.</figcaption></figure><p>Walkers are asked to use the ford.</p><div class="ad-slot">Cheap tyres, this week only!</div><p>A temporary crossing is planned.</p></main>
        <section id=comments><h3>2 comments</h3><div class=comment><p>About time they did something.</p></div></section><footer><p>Imprint, privacy, contact</p></footer></body>""",
        "Bridge closed until May The old bridge over the mill stream is closed to all traffic until the end of May, the town council said on Monday. The bridge last winter. Walkers are asked to use the ford. A temporary crossing is planned.",
    ),
    (
        """<html><body><table width=100%><tr><td><ul><li><a href=a>Home</a></li><li><a href=b>Maps</a></li><li><a href=c>Links</a></li></ul></td><td><h1>How the canal was dug</h1>
        <p>Work on the canal began in the spring of 1774 with four hundred men, most of them from the neighbouring villages.</p><p>They dug by hand, and what they dug out became the bank on which the path runs today.</p></td></tr></table></body></html>""",
        "How the canal was dug Work on the canal began in the spring of 1774 with four hundred men, most of them from the neighbouring villages. They dug by hand, and what they dug out became the bank on which the path runs today.",
    ),
    (
        """<h1>sort</h1><p>Sorts the lines of a file in the order of their bytes, and writes them to the standard output.</p><h2>Options</h2><ul><li>r: the other way round</li><li>u: each line only once</li></ul><pre>sort -u names.txt</pre><p>Lines of any length are read whole.</p>""",
        "sort Sorts the lines of a file in the order of their bytes, and writes them to the standard output. Options r: the other way round u: each line only once sort -u names.txt Lines of any length are read whole.",
    ),
    (
        """<body><header class=masthead><h1><a href=/>The Weekly Observer</a></h1></header><div class="cookie-banner"><p>We use cookies to make this site better. <button>Accept</button></p></div><article class=story><h1>Storks are back</h1><p>The first pair of storks has come back to the tower of the church, two weeks earlier than last year.</p>
        <blockquote><p>They seem to know that the roof was mended,</p></blockquote><p>says the sexton, who has kept a list since 1998.</p></article><aside class=related><h3>Read on</h3><ul><li><a href=x>Swallows in the barn</a></ul></aside><form class=newsletter><label>Your mail</label><input><button>Subscribe</button></form></body>""",
        "Storks are back The first pair of storks has come back to the tower of the church, two weeks earlier than last year. They seem to know that the roof was mended, says the sexton, who has kept a list since 1998.",
    ),
    (
        """<body><section><h2>Opening hours</h2><p>The museum is open from ten to five on every day but Monday, and until eight on the first Friday of the month.</p></section><section><h2>How to get here</h2><p>Take the number four tram to the old harbour and walk along the quay for five minutes.</p></section><footer>Museum of the harbour, <a href=i>imprint</a></footer></body>""",
        "Opening hours The museum is open from ten to five on every day but Monday, and until eight on the first Friday of the month. How to get here Take the number four tram to the old harbour and walk along the quay for five minutes.",
    ),
]


@pytest.mark.parametrize("page,text", BY_HAND)
def test_pages_by_hand(page, text):
    assert html_extract.text_of(page, html_extract.default_model()) == text


def test_rows_that_are_null_empty_or_repeated(spark):
    rows = [(1, "u", "<p>only a paragraph of plain words", 1), (1, "u", "<p>only a paragraph of plain words", 1), (None, None, None, 2), (2, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extracted(pages).collect()), key=repr)
    plain = "only a paragraph of plain words"
    assert got == sorted([(1, "u", plain, len(plain))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_extract.extracted(pages.limit(0)).collect() == []
