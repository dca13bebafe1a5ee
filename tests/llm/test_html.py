import re
import time
from html import unescape

import pytest

from tiltframe.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href="/a">menu</a></ul></nav>
<div id="cookie-notice">We use cookies</div><!-- <p>hidden</p> --><div class="ad">Buy now</div>
<main><div class="post-17"><article><header><h1>Title &amp; more</h1><span>by X</span></header>
<p>First&nbsp;
 block with <b>bold <a href="x">link</a></b>.<br>Next line<p title="a > b">Second block is here, with text
<ul><li>one<li>two</ul><table><tr><td>cell</td><td>other</table><form>Your mail<input></form>
<aside>see also</aside><pre>x &lt; y  &#233;&copy</pre></article>
<section class="comments"><article class="comment"><p>Great post, thank you for it, I liked it a lot indeed</p></article></section>
</div></main><div class="sidebar-left"><p>side</p></div><footer>&copy; us</footer></body></html>"""
TEXT = ["Title & more", "First block with bold link. Next line", "Second block is here, with text", "one", "two", "cell", "other", "x < y é©"]


def test_one_page():
    assert html.extract(PAGE, []) == "\n\n".join(TEXT)
    assert html.vote(PAGE) == ("/html/body.has-sidebar/main/div.post-#/article", 1.0)


def test_broken_pages():
    for page in ("", "<", "<p", "text only", "<!--", "<script>x", "</p></div>", '<div class="a', "<a href='x>y</a>", "<p>a<p>b"):
        html.vote(page)
        html.extract(page, ["/div"])
    assert html.extract("text <i>only</i>", []) == "text only"
    assert html.extract("<p>a<p>b</i></p>", []) == "a\n\nb"
    assert html.extract("<div>" * 300 + "deep", []) == "deep"


def test_pages_cut_inside_a_tag():
    for rest in ("<img alt=" + "x" * 5000, "<a title='" + "it\"s " * 2000, "<a " + "b='c' d " * 1000, "<b" * 50_000, "<!-- <p>" + "x" * 5000):
        assert html.extract("<p>before</p>" + rest, []).startswith("before")
    assert html.extract("<p>a</p><!-- b > c", []) == html.extract("<p>a</p><!-- b", []) == "a"
    # A quote that closes nothing: the tag ends at the next sign of an end.
    assert html.extract("<p title=\"x>one</p>two \" three", []) == "one\n\ntwo \" three"


def test_no_part_of_an_article_is_lost():
    body = "<p>" + "long text of the story " * 40 + "</p>"
    story = ("long text of the story " * 40).strip()
    for page, want in (
        (f"<main><h1>title</h1><p>lead</p><div class=body>{body}</div></main>", f"title\n\nlead\n\n{story}"),
        (f"<main><h1>title</h1><article>{body}</article></main>", f"title\n\n{story}"),
        (f"<main><div class=a>{body}</div><div class=b><p>second column</p></div></main>", f"{story}\n\nsecond column"),
        (f"<body><h1>title</h1><div class=story>{body}</div></body>", f"title\n\n{story}"),
        (f"<div class='content no-sidebar'>{body}</div>", story),
        (f"<div class='elementor-widget'><div class='x-widget'>{body}</div></div><div class=ad>Buy</div>", story),
    ):
        assert html.extract(page, []) == want
        # Nor where the host's winner is a smaller part of it.
        assert html.extract(page, [html.vote(page)[0], "/main/div.body", "/main/article", "/main/div.a"]) == want
        assert html.extract(page, ["/main/div.body", "/main/article", "/main/div.a"]) == want


def test_pages_of_another_template_keep_their_article(spark):
    first = "<html><body><div class='story'><p>{}</p></div></body></html>"
    second = "<html><body><div class='story'><p>teaser</p></div><div class='report'><p>{}</p></div></body></html>"
    story = ("words of the article " * 50).strip()
    rows = [(i, f"http://h.org/{i}", first.format(story)) for i in range(6)]
    rows += [(i, f"http://h.org/{i}", second.format(story)) for i in range(6, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html.main_text(df).collect()} == {story}
    # A template that the host has not ranked loses nothing either.
    assert html.extract(second.format(story), ["/html/body/div.story"], [0.9]) == f"teaser\n\n{story}"


def test_hosts_agree_on_a_path(spark):
    def page(text):
        more = "<div class='box'>" + "other words of another kind " * 3 + "</div>"
        return f"<html><body><div class='story s1'><p>{text}</p></div>{more}</body></html>"

    rows = [(i, f"https://User@News.example.com:80/p{i}", page("long text of the story " * 60)) for i in range(5)]
    rows += [(10, "http://news.example.com/short", page("short story")), (11, "http://other.org/x", page("short story"))]
    rows += [(12, None, None), (13, "http://news.example.com/e", ""), (14, "no url", "<p>x</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, host string, paths int")
    paths = {r.host: r.paths for r in html.host_paths(df).collect()}
    assert paths["news.example.com"][0] == "/html/body/div.s#.story"
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.main_text(df).collect()}
    assert got[10] == ("http://news.example.com/short", "short story", 11)
    assert got[11][1].endswith("another kind")
    assert got[12] == (None, "", 0) and got[13][1] == "" and got[14][1] == "x"
    assert html.main_text(df).count() == len(rows)
    assert html.main_text(df.limit(0)).count() == 0


def test_whole_table_has_the_paragraphs(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = html.main_text(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    for p in pages.collect():
        (r,) = [r for r in rows if r.page_id == p.page_id]
        assert r.text.count("\n\n") + 1 >= p.html.count("</p>") - 1 and "©" not in r.text


def plain_text(page):
    """The article of a page of the given tables, taken apart with regular expressions."""
    inner = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style|form|aside|nav|button)\b.*?</\1>|<div class=\"(?:ad|cookie|share|related)\b.*?</div>", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|table|tr|td|th|tbody|thead|blockquote|pre|figure|figcaption|hr|dl|dt|dd)\b[^>]*>", inner)
    texts = [" ".join(unescape(re.sub(r"<br[^>]*>", " ", b) if "<br" in b else b).split()) for b in (re.sub(r"<(?!br)[^>]*>", "", b) for b in blocks)]
    return "\n\n".join(t for t in texts if t)


def test_given_pages_against_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain_text(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert got == want and all(got.values())


def test_forms_and_marked_paragraphs():
    page = "<body><form action=x><div><h1>T</h1><p>Long text of the page here</p><p class='ad'>BUY NOW</p><label>l</label><input></div></form></body>"
    assert html.extract(page, []) == "T\n\nLong text of the page here"
    page = "<body><div><h1>T</h1><p>Long text of the page here</p><form><p>Your name</p></form></div></body>"
    assert html.extract(page, []) == "T\n\nLong text of the page here"
    page = "<body><p class='ad'>The only text of a page whose template calls all paragraphs so</p></body>"
    assert html.extract(page, []).startswith("The only text")


@pytest.mark.parametrize("body", ["<div>", "<div>x ", "</i>", "<p class=ad>y", "<b>", "<form>"])
def test_deep_and_unclosed_nesting(body):
    began = time.perf_counter()
    page = "<body><article><p>text of the article</p></article>" + body * 50_000 + "<p>end</p>" * 100
    html.extract(page, [])
    assert all(len(path) < 600 for path in html.ballot(page))
    assert time.perf_counter() - began < 5
