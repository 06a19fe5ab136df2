"""Block rules on hand-made pages, the given pages against their own template, edge rows."""
import html
import re

from stepcorpus.llm import html_blocks as H
from stepcorpus.sources.tables import table

LONG = "The house of the man is on the hill and it was not far from the sea that he had seen with her."
OTHER = "There was a time when all of this would have been in the hands of the people who lived by it."


def test_boilerplate_goes_and_the_article_stays():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies &amp; more for all of you and this is in the way of the text that you want to read.</div><main><article><h2>Short head</h2><p>{LONG}<p>Ja.
    <p>A &lt;b&gt; &amp;amp; &eacute;&#33; <b>x</b>y<br>z</p><div class='ad'>Buy the thing</div><script>var t="</p>";</script><blockquote>Q</blockquote></article>
    <section id="comments"><article><p>{OTHER}</p></article></section></main><aside><p>{OTHER}</p></aside><form><label>Name</label><input name=a></form><footer>&copy; x</footer></body></html>"""
    assert H.main_text(page) == "\n\n".join(["Short head", LONG, "Ja.", "A <b> &amp; é! xy z", "Q"])


def test_without_an_article_short_blocks_follow_their_neighbours():
    page = f"<p>Menu</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{LONG}</p><p>Yes.</p><p>{OTHER}</p><ul><li><a href=1>Three</a></ul><p>End</p>"
    assert H.main_text(page) == "\n\n".join([LONG, "Yes.", OTHER])
    assert H.main_text("<p>Hello</p>") == "Hello"
    assert H.main_text("plain text") == "plain text"


def test_broken_markup():
    assert H.main_text(f"<article><p>{LONG}<p>{OTHER} <b unfinished") == f"{LONG}\n\n{OTHER}"
    assert H.main_text(f"<article><p>{LONG}<!-- open") == LONG
    assert H.main_text(f"<article><p>{LONG}<script>x") == LONG
    assert H.main_text("<article>" + "<" * 3000 + "a < b > c").endswith("< c")
    assert H.main_text("<p " + "a=\"" * 2000) is not None
    for empty in (None, "", "   ", "<html></html>", "<!-- x -->"):
        assert H.main_text(empty) == ""


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", None), (None, "u", "<p>a\x00b", None), (2, "u", "<p>" + "w " * 100000, None)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 3, 199999]
    assert H.extract(spark.createDataFrame(rows[:1], "page_id long, url string, html string, text string").limit(0)).collect() == []


def test_wrappers_with_marks_keep_the_article():
    text = "\n\n".join([LONG, "Ja.", OTHER])
    body = f"<p>{LONG}</p><p>Ja.</p><p>{OTHER}</p>"
    for attrs in ('class="has-sidebar"', 'id="with-nav"', "class=no-comments", 'class="post legal"', 'class="right-sidebar"', 'class="comments-open"', 'class="ad-free"', 'id="share"'):
        assert H.main_text(f"<nav>Menu</nav><div {attrs}><article>{body}</article></div><footer>x</footer>") == text, attrs
        assert H.main_text(f"<nav>Menu</nav><article {attrs}>{body}</article><footer>x</footer>") == text, attrs
        assert H.main_text(f"<nav>Menu</nav><div {attrs}>{body}</div><footer>x</footer>") == text, attrs
    assert H.main_text(f"<form action=x><nav>Menu</nav><div class=legal>{body}</div></form>") == text
    assert H.main_text(f"<div class=comments>{body}</div>") == text
    assert H.main_text("<article class='post legal'><p>Hello</p></article>") == "Hello"


def test_boilerplate_beside_the_text_stays_out():
    many = f"<p>{OTHER}</p>" * 9
    for attrs in ('id="comments"', 'class="comment-list"', 'class="ad-300x250"', 'class="cookie-law"', 'class="related-posts"'):
        assert H.main_text(f"<article><p>{LONG}</p></article><div {attrs}>{many}</div>") == LONG, attrs
        assert H.main_text(f"<div><p>{LONG}</p></div><div {attrs}><article>{many}</article></div>") == LONG, attrs
    for attrs in ('class="sidebar-left"', 'class="nav-links"', 'class="legal"', 'class="social-share"'):
        assert H.main_text(f"<p>{LONG}</p><p>{LONG}</p><div {attrs}><p>{OTHER}</p></div>") == f"{LONG}\n\n{LONG}", attrs
    assert H.main_text(f"<article><p>Hello</p></article><div class=cookie-notice><p>{LONG}</p></div>") == "Hello"


def test_main_text_in_a_div_beside_teaser_articles():
    cards = "".join(f"<article><a href={i}>A teaser of the other news</a><p>Short words</p></article>" for i in range(5))
    assert H.main_text(f"<div><p>{LONG}</p><p>Ja.</p><p>{OTHER}</p></div>{cards}") == "\n\n".join([LONG, "Ja.", OTHER])
    dense = "".join(f"<article><p>{OTHER}</p></article>" for _ in range(5))
    got = H.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div>{dense}")
    assert got.startswith(f"{LONG}\n\n{LONG}")
    assert H.main_text(f"<p>{OTHER}</p><article><p>{LONG}</p><p>{OTHER}</p></article>") == f"{LONG}\n\n{OTHER}"


def test_long_blocks_of_few_stop_words_follow_their_neighbours():
    code = "int total = sum(values, count); printf(result, total); return total / count; free(values); exit(0);"
    rows = "Berlin 3,700,000 Hamburg 1,900,000 Munich 1,500,000 Cologne 1,100,000 Frankfurt 760,000 Stuttgart 630,000"
    links = "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>"
    page = f"{links}<p>{LONG}</p><pre>{code}</pre><table><tr><td>{rows}</td></tr></table><p>{code}</p>{links}"
    assert H.main_text(page) == "\n\n".join([LONG, code, rows, code])
    assert H.main_text(f"<p>{LONG}</p>{links}<p>{rows}</p>{links}") == LONG


def test_deep_pages_take_linear_time():
    import time
    pages = ["<nav>" * 60_000 + f"<p>{LONG}</p>", "<div>" * 25_000 + f"<p>{LONG}</p>" + "</span>" * 25_000, "<nav><p>x</p>" * 30_000 + f"<article><p>{LONG}</p></article>",
             "".join(f"<div class=ad><p>{LONG}</p>" for _ in range(3000)), f"<article><p>{LONG}</p></article>" + "<div class=comment><article>" * 9000]
    texts = []
    for page in pages:
        began = time.process_time()
        texts.append(H.main_text(page))
        assert time.process_time() - began < 8 and len(page) > 100_000
    assert texts[1] == LONG and texts[4] == LONG


def test_an_unquoted_value_that_ends_in_a_slash_closes_nothing():
    assert H.main_text(f"<article><div data-u=http://a/><p>{LONG}</p></div><p>{OTHER}</p></article>") == f"{LONG}\n\n{OTHER}"
    assert H.main_text(f"<article><p>{LONG}</p></article><aside data-u=http://a/><p>{OTHER}</p></aside>") == LONG
