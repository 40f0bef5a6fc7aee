"""Extraction from pages of known text."""

import random
import re
import time

from quarry.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><p>The site's own long line of words about itself.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<div class="cookie-notice">We use cookies for many long reasons, please accept them all.</div>
{}
<aside><p>Read also this other thing, it is long enough to look like text.</p></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>What a fine article this was, I liked it a lot.</p></div></section>
<form><label>Name</label><input name=x><button>Send</button></form>
<footer><p>&copy; somebody, all rights reserved and so on for a while.</p></footer></body></html>"""


def test_article():
    body = "<article><h1>Head &amp; line</h1><p>One   two\n three.</p><p>Short.</p><div class=ad>Buy!</div><p>A <b>bold</b> w<i>or</i>d &lt;x&gt; &#233;.</p></article>"
    assert html_text.main_text(PAGE.format(body)) == "Head & line\nOne two three.\nShort.\nA bold word <x> é."


def test_by_density_alone():
    rng = random.Random(1)
    say = lambda k: " ".join(rng.choices(["stone", "river", "a", "of", "winter"], k=k))
    paragraphs = [say(rng.randint(20, 60)) for _ in range(8)] + ["Yes."] + [say(30)]
    body = f'<div id="page"><div class="c1">{"".join(f"<p>{p}</p>" for p in paragraphs)}</div><div class="c2">' + "".join(f'<p><a href="/{i}">{say(3)}</a></p>' for i in range(9)) + "</div></div>"
    assert html_text.main_text(PAGE.format(body)) == "\n".join(paragraphs)
    parts = "".join(f"<div><h2>Part {k}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs[k : k + 3])}</div>" for k in (0, 3, 6))
    want = "\n".join(x for k in (0, 3, 6) for x in [f"Part {k}", *paragraphs[k : k + 3]])
    assert html_text.main_text(PAGE.format(f"<div>{parts}</div>")) == want


def test_broken_markup():
    assert html_text.main_text("<body><article><h1>A<p><b>one<br><p>two</p><ul><li>x<li>y</ul></b>") == "A\none\ntwo\nx\ny"
    assert html_text.main_text("just words & more") == "just words & more"
    assert html_text.main_text("<p>a</div></b><p>b") == "a\nb"
    for x in (None, "", "<html></html>", "<script>x()</script>", "<!-- x -->", "<", "<p", "&", "<a href='"):
        assert isinstance(html_text.main_text(x), str)
    assert html_text.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def test_whole_long_pages():
    text = [f"word{i} " * 30 for i in range(3000)]
    began = time.time()
    got = html_text.main_text(PAGE.format("<article>" + "".join(f"<p>{t}</p>" for t in text) + "</article>"))
    assert got == "\n".join(t.strip() for t in text) and time.time() - began < 20


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        import html

        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p>x</p>"), (2, None, "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "z", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


TWO = "<h1>Head</h1><p>One two three four five six.</p><p>Seven eight nine ten eleven.</p>"
TWO_TEXT = "Head\nOne two three four five six.\nSeven eight nine ten eleven."


def test_wrappers_are_not_dropped():
    """An element that holds the article stays, whatever its class, id or tag says of it."""
    for start in ("<div class='content has-sidebar'>", "<div id=no-sidebar>", "<div class=main-nav-open>", "<section class='modal'>", "<div class='social share'>", "<form action=/x>", "<form><div class=newsletter-open>", "<div class='has-comments'>", "<div role=form>"):
        end = "</form>" if start.startswith("<form") else "</section>" if start.startswith("<sec") else "</div>"
        for inner in (f"<article>{TWO}</article>", f"<main>{TWO}</main>"):
            assert html_text.main_text(PAGE.format(start + inner + end)) == TWO_TEXT, (start, inner)
        wrapped = f"<body><nav><a href=/>Home</a></nav>{start}{TWO * 9}{end}<footer>x</footer>"
        assert html_text.main_text(wrapped) == "\n".join([TWO_TEXT] * 9), start
        inside = f"<body><main><p>By me</p>{start}{TWO * 9}{end}</main>"
        assert html_text.main_text(inside) == "\n".join(["By me", *[TWO_TEXT] * 9]), start
    for name in ("post has-comments", "post comments-open", "no-comments"):
        assert html_text.main_text(PAGE.format(f"<article class='{name}'>{TWO}</article>")) == TWO_TEXT, name
    # a whole page in a form, and what is boilerplate inside it
    page = PAGE.replace("<form>", "<div class=signup>").replace("</form>", "</div>").replace("<header>", "<form id=aspnet><header>").replace("</body>", "</form></body>")
    assert html_text.main_text(page.format(f"<article>{TWO}</article>")) == TWO_TEXT
    assert html_text.main_text(f"<body><div class=share-layout><article>{TWO}</article><div class=social>Share this</div></div>") == TWO_TEXT


def test_boilerplate_beside_the_article_still_goes():
    words = "<p>I too have a long opinion on this, and it goes on and on.</p>"
    for beside in (f"<div id=comments>{words * 9}</div>", f"<div class=comments><article>{words * 3}</article><article>{words * 3}</article></div>", f"<div class=related><article>{words}</article></div>", f"<article class=comment>{words * 9}</article>"):
        assert html_text.main_text(PAGE.format(f"<article>{TWO}</article>{beside}")) == TWO_TEXT, beside


def test_article_in_several_parts():
    part = lambda k: f"<article><h2>Part {k}</h2>{TWO * k}</article>"
    want = "\n".join(x for k in (1, 3, 2) for x in [f"Part {k}", *[TWO_TEXT] * k])
    assert html_text.main_text(PAGE.format(part(1) + part(3) + part(2))) == want
    links = "<article>" + "<a href=/x>Another story to read</a> " * 5 + "</article>"
    assert html_text.main_text(PAGE.format(part(1) + part(3) + part(2) + links)) == want
