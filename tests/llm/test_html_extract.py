"""Extraction against a plain reading of the known template, and hand-made pages."""

import re
from html import unescape

from siltworks.llm.html_extract import aligned, blocks, extract, fold, op10_html_extract, read_wrapper, run, structure, written


def plain(html):
    """The article of the synthetic pages, whose only blocks are h1 and p."""
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", inside)
    texts = [" ".join(unescape(re.sub(r"<[a-z/][^>]*>", " " if "<br" in p else "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages_equal_plain_reading(spark):
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_html_extract(spark, sf).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == plain(html[r.page_id]) and r.n_chars == len(r.text), r.page_id


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav><ul><li>Home<li>News</ul></nav></header>
<div class="cookie-notice">We use cookies</div><main><article><header>By line</header><h2>Head &amp; tail</h2><p>One <b>bold</b>
 line<br>more<p>Two&nbsp;x &lt;b&gt;<ul><li>a<li>b</ul><aside>side</aside><div class=ad>Buy</div>%s</article>
<section id="comments"><p>First!</p></section></main><form><p>Mail <input></p></form><footer>End<script>var a="</p><p>x";</script></footer></body>"""


def test_hand_made_pages_nulls_and_clashing_names(spark):
    rows = [(1, "http://A.com/1", PAGE % "", 1), (2, "http://a.com:80/2", PAGE % "<blockquote>Q</blockquote><p>Last", 1), (3, "http://b.com", None, 1), (4, None, "", 1),
            (None, "nohost", "bare <i>text</i>\n here", 1), (5, "http://c.com", "<p>" + "w " * 90_000 + "<", 1), (6, "http://d.com", "<div class='story'><p>In</p></div><div>Out</div>", 1), (6, "http://d.com", "<div class='story'><p>In</p></div><div>Out</div>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    base = "Head & tail\nOne bold line more\nTwo x <b>\na\nb"
    want = [(1, base), (2, base + "\nQ\nLast"), (3, ""), (4, ""), (None, "bare text here"), (5, "w " * 89_999 + "w <"), (6, "In"), (6, "In")]
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert extract(df.limit(0)).collect() == []


def test_expressions():
    a = structure(*blocks("<div><h1>x</h1><p>a</p><p>b</p><p>c</p></div>"))
    b = structure(*blocks("<div><p>a</p><aside>q</aside></div>"))
    assert a == ["", "", [["div", "", [["h1", "", [["#", "", []]]], ["p", "+", [["#", "", []]]]]]]]
    both = run(aligned(a, b))
    assert [(c[0], c[1]) for c in both[2][0][2]] == [("h1", "?"), ("p", "+"), ("aside", "?")]
    assert read_wrapper(fold([written(a), written(b), written(a)]))[2][0][0] == "div" and read_wrapper(written(both)) == both


def test_roots_of_each_page(spark):
    note = "<p>Real text of the article, longer than the rest.</p>"
    end = "<div class='footer'>End</div>"
    pages = [
        f"<body><article>{note}</article>{end}</body>", f"<body><main>{note}</main>{end}</body>", f"<body><div class='content'>{note}</div>{end}</body>",
        f"<body class='no-sidebar'><article>{note}</article>{end}</body>", f"<body><div class='page header-fixed'><article>{note}</article></div><div>Out</div></body>",
        f"<body class='no-sidebar'><main>{note}</main><div class='comments'><article>First!</article></div></body>",
        f"<body><div class='page header-fixed'><main>{note}</main><div class='comments'><article>First!</article></div></div></body>",
        f"<body><div class='page header-fixed'><div class='content'>{note}</div></div>{end}</body>",
    ]
    rows = [(i, url, h) for i, h in enumerate(pages) for url in ("http://a.com/x", None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(i, note[3:-4]) for i in range(len(pages))}


def host_pages(spark, bodies, url="https://site.example/{}"):
    rows = [(i, url.format(i), f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_text_that_all_pages_of_a_host_share_is_template(spark):
    """Neutral markup says nothing here; only alignment with the host's other pages does."""
    menu, notice = "<div class=x1><div>Start</div><div>Contact us</div></div>", "<p>All rights are ours</p>"
    bodies = [f"{menu}<div class=x2><p>Story {w} told</p><p>and {w} ended</p></div>{notice}" for w in ("one", "two", "three", "four")]
    got = {r.page_id: r.text for r in extract(host_pages(spark, bodies)).collect()}
    assert got[1] == "Story two told\nand two ended"
    alone = extract(host_pages(spark, bodies[:1])).first().text
    assert alone == "Start\nContact us\nStory one told\nand one ended\nAll rights are ours"
    copies = extract(host_pages(spark, bodies[:1] * 5)).collect()
    assert {r.text for r in copies} == {alone}


def test_odd_markup(spark):
    deep = "<div class=a>" * 400 + "<section>" + "<div>deep text</div>" + "</section>" + "</div>" * 400 + "<p>after it</p>"
    bodies = [
        f"<article>{deep}</article>",
        '<p title="abc>first</p><p>second</p>',
        "<form><div><p>All of this page</p><p>is in one form, with <math><mi>x</mi></math> in it</p></div></form>",
        "<article><p>kept</p></article>",
        '<div class="content"><p>also kept</p></div><div class="sidebar">not this</div>',
    ]
    got = {r.page_id: r.text for r in extract(host_pages(spark, bodies)).collect()}
    assert got[0] == "deep text\nafter it"
    assert got[1] == "first\nsecond"
    assert got[2] == "All of this page\nis in one form, with x in it"
    assert got[3] == "kept" and got[4] == "also kept"


def test_groups_nested_to_any_depth_do_not_stop_the_others(spark):
    deep = "<body>" + "".join(f"<div class='{'post' if i % 2 else 'x'}'>" for i in range(50_000)) + "<p>In the deep" + "</div>" * 50_000 + "<p>After</body>"
    open_only = "<ul>" + "<li><div>" * 20_000 + "low"
    mixed = "<table>" + "<tr><td><section>t" * 10_000
    rows = [(i, f"http://h{i % 2}.com/{i}", h) for i, h in enumerate([deep, "<article><p>One</article>", open_only, "<article><p>Two</article>", mixed, deep.replace("<p>After", "")])]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "One" and got[3] == "Two" and got[2] == "low"
    assert got[0] == "In the deep" and got[5] == "In the deep" and got[4].split("\n") == ["t"] * 10_000


def test_nothing_of_a_named_article_is_template(spark):
    page = "<body><div><ul><li>Home<li>News<li>Sport<li>Page %d</ul></div><article><h1>Title %d</h1><h2>Summary</h2><p>Body %d</p><p>Read on below.</p></article></body>"
    rows = [(i, f"http://a.com/{i}", page % (i, i, i)) for i in range(4)]
    # without a named article shared texts go, and with them the menu's own entry
    bare = "<body><div><ul><li>Home<li>News<li>Sport<li>Page %d</ul></div><div><h1>Title %d</h1><p>Body %d</p></div></body>"
    rows += [(10 + i, f"http://b.com/{i}", bare % (i, i, i)) for i in range(4)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nSummary\nBody {i}\nRead on below." for i in range(4))
    assert all(got[10 + i] == f"Title {i}\nBody {i}" for i in range(4))
