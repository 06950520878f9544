import html as H
import random
import re

from pyspark.sql import types as T

from runlens.llm import wrappers as W
from runlens.llm.queries import QUERIES
from tests.llm.data import SMALL

SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("url", "html", "host", "plan", "wrapper", "text")]
)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def test_pages_of_the_tables(spark):
    """The plain version cuts the one template of these pages by hand."""
    given = {
        r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    }
    got = QUERIES["op1_wrappers"](spark, SMALL).collect()
    assert len(got) == len(given)
    for r in got:
        body = re.search(r"(?s)<article>(.*?)(</article>|$)", given[r.page_id].html)[1]
        lines = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\n", body)).split("\n")
        lines = [re.sub(r"\s+", " ", H.unescape(x)).strip() for x in lines]
        assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text) and r.url == given[r.page_id].url


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head>
<body class="has-sidebar"><header><h1>Site</h1></header>
<div id="main-menu"><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></div>
<div class="cookie-notice">We use cookies.</div>
<div class="story"><h2>Title &eacute;%d</h2><p>First   paragraph &lt;%d&gt; with
a <a href="x">link</a> in it, long enough.<p>Second one<br>broken &amp; joined &am
<ul><li>item one %d<li>item two</ul><!-- <p>no</p> --><script>var t="</p><p>no</p>";</script>
<table><tr><td>cell %d<td>other</table><aside>Read more</aside></div>
<div class="tagline">The paper of the valley</div>
<section id="comments"><article class="comment"><p>Nice!</p></article></section>
<form><p>Mail</p><input value="x"></form><div class="ad-slot">Buy %d</div>
<footer>&copy; Site</footer></body></html>"""
WANT = (
    "Title é{0}\nFirst paragraph <{0}> with a link in it, long enough.\n"
    "Second one broken & joined &am\nitem one {0}\nitem two\ncell {0}\nother"
)


def test_a_host_without_article_elements(spark):
    rows = [(i, "http://U:p@Host.example:80/x?y#z", PAGE % (i, i, i, i, i)) for i in range(8)]
    found = {r.page_id: r.text for r in W.extract(pages(spark, rows).repartition(4)).collect()}
    # The line that all pages share is fixed text of the wrapper; the story is a slot.
    assert found == {i: WANT.format(i) for i in range(8)}


def test_edges(spark):
    long = "<p>" + "word " * 200_000
    rows = [
        (1, None, None),
        (2, "http://a.example/", ""),
        (3, "http://a.example/", "plain text"),
        (3, "http://a.example/", "plain text"),
        (4, "not a url", "<article><p>x<p>y</article>"),
        (None, "http://b.example/", "<div><p>a < b"),
        (5, "http://c.example/", f"<article>{long}"),
        (6, "http://c.example/", "<p>no article, but a host with one"),
        (7, "http://d.example/", "<article><nav>menu</nav>"),
    ]
    got = {(r.page_id, r.text) for r in W.extract(pages(spark, rows)).collect()}
    assert got == {
        (1, ""),
        (2, ""),
        (3, "plain text"),
        (4, "x\ny"),
        (None, "a < b"),
        (5, ("word " * 200_000).strip()),
        (6, "no article, but a host with one"),
        (7, ""),
    }
    assert W.extract(pages(spark, rows).limit(0)).count() == 0


def test_expressions():
    one = W.page_wrapper(W.blocks("<div><h1>a</h1><p>x</p><p>y</p></div><footer>f</footer>"))
    two = W.page_wrapper(
        W.blocks("<div><h1>b</h1><table><tr><td>1</table><p>x</p></div><footer>f</footer>")
    )
    assert W.expression(one) == "<div><h1>a</h1>(<p>#</p>)+</div><footer>f</footer>"
    both = W.expression(W.align(one, two))
    assert both == (
        "<div><h1>#</h1>(<table><tr><td>1</td></tr></table>)?(<p>#</p>)+</div><footer>f</footer>"
    )
    assert W.expression(W.align(two, one)) == both
    turns = W.page_wrapper(W.blocks("<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"))
    assert W.expression(turns) == "<dl>(<dt>a</dt>)+(<dd>b</dd>)+</dl>"


def test_folding_in_parts_gives_one_wrapper_a_host(spark):
    rows = [(i, f"http://h{i % 2}.example/", PAGE % (i, i, i, i, i)) for i in range(20)]
    found = W.host_wrappers(pages(spark, rows).repartition(7)).collect()
    assert sorted(r.host for r in found) == ["h0.example", "h1.example"]
    import json

    assert {json.loads(r.wrapper)["p"] for r in found} == {10}


def test_the_host_wrapper_drops_fixed_text_inside_articles(spark):
    """Also what is long, and on pages of the host without an article."""
    notice = "This notice is on all pages of the paper. " * 10
    rows = [
        (
            i,
            "http://a.example/",
            f"<body><article><h1>T{i}</h1><div class=own><p>{notice}</div><p>First {i}"
            f"<p>Last {i}{'<p>More' * (i % 3)}</article><div>Since 1900</div>",
        )
        for i in range(6)
    ]
    rows += [
        (i, "http://a.example/", f"<body><section><p>Story {i}<p>End {i}</section><div>Since 1900</div>")
        for i in range(6, 10)
    ]
    found = {r.page_id: r.text for r in W.extract(pages(spark, rows).repartition(3)).collect()}
    want = {i: f"T{i}\nFirst {i}\nLast {i}" + "\nMore" * (i % 3) for i in range(6)}
    assert found == want | {i: f"Story {i}\nEnd {i}" for i in range(6, 10)}


def test_copies_of_pages_are_no_template(spark):
    one, two = "<article><h1>A</h1><p>x<p>y</article>", "<article><h1>A</h1><p>z<p>y</article>"
    rows = [(i, "http://a.example/", two if i == 9 else one) for i in range(10)]
    found = {r.page_id: r.text for r in W.extract(pages(spark, rows)).collect()}
    assert found == {i: "A\nz\ny" if i == 9 else "A\nx\ny" for i in range(10)}


def test_long_fixed_text(spark):
    """Also on a host without articles, whatever the length."""
    for n in (200, 201, 5000):
        notice = ("legal notice " * 400)[: n - 1] + "."
        rows = [
            (i, "http://a.example/", f"<div class=x><p>Story {i}, rather long<p>End {i}</div><div class=own>{notice}</div>")
            for i in range(4)
        ]
        found = {r.page_id: r.text for r in W.extract(pages(spark, rows)).collect()}
        assert found == {i: f"Story {i}, rather long\nEnd {i}" for i in range(4)}


def texts(spark, pages_of_host):
    rows = [(i, "http://a.example/", x) for i, x in enumerate(pages_of_host)]
    return {r.page_id: r.text for r in W.extract(pages(spark, rows)).collect()}


def test_deep_and_wide_pages(spark):
    """Nested elements beyond any stack, and siblings without a pattern."""
    n = 5000
    deep = "<div>" * n + "<article><p>Deep {0}</p><nav>menu</nav><p>End {0}</article>" + "</div>" * n
    wide = random.Random(3)
    kinds = ["p", "h2", "h3", "blockquote", "pre", "figure"]
    blocks = [[(wide.choice(kinds), f"{k} {i}") for i in range(20_000)] for k in range(2)]
    many = ["<article>" + "".join(f"<{t}>{x}</{t}>" for t, x in b) + "</article>" for b in blocks]
    found = texts(spark, [deep.format(i) for i in range(4)])
    assert found == {i: f"Deep {i}\nEnd {i}" for i in range(4)}
    assert texts(spark, many) == {i: "\n".join(x for _, x in b) for i, b in enumerate(blocks)}
    inline = "<div><b>" * n + "text"
    assert texts(spark, [inline]) == {0: "text"}


def test_common_subsequences():
    """As long as the plain table's, and one for each order of the pairs."""
    draw = random.Random(5)
    for n, m, letters in [(0, 5, 2), (1, 9, 3), (30, 40, 3), (150, 130, 4), (300, 90, 12), (200, 200, 2)]:
        x, y = ([draw.choice("abcdefghijkl"[:letters]) for _ in range(k)] for k in (n, m))
        pairs = W.common(x, y)
        assert all(x[i] == y[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == len(list(W._table(x, y)))
        assert W._lengths(x, y).tolist() == [len(list(W._table(x, y[:j]))) for j in range(m + 1)]


def test_the_order_of_pages_does_not_matter(spark):
    draw = random.Random(7)
    kinds = ["p", "h2", "ul><li", "div class=own", "section", "div class=note-box"]

    def page(i):
        parts = [f"<{draw.choice(kinds)}>{draw.choice(['same', 'same again', f'own {i}'])}" for _ in range(9)]
        return "<body><div class=x>" + "".join(parts) + f"<p>Story {i} with some words</div>"

    rows = [(i, "http://a.example/", page(i)) for i in range(60)]
    results = set()
    for _ in range(5):
        draw.shuffle(rows)
        mixed = pages(spark, rows).repartition(draw.randint(1, 6))
        results.add(tuple((r.host, r.wrapper) for r in W.host_wrappers(mixed, group=7, fan=3).collect()))
    assert len(results) == 1 and len(next(iter(results))) == 1


def test_marks_of_layout_are_not_marks_of_the_article(spark):
    article = "<article><h1>Title {0}</h1><p>First {0}<p>Last one {0}</article>"
    want = "Title {0}\nFirst {0}\nLast one {0}"
    for frame in [
        "<div class='content has-sidebar'>{}</div><div class=sidebar>Other {{0}}</div>",
        "<div title='hidden gems' data-class='ad'>{}</div>",
        "<form id=aspnetForm><div class=search>Find {{0}}</div>{}</form>",
        "<div class=widget>{}</div><div class=comments><article>Nice! {{0}} and much, much more</article></div>",
    ]:
        found = texts(spark, [frame.format(article).format(i) for i in range(5)])
        assert found == {i: want.format(i) for i in range(5)}, frame
    page = (
        "<article data-role=banner><p class=dialog>“Yes {0}”<p class=search-tips>Try {0}"
        "<p class=advert>Buy {0}<div class=newsletter>Mail {0}</div><h2>End</h2></article>"
    )
    assert texts(spark, [page.format(i) for i in range(2)]) == {
        i: f"“Yes {i}”\nTry {i}\nEnd" for i in range(2)
    }


def test_a_heading_of_some_pages_is_no_fixed_text(spark):
    body = "<body><article><p>Story {0}<p>More {0}<div class=own>By the paper</div>{1}</article>"
    end = "<section><h2>Conclusion</h2><p>Thus {0}</section>"
    found = texts(spark, [body.format(i, end.format(i) if i % 9 == 0 else "") for i in range(50)])
    assert found == {
        i: f"Story {i}\nMore {i}" + (f"\nConclusion\nThus {i}" if i % 9 == 0 else "")
        for i in range(50)
    }
