"""Blocks, the network's gradients, and extraction against the pages' own article element."""

import re
from html import unescape

import numpy as np
from pyspark.sql import types as T

from shoplane.llm import bilstm, html_blocks, html_extract
from shoplane.llm.html_blocks import blocks
from shoplane.llm.html_extract import extract_text, train_labeller
from tests.conftest import SF_ORACLE

PAGE = ('<html><body><header><h1>Site name</h1></header><div id="menu"><a href=x>One</a> <a href=y>Two</a></div><{0}><h2>The title &amp; more</h2>'
        '<p>First   paragraph with <b>bold</b>ness,\n and some <i>more</i> words in it.<p>Second one &#233; goes on here for a while.'
        '<div class="ad">Buy this now</div><p>Third paragraph ends the text properly.</{1}><aside>Other stories</aside>'
        '<section class="comments"><p>A reader says something here.</p></section><form><p>Sign up</p></form><footer>&copy; us</footer>')
WANT = "The title & more First paragraph with boldness, and some more words in it. Second one é goes on here for a while. Third paragraph ends the text properly."


def article(html):
    """Plain reading of what stands in the article element."""
    m = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", html or "", re.S)
    parts = re.split(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", m[1]) if m else []
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return " ".join(p for p in parts if p)


def test_blocks_of_odd_markup():
    assert blocks("") == [] and blocks("<") == [((), "<")] and blocks("a < b") == [((), "a < b")]
    assert blocks("<!-- x --><script>var t='</p>';</script><p>one<!-- two") == [(("p",), "one")]
    assert blocks("<p><b>x<br><p>y</b>z") == [(("p", "b"), "x"), (("p",), "yz")]
    assert blocks('<div class="Ad-Box top" id=q title="a>b">t') == [(("div", ".ad", ".box", ".top", ".q"), "t")]
    assert blocks("<ul><li>a<li>b</ul>c") == [(("ul", "li"), "a"), (("ul", "li"), "b"), ((), "c")]
    assert blocks("<div title='unclosed>text") == [(("div",), "text")]
    assert blocks("<style>p{") == [] and blocks("a&nbsp;&lt;b") == [((), "a <b")]
    three = [(("p",), "One two"), (("p",), "Three")]
    for icon in ('<svg class="i"/>', "<SVG/>", '<svg><path d="M0"/></svg>', "<svg><svg>a</svg>b</svg>", "<svg><!-- </svg> -->c</svg>", "<svg>", "<math/>",
                 "<noscript>", "<template>", "<noscript><img></noscript>"):
        assert blocks(f"<p>One {icon} two</p><p>Three</p>") == three, icon
        assert blocks(f"<p>One {icon} two</p><p>Three</p><svg>x</svg><select>y</select>") == three, icon
    for field in ("<select>", "<select><option>a</select>"):  # breaks the line
        assert blocks(f"<p>One {field} two</p><p>Three</p>") == [(("p",), "One"), (("p",), "two"), (("p",), "Three")]
    assert blocks("<p>One</p><object data=x><p>two</p>") == [(("p",), "One"), (("p",), "two")]
    assert blocks("<p>One</p><object><object>x</object>y</object><p>two</p>") == [(("p",), "One"), (("p",), "two")]
    assert blocks("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == [(("p",), "So x=1 holds")]
    assert blocks("<p>a<svg data-x='>'/>b<svgs>c</svgs>") == [(("p",), "abc")]
    assert len(blocks("<p>x<select><svg><object>" * 20000)) == 20000
    assert len(blocks("<p>x" * 20000)) == 20000
    assert blocks("<" * 50000 + "p")[0][1] == "<" * 50000 + "p"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = bilstm.BiLstm(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    pages = [bilstm.inputs([(("div", "p"), "some words."), (("nav", "a"), "menu"), (("p",), "more of them")]), bilstm.inputs([(("p",), "alone")])]
    labels = [[1, 0, 1], [0]]
    _, grads = net.gradients(pages, labels)
    for name in net.w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.w[name].shape)
            if name in ("path", "word"):
                at = (pages[0][0 if name == "path" else 1][0][0], at[1])
            old = net.w[name][at]
            # states are kept in single precision, so a wide step
            net.w[name][at] = old + 1e-2
            up = net.gradients(pages, labels)[0]
            net.w[name][at] = old - 1e-2
            down = net.gradients(pages, labels)[0]
            net.w[name][at] = old
            assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3, name


def test_pages_and_awkward_rows(spark):
    pages = spark.read.parquet(f"{SF_ORACLE}/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    extra = [(-1, None), (-2, ""), (-3, "   "), (-4, "<nav>only a menu</nav>"), (-5, PAGE.format("article", "article")), (-6, PAGE.format("main", "main")),
             (-7, PAGE.format('div class="content"', "div")), (None, "<article><p>No id at all here.</p></article>"),
             (-8, "<article>" + "<p>A long page goes on and on.</p>" * 3000 + "</article>")]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                           T.StructField("text", T.IntegerType())])
    more = spark.createDataFrame([(i, f"u{i}", h, 1) for i, h in extra], schema)
    rows = extract_text(pages.unionByName(more, allowMissingColumns=True)).collect()
    assert len(rows) == len(given) + len(extra) and all(r.n_chars == len(r.text) for r in rows)
    got = {r.page_id: r.text for r in rows}
    exact = [got[i] == article(h) for i, h in given.items()]
    assert np.mean(exact) > 0.98
    assert [got[i] for i in (-1, -2, -3, -4)] == [""] * 4
    assert [got[i] for i in (-5, -6, -7)] == [WANT] * 3
    assert len(got[-8].split()) == 7 * 3000
    assert extract_text(more.limit(0)).count() == 0


def test_one_marked_page_among_unmarked_ones_is_found(spark):
    text = "<h2>A title</h2>" + "<p>Some words of an article go on here for a while.</p>" * 3
    rows = [(i, f"u{i}", f"<div>{text}</div>") for i in range(60)] + [(60, "u60", f"<article>{text}</article>"), (61, "u61", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert train_labeller(pages.where("page_id < 60"), 2, 1, 7) is None
    for fit in (1, 2, 5):
        assert train_labeller(pages, fit, 1, 7) is not None


def test_deep_unclosed_markup_costs_its_length():
    import resource
    import time
    for unit in ("<div>x ", "<b><p>x", "<span class='a b'>x<hr>"):
        start, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        page = html_blocks.leaf_blocks(unit * 50_000 + "</i></q>" * 50_000)
        assert len(page) >= 50_000
        net = bilstm.BiLstm(1)
        (p,) = net.predict_paths([page])
        assert len(p) == len(page) == len(html_extract.markup_labels([x for x, _ in page]))
        assert time.process_time() - start < 60 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 400 << 10


def test_paths_predict_like_their_words():
    html = "<html><body><nav><ul><li><a>menu</a></ul></nav><article class='post'><h1>Title</h1><p>Some words. <a>link</a><p>More</article><p>end"
    net = bilstm.BiLstm(3)
    a, = net.predict([bilstm.inputs(html_blocks.blocks(html))])
    b, = net.predict_paths([html_blocks.leaf_blocks(html)])
    assert len(a) > 4 and np.allclose(a, b, atol=1e-5)
    paths = [p for p, _ in html_blocks.leaf_blocks(html)]
    assert html_extract.markup_labels(paths) == [bool(html_extract.teacher_label(p.all_words())) for p in paths]
