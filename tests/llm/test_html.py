import html
import re
import time

import numpy as np

from sightline.llm import html as h


def plain(page):
    """Main text of a page whose only content is one article element with simple markup."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", body)
    return "\n".join(t for x in parts if (t := re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip()))


def test_pages(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: plain(r.html) for r in d.collect()}
    got = h.extract(d).collect()
    assert len(got) == len(want) == 2500
    assert not [r.page_id for r in got if r.text != want[r.page_id] or r.n_chars != len(r.text)]


def test_zones():
    page = """<html><head><title>T</title></head><body class="header"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies on this site, ok?</div>
<main><article><h1>Head &amp; line</h1><p>First   para<p>Second <a href=x>link</a> para &lt;b&gt; &#233;<script>if (a</p>) { }</script> tail
<!-- <p>no</p> --><aside>By the way, this is a long side remark that nobody needs in the text.</aside><ul class="menu"><li><a>One</a></li></ul>
<form>Mail: <input> <button>Send</button></form><blockquote>Quote</blockquote></article>
<section id="comments"><article><p>I am a reader and this is what I think of all that.</p></article></section></main>
<div class="sidebar widget">Long text in a sidebar with very many words, so that it looks like content to a counter of words.</div><footer>&copy; x</footer></body></html>"""
    assert h.main_text(page) == "Head & line\nFirst para\nSecond link para <b> é tail\nQuote"


def test_pages_without_marks():
    para = "word " * 60
    page = f"<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><div><p>{para}</p><p>{para}</p></div><p><a>Next</a></p></body>"
    assert h.main_text(page) == "\n".join([para.strip()] * 2)


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>x<p>y"), (3, "u", "<<>> & < b"), (3, "u", "<article>" + "<p>a" * 5000), (4, "u", "<article>a<!-- open"), (5, "u", "<script>x")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.n_chars): r.text for r in h.extract(d).collect()}
    assert got[(None, 3)] == "x\ny" and got[(1, 0)] == got[(2, 0)] == got[(5, 0)] == "" and got[(4, 1)] == "a" and got[(3, 9999)] == "\n".join("a" * 5000)
    assert h.extract(d.limit(0)).collect() == []


def test_marked_text_is_kept_and_boilerplate_dropped_whatever_stands_near():
    g = np.random.default_rng(1)
    x = np.column_stack([np.ones(5000), g.integers(1, 300, 5000), g.random(5000) * 0.5, g.integers(0, 300, 5000), g.random(5000), g.integers(0, 300, 5000), g.random(5000)])
    assert h.classify(h.grow(h.LABELLED), x).all()
    x[:, 0], x[:, 2] = h.OTHER, g.random(5000)
    assert not h.classify(h.grow(h.LABELLED), x).any()


def test_tree_fits_its_table():
    assert (h.classify(h.grow(h.LABELLED), h.LABELLED[:, :-1]) == h.LABELLED[:, -1]).mean() > 0.95


def test_words_and_links_decide_where_no_mark_does():
    """Unmarked and hinted blocks: the tree differs from what the zone alone would say, both ways."""
    para, short = " ".join(["word"] * 60), "<a href=1>One</a>"
    page = f"<body><div>{short}</div><div>{short}</div><div class='share-page'><p>{para}</p><p>{para}</p></div><div class='share-box'><p>{short}</p><p>{short}</p></div><article><p>{para}</p><ul><li>{short}</li><li>{short}</li><li>{short}</li></ul></article></body>"
    found = h.blocks(page)
    kept = h.classify(h.grow(h.LABELLED), h.features(found))
    assert h.main_text(page).split("\n").count(para) == 3 and h.main_text(page).startswith(f"{para}\n{para}\n")
    assert {(z, k) for (_, z, _, _), k in zip(found, kept.tolist(), strict=True)} >= {(h.ARTICLE, 1), (h.ARTICLE, 0), (h.HINT, 1), (h.HINT, 0), (h.PLAIN, 0)}
    assert sum((z == h.ARTICLE) != bool(k) for (_, z, _, _), k in zip(found, kept.tolist(), strict=True)) >= 3


def test_references_are_decoded_within_a_text_node():
    assert h.main_text("<article><p>&<b>amp;</b> &amp;lt; &#x41;&eacute;<!-- x -->acute;</p></article>") == "&amp; &lt; Aéacute;"


def test_time_is_linear_in_the_page():
    def seconds(page):
        t = time.perf_counter()
        h.main_text(page)
        return time.perf_counter() - t

    for unit in ("<a ", "<a x='", '<a x="<b y=\'', "<!x", "</script ", "<script></script ", "<div></span>", "<div>", "</div>", "& < ", "<a x=", "<p>a", '<p class="share-x">'):
        seconds(unit * 1000)
        assert seconds(unit * 40_000) < 3, unit
    assert h.main_text("<article>a <b" * 3) == "a a a <b"  # only the last never ends
