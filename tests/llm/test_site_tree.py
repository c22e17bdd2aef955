"""Main text of made pages, and importances against a plain count."""

import math
from collections import Counter

import pytest
from pyspark.sql import types as T

from evigraph.llm import site_tree as st

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- c --><div class="ad">Buy</div>{extra}<article>{body}</article><footer>&copy; me</footer></body></html>'


def test_extract():
    assert st.extract(page("<h1>Title &amp; more</h1><p><b>First\n  line.<br><p>Second <i>in</i>line.</p><ul><li>a<li>b</ul>")) == "Title & more\n\nFirst line.\n\nSecond inline.\n\na\n\nb"
    assert st.extract(page("<p>x</p><div class='comments'><p>no</p></div><aside>no</aside><form>no<input></form><p>y&lt;z&#233;&nbsp;w</p>", '<div class="cookie-notice">no</div><header>no</header>')) == "x\n\ny<zé w"
    assert st.extract(None) == st.extract("") == st.extract("<script>only") == ""
    assert st.extract("plain &eacute; text") == "plain é text"
    assert st.extract("<p>open <table><tr><td>1<td>2<tr><td>3</table>") == "open\n\n1\n\n2\n\n3"
    assert st.extract("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>") == "deep"
    assert st.extract('<p title="a > b">t</p><') == "t\n\n<"


def test_importance_matches_plain_counts(spark):
    """The tree's importances against a count over a plain parse: boxes of one level, no names, each text in a paragraph."""
    texts = [("a.com", [["Top links"], [f"Head {k}", f"Body {k % 5}", "Same end"], [f"Advert {k % 3}"]]) for k in range(12)] + [("b.org", [["one"], ["two"], ["three"]])]
    texts += texts[:4]  # copies count once
    html = lambda boxes: "<html><body>" + "".join("<div>" + "".join(f"<p>{t}</p>" for t in b) + "</div>" for b in boxes) + "</body></html>"
    got = sorted((r["pages"], round(r["importance"], 9)) for r in st.importances(spark.createDataFrame([(h, html(b)) for h, b in texts], "host string, html string")).collect())
    want = []
    pages = {str(b): b for h, b in texts if h == "a.com"}.values()
    for place in range(3):
        n = Counter(t for b in pages for t in set(b[place]))
        total, m = sum(n.values()), len(pages)
        share = 1 - sum(c * math.log(c) for c in n.values()) / (total * math.log(m))
        want += 2 * [(m, round(max(0.0, min(share, len(n) / total)), 9))]  # by place from the first and from the last
    assert got == sorted(want)


def _bare(k, closing="All our letters are answered by hand"):
    """A page without any declaration: links, a notice, an article with a shared closing paragraph, one of seven adverts, an end."""
    article = f"<h2>Head {k}</h2><p>Body number {k} is here</p><p>It goes on about matter {k * 7}</p><p>{closing}</p>"
    return (
        f'<html><body><div><a href="/">Home</a> <a href="/b">About</a></div><div>We use small files to remember you</div><div>{article}</div>'
        f"{'<div><p>One more thought of ' + str(k) + '</p></div>' if k % 3 == 0 else ''}<div>Buy the thing of week {k % 7}</div><div><div>All rights of this page</div></div></body></html>"
    )


def _want(k):
    more = f"\n\nOne more thought of {k}" if k % 3 == 0 else ""
    return f"Head {k}\n\nBody number {k} is here\n\nIt goes on about matter {k * 7}\n\nAll our letters are answered by hand{more}"


@pytest.mark.parametrize("size", [60, 2_000, 20_000])
def test_the_tree_decides_on_bare_pages_alike_at_every_size(spark, size):
    rows = [(k, f"https://bare.example/{k}", _bare(k)) for k in range(size)]
    got = {r["page_id"]: r["text"] for r in st.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k] == _want(k) for k in range(size))
    assert st.extract(_bare(5)) != _want(5)  # without the host nothing tells


@pytest.mark.parametrize("size", [2_000, 12_000])
def test_closing_paragraph_of_declared_articles_stays(spark, size):
    body = lambda k: f'<h1>Head {k}</h1><p>Body number {k} is here</p><p class="end">With thanks to all</p>'
    rows = [(k, f"https://same.example/{k}", page(body(k))) for k in range(size)]
    got = {r["page_id"]: r["text"] for r in st.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k] == f"Head {k}\n\nBody number {k} is here\n\nWith thanks to all" for k in range(size))


def test_boxes_in_articles_go_and_copies_stay(spark):
    body = lambda k: f'<h1>Head {k}</h1><p>Body number {k} is here</p><div class="box">Thank you for reading</div>'
    rows = [(k, f"https://small.example/{k}", page(body(k))) for k in range(50)]
    rows += [(1000 + k, f"https://copies.example/{k}", page(body(0), f"<div>Seen {k} times</div>")) for k in range(5_000)]
    near = lambda k: f'<div class="text"><p>Long part one of all</p><p>Long part two of all</p><p>Long part three of all</p><p>Change {k}</p></div>'
    rows += [(9000 + k, f"https://near.example/{k}", page(f"<h1>T</h1>{near(k)}")) for k in range(300)]
    got = {r["page_id"]: r["text"] for r in st.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k] == f"Head {k}\n\nBody number {k} is here" for k in range(50))
    assert all(got[1000 + k] == "Head 0\n\nBody number 0 is here\n\nThank you for reading" for k in range(5_000))
    assert all(f"Long part two of all\n\nLong part three of all\n\nChange {k}" in got[9000 + k] for k in range(300))


def test_third_of_a_host_may_be_copies_of_one_bare_article(spark):
    rows = [(k, f"https://bare.example/{k}", _bare(k if k % 3 else 1).replace("Buy the thing", f"Buy no {k} thing")) for k in range(900)]
    got = {r["page_id"]: r["text"] for r in st.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(_want(k if k % 3 else 1) in got[k] for k in range(900))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "nohost", ""), (None, "http://x", page("<p>a</p>")), (3, "http://x/1", page("<p>a</p>")), (3, "http://x/1", page("<p>a</p>")), (4, "http://x", page("<p>w</p>" * 30000))]
    got = st.main_text(spark.createDataFrame(rows, PAGES).selectExpr("*", "url as host", "html as text", "page_id as low")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 30000 * 3 - 2)]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert st.main_text(spark.createDataFrame([], PAGES)).count() == 0
