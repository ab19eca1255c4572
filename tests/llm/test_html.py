"""HTML extraction against plain readings of pages whose article is known, and tree matching against all matchings."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import html_extract as H


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "text": F.lit(1), "shape": F.lit(2), "slots": F.lit(3)}).repartition(4)


def texts(df, **settings):
    return {r.page_id: (r.text, r.n_chars) for r in H.extract(df, **settings).collect()}


def one(page):
    return "\n".join(H.main_blocks(H.Page(page), None))


def test_given_pages(spark, sf_dir):
    """The article element of the given pages, cut at its paragraphs by a plain reading."""

    def plain(page):
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article))
        return "\n".join(x for x in blocks if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = H.op11_html_extraction(spark, sf_dir).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (plain(h), len(plain(h))) for i, h in pages.items()} and len(got) == len(pages)


def prose(rng, n=30):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def site(rng, k, paragraphs):
    """A page without any telling name: its menus come from a stock, a legal line is constant, the rest is its own."""
    menu = "".join(f"<li><a href=/{w}>{w} things</a>" for w in f"stock{k % 3} more{k % 2} home".split())
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"<html><body><div class=c1><div class=c2>Our site since 1999</div><ul>{menu}</ul><div class=c3><h1>{paragraphs[0][:20]}</h1>{body}</div><div class=c4>Printed on paper</div></div>"


def test_wrapper_of_a_host_without_telling_names(spark):
    rng = random.Random(1)
    pages = {k: [prose(rng) for _ in range(rng.randint(1, 6))] for k in range(60)}
    rows = [(k, f"https://Hot.example:80/{k}?x=1", site(rng, k, p)) for k, p in pages.items()]
    got = texts(frame(spark, rows))
    want = {k: "\n".join([p[0][:20].strip(), *p]) for k, p in pages.items()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_constant_lines_within_articles(spark):
    rng = random.Random(2)
    own = {k: prose(rng) for k in range(20)}
    page = lambda k: f"<article><p>{own[k]}</p><div>Follow us</div></article>"
    assert texts(frame(spark, [(k, "http://a.b/", page(k)) for k in own])) == {k: (t, len(t)) for k, t in own.items()}
    # copies of one page say nothing about what is constant, nor do few pages
    copies = [(k, "http://c.d/", page(0)) for k in range(30)] + [(100 + k, "http://e.f/", page(k)) for k in range(5)]
    got = texts(frame(spark, copies))
    assert got == {k: (f"{own[0]}\nFollow us",) * 1 + (len(own[0]) + 10,) for k in range(30)} | {100 + k: (f"{own[k]}\nFollow us", len(own[k]) + 10) for k in range(5)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &amp text &lt;here&gt; &#233;&nbsp;x", "plain & text <here> é x"),
        ("<p>a<p>b<div>c<br>d</div>e", "a\nb\nc d\ne"),
        ("<article><header><h1>T</h1></header>x<footer>no</footer><aside>no</aside><form>no</form></article><footer>no</footer>", "T\nx"),
        ("<header><h1>no</h1></header><main><p>yes</p><div class='comments'><article>no</article></div></main>", "yes"),
        ("<div class='sidebar-layout'><main><p>yes</main></div><div class='page has-sidebar'><article>no main</article></div>", "no main"),
        ("<form id=f><nav>no</nav><article><p>in a form</p></article></form>", "in a form"),
        ("<nav><article>no</article></nav><p>yes", "yes"),
        ("<article><p>a <span class=ad>no</span> b</p><div id='cookie-notice'>no</div><p hidden>no</p><p style='display: none'>no</p></article>", "a b"),
        ("<article><h1 class=header>T</h1><p class=promo>no</p><script>var t='</p>';</script><style>p{}</style><p>x<!-- <p>no --></p>", "T\nx"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\nb\n1\n2\n3"),
        ("<article>a < b <3 <b>bold</b>ly <i>it</article>", "a < b <3 boldly it"),
        ("<article><p title='a > b'>q</p></article><p>no", "q"),
        ("<p>never closed <b", "never closed"),
        ("<title>no</title><body class='menu-open has-sidebar'><div>yes</div>", "yes"),
        ("<script>never closed", ""),
        ("<div role=main><p>yes</p></div><p>no</p>", "yes"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
    ],
)
def test_single_pages(page, text):
    assert one(page) == text


def test_edges(spark):
    rng = random.Random(4)
    long = [prose(rng, 50) for _ in range(20_000)]
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "not a url", ""), (3, None, "<p>x"), (3, None, "<p>x"), (None, "http://a/", "<p>null id"), (4, "http://a/", "<article>" + "".join(f"<p>{p}</p>" for p in long) + "</article>"), (5, "http://a/", deep)]
    rows += [(6, "http://a/", "".join(f"<div class=c{'x' * k}>w{k}</div>" for k in range(400)))]
    got = H.extract(frame(spark, rows)).collect()
    assert sorted(str((r.page_id, r.url, r.text[:9], r.n_chars)) for r in got) == sorted(
        str(x) for x in [(1, None, "", 0), (2, "not a url", "", 0), (3, None, "x", 1), (3, None, "x", 1), (None, "http://a/", "null id", 7), (4, "http://a/", long[0][:9], sum(map(len, long)) + 19_999), (5, "http://a/", "deep", 4), (6, "http://a/", "w0\nw1\nw2\n", sum(len(f"w{k}") for k in range(400)) + 399)]
    )
    assert H.extract(frame(spark, [])).collect() == []


def test_tree_matching_is_greatest():
    rng = random.Random(5)

    def shape():
        return "\n".join(["-1 #", *(f"{rng.randrange(k)} {rng.choice('ab')}" for k in range(1, rng.randint(2, 8)))])

    def all_pairs(ta, tb, x, y):
        """The greatest number of pairs below partners x and y, over every choice of pairs in order."""
        (la, ka), (lb, kb) = ta, tb

        def best(p, q):
            if not p or not q:
                return 0
            skip = max(best(p[1:], q), best(p, q[1:]))
            return max(skip, 1 + all_pairs(ta, tb, p[0], q[0]) + best(p[1:], q[1:])) if la[p[0]] == lb[q[0]] else skip

        return best(ka[x], kb[y])

    for _ in range(300):
        a, b = shape(), shape()
        ta, tb = H._tree(a), H._tree(b)
        got = H.align(a, b)
        pairs = [(x, y) for x, y in enumerate(got) if y >= 0]
        assert len(pairs) - 1 == all_pairs(ta, tb, 0, 0) and len({y for _, y in pairs}) == len(pairs)
        assert all(ta[0][x] == tb[0][y] for x, y in pairs)


def test_long_lists_keep_small_shapes():
    page = "<table>" + "".join(f"<tr><td>{k}</td><td><p>x</p></td></tr>" for k in range(5000)) + "</table>"
    p = H.Page(page)
    assert len(p.blocks) == 10_000 and len(p.labels) < 8
