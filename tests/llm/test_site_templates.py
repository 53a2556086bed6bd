import html as entities
import re

import duckdb
import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from tallywork.llm.site_templates import Page, at_least, host_of, main_text, subtree_table, template_blocks, templates


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("a < b &lt;c&gt; &amp;amp; &#233;&eacute;", "a < b <c> &amp; éé"),
        ("<p>one<p>two<b>bold<br>line</b></p>tail", "one\n\ntwobold line\n\ntail"),
        ("<article><h1>T</h1><p><b>first<br><p>second</p></article><footer>f", "T\n\nfirst\n\nsecond"),
        ("<nav>n</nav><article><p>a</p><aside>b</aside><div class='ad top'>c</div><form>d<input value='>'>e</form></article>out", "a"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p>x</p><!-- <p>y</p> --><noscript>n</noscript>", "x"),
        ("<header><h1>Site</h1></header><main><header><h2>Title</h2>by me</header><p>t</p></main>", "Title\n\nt"),
        ("<div id=cookie-notice>c</div><div hidden>h</div><div style='display: none'>s</div><div role=navigation>r</div><p>t", "t"),
        ("<ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>text</p>", "text"), ("<ul><li>a<li>b</ul>", "a\n\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<article><section class=comments><p>Nice</p></section><p>t</p></article>", "t"),
        ("<p title='a>b' data-x=\"</p>\">in</p>", "in"), ("</div></p>x<b>y</i>z", "xyz"), ("<p>un<", "un<"), ("<p>a<!-- open", "a"), ("<title>t</title>b", "b"),
        ("<body class='has-sidebar comments'><p>x</p></body>", "x"), ("x&nbsp;&nbsp;y z", "x y z"), ("<P CLASS=AD>q</P><DIV>w</DIV>", "w"), ("<a href=\"x>t</a><p>y", "t\n\ny"),
        ("<main><p>A long story</p><article class='card'>B</article></main>", "A long story\n\nB"), ("<article>a</article><article class='comment'>c</article>", "a"),
        ("<article><div class='social-history'>s</div><section id='reply-to-critics'>r</section><div class='share-buttons'>x</div></article>", "s\n\nr"),
        ("<main><p>a</p><article>A longer story</article></main>", "A longer story"), ("<div id='ad_slot_3'>q</div>w<aside>e</aside>", "w"), ("<p>one <span class=ad>x</span>two</p>", "one two"),
    ],
)
def test_main_text(html, text):
    assert Page(html).text() == text


def test_deep_and_long_pages_are_read_in_time():
    assert Page("<div>" * 20_000 + "x" + "</div>" * 20_000).text() == "x"
    assert Page("<p>" + prose(1, 50_000)).text() == prose(1, 50_000)
    assert Page('<a b="' * 5_000).text() == ""
    assert len(Page("<" * 20_000).text()) == 20_000


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "page_id long, url string, html string, main_text string, host string, subtrees string")


def test_templates_are_per_host_and_articles_stay(spark):
    shout, shared = "<div class=x><p>Read more of us</p></div>", prose(5, 30)
    rows = [(i, f"https://A.example/{i}", f"<article><p>{prose(i, 40)}</p>{shout}<p>{shared}</p></article>") for i in range(20)]
    rows += [(100 + i, f"http://b.example:80/{i}", f"<article><p>{prose(i, 40)}</p>{shout}<p>end</p></article>") for i in range(2)]
    rows += [(200 + i, "http://u@c.example?x", f"<p>{shared}</p><div><p>again</p><p>and more</p></div>") for i in range(30)]
    rows += [(300, None, f"<article><p>x y z x y z x y z x y z</p>{shout}</article>"), (301, "no url", shout), (None, None, None), (302, "https://a.example/", ""), (0, rows[0][1], rows[0][2])]
    rows += [(400 + i, f"https://d.example/{i}", f"<p>{prose(i, 40)}</p><p>Subscribe now</p>") for i in range(20)]
    pages = table(spark, rows)
    out = main_text(pages)
    assert out.columns == [*pages.columns, "_main_text"]
    text = {r.page_id: r["_main_text"] for r in out.collect()}
    assert out.count() == len(rows)
    assert all(text[i] == f"{prose(i, 40)}\n\n{shared}" for i in range(20))
    assert all(text[100 + i] == f"{prose(i, 40)}\n\nRead more of us\n\nend" for i in range(2))
    assert all(text[200 + i] == f"{shared}\n\nagain\n\nand more" for i in range(30))  # copies of one page
    assert text[300].endswith("Read more of us") and text[301] == "Read more of us" and text[None] == text[302] == ""
    assert all(text[400 + i] == prose(i, 40) for i in range(20))
    assert main_text(table(spark, [])).count() == 0


def test_templates_by_join_are_the_same(spark):
    rows = [(i, f"https://h{i % 3}.example/{i}", f"<article><p>{prose(i, 40)}</p><div>more of h{i % 3}</div></article>") for i in range(45)] + [(90, None, "<p>x")]
    first, second = (sorted(map(tuple, main_text(table(spark, rows), **o).select("page_id", "_main_text").collect())) for o in ({}, {"most_broadcast": 0}))
    assert first == second == sorted([(i, prose(i, 40)) for i in range(45)] + [(90, "x")])


def test_given_pages_are_counted(spark):
    """Menus, adverts and footers of the given sites are counted too, also where their names leave them out."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    assert subtree_table(pages, "url", "html").select("host").distinct().count() == 60
    # Their menus, adverts and footers differ from page to page: no subtree is on even a quarter of a host's articles.
    assert templates(pages, "url", "html").count() == 0


def test_templates_do_the_work_where_nothing_names_itself(spark):
    """A site of plain elements: what its pages repeat goes, by the counts alone, and changes every page."""
    top, foot = "<div><a>Start</a> <a>News</a> <a>Shop</a></div>", "<div><p>All texts are ours.</p><p>Call us</p></div>"
    rows = [(i, f"https://n.example/{i}", f"{top}<div><p>{prose(i, 30)}</p><p>{prose(i + 500, 30)}</p></div><table><tr><td>Offer of the week</td></tr></table>{foot}") for i in range(40)]
    pages = table(spark, rows)
    known = np.sort(templates(pages, "url", "html").select("subtree").toArrow().column(0).to_numpy())
    for i, url, html in rows:
        page = Page(html)
        gone = template_blocks(page, "n.example", known)
        assert len(page.shown(gone)) < len(page.text()) < len(page.shown())
        assert page.text(gone) == f"{prose(i, 30)}\n\n{prose(i + 500, 30)}"
    assert {r.page_id: r["_main_text"] for r in main_text(pages).collect()} == {i: f"{prose(i, 30)}\n\n{prose(i + 500, 30)}" for i, *_ in rows}


def test_a_quotation_stays_however_large_the_host(spark):
    """On 13 of 1,300 pages, or on most pages of a small host: a share counts, and how sure it is."""
    quote = f"<div><p>{prose(9, 12)}</p></div>"
    rows = [(i, f"https://l.example/{i}", f"<article><p>{prose(i, 40)}</p>{quote if i < 13 else ''}</article>") for i in range(1300)]
    rows += [(2000 + i, f"https://s.example/{i}", f"<article><p>{prose(i, 40)}</p>{quote if i < 2 else ''}</article>") for i in range(4)]
    rows += [(3000 + i, f"https://t.example/{i}", f"<article><p>{prose(i, 40)}</p>{quote}</article>") for i in range(3)]
    text = {r.page_id: r["_main_text"] for r in main_text(table(spark, rows)).collect()}
    assert [i for i, t in text.items() if prose(9, 12) in t] == [i for i, _, h in rows if quote in h and i < 3000]
    shares = [(3.0, 3.0), (2.0, 2.0), (5.0, 8.0), (7.0, 8.0), (55.0, 100.0), (60.0, 100.0)]
    df = spark.createDataFrame(shares, "k double, n double")
    assert [r[0] >= 0.5 for r in df.select(at_least(F.col("k"), F.col("n"))).collect()] == [True, False, False, True, False, True]


def test_small_hosts_and_lines_within_articles(spark):
    """Eight pages of a host are enough; a line of every article goes, one quoted in half of them stays."""
    quote = "<p>to be or not to be</p>"
    rows = [(i, f"https://s.example/{i}", f"<article><p>{prose(i, 60)}</p><p>Subscribe now</p>{quote if i % 2 else ''}<div>our box</div></article>") for i in range(8)]
    text = {r.page_id: r["_main_text"] for r in main_text(table(spark, rows)).collect()}
    assert text == {i: prose(i, 60) + ("\n\nto be or not to be" if i % 2 else "") for i in range(8)}


def test_hosts(spark):
    urls = ["https://A.b/c", "http://u:p@x.y:8/z", "//n", None, "mailto:a@b", "http://", "ftp://h?q"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host_of(F.col("u"))).collect()] == ["a.b", "x.y", None, None, None, None, "h"]


def test_given_pages_against_a_plain_reading():
    """The given pages have one article of headings and paragraphs each."""
    for _, html in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = html[html.index("<article>") + 9 : html.index("</article>")].replace("<b>", "").replace("<br>", " ")
        blocks = [" ".join(entities.unescape(b).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert Page(html).text() == "\n\n".join(b for b in blocks if b)
