import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from gridengine.llm import html as H


def text(page, template=lambda h: False):
    root = H.parse(page)
    H.hashed(root)
    return H.main_text(root, template)


def expected(page):
    """The article's text by plain patterns; enough for the made pages."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br|li|ul)>", body)
    return " ".join(t for b in blocks if (t := " ".join(unescape(re.sub(r"</?b>", "", b)).split())))


def test_whole_table_against_patterns(spark, sf):
    got = {r.page_id: (r.text, r.n_chars) for r in H.op5_site_templates(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        want = expected(r.html)
        assert got.pop(r.page_id) == (want, len(want))
    assert not got


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b<b>c", "a bc"),
        ("<article><p>one<br>two&nbsp;&nbsp;three</p><div class='ad'>buy</div></article><footer>f</footer>", "one two three"),
        ("<body><div id=sidebar><p>s</p></div><div class='post'><h2>T</h2>x</div><form><p>f</p></form>", "T x"),
        ("<main><header><nav>n</nav><h1>Head</h1>by me</header><p>p</p><section class='comments'><article>c</article></section></main>", "Head p"),
        ("<script>var a='</p><p>no';</script><style>p{}</style><p title='a>b'>yes</p><!-- <p>no</p> -->", "yes"),
        ("<p>a &lt;b&gt; &#233;&eacute;</p>", "a <b> éé"),
        ("<div class='layout sidebar-right'><h1>T</h1><p>x</p><div class='a left-sidebar'>s</div></div><div class='site-footer'>f</div><div class='has-sidebar'>y</div>", "T x y"),
        ("<article><h1>T</h1><p>x</p><div id=comments><article class=comment><h4>c</h4></article></div><ol class=commentlist><li>c</ol></article>", "T x"),
        ("<article><h2 id='Search_algorithms'>S</h2><p class='share-price'>p</p><section id='related-work'>r</section><div class='notice-period'>n</div><p class=notice>q</p></article>", "S p r n q"),
        ("<article><p>x</p><div role=navigation>n</div><div class='box share'>s</div><div id=comments>c</div><button>more</button></article>", "x more"),
        ("<main><div><p>The story is here, and it is much longer.</p></div><article>Teaser</article></main>", "The story is here, and it is much longer. Teaser"),
        ("<div " * 3 + "<p>broken", "broken"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_whole_table_by_its_templates_alone(spark):
    """The given pages on two hosts, with every tag and name that says what it is made a plain one: only recurrence tells menus, adverts
    and footers from the stories. (Of a story, what recurs on as many pages goes too; within an article it would stay.)"""
    rows, want, chrome = [], {}, {}
    plain = lambda h: " ".join(unescape(re.sub(r"<[^>]*>", " ", h)).split())
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r.html).replace(' class="ad"', "")
        host = f"host{r.page_id % 2}.example"
        page = re.sub(r"&copy; \S+ &middot;", f"&copy; {host} &middot;", page)
        rows.append((r.page_id, f"https://{host}/{r.page_id}", page))
        want[r.page_id] = expected(r.html)
        chrome[r.page_id] = [plain(re.search(x, r.html, re.S)[0]) for x in ("<nav>.*?</nav>", '<div class="ad">.*?</div>')]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, never = ({r.page_id: r.text for r in H.extracted(d, many=many).collect()} for many in (3, 10**9))
    assert all(never[i].startswith(" ".join(chrome[i])) and "©" in never[i] for i in want)
    assert not any(got[i].startswith(chrome[i][0]) or "©" in got[i] for i in want)
    assert sum(map(len, got.values())) > 0.9 * sum(map(len, want.values()))
    assert sum(got[i] == want[i] for i in want) > 100  # as it stands, word for word


@pytest.mark.parametrize("limit", [H.MAX_BROADCAST, 0])
def test_recurring_subtrees_go(spark, limit):
    page = lambda k: f"<div><span>Site name</span></div><div><p>Story {k} is here.</p><p>Same words.</p></div><div><p>All rights reserved by us</p></div>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(20, "http://b.example/1", page(20))]
    rows += [(30 + k, f"http://a.example/x{k}", f"<article><p>Part {k}</p><p>Same words.</p><div><i>Shared box</i></div></article>") for k in range(12)]
    rows += [(50 + k, f"http://c.example/{k}", "<article><div>One copied story</div></article>") for k in range(12)]
    rows += [(70, None, None), (71, "http://a.example/", ""), (71, "http://a.example/", ""), (None, "x", "<p>q")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("c")).withColumn("text", F.lit("c"))
    out = H.extracted(d, max_broadcast=limit)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows)
    assert got[3] == "Story 3 is here."  # a paragraph that recurs outside an article is template
    assert got[20] == "Site name Story 20 is here. Same words. All rights reserved by us"
    assert got[33] == "Part 3 Same words."
    assert got[55] == "One copied story"
    assert got[70] == got[71] == "" and got[None] == "q"
    assert H.extracted(d.limit(0)).count() == 0
