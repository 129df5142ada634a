import html
import re

import pytest

from sumforge.llm import site_templates
from sumforge.llm.markup import Page
from sumforge.llm.site_templates import main_text

SCHEMA = "page_id long, url string, html string, host string, part string, templates string"


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in site_templates.extract(df).collect()), key=str)


def article(source):
    """The blocks of an article element that holds nothing but headings, paragraphs and inline tags."""
    inner = re.search("<article>(.*)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(filter(None, blocks))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert sorted(map(tuple, site_templates.op11(spark, sf).collect())) == sorted((r.page_id, r.url, article(r.html), len(article(r.html))) for r in rows)


def soup(k, words):
    return f"""<div class=top><b>Site</b> <a href=/>Home</a><div>Welcome to our site, friends</div></div>
<table><tr><td><div id=x{k}><h2>Title {k}</h2><div>Story {words}<p>more of {k}</div></div></table>
<div><p>All rights reserved by us</div>"""


def test_templates_of_a_site_without_any_hints(spark):
    rows = [(k, f"http://Host.example:80/{k}", soup(k, f"text {k}")) for k in range(20)]
    rows += [(99, "http://other.example/", soup(99, "alone"))]
    got = dict((r[0], r[2]) for r in extracted(spark, rows))
    assert got[7] == "Title 7\nStory text 7\nmore of 7"
    assert "All rights reserved by us" in got[99]  # nothing recurs on that host


def test_templates_against_counting_in_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts = {}
    for r in rows:
        host = re.match(site_templates.HOST, r.url)[1].lower()
        own, each = site_templates.subtrees(r.html)
        hosts.setdefault(host, {})[own] = each
    want = {}
    for host, pages in hosts.items():
        counts = {}
        for each in pages.values():
            for d in each:
                counts[d] = counts.get(d, 0) + 1
        want[host] = {d for d, n in counts.items() if n >= 3 and n >= 0.1 * len(pages)}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found, heavy = site_templates.site_templates(pages)
    got = {(r.host, r.part): set(r.templates) for r in found.collect()}
    names = spark.createDataFrame([(h,) for h in hosts], "h string").selectExpr("h", "xxhash64(h) AS x").collect()
    parts = {r.host: r.parts for r in heavy.collect()}
    assert got == {(r.x, p): want[r.h] for r in names if want[r.h] for p in range(parts.get(r.x, 1))}
    assert len(parts) > 1


def test_quotations_stay_in_articles_and_copies_are_no_templates(spark):
    page = "<nav>{0}</nav><article><h1>T{0}</h1><p>The same famous words</p><p>own {0}</p><div>Read our letter</div><div class='share-box'>s</div><ul><li><a href=x>Next</a></ul></article>"
    rows = [(k, f"https://a.example/{k}", page.format(k)) for k in range(9)]
    got = extracted(spark, rows + [(50 + k, f"https://a.example/c{k}", "<div><p>copied</div>") for k in range(30)])
    assert [r[2] for r in got if r[0] < 9] == [f"T{k}\nThe same famous words\nown {k}" for k in range(9)]
    assert {r[2] for r in got if r[0] >= 50} == {"copied"}


def test_rows_of_all_kinds(spark):
    rows = [(1, None, None), (1, None, None), (None, "nonsense", ""), (2, "http://x/", "plain  text &amp; <"), (3, "http://x/", "<article></article>"), (4, "", "<p>a<p>b"), (5, "http://u:p@X/", "<p>" + "long " * 400_000)]
    want = [(1, None, "", 0), (1, None, "", 0), (None, "nonsense", "", 0), (2, "http://x/", "plain text & <", 14), (3, "http://x/", "", 0), (4, "", "a\nb", 3), (5, "http://u:p@X/", ("long " * 400_000).strip(), 1_999_999)]
    assert extracted(spark, rows) == sorted(want, key=str)
    assert extracted(spark, []) == []


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><h1>A</h1><p>x<p>y<br>z<script>var t='</p>'</script></article><footer>f</footer>", "A\nx\ny z"),
        ("<body class='has-sidebar'><div class=sidebar>s</div><div>text</div><div id=comments>c</div>", "text"),
        ("<main><header><h1>H</h1><span>by me</span></header><p>b</p><aside>no</aside><form>f</form></main>", "H\nb"),
        ("<form><main><p>in</p></main></form>", "in"),
        ("<article>one<article class=comment>two</article></article>", "one"),
        ("<article>long long story</article><article>short</article>", "long long story"),
        ("<p>a<!-- <p>no</p> -->b<!-->c<!--->d</p>e<!-- open <p>no", "abcd\ne"),
        ("<p>a&nbsp;b&#233;&lt;i&gt;&ampx &nosuch; &am</p>", "a bé<i>&x &nosuch; &am"),
        ("<b>bold <p>par</b> on</p>", "bold\npar on"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ('<p title="a>b" data-x=\'"\'>ok</p><p title="open>gone</p>', "ok"),
        ("<p>x < y <3 </3> z</p><", "x < y <3 z\n<"),
        ("<head><title>t</title>words<p>p", "words\np"),
        ("<p hidden>no</p><p style='display: none'>no</p><template>no</template><textarea><p>no</textarea>yes", "yes"),
        ("<SCRIPT>no</ScRiPt ><STYLE>no", ""),
    ],
)
def test_readings(source, text):
    assert main_text(source) == text


def test_deep_and_broken_pages_take_linear_time():
    import time

    for source in ("<div>" * 60_000 + "x", "<b>" * 60_000 + "<p>x" * 1000, "<a href='x" * 60_000, "<p" * 60_000, "<!--" * 60_000, "</div>" * 60_000, "<i></b>" * 60_000):
        began = time.time()
        Page(source)
        assert time.time() - began < 5
    assert main_text("<div>" * 60_000 + "x") == "x"
