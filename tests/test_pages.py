from html.parser import HTMLParser

from hirelode.operators import pages, strict_pages
from hirelode.plans.contacts import contacts_of, with_website
from tests.conftest import SMALL


def test_anchor_shapes(spark):
    html = """<a href="/a">A <b> x </b> y</a><A class=c HREF='/b?x=1&amp;y'>B</A><a href=/c>C</a>
    <!-- <a href="/no">no</a> --><script>'<a href="/no">no</a>'</script><a name="n">no</a>
    <a data-href="/no" title="a > b" href="/d">D<a href="">E</a><a href="/f">open"""
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    got = [(r.href, r.text) for r in pages.page_links(df).orderBy("pos").collect()]
    assert got == [("/a", "Axy"), ("/b?x=1&y", "B"), ("/c", "C"), ("/d", "D"), ("", "E"), ("/f", "open")]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and "href" in dict(attrs):
            self.found.append([dict(attrs)["href"], ""])
            self.open = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.found[-1][1] += data.strip()


def test_links_agree_with_an_html_parser(spark):
    source = spark.read.parquet(f"{SMALL}/pages.parquet")
    wanted = set()
    for row in source.collect():
        parser = Anchors()
        parser.feed(row.html)
        wanted |= {(row.page_id, i, h, t) for i, (h, t) in enumerate(parser.found)}
    got = {(r.page_id, r.pos, r.href, r.text) for r in pages.page_links(source).collect()}
    assert got == wanted


def test_anchors_that_browsers_hide_are_links(spark):
    page = """<noscript><a href="/kontakt">K</a></noscript><template><a href="/t">T</a> seen</template>
        <script>var a = '<a href="/no">';</script><!-- <a href="/old">x</a> --><p>shown</p>"""
    row = spark.createDataFrame([(page,)], "html string").select(
        pages.anchors("html").alias("links"), pages.visible_text("html").alias("text")
    ).first()
    assert [a.href for a in row.links] == ["/kontakt", "/t"]
    assert row.text.split() == ["shown"]


def test_sponsored(values):
    assert values(pages.is_sponsored, "Stadt", "Gesponsert", "Haus", None) == [True, True, False, False]
    word = lambda v: pages.is_sponsored(v, whole_word=True)
    assert values(word, "Stadt", "an Ad here", "Haus") == [False, True, False]


def test_page_score_adds_up(values):
    got = values(pages.page_score, "/kontakt", "/jobs/contact", "/a/b/team/", "/x", "/a/b/c/d")
    assert got == [115, 185, 40, 15, 0]


def test_ranked_pages(spark):
    rows = [
        ("/Kontakt?x=1", ""), ("/kontakt/", ""), ("/jobs", ""), ("/a/b/c", "Our Team"), ("/imprint", ""),
        ("https://other.de/jobs", ""), ("https://WWW.Site.de/jobs#x", ""), ("mailto:jobs@site.de", ""),
        ("/karriere/a", ""), ("//site.de/about", ""),
    ]
    links = spark.createDataFrame(
        [("site.de", "https://www.site.de/", h, t) for h, t in rows],
        "website string, url string, href string, text string",
    )
    got = [(r.page_url, r.score) for r in pages.rank_relevant_pages(links).orderBy("rank").collect()]
    assert got == [
        ("https://www.site.de/Kontakt", 115), ("https://www.site.de/kontakt", 115),
        ("https://WWW.Site.de/jobs", 85), ("https://www.site.de/jobs", 85),
        ("https://www.site.de/karriere/a", 85), ("https://site.de/about", 55),
        ("https://www.site.de/a/b/c", 0),
    ]
    assert pages.rank_relevant_pages(links, k=2).count() == 2


def test_harvest_profiles(spark):
    rows = ["https://p.org/in/a?x=1", "https://p.org/in/a/", "https://p.org/in/b", "https://p.org/x?r=/in/", "https://p.org/in/c"]
    links = spark.createDataFrame([(r,) for r in rows], "href string")
    seen = spark.createDataFrame([("https://p.org/in/b ",)], "profile_url string")
    got = [r.profile_url for r in pages.harvest_profiles(links, seen).collect()]
    assert got == ["https://p.org/in/a", "https://p.org/in/c"]


def test_website_and_domain(spark):
    df = spark.createDataFrame([("https://www.a.de/?x",), (" ",), (None,)], "raw_url string")
    assert [(r.website, r.domain) for r in with_website(df).collect()] == [
        ("https://www.a.de/", "a.de"), (None, None), (None, None),
    ]


def test_contacts_of_new_websites(spark, plan):
    home = '<p>hallo@a.de</p><a href="/kontakt">Kontakt</a><a href="/jobs">Jobs</a><a href="/x">x</a>'
    rows = [
        (1, "https://www.a.de/", home), (2, "https://www.a.de/", home),
        (3, "https://www.a.de/kontakt", "<p>nichts</p>"),
        (4, "https://www.a.de/jobs?page=1", "<p>jobs-team@a.de, info@a.de, support@a.de</p>"),
        (5, "https://www.a.de/x", "<p>late@a.de</p>"),
        (6, "https://known.de", "<p>hr@known.de</p>"),
    ]
    stored = spark.createDataFrame(rows, "page_id int, url string, html string")
    listed = [(1, "https://www.a.de/?utm=1"), (2, "https://www.a.de/"), (3, "https://known.de/"), (4, None)]
    listings = spark.createDataFrame(listed, "listing_idx int, raw_url string")
    known = spark.createDataFrame([("known.de",)], "domain string")
    found = contacts_of(listings, stored, known)
    assert sorted(map(tuple, found.collect())) == [
        ("a.de", "hallo@a.de"), ("a.de", "info@a.de"), ("a.de", "jobs-team@a.de"),
    ]
    assert "EvalPython" not in plan(found) and "CartesianProduct" not in plan(found)


MALFORMED = [
    '<a href="/a">A<a href=/b title="x > y">B</b><a class=\'q" href="/c\'>C', '<a href="/x?a=1&amp;b=2&uuml">&auml &lt;<b>z</a> out', "<a href='/open", '<a href="/q" <b>text</b></a>',
    '<!-- <a href="/no">no</a> <a href="/still">', "<script>if (a < b) document.write('<a href=\"/no\">')</script><a href=/yes>y</a>", "<style><a href=/no></style><A HREF = '/up' >Up</A>",
    '<a\nhref\n=\n"/lines"\n>\n a \n</a\n>', "<a href>none</a><a name=x>no</a><a/href=/slash>s</a>", "<p><a href=/1>1<p>2</p></p>3</a>4", "<![CDATA[<a href=/in>x</a>]]><a href=/after>y</a>",
    "<a href=/a><script>hidden()</script>shown</a>", "", "no tags & <", "<a href=/last", "<a href=/e>é&#8364;</a></a></a>", "<<a href=/two>t</a>", "<a href=\"/dup\" href=\"/second\">d</a>", None,
]


def test_strict_links_of_malformed_pages_agree_with_an_html_parser(spark):
    rows = [(i, "u", html, "kept") for i, html in enumerate(MALFORMED)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    wanted = set()
    for i, _, html, _ in rows:
        parser = Anchors()
        parser.feed((html or "").replace("<![", "<!x["))
        parser.close()
        wanted |= {(i, n, h or "", t) for n, (h, t) in enumerate(parser.found)}
    got = {(r.page_id, r.pos, r.href, r.text) for r in strict_pages.page_links_strict(df).collect()}
    # The class above lets an anchor without an address go on the one before, takes a script for its text
    # and, of two addresses of a tag, the second.
    other = {(0, 1, "/b", "B"), (11, 0, "/a", "shown"), (17, 0, "/dup", "d")}
    assert other <= got
    assert got - other == {w for w in wanted if w[:2] not in {o[:2] for o in other}}
    assert strict_pages.page_links_strict(df.limit(0)).collect() == []


def test_what_looks_like_an_anchor_in_a_text_element_is_none(spark):
    html = '<title><a href="/t">t</a></title><a href="/a">A</a><TEXTAREA rows=2>see <a href="/no">x</a></textarea><a href="/b">B</a><textarea><a href="/open">'
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    for links in (pages.page_links(df), strict_pages.page_links_strict(df)):
        assert [(r.pos, r.href, r.text) for r in links.orderBy("pos").collect()] == [(0, "/a", "A"), (1, "/b", "B")]
