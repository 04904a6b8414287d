from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from leadloom.operators import markup


def rows(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(2)


class Nest(HTMLParser):
    """Opening tags in order with how many of each name are open around them."""

    def __init__(self, page):
        super().__init__()
        self.open, self.found = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, tuple(self.open)))
        if tag not in markup.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


@pytest.mark.parametrize("page", [
    "<div><div a=1><p>x</p></div><div>y</div></div>", "<ul><li><ul><li>a</li><li>b</li></ul></li><li>c</li></ul>", "<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table><br><img src=x>", "",
    "<div>" * 300 + "<a href=x>y</a>" + "</div>" * 300,
])
def test_nesting_against_a_parser(spark, page):
    found = markup.elements(markup.tokens(rows(spark, page), "id", "html"), "id").collect()
    got = []
    for e in sorted(found, key=lambda e: e.at):
        around = [o for o in found if o.at < e.at < o.end]
        got.append((e.name, tuple(o.name for o in sorted(around, key=lambda o: o.at))))
    assert got == Nest(page).found


def test_unclosed_and_stray_tags(spark):
    page = "</div><ul><li>a<li>b</ul><div><p>c<p>d</div><!-- <div> --><script>'<div>'</script><input value='>'><div>e"
    found = {(e.name, e.at): e.end for e in markup.elements(markup.tokens(rows(spark, page), "id", "html"), "id").collect()}
    ends = [found[k] for k in sorted(k for k in found if k[0] == "li")]
    assert ends[0] == sorted(k[1] for k in found if k[0] == "li")[1]
    assert len([k for k in found if k[0] == "div"]) == 2 and len([k for k in found if k[0] == "p"]) == 2 and len([k for k in found if k[0] in ("script", "input")]) == 2


CARDS = [("div", "hit"), ("li", None)]


def test_listing_by_hand(spark):
    first = """<div class="hit a"><h2>One <i>Ltd</i></h2><a href="#x">x</a><a href='http://one.example/?a=1&amp;b=2'>go</a> said</div><div class=hit><a href="http://two.example">Two</a></div>
    <div class="hit"><a href="http://two.example">Two again</a></div><div class="hit"><a href="mailto:a@b.c">mail</a><h3>three</h3></div><div class="hit"><h3>THREE</h3></div><li><a href="/l">no card</a></li>"""
    second = "<ul><li><a href=/a>Alpha</a><li><a href='/b'>Home</a><li>No link</ul>"
    got = {}
    for r in markup.listing(rows(spark, first, second, None, "", "<p>none</p>"), "id", "html", CARDS).collect():
        got.setdefault(r.id, []).append((r.place, r.link, r.title))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, "http://one.example/?a=1&b=2", "One Ltd"), (2, "http://two.example", "Two"), (3, "", "three")], 1: [(1, "/a", "Alpha"), (2, "/b", "Home")]}
    names = markup.exhibitors(markup.listing(rows(spark, second), "id", "html", CARDS)).collect()
    assert [r.title for r in names] == ["Alpha"]


def test_links_within_a_card_only(spark):
    page = rows(spark, "<a href=/out>o</a><div class=card><span><a href=/in>i</a></span></div>")
    tokens = markup.tokens(page, "id", "html")
    boxes = markup.cards(markup.elements(tokens, "id"), "id", [("div", "card")])
    links = markup.within(boxes, tokens.filter("kind = 'open' and name = 'a'"), "id").select(markup.attribute(F.col("raw"), "href").alias("h")).collect()
    assert [r.h for r in links] == ["/in"]


def test_a_page_goes_through_one_shuffle(spark):
    """Cards are cut out of their page's row: no page or token is written or meets another row, and pages that come grouped by their key are not dealt anew."""
    page = "<ul><LI class='x y'>a<!-- <li> --><a href=/a>A</a><li>b<p><a href=/b>B</a></ul><lix><a href=/no>no</a></lix><li/><ol><li><ol><li><a href=/c>C</a></li></ol><h2>D</h2></li></ol><li>open <a href=/e>E"
    pages = spark.createDataFrame([(1, page), (None, page), (2, "<li>"), (3, None), (4, "<p>x</p>")], "id int, html string").repartition(2)
    parts = markup.card_parts(pages, "id", "html", CARDS)
    rows = markup.tokens(pages, "id", "html")
    inside = markup.within(markup.cards(markup.elements(rows, "id"), "id", CARDS).select("id", "at", "end"), rows.filter("kind != 'other'"), "id", "card_")
    got = [(r.id, r.card_at, *p) for r in parts.collect() for p in r.parts]
    assert sorted(got, key=str) == sorted([(r.id, r.card_at, r.at, r.kind, r["name"], r.raw) for r in inside.collect()], key=str) and len(got) > 20
    found = markup.listing(pages.groupBy("id").agg(F.max("html").alias("html")), "id", "html", CARDS)
    assert sorted([(r.place, r.link, r.title) for r in found.collect() if r.id == 1]) == [(1, "/a", "A"), (2, "/b", "B"), (3, "/c", "D"), (4, "/e", "E")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and "parquet" not in plan.lower() and plan.count("Exchange hashpartitioning") == 1


def test_next_page(spark):
    pages = ['<a rel="next" href="/2">2</a>', '<a href="?p=2"> Next </a>', '<a class="b next" href="/n">3</a>', '<form><input type=submit value="Next"></form>', '<a href="/next">nothing</a>', None, "", "<a rel=next>x</a>", "x" * 300_000 + '<a rel="next" href="/far">f</a>']
    got = {r.id: (r.has_next, r.next_url) for r in markup.next_page(rows(spark, *pages), "id", "html").collect()}
    assert got == {0: (True, "/2"), 1: (True, "?p=2"), 2: (True, "/n"), 3: (True, ""), 4: (False, ""), 5: (False, ""), 6: (False, ""), 7: (False, ""), 8: (True, "/far")}


def test_within_meets_by_equal_places(spark):
    """Rows of one page are not compared all with all: places are keys of the join, and nested, empty and unkeyed outer rows count."""
    outer = [(1, 0, 9), (1, 2, 5), (1, 3, 3), (1, 7, 8), (None, 1, 4)]
    inner = [(k, at) for k in (1, 2, None) for at in range(11)]
    boxes, rows = spark.createDataFrame(outer, "k int, at int, end int"), spark.createDataFrame(inner, "k int, at int")
    got = markup.within(boxes, rows, "k")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(k, at, a, e) for k, at in inner for o, a, e in outer if k == o and a < at < e], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(at#" in plan and "= __place#" in plan and "< outer_end#" not in plan.split("Join", 1)[1].split("\n")[0]
