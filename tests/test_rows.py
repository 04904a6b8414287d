from pyspark.sql import functions as F

from leadloom import registry
from leadloom.functions import html

SF = "/root/testdata/sf0.01"


def test_queries_without_sql_give_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert registry.QUERIES["q_html_text"](spark, SF).count() == pages
    found = registry.QUERIES["q_html_contacts"](spark, SF)
    assert found.columns == ["page_id", "email", "score", "rank"] and found.filter("rank = 1").groupBy("page_id").count().filter("count > 1").isEmpty()


def test_directory_companies_by_page(spark, tmp_path):
    """Rules of the survey's S28, by hand; the cap is by page."""
    body = """<nav><a href="http://nav.example.org">N</a></nav><HEADER class="x"><a href="http://head.example.org">H</a></HEADER><div role="navigation"><a href="http://role.example.org">R</a></div>
<p><a class="c" href='https://www.Acme.example.org/a#top'>Acme <b>Ltd</b></a> <a href="http://acme.example.org/b">again</a> <a href="/own">own</a> <a href="http://shop.dir.example.com/x">own too</a>
<a href="//other.example.net/?a=1&amp;b=2">Other</a> <a href="http://x.com/acme">X</a> <a href="http://a.spam-farm.example.com/">spam</a> <a href="http://t.example.org">Tickets</a>
<a href="http://press.example.org/news/1">In the news</a> <a href="http://pdf.example.org/a.pdf">list</a> <a href="mailto:a@b.example.org">m</a> <a href="#x">x</a></p><footer><a href="http://foot.example.org">F</a></footer>"""
    many = "".join(f'<a href="http://c{i}.example.org/">c{i}</a>' for i in range(25))
    pages = [(1, "https://www.dir.example.com/list", body), (2, "http://many.example.com/", many), (3, "http://more.example.com/", many), (4, "http://none.example.com/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = registry.QUERIES["q_directory_companies"](spark, str(tmp_path)).collect()
    assert [(r.place, r.host, r.url) for r in rows if r.page_id == 1] == [(1, "acme.example.org", "https://www.Acme.example.org/a"), (2, "other.example.net", "https://other.example.net/?a=1&b=2")]
    for page in (2, 3):
        assert [r.host for r in sorted((r for r in rows if r.page_id == page), key=lambda r: r.place)] == [f"c{i}.example.org" for i in range(20)]
    assert not any(r.page_id == 4 for r in rows)


def test_contact_hits_work_a_page_out_once(spark):
    texts = ["a [at] b dot com x", None, "<p>sales&nbsp;at&nbsp;acme.org</p>", "<p>Sales @ Acme . com, info@acme.net</p><a href=\"mailto:b%40acme.org?x\">m</a>", "<i>a</i>t", "<i>me a</i>t shop.example.io", "<p>hello&lt;AT&gt;corp.de or hello@corp.de</p>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, html string").withColumn("hits", html.contact_hits(F.col("html")))
    got = [[tuple(h) for h in r.hits] for r in sorted(rows.collect(), key=lambda r: r.i)]
    assert got == [[("a@b.com", 12)], [], [("sales@acme.org", 12)], [("b@acme.org", 40), ("info@acme.net", 15), ("sales@acme.com", 15)], [], [("me@shop.example.io", 12)], [("hello@corp.de", 15)]]
    assert rows._jdf.queryExecution().analyzed().toString().count("blockquote") == 1  # the pattern of text_of()
