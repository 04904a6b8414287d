import json

from pyspark.sql import functions as F

from leadloom.sources import payloads, sinks
from leadloom.sources.replay import ReplaySource


def one(spark, payload):
    return spark.createDataFrame([(json.dumps(payload) if not isinstance(payload, str) else payload,)], "payload string")


def test_overpass_keeps_one_open_place_a_host(spark):
    tags = [
        {"name": "A", "website": "a.example.com", "addr:city": "Rome", "addr:country": "IT"}, {"website": "https://b.example.com"}, {"name": "A2", "website": "https://www.a.example.com/x"},
        {"name": "C", "website": "https://c.example.com", "disused:shop": "yes"}, {"name": "F", "website": "https://facebook.com/f"},
    ]
    rows = payloads.overpass(one(spark, {"elements": [{"type": "node", "id": i, "tags": t} for i, t in enumerate(tags)]})).collect()
    assert [(r.name, r.website, r.address) for r in rows] == [("A", "https://a.example.com", "Rome, IT")]
    assert payloads.overpass(one(spark, "not json")).count() == 0


def test_registry_adds_the_country(spark):
    items = [{"company_name": "X Ltd", "company_number": "1", "registered_office_address": {"address_line_1": "1 Way", "locality": " ", "postal_code": "Z1"}}, {"company_name": " ", "company_number": "2"}]
    assert [tuple(r) for r in payloads.registry(one(spark, {"items": items})).collect()] == [("X Ltd", "1", "1 Way, Z1, United Kingdom")]


def test_sparql_and_search_and_products(spark):
    v = lambda **k: {n: {"value": x} for n, x in k.items()}
    rows = payloads.sparql(one(spark, {"results": {"bindings": [v(item="http://e/Q1", itemLabel="A", website="http://a.org"), v(item="http://e/Q2", itemLabel="B", website="http://www.a.org/"), v(item="http://e/Q3", itemLabel="C")]}})).collect()
    assert [(r.name, r.ref) for r in rows] == [("A", "Q1")]
    hits = payloads.search_hits(one(spark, {"organic": [{"title": "1", "link": "http://A.org/x/"}, {"title": "2", "link": "http://a.org/x#y"}], "ads": [{"title": "3", "link": "http://b.org"}]})).collect()
    assert sorted(r.title for r in hits) == ["1", "3"]
    goods = payloads.products(one(spark, {"products": [{"title": "Ring", "tags": ["gold"]}, {"title": "", "product_type": "x"}, {"title": "Cup", "product_type": "Kitchen"}, {"title": "Nut"}]})).collect()
    assert sorted((r.name, r.category) for r in goods) == [("Cup", "Kitchen"), ("Nut", "Uncategorized"), ("Ring", "gold")]


def test_xml_and_sheets(spark):
    x = spark.createDataFrame([("<urlset><url><loc> http://a/1 </loc></url></urlset>",), ("<sitemapindex><sitemap><loc>http://a/s.xml</loc></sitemap></sitemapindex>",)], "xml string")
    assert sorted(tuple(r) for r in payloads.sitemap(x).collect()) == [("http://a/1", False), ("http://a/s.xml", True)]
    assert [r.sitemap for r in payloads.robots(spark.createDataFrame([("User-agent: *\nSitemap: http://a/s.xml",)], "body string")).collect()] == ["http://a/s.xml"]
    feed = spark.createDataFrame([("<rss><item><title><![CDATA[T  1]]></title><link>http://a</link><description>d</description></item></rss>",)], "xml string")
    assert [tuple(r) for r in payloads.rss(feed).collect()] == [(0, "T 1", "http://a", "d")]
    s = spark.createDataFrame([("A", "7.9"), ("", "1"), ("B", "x")], "`Company Name` string, Fit string")
    assert sorted(tuple(r) for r in payloads.sheet(s, {"name": ("company name",), "fit": (), "city": ()}).select("name", "fit", "city").collect()) == [("A", 7, None), ("B", 0, None)]


def test_replay_resumes(spark, tmp_path):
    spark.dataSource.register(ReplaySource)

    def run(rows):
        q = spark.readStream.format("replay").option("rows", rows).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(95) == list(range(95))
    assert run(100) == list(range(100))


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 2, "w"), ("c", 3, "u")], "k string, seq int, v string")
    read = lambda p: {r.k: r.v for r in spark.read.parquet(str(p)).collect()}
    sinks.upsert(old, new, ["k"], "seq", str(tmp_path / "1"))
    assert read(tmp_path / "1") == {"a": "x", "b": "z", "c": "u"}
    sinks.upsert(old, new, ["k"], "seq", str(tmp_path / "2"), skip_existing=True)
    assert read(tmp_path / "2") == {"a": "x", "b": "y", "c": "u"}
    sinks.replace_all(new, str(tmp_path / "3"), ["k"], "seq")
    assert read(tmp_path / "3") == {"b": "z", "c": "u"}
    sinks.export_csv(new, str(tmp_path / "csv"), {"v": 1}, F.desc("seq"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert [r.k for r in sinks.delete_keys(old, new, ["k"]).collect()] == ["a"]
    colours = spark.createDataFrame([("Contacted", True), ("Contacted", False), ("?", False)], "s string, r boolean").select(sinks.status_colour(F.col("s"), F.col("r")).alias("c")).collect()
    assert [r.c for r in colours] == ["green", "yellow", "white"]
