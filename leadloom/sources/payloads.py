"""Rows of list services' JSON answers, which are supplied as a column of text; nothing here opens a connection."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import text, url

OVERPASS = "elements array<struct<type string, id bigint, tags map<string,string>>>"
REGISTRY = "items array<struct<company_name string, company_number string, registered_office_address struct<address_line_1 string, locality string, postal_code string, country string>>>"
SPARQL = "results struct<bindings array<map<string,struct<value string>>>>"
SEARCH = "organic array<struct<title string, link string, snippet string>>, ads array<struct<title string, link string, snippet string>>"
PRODUCTS = "products array<struct<title string, handle string, product_type string, tags array<string>, body_html string>>"
#: Tags that mark a place as closed, and hosts that are no company's own.
CLOSED = ("disused", "abandoned", "demolished", "razed")
COUNTRY = "United Kingdom"


def _parsed(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    return rows.withColumn("__p", F.from_json(payload, schema))


def _first_by_host(rows: DataFrame, place: str) -> DataFrame:
    """The first row of each host, in order of place; hosts of social networks go."""
    return rows.filter((F.col("host") != "") & ~url.is_social(F.col("host"))).withColumn("__n", F.row_number().over(Window.partitionBy("host").orderBy(place))).filter("__n = 1").drop("__n")


def _https(website: Column) -> Column:
    return F.when(F.regexp_like(website, F.lit("^[a-z]+://")), website).otherwise(F.concat(F.lit("https://"), website))


def overpass(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Open places with a name and a website, one a host."""
    e = _parsed(rows, payload, OVERPASS).select(F.posexplode("__p.elements").alias("place", "e"))
    tag = lambda *names: F.coalesce(*[F.try_element_at(F.col("e.tags"), F.lit(n)) for n in names])
    closed = F.exists(F.map_keys(F.coalesce("e.tags", F.create_map().cast("map<string,string>"))), lambda k: k.isin(*CLOSED) | F.regexp_like(k, F.lit("^(" + "|".join(CLOSED) + "):")))
    found = e.select("place", tag("name").alias("name"), _https(tag("website", "contact:website")).alias("website"), F.concat_ws(", ", tag("addr:street"), tag("addr:city"), tag("addr:country")).alias("address"), closed.alias("closed"))
    found = found.filter("name is not null and website is not null and not closed").withColumn("host", url.site(url.host(F.col("website"))))
    return _first_by_host(found, "place").select("name", "website", "host", "address")


def registry(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Companies with a name; their address, with the country where it lacks one."""
    e = _parsed(rows, payload, REGISTRY).select(F.explode("__p.items").alias("e"))
    a = e.select(text.clean(F.col("e.company_name")).alias("name"), F.col("e.company_number").alias("number"), F.col("e.registered_office_address").alias("a")).filter("name != ''")
    parts = [F.when(F.trim(F.coalesce(f"a.{c}", F.lit(""))) != "", F.trim(f"a.{c}")) for c in ("address_line_1", "locality", "postal_code")]
    return a.select("name", "number", F.concat_ws(", ", *parts, F.coalesce("a.country", F.lit(COUNTRY))).alias("address"))


def sparql(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Items with a name and a website, one a host; the reference is the last path segment."""
    e = _parsed(rows, payload, SPARQL).select(F.posexplode("__p.results.bindings").alias("place", "b"))
    value = lambda n: F.try_element_at(F.col("b"), F.lit(n))["value"]
    found = e.select("place", value("itemLabel").alias("name"), value("website").alias("website"), F.substring_index(value("item"), "/", -1).alias("ref")).filter("name != '' and website != ''")
    return _first_by_host(found.withColumn("host", url.site(url.host(F.col("website")))), "place").select("name", "website", "host", "ref")


def search_hits(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Hits of all blocks in order, one a URL without fragment, final slash and case."""
    e = _parsed(rows, payload, SEARCH)
    both = F.concat(*[F.coalesce(f"__p.{b}", F.array().cast("array<struct<title string, link string, snippet string>>")) for b in ("organic", "ads")])
    hits = e.select(F.posexplode(both).alias("place", "h")).select("place", "h.*").filter("link != ''")
    key = F.lower(F.regexp_replace(F.regexp_replace("link", "#.*$", ""), "/+$", ""))
    return hits.withColumn("key", key).groupBy("key").agg(F.min(F.struct("place", "title", "link", "snippet")).alias("h")).select("h.*")


def products(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Products with a name; the category is the type, else the first tag, else Uncategorized."""
    e = _parsed(rows, payload, PRODUCTS).select(F.explode("__p.products").alias("p")).select("p.*").filter("trim(title) != ''")
    category = F.coalesce(F.when(F.trim("product_type") != "", F.trim("product_type")), F.try_element_at("tags", F.lit(1)), F.lit("Uncategorized"))
    return e.select(F.substring(text.clean(F.col("title")), 1, 90).alias("name"), F.substring(category, 1, 80).alias("category"), F.substring("handle", 1, 180).alias("handle"))


def sitemap(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Locations of sitemaps, and whether each leads to a further sitemap."""
    index = F.col(xml).contains("<sitemapindex")
    return rows.select(F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"), index.alias("is_sitemap")).distinct()


def robots(rows: DataFrame, body: str = "body") -> DataFrame:
    """Sitemap lines of robots.txt files."""
    return rows.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("sitemap")).distinct()


def rss(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of RSS feeds."""
    items = rows.select(F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("place", "item"))
    part = lambda t: text.clean(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{t}>(.*?)</{t}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    return items.select("place", part("title").alias("title"), part("link").alias("link"), part("description").alias("snippet"))


def sheet(rows: DataFrame, header: dict[str, tuple[str, ...]]) -> DataFrame:
    """Sheet rows by header name with alternatives; rows without a name go, the fit is a whole number or 0."""
    have = {c.strip().lower(): c for c in rows.columns}
    pick = {name: next((F.trim(F.col(f"`{have[a]}`").cast("string")) for a in (name, *others) if a in have), F.lit(None).cast("string")) for name, others in header.items()}
    out = rows.select(*[c.alias(n) for n, c in pick.items()])
    if "fit" in header:
        out = out.withColumn("fit", F.coalesce(F.expr("try_cast(try_cast(fit as double) as int)"), F.lit(0)))
    return out.filter(F.coalesce("name", F.lit("")) != "") if "name" in header else out
