"""Queries that read listings out of pages: raw pages as they are, and result pages that suppliers' parts are put into.

_CARD and _PAGE are plain SQL, the same for Spark and for the SQL beside each query.
"""

from pyspark.sql import functions as F

from leadloom.operators import crawl, linked, markup
from leadloom.sources.tables import read

_CARD = """CASE l_partkey % 4
    WHEN 0 THEN '<div class="result big"><h2> ' || p_name || ' &amp; co <b>' || p_type || '</b></h2><a href="#top">up</a><p>by <a href=''https://p' || l_partkey || '.example/a?b=1&amp;c=2''>site</a></div>'
    WHEN 1 THEN '<div class="result"><div class="in"><a class=x href=/part/' || l_partkey || '>' || p_name || '<br>' || p_brand || '</a></div><!-- <a href="/no">no</a> --></div>'
    WHEN 2 THEN '<DIV CLASS="result"><h3>' || p_type || '</h3><script>var a = "<a href=x>";</script></DIV>'
    ELSE '<div class="ad"><a href="/ad' || l_partkey || '">ad</a></div>' END"""
_PAGE = """'<!DOCTYPE html><body><nav><a href="/">Home</a></nav>' || cards || CASE s_suppkey % 5
    WHEN 0 THEN '<a rel="next" href="?page=2">on</a>'
    WHEN 1 THEN '<a href="?p=3&amp;q=1"> Next page </a>'
    WHEN 2 THEN '<form><input type="hidden" name="s" value="10"><input type="submit" value="Next"></form>'
    WHEN 3 THEN '<a href="?page=9">9</a>' ELSE '' END || '</body>'"""
_ITEM = """CASE l_partkey % 4
    WHEN 0 THEN '{"@type": "Product", "name": "' || p_name || '", "url": "/p/' || l_partkey || '", "offers": {"price": ' || p_size || '}, "image": ["a' || l_partkey || '.png"]}'
    WHEN 1 THEN '{"@type": "ListItem", "item": {"@type": ["Thing", "product"], "name": " ' || p_name || '", "@id": "#' || l_partkey || '", "offers": [{"price": "' || p_size || '"}], "image": {"url": "b.png"}}}'
    WHEN 2 THEN '{"@type": "Product", "name": "' || p_type || '"}'
    ELSE '{"@type": "Person", "name": "' || p_name || '", "team": [{"lead": {"email": "mailto:P' || l_partkey || '@Shop.com"}}]}' END"""
_LINKED = """'<script type="application/ld+json">{"@graph": [{"@type": "ItemList", "itemListElement": [' || cards || ']}, {"contact": {"email": "info@shop' || s_suppkey || '.com"}}]}</script><script type="application/ld+json">{"broken</script>'"""
RESULTS = [("article", "hit"), ("div", "result"), ("li", None)]


def result_pages(spark, sf_dir):
    """A page for each supplier: a card for each part that it delivers, in order of parts."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    each = lines.select("l_suppkey", "l_partkey", F.expr(_CARD).alias("card"))
    joined = each.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "card"))), lambda x: x["card"]), "").alias("cards"))
    return joined.select("s_suppkey", F.expr(_PAGE).alias("html"))


def linked_pages(spark, sf_dir):
    """A page of linked data for each supplier: an entry for each part that it delivers."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    each = lines.select("l_suppkey", "l_partkey", F.expr(_ITEM).alias("card"))
    joined = each.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "card"))), lambda x: x["card"]), ", ").alias("cards"))
    return joined.select("s_suppkey", F.expr(_LINKED).alias("html"))


def linked_products(spark, sf_dir):
    """Products in each page's linked data."""
    rows = linked.nodes(linked.blocks(linked_pages(spark, sf_dir), "s_suppkey", "html"), "s_suppkey", linked.is_product)
    return linked.products(rows, "s_suppkey").select("s_suppkey", "name", "link", "price", "image")


def linked_emails(spark, sf_dir):
    """Addresses in each page's linked data."""
    return linked.emails(linked.nodes(linked.blocks(linked_pages(spark, sf_dir), "s_suppkey", "html"), "s_suppkey", linked.is_email), "s_suppkey")


def result_hits(spark, sf_dir):
    """Hits of each result page in order."""
    return markup.listing(result_pages(spark, sf_dir), "s_suppkey", "html", RESULTS).select("s_suppkey", "place", "link", "title")


def result_next(spark, sf_dir):
    """Whether each result page has a next one, and where."""
    return markup.next_page(result_pages(spark, sf_dir), "s_suppkey", "html")


def page_cards(spark, sf_dir):
    """List items of raw pages with a name that may be a company's."""
    found = markup.listing(read(spark, sf_dir, "pages"), "page_id", "html", [("div", "exhibitor"), ("li", None)])
    return markup.exhibitors(found).select("page_id", "place", "link", "title")


def page_elements(spark, sf_dir):
    """Elements of raw pages by name: how many, and how many tokens they hold."""
    rows = markup.tokens(read(spark, sf_dir, "pages"), "page_id", "html")
    return markup.elements(rows, "page_id").groupBy("page_id", "name").agg(F.count("*").alias("n"), F.count(F.when(F.col("end") > F.col("at"), 1)).alias("n_holding"))


def listing_crawl(spark, sf_dir):
    """A crawl over customers as pages of their nations' listings: each leads to three further ones and back to one before; accounts in credit are finds."""
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer")
    pages = rows.select(key.cast("string").alias("url"), F.concat(F.lit("nation "), "c_nationkey").alias("branch"), (F.col("c_acctbal") > 4000).cast("int").alias("found"))
    links = rows.select(key.cast("string").alias("url"), F.posexplode(F.array(key * 3 + 1, key * 3 + 2, key * 3 + 3, F.floor(key / 2))).alias("place", "target")).withColumn("target", F.col("target").cast("string"))
    seeds = rows.filter("c_custkey < 4").select(key.cast("string").alias("url"), key.alias("place"))  # where the crawl starts
    return crawl.crawled(pages, links, seeds)


QUERIES = {"q_listing_crawl": listing_crawl, "q_result_hits": result_hits, "q_result_next": result_next, "q_page_cards": page_cards, "q_page_elements": page_elements, "q_linked_products": linked_products, "q_linked_emails": linked_emails}

_LINES = "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey"
ORACLES = {
    # from the tables, not from the pages
    "q_result_hits": f"""WITH c AS (SELECT l_suppkey, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'https://p' || l_partkey || '.example/a?b=1&c=2' WHEN 1 THEN '/part/' || l_partkey ELSE '' END AS link,
    CASE l_partkey % 4 WHEN 0 THEN p_name || ' & co ' || p_type WHEN 1 THEN p_name || ' ' || p_brand ELSE p_type END AS title FROM {_LINES} WHERE l_partkey % 4 < 3),
f AS (SELECT l_suppkey, min(l_partkey) AS l_partkey FROM c GROUP BY l_suppkey, CASE WHEN link = '' THEN lower(title) ELSE link END)
SELECT l_suppkey AS s_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey)::int AS place, link, title FROM f JOIN c USING (l_suppkey, l_partkey)""",
    "q_result_next": "SELECT DISTINCT l_suppkey AS s_suppkey, l_suppkey % 5 < 3 AS has_next, CASE l_suppkey % 5 WHEN 0 THEN '?page=2' WHEN 1 THEN '?p=3&q=1' ELSE '' END AS next_url FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)",
    "q_page_cards": rf"""WITH l AS (SELECT page_id, unnest(items) AS item, unnest(range(len(items))) AS spot FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS items FROM pages)),
c AS (SELECT page_id, spot, regexp_extract(item, 'href="([^"]*)"', 1) AS link, trim(regexp_extract(item, '(?s)<a[^>]*>(.*?)</a>', 1)) AS title FROM l),
f AS (SELECT page_id, min(spot) AS spot FROM c WHERE link != '' OR title != '' GROUP BY page_id, CASE WHEN link != '' THEN 'l' || link ELSE 't' || lower(title) END),
p AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY spot)::int AS place, link, title FROM f JOIN c USING (page_id, spot))
SELECT * FROM p WHERE length(title) BETWEEN 3 AND 70 AND regexp_matches(title, '\p{{L}}') AND lower(title) NOT IN ({", ".join(f"'{x}'" for x in markup.NO_NAMES)})""",
    "q_page_elements": r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(script|style)\b[^>]*>).*?</(script|style)\s*>', '\1', 'g'), '<([a-z][a-z0-9]*)', 1)) AS name FROM pages)
SELECT page_id, name, count(*) AS n, count(*) FILTER (name NOT IN ('meta', 'br', 'img', 'script', 'style', 'link', 'input', 'hr')) AS n_holding FROM t GROUP BY ALL""",
    "q_linked_products": f"""WITH c AS (SELECT l_suppkey AS s_suppkey, l_partkey, CASE l_partkey % 4 WHEN 2 THEN p_type ELSE p_name END AS name, CASE l_partkey % 4 WHEN 0 THEN '/p/' || l_partkey WHEN 1 THEN '#' || l_partkey ELSE '' END AS link,
    CASE WHEN l_partkey % 4 < 2 THEN p_size::varchar ELSE '' END AS price, CASE l_partkey % 4 WHEN 0 THEN 'a' || l_partkey || '.png' WHEN 1 THEN 'b.png' ELSE '' END AS image FROM {_LINES} WHERE l_partkey % 4 < 3)
SELECT s_suppkey, name, link, price, image FROM c QUALIFY row_number() OVER (PARTITION BY s_suppkey, CASE WHEN link = '' THEN lower(name) ELSE link END ORDER BY l_partkey) = 1""",
    "q_linked_emails": f"SELECT DISTINCT l_suppkey AS s_suppkey, 'p' || l_partkey || '@shop.com' AS email FROM {_LINES} WHERE l_partkey % 4 = 3 UNION SELECT l_suppkey, 'info@shop' || l_suppkey || '.com' FROM {_LINES}",
}
