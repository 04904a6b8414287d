"""Queries over crawled pages: hosts, sites, kinds, links and repeated listings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import contact, html, text, url
from leadloom.operators import dedup, series
from leadloom.sources.tables import read

#: Hosts that the harness treats as blocked, by suffix.
BLOCKED = ("spam-farm.example.com", "cheap-pills.example.net", "spam-farm.example.org", "cheap-pills.example.com")


def hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", url.host(F.col("url")).alias("host"))


def host_first_page(spark, sf_dir):
    """The first page of each host, and how many it has."""
    return hosted(spark, sf_dir).groupBy("host").agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


def registrable_counts(spark, sf_dir):
    """Pages and hosts by registrable domain."""
    return hosted(spark, sf_dir).groupBy(url.registrable(F.col("host")).alias("domain")).agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


def blocklist_antijoin(spark, sf_dir):
    """Pages on hosts that are not, and do not end with, a blocked one."""
    return hosted(spark, sf_dir).filter(~url.host_in(F.col("host"), BLOCKED)).select("page_id", "host")


def blocklist_semijoin(spark, sf_dir):
    """Pages on blocked hosts."""
    return hosted(spark, sf_dir).filter(url.host_in(F.col("host"), BLOCKED)).select("page_id", "host")


def company_names(spark, sf_dir):
    """A company name for each site."""
    return hosted(spark, sf_dir).select(url.site(F.col("host")).alias("site")).distinct().select("site", url.company_name(F.col("site")).alias("name"))


def url_categories(spark, sf_dir):
    """Pages by the category that the path names, and whether the path looks like an article."""
    pages = read(spark, sf_dir, "pages").select(url.category(F.col("url")).alias("category"), url.article_path(F.col("url")).alias("article"))
    return pages.groupBy("category", "article").agg(F.count("*").alias("pages"))


def on_topic(spark, sf_dir):
    """Listings (pages of one host) in which at least three tenths name a topic stem; off-topic listings go as a whole."""
    title = F.lower(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
    pages = read(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"), F.regexp_like(title, F.lit("the|and|der|des")).alias("hit"))
    # counts by host, combined before their shuffle, joined back to the hits: no task holds a whole host
    listing = pages.groupBy(F.col("host").alias("listing")).agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.count("*").alias("pages"))
    listing = listing.filter(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("pages") * 3 / F.lit(10))))
    return pages.filter("hit").join(listing, F.col("host").eqNullSafe(F.col("listing")), "left_semi").select("page_id", "host")


def page_fingerprints(spark, sf_dir):
    """Batches of ten pages with the fingerprint of their sites, and whether it repeats the batch before."""
    pages = hosted(spark, sf_dir).select((F.floor(F.col("page_id") / 10)).alias("batch"), url.site(F.col("host")).alias("site"), (F.floor(F.col("page_id") / 50)).alias("intent"))
    prints = pages.groupBy("intent", "batch").agg(text.fingerprint(F.collect_set("site")).alias("fingerprint"), F.countDistinct("site").alias("sites"))
    return series.repeats_previous(prints, ["intent"], "fingerprint", "batch")


def company_memory(spark, sf_dir):
    """Two batches of pages merged into one memory of sites: first and last page, spellings of the host, and the batch that opened it."""
    pages = hosted(spark, sf_dir).select("page_id", "host", url.site(F.col("host")).alias("site"), F.when(F.col("page_id") % 2 == 0, 1).otherwise(2).alias("batch"))
    memory = pages.groupBy("site").agg(F.min("page_id").alias("first_seen"), F.max("page_id").alias("last_seen"), F.count("*").alias("touches"), F.min("batch").alias("opened_by"))
    hosts = dedup.ordered_distinct(pages, ["site"], "host", F.col("page_id"), cap=3)
    return memory.join(hosts, "site").select("site", "first_seen", "last_seen", "touches", "opened_by", F.array_join("values", ",").alias("hosts"))


def query_parameters(spark, sf_dir):
    """Pages by reference parameter, and the highest page number asked for."""
    page = F.regexp_extract("url", r"[?&]page=([0-9]+)", 1)
    rows = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"[?&]ref=([^&#]*)", 1).alias("ref"), F.try_to_number(page, F.lit("999999")).cast("long").alias("page"))
    return rows.groupBy("ref").agg(F.count("*").alias("pages"), F.max("page").alias("last_page"))


def next_pages(spark, sf_dir):
    """The URL of the listing page after each page that has a page number."""
    n = F.regexp_extract("url", r"[?&]page=([0-9]+)", 1)
    rows = read(spark, sf_dir, "pages").filter(n != "").select("page_id", "url", (n.cast("long") + 1).alias("next"))
    return rows.select("page_id", F.concat(F.regexp_extract("url", r"^(.*[?&]page=)", 1), F.col("next"), F.regexp_extract("url", r"[?&]page=[0-9]+(.*)$", 1)).alias("next_url"))


def titles(spark, sf_dir):
    """Title, its word count and the number of links of each page."""
    rows = read(spark, sf_dir, "pages").select("page_id", text.clean(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"), (F.regexp_count("html", F.lit("<a href="))).cast("long").alias("links"))
    return rows.select("page_id", "title", F.size(F.filter(F.split("title", " "), lambda w: w != "")).cast("long").alias("words"), "links")


def directory_links(spark, sf_dir):
    """Link targets of pages with how many pages have them, navigation included; the twenty most frequent."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(links)).alias("link"))
    return rows.groupBy("link").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "link").limit(20)


def directory_companies(spark, sf_dir):
    """A row for each page and company host that it links to, up to twenty of a page in its order."""
    links = html.company_links(F.col("html"), F.col("url"), (*BLOCKED, *url.SOCIAL_HOSTS))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("l")).select("page_id", "l.place", "l.host", "l.url")


def html_text(spark, sf_dir):
    """Visible text of each page: lines, characters, and whether scripts would have to fill it."""
    rows = read(spark, sf_dir, "pages").select("page_id", html.text_of(F.col("html")).alias("t"), html.is_shell(F.col("html")).alias("shell"))
    return rows.select("page_id", F.size(F.split("t", "\n")).cast("long").alias("lines"), F.length("t").cast("long").alias("chars"), "shell")


def html_contacts(spark, sf_dir):
    """Addresses on pages, ranked by where they stand and whose they are."""
    rows = read(spark, sf_dir, "pages").select("page_id", url.site(url.host(F.col("url"))).alias("site"), "url", "html")
    page = F.when(url.contact_path(F.col("url")), contact.PAGE_CONTACT).otherwise(contact.PAGE_FOOTER)
    hits = rows.select("page_id", "site", page.alias("page"), F.explode(html.contact_hits(F.col("html"))).alias("h")).select("page_id", "site", "page", "h.email", "h.source")
    return contact.ranked_hits(hits, ["page_id"])


def host_countries(spark, sf_dir):
    """Sites by the country that their last label names, and whether they are social networks."""
    sites = hosted(spark, sf_dir).select("host").distinct()
    return sites.groupBy(F.coalesce(url.country(F.col("host")), F.lit("")).alias("country"), url.is_social(F.col("host")).alias("social")).agg(F.count("*").alias("hosts"))


QUERIES = {
    "q_html_text": html_text, "q_html_contacts": html_contacts, "q_host_countries": host_countries,
    "q_host_first_page": host_first_page, "q_registrable_counts": registrable_counts, "q_blocklist_antijoin": blocklist_antijoin, "q_blocklist_semijoin": blocklist_semijoin,
    "q_company_name_from_host": company_names, "q_url_path_category": url_categories, "q_on_topic_page_filter": on_topic, "q_page_fingerprint_repeat": page_fingerprints,
    "q_company_memory_merge": company_memory, "q_query_parameters": query_parameters, "q_next_page_url": next_pages, "q_page_titles": titles, "q_directory_links": directory_links,
    "q_directory_companies": directory_companies,
}

HOST = r"coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '')"
SITE = r"regexp_replace(host, '^(www|m|blog)\.', '')"
BLOCK = " OR ".join(f"host = '{b}' OR host LIKE '%.{b}'" for b in BLOCKED)
H = f"WITH h AS (SELECT page_id, url, html, {HOST} AS host FROM pages)"

COUNTRY = "CASE split_part(host, '.', -1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in url.COUNTRY_LABELS.items()) + " ELSE '' END"
SOCIAL = "(" + " OR ".join(f"host = '{x}' OR host LIKE '%.{x}'" for x in url.SOCIAL_HOSTS) + ")"

ORACLES = {
    "q_host_countries": f"{H}, s AS (SELECT DISTINCT host FROM h) SELECT {COUNTRY} AS country, {SOCIAL} AS social, count(*) AS hosts FROM s GROUP BY 1, 2",
    "q_host_first_page": f"{H} SELECT host, arg_min(url, page_id) AS url, min(page_id) AS page_id, count(*) AS pages FROM h GROUP BY host",
    "q_registrable_counts": rf"{H} SELECT array_to_string(split(host, '.')[-2:], '.') AS domain, count(*) AS pages, count(DISTINCT host) AS hosts FROM h GROUP BY 1",
    "q_blocklist_antijoin": f"{H} SELECT page_id, host FROM h WHERE NOT ({BLOCK})",
    "q_blocklist_semijoin": f"{H} SELECT page_id, host FROM h WHERE {BLOCK}",
    "q_company_name_from_host": rf"""{H}, s AS (SELECT DISTINCT {SITE} AS site FROM h), l AS (SELECT site, split_part(site, '.', 1) AS label FROM s)
SELECT site, array_to_string(list_transform(split(trim(regexp_replace(label, '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM l""",
    "q_url_path_category": r"""WITH p AS (SELECT split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/') AS parts FROM pages),
q AS (SELECT coalesce(parts[2], '') AS seg, parts FROM p)
SELECT CASE WHEN seg IN ('', 'product-category') THEN '' ELSE replace(lower(seg), 'and', '&') END AS category,
  len(list_filter(parts, lambda x: x <> '')) >= 3 AND length(array_to_string(parts, '/')) > 24 OR regexp_matches(array_to_string(parts, '/'), '/(blog|news|article|press)/') AS article,
  count(*) AS pages FROM q GROUP BY 1, 2""",
    "q_on_topic_page_filter": rf"""{H}, t AS (SELECT page_id, host, regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'the|and|der|des') AS hit FROM h),
k AS (SELECT *, sum(hit::INT) OVER (PARTITION BY host) >= greatest(1, count(*) OVER (PARTITION BY host) * 3 // 10) AS kept FROM t)
SELECT page_id, host FROM k WHERE hit AND kept""",
    "q_page_fingerprint_repeat": rf"""{H}, b AS (SELECT page_id // 10 AS batch, page_id // 50 AS intent, {SITE} AS site FROM h),
f AS (SELECT intent, batch, sha1(array_to_string(list_sort(list_distinct(list(site))), '|')) AS fingerprint, count(DISTINCT site) AS sites FROM b GROUP BY ALL)
SELECT *, coalesce(lag(fingerprint) OVER (PARTITION BY intent ORDER BY batch) = fingerprint, false) AS repeats FROM f""",
    "q_company_memory_merge": rf"""{H}, s AS (SELECT page_id, host, {SITE} AS site, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM h),
d AS (SELECT site, host, min(page_id) AS place FROM s GROUP BY ALL), l AS (SELECT site, array_to_string((list(host ORDER BY place))[1:3], ',') AS hosts FROM d GROUP BY site)
SELECT site, min(page_id) AS first_seen, max(page_id) AS last_seen, count(*) AS touches, min(batch) AS opened_by, any_value(l.hosts) AS hosts FROM s JOIN l USING (site) GROUP BY site""",
    "q_query_parameters": r"SELECT regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref, count(*) AS pages, max(try_cast(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT)) AS last_page FROM pages GROUP BY 1",
    "q_next_page_url": r"""SELECT page_id, regexp_extract(url, '^(.*[?&]page=)', 1) || CAST(CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) + 1 AS VARCHAR) || regexp_extract(url, '[?&]page=[0-9]+(.*)$', 1) AS next_url
FROM pages WHERE regexp_extract(url, '[?&]page=([0-9]+)', 1) <> ''""",
    "q_page_titles": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \t\r\n\f\x0B]+', ' ', 'g')) AS title, (length(html) - length(replace(html, '<a href=', ''))) // 8 AS links FROM pages)
SELECT page_id, title, len(list_filter(split(title, ' '), lambda w: w <> '')) AS words, links FROM t""",
    "q_directory_links": r"""WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS link FROM pages)
SELECT link, count(*) AS pages FROM l GROUP BY link ORDER BY pages DESC, link LIMIT 20""",
}
