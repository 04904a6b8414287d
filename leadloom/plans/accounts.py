"""Queries that qualify accounts: customers as accounts, their sites put together from orders, profiles from suppliers.

_SAID, _FACTS and _PROFILE are plain SQL, the same for Spark and for the SQL beside each query.
"""

from pyspark.sql import functions as F

from leadloom.functions import scoring
from leadloom.operators import overlap, ranges
from leadloom.operators import qualifying as Q
from leadloom.plans.leads import companies
from leadloom.sources.tables import read

_SAID = """CASE o_orderkey % 13
    WHEN 0 THEN 'We are a leading manufacturer of ' || p_name || '.'
    WHEN 1 THEN 'Wholesale and bulk order of each ' || p_name || '.'
    WHEN 2 THEN 'We sell every ' || p_name || ' there is.'
    WHEN 3 THEN 'Looking for a supplier of ' || p_name || ' in ' || CAST(o_orderkey AS STRING) || '.'
    WHEN 4 THEN 'See our New collection\n of ' || p_name || '.'
    WHEN 5 THEN 'Add to cart: ' || p_name || '.'
    WHEN 6 THEN 'Start free on our platform.'
    WHEN 7 THEN 'Opening a second store in 2025.'
    WHEN 8 THEN 'About us: a machinery shop and importers.'
    ELSE 'Fine ' || split_part(p_name, ' ', 2) || 's for all.' END"""
_FACTS = """'A ' || lower(c_mktsegment) || ' club of ' || n_name AS snippet, CASE c_custkey % 4 WHEN 0 THEN 'https://a.example/products/1' WHEN 1 THEN 'https://a.example/' END AS url,
    CASE c_custkey % 3 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN n_name END AS location, CASE WHEN c_custkey % 7 = 0 THEN 'maps' ELSE 'web' END AS source,
    CASE WHEN c_custkey % 2 = 0 THEN '1' END AS phone, CASE WHEN c_custkey % 8 != 0 THEN 'https://a.example/' END AS website, c_custkey % 3 = 0 AS related"""
_PROFILE = """CASE s_suppkey % 5 WHEN 0 THEN 'oem' WHEN 1 THEN 'wholesale' WHEN 2 THEN 'saas' WHEN 3 THEN 'local' END AS motion, s_suppkey % 4 = 0 AS hunting,
    CASE s_suppkey % 3 WHEN 0 THEN {a}'wholesale distributors', 'machinery shops'{b} WHEN 1 THEN {a}'building clubs'{b} ELSE {a}'automobile importers', 'household clubs'{b} END AS buyers,
    CASE WHEN s_suppkey % 2 = 0 THEN {a}lower(n_name), lower(r_name){b} ELSE {a}{b} END AS places,
    CASE WHEN s_suppkey % 4 = 3 THEN {a}split_part(first_part, ' ', 2), 'gear'{b} ELSE {a}first_part, next_part{b} END AS categories"""
_EVERY = 10


def accounts(spark, sf_dir):
    """Each customer with its site's text and the profile of the supplier that asks about it."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    said = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").join(lines, "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr(_SAID).alias("said"))
    sites = said.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "said"))), lambda x: x["said"]), " ").alias("site"))
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # a profile for each of the first suppliers: the harness's bound on profiles, not on accounts
    profiles = read(spark, sf_dir, "supplier").filter(F.col("s_suppkey") < _EVERY).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    profiles = profiles.join(part.select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("first_part")), "s_suppkey").join(part.select((F.col("p_partkey") - 50).alias("s_suppkey"), F.col("p_name").alias("next_part")), "s_suppkey")
    profiles = profiles.selectExpr("s_suppkey", *_split(_PROFILE.format(a="array(", b=")")))
    each = companies(spark, sf_dir).join(sites, "c_custkey", "left")
    each = each.selectExpr("c_custkey", "c_name AS name", *_split(_FACTS), "CASE WHEN c_custkey % 6 != 0 THEN site END AS site")
    # rules take far longer than their rows are large, so they are dealt by number: partitions by size would leave them to a few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return each.join(profiles, F.col("c_custkey") % _EVERY == F.col("s_suppkey")).repartition(tasks, "c_custkey", "s_suppkey")


def _split(columns: str) -> list[str]:
    """A list of SQL columns, cut at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def account_levels(spark, sf_dir):
    """Customer, motion, offer fit and intent of each account, fit and priority, and the evidence in order."""
    found = Q.qualified(accounts(spark, sf_dir), "c_custkey")
    said = F.transform("evidence", lambda e: F.concat_ws(":", e["claim"], e["quote"]))
    return found.select("c_custkey", "icp", "motion", "offer", "intent", "fit", "priority", "confidence", "persist", F.array_join(said, "|").alias("evidence"))


def account_scores(spark, sf_dir):
    """The fit score of each account, fed by its levels, and its parts."""
    return Q.qualified(accounts(spark, sf_dir), "c_custkey").select("c_custkey", "score.*")


def catalog_matches(spark, sf_dir):
    """The four best parts of a supplier's catalog for each account by its site."""
    each = accounts(spark, sf_dir).select("c_custkey", "s_suppkey", F.col("site").alias("text"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    parts = lines.join(read(spark, sf_dir, "part"), "p_partkey").select("s_suppkey", "p_partkey", overlap.long_words(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    products = ranges.positions(parts, ["s_suppkey"], ["p_partkey"], "place")
    return overlap.catalog_matches(each, "c_custkey", products, "s_suppkey", "place")


QUERIES = {"q_account_levels": account_levels, "q_account_scores": account_scores, "q_catalog_matches": catalog_matches}

_text = lambda s: "'" + s.replace("'", "''") + "'"
_has = lambda column, pattern: f"regexp_matches({column}, {_text('(?i)' + pattern)})"
_quote = lambda pattern: rf"trim(regexp_replace(regexp_extract(text, {_text('(?is).{0,40}(?:' + pattern + ').{0,140}')}), '[ \t\r\n\f\v]+', ' ', 'g'))"
_tokens = lambda x, n=3: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > {n})"
_hits = lambda column: f"list_filter({column}, lambda b: len({_tokens('b')}) > 0 AND (contains(low, lower(b)) OR len(list_filter({_tokens('b')}, lambda t: contains(low, t))) >= least(2, len({_tokens('b')}))))"
_broad = "[" + ", ".join(map(_text, Q.BROAD)) + "]"
_level = lambda claim, level, quote: f"{{'level': {level}, 'said': [{_text(claim + ':')} || left(coalesce({quote}, ''), 200)]}}"
_bare = lambda level: f"{{'level': {_text(level)}, 'said': []::varchar[]}}"
_site = lambda home, listing: f"CASE WHEN home THEN '{home}' ELSE '{listing}' END"
_points = lambda c, table: f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " ELSE 0::DOUBLE END)"
_motion_case = lambda name, level, quote: f"WHEN motion = '{name}' AND ({_has('text', Q.MOTIONS[name])} OR {_has('text', Q.BUYER)}) THEN {_level('motion', level, quote)}"
_either = lambda name: f"coalesce(nullif({_quote(Q.MOTIONS[name])}, ''), {_quote(Q.BUYER)})"
_intents = " ".join(f"WHEN {_quote(r.pattern)} != '' THEN {_level('intent', _text(r.level), _quote(r.pattern))}" for r in Q.INTENT)

_QUALIFIED = rf"""WITH w AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
lines AS (SELECT l_orderkey AS o_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1),
sites AS (SELECT o_custkey, string_agg({_SAID.replace("STRING", "VARCHAR").replace(chr(92) + "n", chr(10))}, ' ' ORDER BY o_orderkey) AS site FROM orders JOIN lines USING (o_orderkey) JOIN part USING (p_partkey) WHERE o_totalprice > 300000 GROUP BY 1),
profiles AS (SELECT s_suppkey, {_PROFILE.format(a="[", b="]").replace("ELSE [] END", "ELSE []::varchar[] END")} FROM supplier JOIN w ON s_nationkey = n_nationkey JOIN (SELECT p_partkey AS s_suppkey, p_name AS first_part FROM part) USING (s_suppkey) JOIN (SELECT p_partkey - 50 AS s_suppkey, p_name AS next_part FROM part) USING (s_suppkey) WHERE s_suppkey < {_EVERY}),
a0 AS (SELECT c_custkey, c_name AS name, {_FACTS}, CASE WHEN c_custkey % 6 != 0 THEN site END AS site FROM customer JOIN w ON c_nationkey = n_nationkey LEFT JOIN sites ON o_custkey = c_custkey),
a1 AS (SELECT *, coalesce(site, '') != '' AS home, concat_ws(chr(10), name, snippet, coalesce(site, '')) AS text FROM a0 JOIN profiles ON c_custkey % {_EVERY} = s_suppkey),
a2 AS (SELECT *, lower(text) AS low, lower(concat_ws(' ', coalesce(location, ''), text)) AS place_text, lower(concat_ws(' ', coalesce(location, ''), coalesce(site, ''))) AS whole FROM a1),
a3 AS (SELECT *, {_hits("buyers")} AS buyer_hits, {_hits("categories")} AS category_hits, len(list_filter(buyers, lambda b: regexp_matches(lower(b), '{Q.CHANNEL_BUYER}'))) > 0 AS channel,
    len(places) = 0 OR len(list_filter(places, lambda p: contains(place_text, p))) > 0 AS geo, {_has("text", Q.MAKER)} AND hunting AS maker,
    coalesce(regexp_matches(lower(url), '/(products?|collections?|cart)(/|$|\?)'), false) OR {_has("text", Q.RETAIL)} AS retail, list_filter(categories, lambda c: len(string_split(c, ' ')) >= 2 OR NOT list_contains({_broad}, lower(c))) AS specific FROM a2),
a4 AS (SELECT *, list_filter(list_distinct(flatten(list_transform(specific, lambda c: {_tokens("c")}))), lambda t: NOT list_contains({_broad}, t) AND regexp_matches(low, '\b' || t || '\b')) AS words_there,
    list_filter(specific, lambda c: len(string_split(c, ' ')) >= 2 AND contains(low, lower(c))) AS phrases_there, {_hits("specific")} AS specific_hits FROM a3),
a5 AS (SELECT *, len(phrases_there) + (len(words_there) >= 2)::int + (len(words_there) >= 4)::int + (len(specific_hits) > 0 AND len(words_there) > 0)::int AS strong, list_concat(phrases_there, specific_hits, list_transform(list_sort(list_transform(words_there, lambda t: {{'less': -length(t), 'word': t}})), lambda x: x.word))[1] AS label FROM a4),
a6 AS (SELECT *, CASE WHEN maker THEN {_level("icp", "'low'", _quote(Q.MAKER))} WHEN len(buyer_hits) > 0 AND geo THEN {_level("icp", _site("high", "medium"), "left(snippet, 160)")} WHEN len(buyer_hits) > 0 THEN {_level("icp", "'low'", "left(snippet, 160)")}
    WHEN len(category_hits) > 0 AND home AND channel AND retail AND NOT {_has("text", Q.CHANNEL)} THEN {_level("icp", "'low'", "category_hits[1]")} WHEN len(category_hits) > 0 AND home THEN {_level("icp", "'medium'", "category_hits[1]")} WHEN home THEN {_bare("low")} ELSE {_bare("unknown")} END AS icp,
    CASE WHEN motion = 'oem' AND maker THEN {_level("motion", "'low'", _quote(Q.MAKER))} {_motion_case("oem", _site("high", "medium"), _either("oem"))} {_motion_case("wholesale", _site("high", "medium"), _either("wholesale"))}
    WHEN motion = 'saas' AND {_has("text", Q.MOTIONS["saas"])} THEN {_level("motion", "'medium'", _quote(Q.MOTIONS["saas"]))} WHEN motion = 'local' AND home THEN {_bare("medium")} WHEN motion IS NULL AND {_has("text", Q.BUYER)} THEN {_bare("medium")} ELSE {_bare("unknown")} END AS drive,
    CASE WHEN NOT home THEN {_bare("unknown")} WHEN len(phrases_there) > 0 OR strong >= 2 THEN {_level("offer", "'high'", "label")} WHEN len(specific_hits) > 0 OR len(words_there) >= 2 THEN {_level("offer", "'medium'", "label")} WHEN len(words_there) > 0 THEN {_level("offer", "'low'", "label")} ELSE {_bare("unknown")} END AS offer,
    CASE WHEN NOT home THEN {_bare("none")} {_intents} ELSE {_bare("none")} END AS intent FROM a5),
a7 AS (SELECT * REPLACE (icp.level AS icp, offer.level AS offer, intent.level AS intent), drive.level AS m, list_concat(icp.said, drive.said, offer.said, intent.said) AS said, len(icp.said) + len(drive.said) + len(offer.said) AS claims,
    home AND len(list_filter(categories, lambda c: len(string_split(c, ' ')) >= 2)) > 0 AS hunt FROM a6),
a8 AS (SELECT *, CASE WHEN icp = 'unknown' OR m = 'unknown' THEN CASE WHEN 'low' IN (icp, m) THEN 'low' ELSE 'medium' END WHEN 'low' IN (icp, m) THEN 'low' WHEN 'medium' IN (icp, m) THEN 'medium' ELSE 'high' END AS least, rtrim(lower(buyers[1]), 's') AS wanted FROM a7),
a9 AS (SELECT *, CASE WHEN 'low' IN (icp, m) THEN 'low' WHEN hunt AND offer = 'low' THEN 'low' WHEN hunt AND offer = 'unknown' AND (NOT related OR (icp = 'unknown' AND NOT channel)) THEN 'low' WHEN offer = 'low' AND home AND least = 'high' THEN 'medium' ELSE least END AS fit FROM a8),
b AS (SELECT *, CASE WHEN fit = 'high' AND intent = 'high' THEN 'priority' WHEN fit = 'high' THEN 'nurture' WHEN fit = 'medium' AND (intent = 'high' OR (home AND regexp_matches(low, '\b' || wanted || 's?\b')) OR location IS NOT NULL OR source = 'maps') THEN 'review' WHEN fit = 'medium' THEN 'low' ELSE 'reject' END AS priority,
    fit IN ('medium', 'high') AND NOT (hunt AND offer = 'low') AS sound FROM a9)"""

ORACLES = {
    "q_account_levels": rf"""{_QUALIFIED} SELECT c_custkey, icp, m AS motion, offer, intent, fit, priority, round(least(0.9::DOUBLE, CASE WHEN home THEN 0.58::DOUBLE ELSE 0.28::DOUBLE END + 0.08::DOUBLE * least(3, len(said))), 2) AS confidence,
    (priority != 'reject' AND NOT (NOT home AND icp = 'unknown' AND m = 'unknown' AND offer IN ('unknown', 'low') AND location IS NULL AND NOT regexp_matches(lower(snippet), '\b' || wanted || 's?\b'))) OR (sound AND website IS NOT NULL) OR (sound AND source = 'maps' AND phone IS NOT NULL) AS persist,
    array_to_string(said, '|') AS evidence FROM b""",
    "q_account_scores": rf"""{_QUALIFIED},
c AS (SELECT *, coalesce(location, '') AS loc, coalesce(site, '') AS page, CASE WHEN home THEN least(6, least(6, least(6, length(site) / 900.0::DOUBLE) + CASE WHEN {_has("site", Q.DEEP)} THEN 1.5 ELSE 0 END) + CASE WHEN {_has("site", Q.ABOUT)} THEN 0.8 ELSE 0 END)::DOUBLE ELSE 0::DOUBLE END AS depth FROM b),
d AS (SELECT *, {_points("icp", scoring.ICP_POINTS)} + CASE WHEN icp IN ('high', 'medium') THEN depth * 0.35::DOUBLE ELSE 0 END AS p1,
    {_points("offer", scoring.OFFER_POINTS)} + CASE WHEN offer IN ('high', 'medium') THEN least(5::DOUBLE, len(list_filter({_tokens("array_to_string(categories, ' ')")}, lambda t: contains(lower(page), t))) * 0.9::DOUBLE) ELSE 0 END AS p2,
    {_points("m", scoring.MOTION_POINTS)} + CASE WHEN m IN ('high', 'medium') THEN depth * 0.25::DOUBLE ELSE 0 END AS p3,
    CASE WHEN len(places) = 0 THEN 0::DOUBLE WHEN len(list_filter(places, lambda p: contains(whole, p))) > 0 THEN 9::DOUBLE + CASE WHEN regexp_matches(loc, ',\s*\w+') THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN length(trim(loc)) >= 16 THEN 1::DOUBLE ELSE 0 END WHEN length(trim(loc)) >= 8 THEN 1.5::DOUBLE ELSE 0 END AS p4,
    CASE WHEN length(wanted) >= 4 AND regexp_matches(whole, '\b' || wanted || 's?\b') THEN 4.5::DOUBLE + least(2.5::DOUBLE, depth * 0.4::DOUBLE) ELSE 0 END AS p5, CASE WHEN home THEN 4::DOUBLE + least(3::DOUBLE, depth * 0.5::DOUBLE) ELSE 0 END + least(5::DOUBLE, claims * 1.4::DOUBLE) AS p6,
    substr(concat_ws('|', name, coalesce(url, ''), loc, CASE WHEN home THEN 'homepage' ELSE 'serp' END, icp, offer, m, length(page)), 1, 180) AS seed FROM c),
k AS (SELECT *, CAST(list_sum(list_transform(range(1, length(seed) + 1), lambda i: i * ascii(seed[i]))) AS BIGINT) AS k FROM d),
j AS (SELECT *, (k % 71) / 10.0::DOUBLE AS j FROM k),
r AS (SELECT *, p1 + p2 + p3 + p4 + p5 + p6 + CASE WHEN k % 2 = 1 THEN j * 0.65::DOUBLE ELSE -j * 0.4::DOUBLE END AS r FROM j),
s AS (SELECT *, list_min([r, CASE WHEN NOT home THEN 51 + j * 0.15::DOUBLE END, CASE WHEN icp IN ('unknown', 'low') AND m IN ('unknown', 'low') THEN 38 + j * 0.2::DOUBLE END, CASE WHEN offer = 'low' AND home THEN 70 + j * 0.25::DOUBLE END, CASE WHEN 'low' IN (icp, m) THEN 34 + j * 0.15::DOUBLE END]) AS s FROM r)
SELECT c_custkey, round_even(greatest(0, least(99, s)), 0)::BIGINT AS total, least(25, round_even(p1 * (25 / 30.0::DOUBLE), 0)::INT) AS industry, least(20, round_even(p4 * (20 / 12.5::DOUBLE), 0)::INT) AS location, least(20, round_even(p2 * (20 / 27.0::DOUBLE), 0)::INT) AS product, least(15, round_even((p3 + p6) * (15 / 32.0::DOUBLE), 0)::INT) AS company FROM s""",
    "q_catalog_matches": rf"""{_QUALIFIED},
p AS (SELECT l_suppkey AS s_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS place, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]{{4,}}')) AS words FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey),
h AS (SELECT c_custkey, s_suppkey, place, len(list_intersect(words, regexp_extract_all(lower(coalesce(site, '')), '[a-z0-9]{{4,}}'))) AS hits, regexp_matches(coalesce(site, ''), '{overlap.DEMAND}') AS demand FROM a1 JOIN p USING (s_suppkey)),
l AS (SELECT *, CASE WHEN hits >= 2 OR (hits >= 1 AND demand) THEN 0 WHEN hits >= 1 OR demand THEN 1 ELSE 2 END AS rank FROM h)
SELECT c_custkey, s_suppkey, place, hits, ['High', 'Medium', 'Low'][rank + 1] AS level FROM l QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank, place) <= 4""",
}
