"""Queries over search lines and company texts: product, role and place of a line, place names, and where companies sit.

The lexicon comes from the tables: market segments are roles, nations are places in regions. Lines and texts are put together from
orders and customers; _LINE, _HEAD, _ORDER, _ADDRESS and _ASKED are plain SQL, the same for Spark and for the SQL beside each query.
"""

from pyspark.sql import functions as F

from leadloom.operators import dedup, intent, locating
from leadloom.plans.leads import companies
from leadloom.sources.tables import read

_LINE = """CASE o_orderkey % 8
    WHEN 0 THEN '"' || p_name || '" ' || lower(c_mktsegment) || 's in ' || n_name || ' -' || lower(r_name)
    WHEN 1 THEN p_name || ' ' || lower(c_mktsegment) || ' ' || replace(n_name, '_', ' ') || ', ' || r_name
    WHEN 2 THEN p_name || ' ' || lower(c_mktsegment) || ' shops in ' || n_name || ', ' || r_name || '.'
    WHEN 3 THEN p_name
    WHEN 4 THEN '"' || p_name || ' in ' || n_name || '" ' || c_mktsegment
    WHEN 5 THEN '  -new ' || p_name || '  ' || lower(c_mktsegment) || 's  ' || n_name || ' and ' || r_name
    WHEN 6 THEN p_name || ' household ' || lower(c_mktsegment) || ' in ' || r_name
    ELSE 'in ' || r_name END"""
_HEAD = """CASE c_custkey % 9
    WHEN 0 THEN c_name || ' is based in ' || n_name || '.'
    WHEN 1 THEN 'Headquartered in ' || replace(n_name, '_', ' ') || ', ' || c_name || ' sells parts.'
    WHEN 2 THEN c_name || ' is not based in NATION_' || CAST(c_custkey % 25 AS STRING) || '! Find us in ' || n_name || '.'
    WHEN 3 THEN c_name || ' ships to ' || n_name || '.'
    WHEN 4 THEN 'The ' || n_name || ' office of ' || c_name || ' is open.'
    WHEN 5 THEN c_name || ' sells parts.'
    WHEN 6 THEN c_name || ', of ' || r_name || '.'
    WHEN 7 THEN 'A firm of ' || n_name || ' ' || r_name || ': ' || c_name || '.'
    ELSE 'We never had a warehouse in ' || n_name || '.' END"""
_ORDER = """CASE o_orderkey % 8
    WHEN 0 THEN 'We deliver parts quickly to ' || n_name || '.'
    WHEN 1 THEN 'Serving customers in ' || n_name || ', and others.'
    WHEN 2 THEN 'Order ' || CAST(o_orderkey AS STRING) || ' went well.'
    WHEN 3 THEN 'Available in ' || r_name || '?'
    ELSE 'Ships to ' || replace(n_name, '_', ' ') || '.' END"""
_ADDRESS = """CASE c_custkey % 5
    WHEN 0 THEN CAST(c_custkey AS STRING) || ' Main Street, ' || n_name
    WHEN 1 THEN n_name
    WHEN 2 THEN n_name || ', ' || r_name END"""
_ASKED = """CASE c_custkey % 4
    WHEN 0 THEN n_name
    WHEN 1 THEN 'NATION_' || CAST((c_nationkey + 5) % 25 AS STRING)
    WHEN 2 THEN 'ASIA' END"""


def lexicon(spark, sf_dir):
    """phrase, kind, name, tier and parent: segments as roles, alone or with shops; nations, alone or with their regions, and regions as places."""
    segment = F.lower("c_mktsegment")
    forms = F.array(F.struct(segment, F.concat(segment, F.lit("s"))), F.struct(F.concat(segment, F.lit("s")), F.concat(segment, F.lit("s"))), F.struct(F.concat(segment, F.lit(" shops")), F.concat(segment, F.lit(" shops"))))
    tier = F.when(F.length("c_mktsegment") > 8, 1).otherwise(2)
    roles = read(spark, sf_dir, "customer").select("c_mktsegment").distinct().select(F.inline(forms).alias("phrase", "name"), tier.alias("tier"))
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    apart = F.replace(F.lower("n_name"), F.lit("_"), F.lit(" "))
    places = nations.select(F.explode(F.array(F.lower("n_name"), apart, F.concat_ws(" ", apart, F.lower("r_name")))).alias("phrase"), F.lit("place").alias("kind"), F.col("n_name").alias("name"), F.lit(0).alias("tier"), F.col("r_name").alias("parent"))
    regions = read(spark, sf_dir, "region").select(F.lower("r_name").alias("phrase"), F.lit("place").alias("kind"), F.col("r_name").alias("name"), F.lit(0).alias("tier"), F.lit(None).cast("string").alias("parent"))
    return roles.select("phrase", F.lit("role").alias("kind"), "name", "tier", F.lit(None).cast("string").alias("parent")).union(places).union(regions)


def query_lines(spark, sf_dir):
    """A search line for each order: a part it has, its customer's segment, nation and region."""
    parts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey")).join(read(spark, sf_dir, "part"), "p_partkey")
    orders = read(spark, sf_dir, "orders").join(parts, "o_orderkey").join(companies(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", F.expr(_LINE).alias("line"))


def query_parse(spark, sf_dir):
    """Product, role, place and the places' names of each order's search line."""
    found = intent.parsed(query_lines(spark, sf_dir), "o_orderkey", "line", lexicon(spark, sf_dir))
    return found.select("o_orderkey", "product", "role", "place", F.array_join("places", "|").alias("places"))


def aliases(spark, sf_dir):
    """All phrases for each supplier's place, its own first."""
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    place = F.when(F.col("s_suppkey") % 3 == 0, F.replace("n_name", F.lit("_"), F.lit(" "))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.col("n_name"), F.lit(" "))).otherwise(F.col("s_name"))
    suppliers = read(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("s_suppkey", place.alias("place"))
    return intent.place_aliases(suppliers, "s_suppkey", "place", lexicon(spark, sf_dir)).select("s_suppkey", F.array_join("aliases", "|").alias("aliases"))


def company_texts(spark, sf_dir):
    """Each customer's text (a sentence of its own and one for each order), address and the place that is asked for."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = read(spark, sf_dir, "orders").join(nations, F.col("o_orderkey") % 25 == F.col("n_nationkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr(_ORDER).alias("said"))
    said = orders.groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "said"))), lambda x: x["said"]).alias("said"))
    c = companies(spark, sf_dir).join(said, "c_custkey", "left")
    return c.select("c_custkey", F.concat_ws(" ", F.expr(_HEAD), F.array_join("said", " ")).alias("text"), F.expr(_ADDRESS).alias("address"), F.expr(_ASKED).alias("requested"))


def location_evidence(spark, sf_dir):
    """Each place in each customer's text, and what the words around it make of it."""
    return locating.evidence(company_texts(spark, sf_dir), "c_custkey", "text", lexicon(spark, sf_dir).filter("kind = 'place'")).select("c_custkey", "sentence", "start", "name", "claim")


def location_verdict(spark, sf_dir):
    """Whether each customer sits in the place that was asked for: verdict, reason and where it is instead."""
    return locating.verdicts(company_texts(spark, sf_dir), "c_custkey", lexicon(spark, sf_dir).filter("kind = 'place'")).drop("mentioned")


def places_mentioned(spark, sf_dir):
    """Whether the place that was asked for stands in a customer's text: null where nothing was asked for. Counted by verdict."""
    found = locating.verdicts(company_texts(spark, sf_dir), "c_custkey", lexicon(spark, sf_dir).filter("kind = 'place'"))
    return found.groupBy("mentioned", "verdict").agg(F.count("*").alias("companies"))


def hunt_queries(spark, sf_dir):
    """Searches of each supplier's hunt: its first three products, two segments as roles, its nation."""
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct().join(read(spark, sf_dir, "part"), "p_partkey")
    first = dedup.ordered_distinct(parts, ["s_suppkey"], "p_name", F.col("p_partkey"), 3)
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    roles = F.expr("CASE s_suppkey % 4 WHEN 0 THEN array('Building', ' buildings', 'machinery') WHEN 1 THEN array('household shops', '') WHEN 2 THEN array('clubs', 'Automobile') ELSE array() END")
    hunts = first.join(read(spark, sf_dir, "supplier"), "s_suppkey").join(nations, "s_nationkey").select("s_suppkey", F.col("values").alias("products"), roles.alias("roles"), F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name")).alias("location"))
    return intent.generated(hunts, "s_suppkey", lexicon(spark, sf_dir))


def precise_queries(spark, sf_dir):
    """Each order's search line parsed and written as one precise search; products that end in a noun of many parts mean many things."""
    found = intent.parsed(query_lines(spark, sf_dir), "o_orderkey", "line", lexicon(spark, sf_dir))
    nouns = read(spark, sf_dir, "part").groupBy(F.substring_index("p_name", " ", -1).alias("head")).agg(F.min("p_type").alias("kind")).filter("head < 'g'")
    heads = nouns.select("head", F.when(F.col("head") < "c", F.array(F.lower("kind"), F.lit("used"))).alias("exclude"))
    return intent.formatted(found, "o_orderkey", heads)


QUERIES = {"q_hunt_queries": hunt_queries, "q_precise_queries": precise_queries, "q_query_parse": query_parse, "q_place_aliases": aliases, "q_location_evidence": location_evidence, "q_location_verdict": location_verdict, "q_places_mentioned_tristate": places_mentioned}

_WORLD = "nation JOIN region ON n_regionkey = r_regionkey"
_COMPANIES = f"customer JOIN ({_WORLD}) ON c_nationkey = n_nationkey"
_LEXICON = f"""seg AS (SELECT DISTINCT lower(c_mktsegment) AS s, CASE WHEN length(c_mktsegment) > 8 THEN 1 ELSE 2 END AS tier FROM customer),
lex AS (SELECT s AS phrase, 'role' AS kind, s || 's' AS name, tier, NULL::varchar AS parent FROM seg UNION ALL SELECT s || 's', 'role', s || 's', tier, NULL FROM seg UNION ALL SELECT s || ' shops', 'role', s || ' shops', tier, NULL FROM seg
    UNION ALL SELECT unnest([lower(n_name), replace(lower(n_name), '_', ' '), replace(lower(n_name), '_', ' ') || ' ' || lower(r_name)]), 'place', n_name, 0, r_name FROM {_WORLD}
    UNION ALL SELECT lower(r_name), 'place', r_name, 0, NULL FROM region)"""
_GREEDY = "list_reduce(list_prepend([], list_transform(list_sort({hits}), lambda h: [h])), lambda kept, h: CASE WHEN len(kept) = 0 OR h[1].start >= kept[-1].start - kept[-1].less THEN kept || h ELSE kept END)"
_TEXTS = f"""said AS (SELECT o_custkey, string_agg({_ORDER.replace("STRING", "VARCHAR")}, ' ' ORDER BY o_orderkey) AS said FROM orders JOIN ({_WORLD}) ON o_orderkey % 25 = n_nationkey GROUP BY 1),
texts AS (SELECT c_custkey, concat_ws(' ', {_HEAD.replace("STRING", "VARCHAR")}, coalesce(said, '')) AS text, {_ADDRESS.replace("STRING", "VARCHAR")} AS address, {_ASKED.replace("STRING", "VARCHAR")} AS asked FROM {_COMPANIES} LEFT JOIN said ON o_custkey = c_custkey)"""
_CUES = ", ".join(f"('{p.replace(chr(39), chr(39) * 2)}', '{kind}')" for kind, listed in locating.CUES.items() for p in listed.split(","))


def _evidence(name: str, text: str) -> str:
    """SQL for the evidence of a column of texts: every pair of a place and a cue in a sentence is looked at in turn."""
    reach, negated, before, behind, carry = locating.REACH, locating.NEGATED, locating.BEFORE, locating.BEHIND, locating.CARRY
    near = f"p.start >= h.start AND p.start < h.start - h.less + {reach}"
    beside = "(h.start = p.start - p.less OR h.start - h.less = p.start)"
    no = f"EXISTS (FROM {name}_hits n WHERE n.c_custkey = h.c_custkey AND n.sentence = h.sentence AND n.kind = 'negation' AND n.start - n.less <= h.start AND n.start - n.less > h.start - {negated})"
    to = f"EXISTS (FROM {name}_hits t WHERE t.c_custkey = h.c_custkey AND t.sentence = h.sentence AND t.kind = 'to' AND t.start >= h.start - h.less AND t.start < h.start - h.less + {carry})"
    return rf"""{name}_s AS (SELECT c_custkey, unnest(range(len(cut))) AS sentence, unnest(cut) AS cut FROM (SELECT c_custkey, regexp_split_to_array({text}, '[.!?]+(?:\s+|$)|[\r\n]+') AS cut FROM texts)),
    {name}_w AS (SELECT c_custkey, sentence, regexp_extract_all(lower(cut), '[\p{{L}}\p{{N}}]+(?:[_&''.-][\p{{L}}\p{{N}}]+)*') AS words FROM {name}_s),
    {name}_g AS (SELECT c_custkey, sentence, start, -n AS less, array_to_string(words[start + 1:start + n], ' ') AS phrase FROM (SELECT *, unnest(range(len(words))) AS start FROM {name}_w), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE start + n <= len(words)),
    {name}_hits AS (SELECT c_custkey, sentence, start, less, kind, name, parent FROM {name}_g JOIN (SELECT phrase, kind, name, parent FROM lex WHERE kind = 'place' UNION ALL SELECT phrase, kind, NULL, NULL FROM (VALUES {_CUES}) v(phrase, kind)) USING (phrase)),
    {name}_p AS (SELECT c_custkey, sentence, unnest({_GREEDY.format(hits="list({'start': start, 'less': less, 'name': name, 'parent': parent})")}) AS p FROM {name}_hits WHERE kind = 'place' GROUP BY 1, 2),
    {name}_q AS (SELECT c_custkey, sentence, p.start AS start, p.less AS less, p.name AS name, p.parent AS parent FROM {name}_p),
    {name}_k AS (SELECT p.*, coalesce(bool_or((h.kind = 'service' OR (h.kind = 'carrying' AND {to})) AND p.start >= h.start - {before} AND p.start < h.start - h.less + {behind}), false) AS served,
        coalesce(bool_or(((h.kind = 'presence' AND {near}) OR (h.kind = 'premises' AND {beside})) AND NOT {no}), false) AS office,
        coalesce(bool_or(((h.kind = 'presence' AND {near}) OR (h.kind = 'premises' AND {beside})) AND {no}), false) AS denied
        FROM {name}_q p LEFT JOIN {name}_hits h ON h.c_custkey = p.c_custkey AND h.sentence = p.sentence AND h.kind != 'place' GROUP BY ALL),
    {name} AS (SELECT c_custkey, sentence, start, less, name, parent, CASE WHEN served THEN 'served' WHEN office THEN 'office' WHEN denied THEN 'denied' ELSE 'stated' END AS claim FROM {name}_k)"""


_VERDICTS = rf"""WITH {_LEXICON}, {_TEXTS}, {_evidence("e", "text")}, {_evidence("a", "address")},
asked AS (SELECT t.*, (SELECT min(parent) FROM lex WHERE lex.name = asked) AS asked_parent FROM texts t),
site AS (SELECT c_custkey, bool_or(claim = 'office' AND here) AS office, bool_or(claim = 'served' AND here) AS served, bool_or(sits AND here) AS sits, bool_or(here) AS named,
    arg_min({{'name': name, 'parent': parent}}, {{'p': parent IS NULL, 's': sentence, 't': start}}) FILTER (sits) AS site
    FROM (SELECT e.*, claim IN ('office', 'stated') AS sits, coalesce(name = asked, false) OR coalesce(parent = asked, false) AS here FROM e JOIN asked USING (c_custkey)) GROUP BY 1),
line AS (SELECT c_custkey, arg_min({{'name': name, 'parent': parent}}, {{'p': parent IS NULL, 's': sentence, 't': start}}) AS line FROM a JOIN asked USING (c_custkey)
    GROUP BY c_custkey, asked, address HAVING NOT (bool_and(coalesce(name = asked, false)) AND sum(-less) = len(regexp_extract_all(lower(address), '[\p{{L}}\p{{N}}]+(?:[_&''.-][\p{{L}}\p{{N}}]+)*')))),
spots AS (SELECT *, coalesce(line, site) AS spot FROM asked LEFT JOIN site USING (c_custkey) LEFT JOIN line USING (c_custkey)),
r AS (SELECT *, coalesce(spot.name = asked OR spot.parent = asked, spot.name = asked, false) AS here FROM spots),
v AS (SELECT *, CASE WHEN asked IS NULL OR coalesce(office, false) OR here THEN '' WHEN spot IS NULL THEN 'uncertain_location' WHEN spot.name = asked_parent THEN 'country_only'
    WHEN coalesce(served, false) AND NOT coalesce(sits, false) THEN 'foreign_business_serving_target_area' WHEN coalesce(spot.parent, spot.name) != coalesce(asked_parent, asked) THEN 'location_mismatch_country' ELSE 'location_mismatch_state' END AS reason FROM r),
w AS (SELECT c_custkey, CASE WHEN asked IS NOT NULL THEN coalesce(named, false) END AS mentioned, CASE WHEN reason = '' THEN 'MATCH' WHEN reason IN ('uncertain_location', 'country_only') THEN 'UNCERTAIN' ELSE 'WRONG' END AS verdict, reason,
    CASE WHEN reason NOT IN ('', 'uncertain_location', 'country_only') OR (asked IS NOT NULL AND (coalesce(office, false) OR (here AND line IS NOT NULL))) THEN 'high' WHEN reason = '' AND spot IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
    coalesce(concat_ws(', ', spot.name, spot.parent), '') AS business_location, reason IN ('foreign_business_serving_target_area', 'location_mismatch_country') AS rejected FROM v)"""

_PARSED = rf"""WITH {_LEXICON},
parts AS (SELECT l_orderkey AS o_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1),
lines AS (SELECT o_orderkey, {_LINE} AS line FROM orders JOIN parts USING (o_orderkey) JOIN part USING (p_partkey) JOIN ({_COMPANIES}) ON o_custkey = c_custkey),
t AS (SELECT o_orderkey, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '(^|\s)-\S+', '', 'g')), '^"([^"]+)"\s*', '"\1" ')) AS text FROM lines),
b AS (SELECT o_orderkey, regexp_extract(text, '^"([^"]+)"', 1) AS quoted, string_split(text, ' ') AS tokens FROM t),
c AS (SELECT *, list_transform(tokens, lambda w: regexp_replace(lower(w), '[,.]+$', '')) AS words, CASE WHEN quoted = '' THEN 0 ELSE len(string_split(quoted, ' ')) END AS since FROM b),
d AS (SELECT *, list_filter(range(since, len(words) - 1), lambda i: words[i + 1] = 'in')[1] AS marker FROM c),
g AS (SELECT *, coalesce(marker, len(words)) AS until FROM d),
hits AS (SELECT o_orderkey, start, -n AS less, kind, name, tier FROM (SELECT *, unnest(range(len(words))) AS start FROM g), (SELECT unnest([1, 2, 3, 4]) AS n), lex WHERE start + n <= len(words) AND phrase = array_to_string(words[start + 1:start + n], ' ')),
role AS (SELECT o_orderkey, min({{'tier': tier, 'start': start, 'less': less, 'name': name}}) AS role FROM hits JOIN g USING (o_orderkey) WHERE kind = 'role' AND start - less <= until AND CASE WHEN quoted != '' THEN start = since ELSE start >= 1 END GROUP BY 1),
f AS (SELECT *, coalesce(marker + 1, role.start - role.less, len(words)) AS start FROM g LEFT JOIN role USING (o_orderkey)),
named AS (SELECT o_orderkey, {_GREEDY.format(hits="list({'start': hits.start, 'less': less, 'name': name})")} AS kept FROM hits JOIN f USING (o_orderkey) WHERE kind = 'place' AND hits.start >= f.start GROUP BY 1)
"""
_PARSE = """SELECT o_orderkey, CASE WHEN quoted != '' THEN quoted ELSE array_to_string(tokens[:coalesce(role.start, until)], ' ') END AS product, coalesce(role.name, '') AS role, regexp_replace(array_to_string(tokens[start + 1:], ' '), '[,.\\s]+$', '') AS place,
    coalesce(array_to_string(list_transform(kept, lambda k: k.name), '|'), '') AS places FROM f LEFT JOIN named USING (o_orderkey)"""

ORACLES = {
    "q_query_parse": _PARSED + _PARSE,
    "q_precise_queries": f"""{_PARSED}, parsed AS ({_PARSE}), heads AS (SELECT split_part(p_name, ' ', -1) AS head, min(p_type) AS kind FROM part GROUP BY 1 HAVING head < 'g'),
h AS (SELECT o_orderkey, product, place, kind, head, concat_ws(' ', CASE WHEN head IS NOT NULL AND contains(product, ' ') THEN '"' || product || '"' ELSE product END, nullif(role, '')) AS said FROM parsed LEFT JOIN heads ON head = lower(split_part(product, ' ', -1)))
SELECT o_orderkey, CASE WHEN product = '' THEN '' ELSE concat_ws(' ', said, CASE WHEN place != '' AND NOT contains(lower(said), lower(place)) THEN place END, CASE WHEN head < 'c' THEN '-' || lower(kind) || ' -used' END) END AS query FROM h""",
    "q_hunt_queries": """WITH f AS (SELECT l_suppkey, p_name, min(l_partkey) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_name QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_partkey)) <= 3),
r AS (SELECT * FROM (VALUES (0, 1, 'buildings', 'building'), (0, 2, 'machinerys', 'machinery'), (1, 1, 'household shops', 'household shop'), (2, 1, 'clubs', 'club'), (2, 2, 'automobiles', 'automobile'), (3, 1, 'distributors', 'distributor')) v(m, n, role, one)),
p AS (SELECT l_suppkey, first, p_name, CASE WHEN p_name LIKE '%ies' THEN p_name[:-4] || 'y' WHEN p_name LIKE '%s' AND p_name NOT LIKE '%ss' THEN p_name[:-2] ELSE p_name END AS single, n, role, one, CASE WHEN s_suppkey % 3 != 0 THEN ' ' || n_name ELSE '' END AS location
    FROM f JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN r ON m = s_suppkey % 4),
q AS (SELECT l_suppkey, 'primary' AS bucket, {'a': n, 'b': first, 'c': 0} AS spot, p_name || ' ' || role || location AS query FROM p
    UNION ALL SELECT l_suppkey, 'volume', {'a': n, 'b': first, 'c': 1}, '"' || p_name || '" ' || role || location FROM p UNION ALL SELECT l_suppkey, 'volume', {'a': n, 'b': first, 'c': 2}, '"' || p_name || '" ' || one || location FROM p
    UNION ALL SELECT l_suppkey, 'volume', {'a': n, 'b': first, 'c': 3}, '"' || single || '" ' || one || location FROM p WHERE single != p_name),
d AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY l_suppkey, lower(query) ORDER BY bucket, spot) = 1)
SELECT l_suppkey AS s_suppkey, bucket, row_number() OVER (PARTITION BY l_suppkey, bucket ORDER BY spot)::int AS place, query FROM d""",
    "q_place_aliases": f"""WITH {_LEXICON}, s AS (SELECT s_suppkey, lower(trim(CASE s_suppkey % 3 WHEN 0 THEN replace(n_name, '_', ' ') WHEN 1 THEN n_name ELSE s_name END)) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT s_suppkey, place, (SELECT min(name) FROM lex WHERE kind = 'place' AND phrase = place) AS name FROM s)
SELECT s_suppkey, concat_ws('|', place, string_agg(phrase, '|' ORDER BY phrase != lower(n.name), phrase)) AS aliases FROM n LEFT JOIN lex ON lex.name = n.name AND kind = 'place' AND phrase != place GROUP BY s_suppkey, place""",
    "q_location_evidence": f"WITH {_LEXICON}, {_TEXTS}, {_evidence('e', 'text')} SELECT c_custkey, sentence::int AS sentence, start::int AS start, name, claim FROM e",
    "q_location_verdict": f"{_VERDICTS} SELECT c_custkey, verdict, reason, confidence, business_location, rejected FROM w",
    "q_places_mentioned_tristate": f"{_VERDICTS} SELECT mentioned, verdict, count(*) AS companies FROM w GROUP BY ALL",
}
