"""Queries over companies, leads and catalogs: matching, selection, ranking, merging and reporting."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import scoring
from leadloom.operators import dedup, joins, merging, ranking, series
from leadloom.sources.tables import read

STAGES = {"O": "To contact", "P": "Contacted", "F": "Replied"}
DOMAIN = ["To contact", "Contacted", "Replied", "Re-contact", "Won"]
PRIORITY = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}
TODAY = "1998-08-01"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation's and region's names. The dimensions are the fixed lists of nations and regions."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


def stage(column="o_orderstatus"):
    return F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col(column))


def rank_of(column="o_orderpriority"):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col(column)), F.lit(0))


def day_key(column):
    return F.date_format(column, "yyyy-MM-dd")


def lead_priority_match(spark, sf_dir):
    """Each customer's supplier by the first key that hits: last digits of the name, then nation. Counted by key."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("#"), F.substring_index("c_name", "#", -1)).alias("number"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("nation"))
    known = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("#"), F.substring_index("s_name", "#", -1)).alias("number"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("nation"))
    return dedup.priority_match(rows, known, "c_custkey", "s_suppkey", ["number", "nation"]).groupBy(F.coalesce("match_key", F.lit("none")).alias("match_key")).agg(F.count("*").alias("leads"), F.sum("match_id").alias("match_sum"))


def leads_anti_known(spark, sf_dir):
    """Customers without any large order."""
    known = read(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("key"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    return dedup.without_known(rows, known, ["key"]).select("c_custkey")


def leads_semi_ids(spark, sf_dir):
    """Orders of customers in debt, counted by stage."""
    ids = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").groupBy(stage().alias("stage")).agg(F.count("*").alias("leads"))


def role_product_cross(spark, sf_dir):
    """Part nouns by segments, segment by segment, the first 24."""
    nouns = read(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("product")).distinct()
    roles = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role")).distinct()
    return joins.priority_cross(nouns, roles, "product", "role", 24)


def type_city_diagonal(spark, sf_dir):
    """Part types by nations along anti-diagonals, the first 30."""
    kinds = read(spark, sf_dir, "part").select(F.col("p_type").alias("kind")).distinct()
    cities = read(spark, sf_dir, "nation").select(F.col("n_name").alias("city")).distinct()
    return joins.priority_cross(kinds, cities, "kind", "city", 30, diagonal=True)


def containment(spark, sf_dir):
    """Part names by the adjectives and nouns of other parts of the brand that they contain, counted."""
    parts = read(spark, sf_dir, "part")
    wanted = parts.filter("p_brand = 'Brand#1'").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    found = joins.contains_word(parts.select("p_partkey", "p_name"), F.split("p_name", " "), wanted, "word")
    return found.groupBy("word").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


def range_bands(spark, sf_dir):
    """Orders by overlapping price bands that a table gives."""
    bands = spark.createDataFrame([("small", 0.0, 60000.0), ("middle", 50000.0, 250000.0), ("large", 240000.0, 600000.0)], "band string, low double, high double")
    return joins.range_join(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "low", "high", 50000.0).groupBy("band").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))


def latest_order(spark, sf_dir):
    """Each customer's latest order, the highest key of those of a day."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return dedup.latest_per_key(rows, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", day_key("o_orderdate").alias("day"), "o_orderstatus")


def first_order(spark, sf_dir):
    """Each customer's first order, the lowest key of those of a day."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return dedup.first_per_key(rows, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", day_key("o_orderdate").alias("day"))


def diversified(spark, sf_dir):
    """Parts brand by brand in turns, forty of them."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return ranking.round_robin(parts, "p_brand", F.col("p_partkey"), 40)


def family_caps(spark, sf_dir):
    """Parts by type with a cap for each type and one in all."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    return ranking.family_caps(parts, "p_type", {"ECONOMY": 8, "STANDARD": 4}, 3, F.col("p_partkey"), 20)


def budget_cutoff(spark, sf_dir):
    """Orders of each customer, oldest first, until 300,000 are spent."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("price"))
    kept = ranking.within_budget(rows, ["o_custkey"], "price", 300_000, F.col("o_orderkey"))
    return kept.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("spent_before").alias("spent_before_last"))


def top_leads(spark, sf_dir):
    """The forty best leads: customers with a positive balance first, then by best priority, orders and key."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(rank_of()).alias("priority"), F.count("*").alias("orders"))
    leads = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("reachable")).join(orders, "c_custkey")
    return leads.orderBy(F.desc("reachable"), F.desc("priority"), F.desc("orders"), "c_custkey").limit(40)


def threshold_choice(spark, sf_dir):
    """For each part noun the type that most of its parts have, if a quarter of them do."""
    counts = read(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("noun"), "p_type").groupBy("noun", "p_type").agg(F.count("*").alias("n"))
    share = F.floor(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("noun")))
    return ranking.best_or_none(counts.withColumn("share", share), ["noun"], "share", "p_type", 25)


def intent_rank(spark, sf_dir):
    """The thirty first orders by priority rank, price and key."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", rank_of().alias("rank"), F.floor("o_totalprice").alias("price"))
    return rows.orderBy(F.desc("rank"), F.desc("price"), "o_orderkey").limit(30)


def offset_page(spark, sf_dir):
    """The second page of suppliers by name, ten to a page."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey").offset(10).limit(10)


def ordered_distinct(spark, sf_dir):
    """The first five parts that each supplier shipped, in order of order key, each once."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    found = dedup.ordered_distinct(rows, ["l_suppkey"], "l_partkey", F.col("l_orderkey"), cap=5)
    return found.select("l_suppkey", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("parts"))


def stage_histogram(spark, sf_dir):
    """Leads of every stage, those without any too, and of all."""
    counts = read(spark, sf_dir, "orders").groupBy(stage().alias("stage")).agg(F.count("*").alias("leads"))
    total = counts.agg(F.lit("All").alias("stage"), F.sum("leads").alias("leads"))
    return series.zero_filled(counts, "stage", DOMAIN, "leads").union(total)


def pipeline_outcomes(spark, sf_dir):
    """Overlapping outcome counts in one pass."""
    n = lambda c: F.count(F.when(c, 1))
    s, price, old = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return read(spark, sf_dir, "orders").agg(
        F.count("*").alias("leads"), n(s == "O").alias("open"), n(s == "P").alias("contacted"), n(s == "F").alias("replied"), n((s == "P") & old).alias("follow_up_due"),
        n(price >= 250_000).alias("large"), n((s == "O") & (rank_of() >= 4)).alias("urgent_open"), F.countDistinct("o_custkey").alias("companies"),
    )


def follow_up_due(spark, sf_dir):
    """Contacted leads that have waited three days or more, by priority, with the longest wait."""
    waited = F.datediff(F.lit(TODAY).cast("date"), F.col("o_orderdate").cast("date"))
    rows = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("priority"), waited.alias("days")).filter("days >= 3")
    return rows.groupBy("priority").agg(F.count("*").alias("due"), F.max("days").alias("longest"))


def replace_all(spark, sf_dir):
    """A catalog by lower-case name and type, the last row of each."""
    rows = read(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.col("p_type").alias("category"), "p_partkey", F.col("p_brand").alias("brand"))
    return dedup.latest_per_key(rows, ["name", "category"], "p_partkey")


def merge_non_regressing(spark, sf_dir):
    """Each customer's older orders merged with newer ones: the stage never falls, the first note stays, the newest price counts. Totals by stage."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", stage().alias("stage"), "o_orderkey", F.col("o_orderpriority").alias("note"), F.floor("o_totalprice").alias("price"))
    old = dedup.first_per_key(rows.filter("o_orderkey % 2 = 0"), ["o_custkey"], "o_orderkey")
    new = dedup.latest_per_key(rows.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")
    merged = merging.non_regressing(old, new, "o_custkey", {s: i for i, s in enumerate(DOMAIN)}, "stage", ["note"], ["price"])
    return merged.groupBy("stage", "note").agg(F.count("*").alias("leads"), F.sum("price").alias("price"))


def route_manual(spark, sf_dir):
    """Orders dealt to two sheets, each customer to the manual one if any of its orders is urgent and open."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", ((F.col("o_orderstatus") == "O") & (rank_of() == 5)).alias("manual"))
    tabs = rows.groupBy("o_custkey").agg(F.max("manual").alias("manual"), F.count("*").alias("orders"))
    return tabs.groupBy(F.when(F.col("manual"), "Manual").otherwise("Leads").alias("tab")).agg(F.count("*").alias("companies"), F.sum("orders").alias("orders"))


def export_projection(spark, sf_dir):
    """The columns of an export: texts cut, flags as words, city and country apart."""
    c = companies(spark, sf_dir)
    return c.select(F.col("c_custkey").alias("id"), F.substring("c_name", 1, 12).alias("company"), F.concat_ws(", ", "n_name", "r_name").alias("location"), F.when(F.col("c_acctbal") < 0, "yes").otherwise("no").alias("in_debt"), F.initcap("c_mktsegment").alias("industry"))


def union_sources(spark, sf_dir):
    """Companies of both tables, counted by source and nation."""
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"))
    b = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b).groupBy("source", "nation").agg(F.count("*").alias("companies"))


def set_difference(spark, sf_dir):
    """Nations with customers in debt but without suppliers in debt."""
    a = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    return a.subtract(read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nation")))


def set_intersection(spark, sf_dir):
    """Nations with both."""
    a = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    return a.intersect(read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nation")))


def outer_keys(spark, sf_dir):
    """Every nation that either table has, with counts of both, null where one has none."""
    a = read(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return merging.both_sides(a, b, "nation")


def backfill(spark, sf_dir):
    """Customers' contact cell, taken from a supplier of the same number where it is blank."""
    number = lambda c: F.substring_index(c, "#", -1)
    c = read(spark, sf_dir, "customer").select("c_custkey", number("c_name").alias("number"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("c"), F.col("c_custkey"))).alias("contact"))
    s = read(spark, sf_dir, "supplier").select(number("s_name").alias("number"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("other"))
    return c.join(s, "number", "left").select("c_custkey", merging.fill_if_empty(F.col("contact"), F.col("other")).alias("contact"))


def stage_repair(spark, sf_dir):
    """Stages mended by what the line items say: all shipped means contacted, none of them open."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_linestatus") == "O").cast("int")).alias("open"))
    rows = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    mended = F.when((F.col("o_orderstatus") == "O") & (F.col("open") == 0), "Contacted").otherwise(stage())
    return rows.groupBy(stage().alias("before"), mended.alias("after")).agg(F.count("*").alias("leads"))


def catalog_cascade(spark, sf_dir):
    """Three catalogs in order of priority: a product counts where it stands first."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), (F.col("p_partkey") % 3).alias("source"))
    first = dedup.first_per_key(rows, ["name"], "source", "p_partkey")
    return first.groupBy("source").agg(F.count("*").alias("products"), F.min("p_partkey").alias("first_part"))


def fit_scores(spark, sf_dir):
    """Fit scores of companies from levels of balance, orders and segment."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max(rank_of()).alias("priority"))
    c = companies(spark, sf_dir).join(orders, "c_custkey", "left").select("c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("priority", F.lit(0)).alias("priority"))
    level = lambda v, high, medium: F.when(v >= high, "high").when(v >= medium, "medium").when(v >= 0, "unknown").otherwise("low")
    icp, offer, motion = level(F.col("c_acctbal"), 6000, 2000), level(F.col("orders"), 12, 6), level(F.col("priority"), 5, 4)
    home = F.col("c_custkey") % 2 == 0
    geo = F.when(F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3"), 9.0).otherwise(1.5)
    role = F.when(F.col("c_mktsegment") == "BUILDING", 4.5).otherwise(0.0)
    seed = F.concat_ws("|", "c_name", "n_name", icp, offer, motion)
    return c.select("c_custkey", icp.alias("icp"), scoring.lowest_level(icp, offer, motion).alias("lowest"), scoring.fit_score(icp, offer, motion, geo, role, F.col("priority"), home, seed).alias("score"))


def recursive_frontier(spark, sf_dir):
    """Places reachable from a region through a bounded number of steps down an edge table."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    edges = edges.union(read(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    seen = frontier = region.filter("r_name = 'ASIA'").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(0).alias("depth"))
    for depth in (1, 2):
        frontier = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        seen = seen.union(frontier.join(seen, "node", "left_anti"))
    return seen


QUERIES = {
    "q_lead_priority_key_match": lead_priority_match, "q_leads_anti_known": leads_anti_known, "q_leads_semi_ids": leads_semi_ids, "q_role_product_cross": role_product_cross,
    "q_type_city_antidiagonal": type_city_diagonal, "q_containment_join": containment, "q_range_join_bands": range_bands, "q_latest_per_key": latest_order, "q_first_per_key": first_order,
    "q_round_robin_diversify": diversified, "q_family_caps": family_caps, "q_budget_cutoff": budget_cutoff, "q_rank_tuple_topk": top_leads, "q_threshold_top1": threshold_choice,
    "q_intent_rank_sort": intent_rank, "q_offset_page": offset_page, "q_ordered_distinct_capped": ordered_distinct, "q_status_histogram_zero_filled": stage_histogram,
    "q_pipeline_outcomes": pipeline_outcomes, "q_followup_due": follow_up_due, "q_replace_all_last_wins": replace_all, "q_merge_non_regressing": merge_non_regressing,
    "q_route_manual": route_manual, "q_export_projection": export_projection, "q_union_sources": union_sources, "q_set_difference": set_difference, "q_set_intersection": set_intersection,
    "q_full_outer_keys": outer_keys, "q_backfill_fill_if_empty": backfill, "q_stage_repair": stage_repair, "q_catalog_priority_merge": catalog_cascade, "q_fit_score": fit_scores,
    "q_recursive_frontier": recursive_frontier,
}

_STAGE = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items()) + " END"
_RANK = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 0 END"
_PLACE = "CASE {c} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(DOMAIN)) + " ELSE -1 END"
_COMPANIES = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _level(v, high, medium):
    return f"CASE WHEN {v} >= {high} THEN 'high' WHEN {v} >= {medium} THEN 'medium' WHEN {v} >= 0 THEN 'unknown' ELSE 'low' END"


def _points(level, table):
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"


ORACLES = {
    "q_lead_priority_key_match": """WITH n AS (SELECT '#' || split_part(s_name, '#', -1) AS number, min(s_suppkey) AS id FROM supplier GROUP BY 1), k AS (SELECT s_nationkey, min(s_suppkey) AS id FROM supplier GROUP BY 1),
m AS (SELECT CASE WHEN n.id IS NOT NULL THEN 'number' WHEN k.id IS NOT NULL THEN 'nation' ELSE 'none' END AS match_key, coalesce(n.id, k.id) AS id FROM customer LEFT JOIN n ON n.number = '#' || split_part(c_name, '#', -1) LEFT JOIN k ON k.s_nationkey = c_nationkey)
SELECT match_key, count(*) AS leads, CAST(sum(id) AS BIGINT) AS match_sum FROM m GROUP BY match_key""",
    "q_leads_anti_known": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "q_leads_semi_ids": f"SELECT {_STAGE} AS stage, count(*) AS leads FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
    "q_role_product_cross": "WITH n AS (SELECT DISTINCT split_part(p_name, ' ', -1) AS product FROM part), r AS (SELECT DISTINCT c_mktsegment AS role FROM customer) SELECT product, role FROM n, r ORDER BY role, product LIMIT 24",
    "q_type_city_antidiagonal": "WITH k AS (SELECT p_type AS kind, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)), c AS (SELECT n_name AS city, row_number() OVER (ORDER BY n_name) - 1 AS j FROM (SELECT DISTINCT n_name FROM nation)) SELECT kind, city FROM k, c ORDER BY i + j, j LIMIT 30",
    "q_containment_join": "WITH w AS (SELECT DISTINCT unnest(split(p_name, ' ')) AS word FROM part WHERE p_brand = 'Brand#1') SELECT word, count(*) AS parts, min(p_partkey) AS first_part FROM part JOIN w ON list_contains(split(p_name, ' '), word) GROUP BY word",
    "q_range_join_bands": "WITH b(band, low, high) AS (VALUES ('small', 0.0, 60000.0), ('middle', 50000.0, 250000.0), ('large', 240000.0, 600000.0)) SELECT band, count(*) AS orders, min(o_orderkey) AS first_order FROM orders JOIN b ON o_totalprice BETWEEN low AND high GROUP BY band",
    "q_latest_per_key": "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "q_first_per_key": "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "q_round_robin_diversify": "WITH r AS (SELECT p_partkey, p_brand, p_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS turn, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part) SELECT p_partkey, p_brand, p_name, turn FROM r ORDER BY turn, f LIMIT 40",
    "q_family_caps": "WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, p_type FROM r WHERE n <= CASE p_type WHEN 'ECONOMY' THEN 8 WHEN 'STANDARD' THEN 4 ELSE 3 END ORDER BY p_partkey LIMIT 20",
    "q_budget_cutoff": "WITH p AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders), s AS (SELECT *, coalesce(sum(price) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT o_custkey, count(*) AS orders, CAST(max(b) AS BIGINT) AS spent_before_last FROM s WHERE b < 300000 GROUP BY o_custkey",
    "q_rank_tuple_topk": f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS reachable, max({_RANK}) AS priority, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY reachable DESC, priority DESC, orders DESC, c_custkey LIMIT 40",
    "q_threshold_top1": "WITH c AS (SELECT split_part(p_name, ' ', -1) AS noun, p_type, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT noun, p_type, CAST(n * 100 // sum(n) OVER (PARTITION BY noun) AS BIGINT) AS share FROM c) SELECT noun, share, CASE WHEN share >= 25 THEN p_type END AS p_type FROM s QUALIFY row_number() OVER (PARTITION BY noun ORDER BY share DESC, p_type) = 1",
    "q_intent_rank_sort": f"SELECT o_orderkey, {_RANK} AS rank, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders ORDER BY rank DESC, price DESC, o_orderkey LIMIT 30",
    "q_offset_page": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 10 OFFSET 10",
    "q_ordered_distinct_capped": "WITH f AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS o FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY o, l_partkey) AS n FROM f) SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY n) AS parts FROM r WHERE n <= 5 GROUP BY l_suppkey",
    "q_status_histogram_zero_filled": f"WITH d(stage) AS (VALUES {', '.join(f'''('{s}')''' for s in DOMAIN)}), c AS (SELECT {_STAGE} AS stage, count(*) AS leads FROM orders GROUP BY 1) SELECT stage, coalesce(leads, 0) AS leads FROM d LEFT JOIN c USING (stage) UNION ALL SELECT 'All', CAST(sum(leads) AS BIGINT) FROM c",
    "q_pipeline_outcomes": f"SELECT count(*) AS leads, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS contacted, count(*) FILTER (o_orderstatus = 'F') AS replied, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01') AS follow_up_due, count(*) FILTER (o_totalprice >= 250000) AS large, count(*) FILTER (o_orderstatus = 'O' AND {_RANK} >= 4) AS urgent_open, count(DISTINCT o_custkey) AS companies FROM orders",
    "q_followup_due": f"SELECT o_orderpriority AS priority, count(*) AS due, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}')) AS INTEGER) AS longest FROM orders WHERE o_orderstatus = 'P' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') >= 3 GROUP BY 1",
    "q_replace_all_last_wins": "SELECT lower(p_name) AS name, p_type AS category, max(p_partkey) AS p_partkey, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY 1, 2",
    "q_merge_non_regressing": f"""WITH r AS (SELECT o_custkey, {_STAGE} AS stage, o_orderkey, o_orderpriority AS note, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
o AS (SELECT * FROM r WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1), n AS (SELECT * FROM r WHERE o_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
m AS (SELECT CASE WHEN {_PLACE.format(c='n.stage')} > {_PLACE.format(c='o.stage')} THEN n.stage ELSE coalesce(o.stage, n.stage) END AS stage, coalesce(o.note, n.note) AS note, coalesce(n.price, o.price) AS price FROM o FULL JOIN n ON o.o_custkey = n.o_custkey)
SELECT stage, note, count(*) AS leads, CAST(sum(price) AS BIGINT) AS price FROM m GROUP BY ALL""",
    "q_route_manual": f"WITH t AS (SELECT o_custkey, bool_or(o_orderstatus = 'O' AND {_RANK} = 5) AS manual, count(*) AS orders FROM orders GROUP BY 1) SELECT CASE WHEN manual THEN 'Manual' ELSE 'Leads' END AS tab, count(*) AS companies, CAST(sum(orders) AS BIGINT) AS orders FROM t GROUP BY 1",
    "q_export_projection": f"SELECT c_custkey AS id, substr(c_name, 1, 12) AS company, n_name || ', ' || r_name AS location, CASE WHEN c_acctbal < 0 THEN 'yes' ELSE 'no' END AS in_debt, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS industry FROM {_COMPANIES}",
    "q_union_sources": "SELECT source, nation, count(*) AS companies FROM (SELECT 'customer' AS source, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY ALL",
    "q_set_difference": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "q_set_intersection": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "q_full_outer_keys": "WITH a AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT nation, customers, suppliers FROM a FULL JOIN b USING (nation)",
    "q_backfill_fill_if_empty": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'c' || c_custkey ELSE 's' || s_suppkey END AS contact FROM customer LEFT JOIN supplier ON split_part(c_name, '#', -1) = split_part(s_name, '#', -1)",
    "q_stage_repair": f"WITH l AS (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open FROM lineitem GROUP BY 1) SELECT {_STAGE} AS before, CASE WHEN o_orderstatus = 'O' AND open = 0 THEN 'Contacted' ELSE {_STAGE} END AS after, count(*) AS leads FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "q_catalog_priority_merge": "WITH f AS (SELECT p_partkey, p_partkey % 3 AS source FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey % 3, p_partkey) = 1) SELECT source, count(*) AS products, min(p_partkey) AS first_part FROM f GROUP BY source",
    "q_fit_score": f"""WITH o AS (SELECT o_custkey, count(*) AS orders, max({_RANK}) AS priority FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_name, n_name, c_mktsegment, c_custkey % 2 = 0 AS home, {_level('c_acctbal', 6000, 2000)} AS icp, {_level('coalesce(orders, 0)', 12, 6)} AS offer, {_level('coalesce(priority, 0)', 5, 4)} AS motion, coalesce(priority, 0) AS evidence FROM {_COMPANIES} LEFT JOIN o ON o_custkey = c_custkey),
s AS (SELECT *, substr(concat_ws('|', c_name, n_name, icp, offer, motion), 1, 180) AS seed FROM c),
k AS (SELECT *, CAST(list_sum(list_transform(range(1, length(seed) + 1), lambda i: i * ascii(seed[i]))) AS BIGINT) AS k FROM s),
j AS (SELECT *, (k % 71) / 10.0::DOUBLE AS j FROM k),
r AS (SELECT *, {_points('icp', scoring.ICP_POINTS)} + {_points('offer', scoring.OFFER_POINTS)} + {_points('motion', scoring.MOTION_POINTS)} + CASE WHEN n_name IN ('NATION_1', 'NATION_2', 'NATION_3') THEN 9.0::DOUBLE ELSE 1.5::DOUBLE END + CASE WHEN c_mktsegment = 'BUILDING' THEN 4.5::DOUBLE ELSE 0 END + CASE WHEN home THEN 4.0::DOUBLE ELSE 0 END + least(5.0::DOUBLE, evidence * 1.4::DOUBLE) + CASE WHEN k % 2 = 1 THEN j * 0.65::DOUBLE ELSE -j * 0.4::DOUBLE END AS a FROM j),
b AS (SELECT *, CASE WHEN NOT home THEN least(a, 51.0::DOUBLE + j * 0.15::DOUBLE) ELSE a END AS b FROM r),
d AS (SELECT *, CASE WHEN icp IN ('unknown', 'low') AND motion IN ('unknown', 'low') THEN least(b, 38.0::DOUBLE + j * 0.2::DOUBLE) ELSE b END AS d FROM b),
e AS (SELECT *, CASE WHEN offer = 'low' AND home THEN least(d, 70.0::DOUBLE + j * 0.25::DOUBLE) ELSE d END AS e FROM d),
f AS (SELECT *, CASE WHEN icp = 'low' OR motion = 'low' THEN least(e, 34.0::DOUBLE + j * 0.15::DOUBLE) ELSE e END AS f FROM e)
SELECT c_custkey, icp, CASE WHEN 'low' IN (icp, offer, motion) THEN 'low' WHEN 'unknown' IN (icp, offer, motion) THEN 'unknown' WHEN 'medium' IN (icp, offer, motion) THEN 'medium' ELSE 'high' END AS lowest, CAST(round_even(greatest(0, least(99, f)), 0) AS BIGINT) AS score FROM f""",
    "q_recursive_frontier": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
f AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name = 'ASIA' UNION SELECT dst, depth + 1 FROM f JOIN e ON node = src WHERE depth < 2) SELECT node, min(depth) AS depth FROM f GROUP BY node""",
}
