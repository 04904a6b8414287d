"""Queries over ordered lists, picks, filters and kept state, on the driver's tables."""

import uuid

from pyspark.sql import functions as F

from leadloom.functions import text, url
from leadloom.operators import dedup, ordering, ranges, state
from leadloom.sources.tables import read
from leadloom.streaming import ordered

NOW = "2024-01-20 00:00:00"
SEGMENT_LEVELS = {"AUTOMOBILE": "high", "BUILDING": "medium", "MACHINERY": "low"}
NATION_PRIORITIES = ("priority", "nurture", "review", "low", "none")
LIST_SOURCES = ("directory", "osm", "overture", "wikidata")


def book(column, values: dict[str, str], other: str):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column)), F.lit(other))


def final_lead_rank(spark, sf_dir):
    """The fifty first customers by e-mail, relevance, priority and score."""
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.lit("a@b.example")).otherwise(" ").alias("email"), book("c_mktsegment", SEGMENT_LEVELS, "unknown").alias("relevance"),
        F.element_at(F.array(*map(F.lit, NATION_PRIORITIES)), F.col("c_nationkey") % 5 + 1).alias("priority"), (F.floor(F.abs("c_acctbal")) % 100).alias("score"),
    )
    ranked = rows.withColumn("rank", ordering.final_rank(F.col("email"), F.col("relevance"), F.col("priority"), F.col("score")))
    return ordering.top(ranked, 50, F.col("rank").desc(), F.col("c_custkey")).select("place", "c_custkey", "relevance", "priority", "score")


def search_hit_rank(spark, sf_dir):
    """The forty first pages as search hits."""
    rows = read(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"), "url", F.lower("html").alias("html"))
    rank = ordering.search_rank(F.col("host").contains("spam-farm"), F.col("url").contains("/fr/"), F.col("html").contains("<table"), F.when(F.col("page_id") % 5 == 0, "maps").otherwise("web"))
    return ordering.top(rows.select("page_id", rank.alias("rank")), 40, F.col("rank").desc(), F.col("page_id")).select("place", "page_id", F.col("rank.kept").alias("kept"), F.col("rank.role").alias("role"))


def inbox_order(spark, sf_dir):
    """The hundred first drafts by state, then weight."""
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", book("o_orderstatus", {"O": "Draft", "P": "Sent", "F": "Replied"}, "none").alias("status"), book("o_orderpriority", {"1-URGENT": "priority", "2-HIGH": "nurture", "3-MEDIUM": "review"}, "").alias("priority"),
        F.when(F.col("o_custkey") % 3 == 0, "high").when(F.col("o_custkey") % 3 == 1, "low").otherwise("none").alias("intent"), (F.floor("o_totalprice") % 100).alias("score"),
    )
    weighed = rows.select("o_orderkey", "status", ordering.inbox_weight(F.col("priority"), F.col("intent"), F.col("score")).alias("weight"))
    return ordering.top(weighed, 100, ordering.level(F.col("status"), ordering.DRAFTS, ordering.OTHER_DRAFT), F.col("weight").desc(), F.col("o_orderkey"))


def newest_notices(spark, sf_dir):
    """The three newest events of each user."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordering.newest(rows, ["user_id"], 3, F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "place", "event_id")


def primary_turns(spark, sf_dir):
    """The longest text of the lowest tier of each conversation."""
    tier = F.when(F.col("role") == "system", 3).when(F.col("role") == "assistant", 2).otherwise(1)
    rows = read(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.min(F.struct(tier.alias("tier"), "text")).alias("first")).select("conv_id", "turn", "first.*")
    return ordering.primary(rows, ["conv_id"], "tier", "text", "turn").select("conv_id", "turn", F.col("tier").cast("long").alias("tier"), F.substring("text", 1, 280).alias("text"))


def first_pending(spark, sf_dir):
    """The first error event of each user that has not expired."""
    rows = read(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "pending_popup").otherwise("seen").alias("status"), F.when(F.col("value") >= 10, F.col("event_id")).alias("message_id"),
        F.when(F.col("event_id") % 3 == 0, F.date_add(F.col("ts").cast("date"), 5).cast("timestamp_ntz")).alias("expires_at"),
    )
    return state.pending(rows, "user_id", F.lit(NOW).cast("timestamp_ntz"), "ts", "event_id").select("user_id", "event_id")


def match_list(spark, sf_dir):
    """The parts that are shown of each brand, kind of offer and week day of keys, best level first."""
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 40, "high").when(F.col("p_size") > 30, "Medium").otherwise("low").alias("fit"), F.when(F.col("p_type") == "PROMO", "low").otherwise("high").alias("offer"), F.concat_ws(" ", "p_brand", (F.col("p_type") == "PROMO").cast("string"), (F.col("p_partkey") % 7).cast("string")).alias("account"))
    return ordering.matches_shown(rows, "account", "fit", "offer", "p_partkey").select("account", "p_partkey", "fit", "place")


def preferred_parts(spark, sf_dir):
    """Red parts first, 120 in all."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return ordering.preferred_first(rows, F.col("p_name").startswith("red"), 120, F.col("p_partkey")).select("place", "p_partkey")


def ragged_lists(spark, sf_dir):
    """Nouns of each brand's parts, interleaved by their place in the brand's list."""
    rows = read(spark, sf_dir, "part").select("p_brand", F.substring_index("p_name", " ", -1).alias("noun"), "p_partkey")
    listed = ordering.newest(rows, ["p_brand"], 6, F.col("p_partkey"))
    return ordering.ragged_round_robin(listed.select("p_brand", "noun", "place"), "p_brand", "noun", "place", 6)


def lane_breaker(spark, sf_dir):
    """How often four cheap events in a row blocked a user's lane for two days, and what fell into blocks."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") >= 20).cast("int").alias("hits"))
    return state.blocked_lanes(rows, "user_id", "hits", "ts", "event_id", seconds=2 * 86_400)


STREAMED = "key long, id long, ts timestamp, kind string, hits double"


def streamed(spark, rows, make):
    """What a streaming rule makes of rows: they are written as files in no order of time, with a last row beyond all others that lets the watermark pass."""
    folder = f"{ranges.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    each = rows.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "kind", F.col("hits").cast("double").alias("hits"))
    per_batch = spark.sparkContext.defaultParallelism  # three batches, whose files every core can write and read
    each.repartition(3 * per_batch, "id").write.parquet(f"{folder}/in")
    # a watermark that lags by the table's span takes no row for late, in whatever order files come
    span = (each.agg(F.date_diff(F.max("ts"), F.min("ts")).alias("days")).first().days or 0) + 2
    end = each.agg(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("id"), (F.max("ts") + F.make_dt_interval(F.lit(2 * span))).alias("ts"), F.lit("end").alias("kind"), F.lit(0.0).alias("hits"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return ordered.drained(spark, lambda s: make(s, f"{span} days"), f"{folder}/in", STREAMED, folder, per_batch).filter("key >= 0")


def stream_lanes(spark, sf_dir):
    """The lane breaker over a stream of events: pages, skipped ones and blocks by user, as the batch query has them."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.lit("").alias("kind"), (F.col("value") >= 20).cast("int").alias("hits"))
    found = streamed(spark, rows, lambda s, late: ordered.lanes(s, late, seconds=2 * 86_400))
    count = lambda *kinds: F.count(F.when(F.col("outcome").isin(*kinds), 1))
    return found.groupBy(F.col("key").alias("user_id")).agg(count("hit", "empty", "blocked").alias("pages"), count("skipped").alias("skipped"), count("blocked").alias("blocks"))


def reopened_cursors(spark, sf_dir):
    """Customers as list cursors, candidates being their orders: counted by what a retry makes of them."""
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("candidates"))
    rows = read(spark, sf_dir, "customer").join(n, "c_custkey", "left").select(
        "c_custkey", F.element_at(F.array(*map(F.lit, LIST_SOURCES + ("web",))), F.col("c_nationkey") % 5 + 1).alias("source"), F.when(F.col("c_acctbal") < 5000, "exhausted").otherwise("active").alias("status"),
        F.col("c_custkey").cast("string").alias("cursor"), "candidates",
    )
    again = state.reopened(rows, state.worth_retry(F.col("source"), F.col("status"), F.col("candidates"), LIST_SOURCES))
    return again.groupBy("source", "status").agg(F.count("*").alias("n"), F.count(F.when(F.col("cursor") == "", 1)).alias("at_start"))


def cursor_keys(spark, sf_dir):
    """How many customers share each cursor."""
    rows = read(spark, sf_dir, "customer").select(F.element_at(F.array(*map(F.lit, LIST_SOURCES + ("exhibitors", "web", "companies_house", "stockists"))), F.col("c_nationkey") % 8 + 1).alias("source"), F.concat(F.lit("N"), F.col("c_nationkey") % 4).alias("iso"), "c_mktsegment")
    key = state.cursor_key(F.col("source"), F.col("iso"), F.lit("Old  Town"), F.col("c_mktsegment"), F.array(F.col("c_mktsegment"), F.lit("gym")), F.concat(F.lit("Query "), F.col("c_mktsegment")), F.lit("Gym Straps"), F.when(F.col("iso") != "N1", F.concat(F.lit("Brand "), F.col("c_mktsegment"))))
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def sent_notices(spark, sf_dir):
    """Which events become notices, clicks being usage ones."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_type") == "click", "usage").otherwise("other").alias("kind"), F.to_date("ts").alias("day"), "value", "ts", "event_id")
    sent = state.notices(rows, ["user_id", "event_type"], "kind", "day", F.col("value") >= 30, "ts", "event_id")
    return sent.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least_id"), F.max("event_id").alias("greatest_id"))


def bounded_logs(spark, sf_dir):
    """The last fifty events of each user."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return state.last_kept(rows, ["user_id"], 50, F.col("ts").desc(), F.col("event_id").desc()).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least_id"))


def ticket_facets(spark, sf_dir):
    """Tickets by state, with the new ones among them and the open ones of all."""
    rows = read(spark, sf_dir, "orders").select(book("o_orderstatus", {"O": "open", "P": "in_progress", "F": "resolved"}, "closed").alias("status"), (F.year("o_orderdate") == 1998).alias("new"), F.coalesce("o_orderpriority", F.lit("normal")).alias("priority"))
    return rows.groupBy("priority").agg(F.count("*").alias("tickets"), *[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("open", "in_progress", "resolved", "closed")], F.count(F.when(F.col("new"), 1)).alias("n_new"))


def user_search(spark, sf_dir):
    """Users that are not suspended and have been active, by a part of name or plan."""
    used = read(spark, sf_dir, "events").filter(F.col("event_type") != "view").groupBy("user_id").agg(F.count("*").alias("used"))
    users = read(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("user_id"))
    asked = F.lower(F.lit("  Machin ".strip()))
    hit = F.lower("c_name").contains(asked) | F.lower(F.coalesce("c_mktsegment", F.lit(""))).contains(asked)
    return users.filter((F.col("c_acctbal") >= 0) & (F.col("used") > 0) & hit).select("c_custkey", "used")


def inbox_filters(spark, sf_dir):
    """How many drafts each filter of the inbox shows."""
    d = read(spark, sf_dir, "orders").select(book("o_orderstatus", {"O": "Draft", "P": "Sent", "F": "Replied"}, "none").alias("status"), (F.col("o_totalprice") > 300000).alias("fit"), (F.col("o_custkey") % 4 != 0).alias("email"), "o_orderdate")
    unsent, sent = F.col("status").isin("Draft", "Approved"), F.col("status").isin("Sent", "Replied")
    shown = {"to_send": unsent, "best_fit": unsent & F.col("fit"), "with_email": unsent & F.col("email"), "no_email": unsent & ~F.col("email"), "follow_up": (F.col("status") == "Sent") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), "sent": sent}
    return d.agg(*[F.count(F.when(c, 1)).alias(name) for name, c in shown.items()])


def workspace_access(spark, sf_dir):
    """Workspaces (suppliers) of customers: as owner, or as active member by id or e-mail. Equi-joins, one for each way."""
    users = read(spark, sf_dir, "customer").select("c_custkey", F.lower(F.concat("c_name", F.lit("@x.example"))).alias("email"))
    spaces = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("owner"))
    members = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("s_suppkey"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("gone").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("user"), F.lower(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("@X.example"))).alias("member_email"))
    active = members.filter("status = 'active'").join(spaces, "s_suppkey", "left_semi")
    ways = users.join(spaces, F.col("c_custkey") == F.col("owner")).select("c_custkey", "s_suppkey")
    ways = ways.union(users.join(active, F.col("c_custkey") == F.col("user")).select("c_custkey", "s_suppkey")).union(users.join(active, F.trim("email") == F.trim("member_email")).select("c_custkey", "s_suppkey"))
    return ways.distinct()


def page_positions(spark, sf_dir):
    """Place of each page among its host's, from 1 on."""
    rows = read(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"))
    return ranges.positions(rows, ["host"], ["page_id"], "place")


#: Limits of a user's run, in the order in which they are looked at: name, measure, most, and whether it is summed.
RUN_LIMITS = [("leads", "lead", 12, True), ("runtime", "seconds", 15 * 86_400, False), ("requests", "request", 70, True), ("pages", "page", 30, True), ("domains", "domain", 25, True), ("enrichments", "enriched", 18, True)]


def run_limits(spark, sf_dir):
    """The first of six limits that each user's run of events reaches, and at which event; null for none."""
    rows = read(spark, sf_dir, "events")
    start = rows.groupBy(F.col("user_id").alias("__user")).agg(F.min("ts").alias("start"))
    first = rows.groupBy("user_id", "props").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(1).cast("long").alias("domain"))
    is_ = lambda *kinds: F.col("event_type").isin(*kinds).cast("long")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    each = rows.join(start, F.col("user_id") == F.col("__user")).join(first, "event_id", "left")
    each = each.select("user_id", "event_id", seconds.alias("seconds"), is_("purchase").alias("lead"), F.lit(1).cast("long").alias("request"), is_("view", "click").alias("page"), "domain", is_("signup").alias("enriched"))
    return ranges.first_limit(each, ["user_id"], ["event_id"], RUN_LIMITS)


def applied_hits(spark, sf_dir):
    """Leads with the values of the newest hit by id; leads without hits keep theirs."""
    hits = dedup.latest_per_key(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderpriority"), ["c_custkey"], "o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(hits, "c_custkey", "left")
    return rows.groupBy(F.coalesce("o_orderpriority", "c_mktsegment").alias("value")).agg(F.count("*").alias("leads"))


def off_topic_pages(spark, sf_dir):
    """Hosts by whether their pages look off topic or mostly known."""
    rows = read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("host"), (F.col("page_id") % 9 == 0).alias("queued"), (F.length("html") % 7 > 0).alias("known"))
    n = rows.groupBy("host").agg(F.count("*").alias("total"), F.count(F.when(F.col("queued"), 1)).alias("queued"), F.count(F.when(F.col("known"), 1)).alias("known"))
    off = (F.col("total") >= 8) & (F.col("queued") == 0) & (F.col("known") == 0)
    return n.select("host", "total", off.alias("off_topic"), ((F.col("total") >= 6) & (F.col("known") / F.col("total") >= 0.9)).alias("mostly_known"))


def engine_counts(spark, sf_dir):
    """Hits of each engine, its share of the most, the best one by hits and then by the fixed order, and its part of a limit of 100, rounded up."""
    engines = ("click", "view", "purchase", "error", "signup")
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("hits"))
    at = F.array_position(F.array(*map(F.lit, engines)), F.col("event_type"))
    best = n.agg(F.max("hits").alias("most"), F.min_by("event_type", F.struct((-F.col("hits")).alias("less"), at.alias("at"))).alias("best"), F.count("*").alias("engines"))
    return n.crossJoin(F.broadcast(best)).select("event_type", "hits", F.round(F.col("hits") / F.col("most"), 6).alias("share"), (F.col("event_type") == F.col("best")).alias("is_best"), F.ceil(F.lit(100) / F.col("engines")).alias("part"))


def product_urls(spark, sf_dir):
    """Pages by whether their URL looks like a product, on paths that stand for shops."""
    forms = F.array(*map(F.lit, ("/products/", "/shop/", "/collections/", "/collections/all/products/", "/blog/", "/p-", "/item/", "/")))
    made = F.concat(F.lit("https://"), url.host(F.col("url")), F.element_at(forms, (F.col("page_id") % 8 + 1).cast("int")), F.when(F.col("page_id") % 16 > 7, F.concat(F.lit("A"), F.col("page_id"))).otherwise(""), F.when(F.col("page_id") % 3 == 0, "?a=/cart").otherwise(""))
    rows = read(spark, sf_dir, "pages").select("page_id", made.alias("made"))
    return rows.select("page_id", url.is_product(F.col("made")).alias("product"), url.is_no_product(F.col("made")).alias("no_product"))


TERMS = ["license", "the", "que", "die", "MIT", "at", "the", "rights reserved"]


def term_hits(spark, sf_dir):
    """Whole-word hits of terms in documents, counted by what was found."""
    found = F.array_join(text.term_hits(F.col("text"), TERMS), ",")
    return read(spark, sf_dir, "documents").groupBy(found.alias("found")).agg(F.count("*").alias("documents"))


ADDRESSES = ("Old Town, NJ", "importers in New Jersey", "shops near ny", "Gary, in 46401", "made in or near", "co 80201 Denver", "TX72 zone", "in tx today")


def state_codes(spark, sf_dir):
    """Which state codes stand in addresses, over made addresses by nation."""
    address = F.element_at(F.array(*map(F.lit, ADDRESSES)), F.col("n_nationkey") % 8 + 1)
    rows = read(spark, sf_dir, "nation").select("n_nationkey", address.alias("address"))
    return rows.select("n_nationkey", *[text.state_code_hit(F.col("address"), c).alias(f"in_{c}") for c in ("nj", "ny", "in", "or", "co", "tx")])


def lenient_json(spark, sf_dir):
    """The k of event properties as answers of a model give them: fenced, in a sentence, or bare."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" - bye"))).otherwise(F.concat(F.lit("  "), F.col("props")))
    k = F.get_json_object(text.json_part(said), "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("read"), F.sum(k).alias("k_sum"))


QUERIES = {
    "q_final_lead_rank": final_lead_rank, "q_search_hit_rank": search_hit_rank, "q_inbox_order": inbox_order, "q_newest_notices": newest_notices, "q_primary_signal": primary_turns, "q_first_pending": first_pending,
    "q_match_list": match_list, "q_preferred_first": preferred_parts, "q_ragged_round_robin": ragged_lists, "q_lane_breaker": lane_breaker, "q_stream_lanes": stream_lanes, "q_reopened_cursors": reopened_cursors, "q_cursor_keys": cursor_keys,
    "q_sent_notices": sent_notices, "q_bounded_logs": bounded_logs, "q_ticket_facets": ticket_facets, "q_user_search": user_search, "q_inbox_filters": inbox_filters, "q_workspace_access": workspace_access,
    "q_page_positions": page_positions, "q_run_limits": run_limits, "q_applied_hits": applied_hits, "q_off_topic_pages": off_topic_pages, "q_engine_counts": engine_counts, "q_product_urls": product_urls, "q_term_hits": term_hits,
    "q_state_codes": state_codes, "q_lenient_json": lenient_json,
}

_HOST = "coalesce(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\\.$', ''), '')"
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Draft' WHEN 'P' THEN 'Sent' WHEN 'F' THEN 'Replied' ELSE 'none' END"

ORACLES = {
    "q_final_lead_rank": """WITH r AS (SELECT c_custkey, c_acctbal > 0 AS email, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'high' WHEN 'BUILDING' THEN 'medium' WHEN 'MACHINERY' THEN 'low' ELSE 'unknown' END AS relevance,
        (['priority', 'nurture', 'review', 'low', 'none'])[c_nationkey % 5 + 1] AS priority, CAST(floor(abs(c_acctbal)) AS BIGINT) % 100 AS score FROM customer),
        p AS (SELECT *, row_number() OVER (ORDER BY email DESC, CASE relevance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, CASE priority WHEN 'priority' THEN 3 WHEN 'nurture' THEN 2 WHEN 'review' THEN 1 ELSE 0 END DESC, score DESC, c_custkey) AS place FROM r)
        SELECT place, c_custkey, relevance, priority, score FROM p WHERE place <= 50""",
    "q_search_hit_rank": f"""WITH r AS (SELECT page_id, CAST(NOT contains({_HOST}, 'spam-farm') AS INTEGER) AS kept, CAST(contains(url, '/fr/') AS INTEGER) AS geo, CAST(contains(lower(html), '<table') AS INTEGER) AS role, CAST(page_id % 5 = 0 AS INTEGER) AS map FROM pages),
        p AS (SELECT *, row_number() OVER (ORDER BY kept DESC, geo DESC, role DESC, map DESC, page_id) AS place FROM r) SELECT place, page_id, kept, role FROM p WHERE place <= 40""",
    "q_inbox_order": f"""WITH r AS (SELECT o_orderkey, {_STATUS} AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END * 1000 + CASE o_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END * 100 + CAST(floor(o_totalprice) AS BIGINT) % 100 AS weight FROM orders),
        p AS (SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'Draft' THEN 0 WHEN 'Sent' THEN 2 WHEN 'Replied' THEN 3 ELSE 9 END, weight DESC, o_orderkey) AS place FROM r) SELECT o_orderkey, status, weight, place FROM p WHERE place <= 100""",
    "q_newest_notices": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, event_id FROM events QUALIFY place <= 3",
    "q_primary_signal": """WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END AS tier, text FROM conversations WHERE text IS NOT NULL),
        d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY tier, text) AS k FROM r),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tier, length(text) DESC, turn) AS n FROM d WHERE k = 1) SELECT conv_id, turn, CAST(tier AS BIGINT) AS tier, text[1:280] AS text FROM p WHERE n = 1""",
    "q_first_pending": f"SELECT user_id, event_id FROM events WHERE event_type = 'error' AND value >= 10 AND (event_id % 3 <> 0 OR CAST(ts AS DATE) + INTERVAL 5 DAY >= TIMESTAMP '{NOW}') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "q_match_list": """WITH r AS (SELECT p_brand || ' ' || (p_type = 'PROMO') || ' ' || (p_partkey % 7) AS account, p_partkey, p_type = 'PROMO' AS low_offer, CASE WHEN p_size > 40 THEN 'high' WHEN p_size > 30 THEN 'Medium' ELSE 'low' END AS fit, CASE WHEN p_size > 40 THEN 3 WHEN p_size > 30 THEN 2 ELSE 1 END AS n FROM part),
        f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY account ORDER BY p_partkey) <= 6), k AS (SELECT *, max(n) OVER (PARTITION BY account) AS best FROM f),
        m AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY n DESC, p_partkey) AS place FROM k WHERE low_offer OR n > 1 OR best = 1) SELECT account, p_partkey, fit, place FROM m WHERE place <= CASE WHEN low_offer OR best > 1 THEN 3 ELSE 2 END""",
    "q_preferred_first": "SELECT row_number() OVER (ORDER BY NOT starts_with(p_name, 'red'), p_partkey) AS place, p_partkey FROM part QUALIFY place <= 120",
    "q_ragged_round_robin": """WITH l AS (SELECT p_brand, split_part(p_name, ' ', -1) AS noun, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part QUALIFY place <= 6),
        f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY noun ORDER BY place, p_brand) = 1) SELECT noun, place, p_brand FROM f ORDER BY place, p_brand, noun LIMIT 6""",
    "q_lane_breaker": """WITH RECURSIVE n AS (SELECT user_id, value >= 20 AS hit, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        w AS (SELECT DISTINCT user_id, 0::bigint AS n, 0::bigint AS pages, 0::bigint AS skipped, 0::bigint AS blocks, 0 AS strikes, 0::double AS until FROM n
            UNION ALL SELECT w.user_id, w.n + 1, pages + (t >= until)::int, skipped + (t < until)::int, blocks + (t >= until AND NOT coalesce(hit, false) AND strikes = 3)::int,
                CASE WHEN t < until THEN strikes WHEN coalesce(hit, false) OR strikes = 3 THEN 0 ELSE strikes + 1 END, CASE WHEN t >= until AND NOT coalesce(hit, false) AND strikes = 3 THEN t + 172800 ELSE until END
            FROM w JOIN n ON n.user_id = w.user_id AND n.n = w.n + 1)
        SELECT user_id, max(pages) AS pages, max(skipped) AS skipped, max(blocks) AS blocks FROM w GROUP BY user_id""",
    "q_reopened_cursors": """WITH n AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1), r AS (SELECT (['directory', 'osm', 'overture', 'wikidata', 'web'])[c_nationkey % 5 + 1] AS source, c_acctbal < 5000 AS done, coalesce(c, 0) AS c FROM customer LEFT JOIN n ON c_custkey = o_custkey),
        a AS (SELECT source, done, source <> 'web' AND done AND c = 0 AS again FROM r) SELECT source, CASE WHEN again OR NOT coalesce(done, false) THEN 'active' ELSE 'exhausted' END AS status, count(*) AS n, count(*) FILTER (again) AS at_start FROM a GROUP BY ALL""",
    "q_cursor_keys": """WITH r AS (SELECT (['directory', 'osm', 'overture', 'wikidata', 'exhibitors', 'web', 'companies_house', 'stockists'])[c_nationkey % 8 + 1] AS source, 'N' || (c_nationkey % 4) AS iso, c_mktsegment AS s FROM customer)
        SELECT lower(CASE source WHEN 'directory' THEN 'dir ' || iso || ' ' || s WHEN 'osm' THEN 'osm ' || iso || ' Old Town ' || s WHEN 'overture' THEN 'ov ' || iso || ' Old Town ' || md5(s || ',gym')[1:8] WHEN 'wikidata' THEN 'wd ' || iso || ' ' || s WHEN 'exhibitors' THEN 'exh global' WHEN 'companies_house' THEN 'ch ' || iso || ' ' || s || ' Gym Straps' WHEN 'stockists' THEN 'stock ' || iso || CASE WHEN iso = 'N1' THEN ' x' ELSE ' Brand ' || s END ELSE 'Query ' || s END) AS key, count(*) AS n FROM r GROUP BY 1""",
    "q_sent_notices": """WITH e AS (SELECT user_id, event_type, value, ts, event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS in_day FROM events),
        o AS (SELECT *, min(CASE WHEN value >= 30 THEN n END) OVER (PARTITION BY user_id, event_type) AS stop FROM e), s AS (SELECT * FROM o WHERE CASE WHEN event_type = 'click' THEN in_day = 1 ELSE stop IS NULL OR n <= stop END)
        SELECT user_id, event_type, count(*) AS n, min(event_id) AS least_id, max(event_id) AS greatest_id FROM s GROUP BY ALL""",
    "q_bounded_logs": "WITH r AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) SELECT user_id, count(*) AS n, min(event_id) AS least_id FROM r GROUP BY 1",
    "q_ticket_facets": """SELECT coalesce(o_orderpriority, 'normal') AS priority, count(*) AS tickets, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'P') AS n_in_progress, count(*) FILTER (o_orderstatus = 'F') AS n_resolved,
        count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'P', 'F')) AS n_closed, count(*) FILTER (year(o_orderdate) = 1998) AS n_new FROM orders GROUP BY 1""",
    "q_user_search": "WITH u AS (SELECT user_id, count(*) AS used FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT c_custkey, used FROM customer JOIN u ON c_custkey = user_id WHERE c_acctbal >= 0 AND (contains(lower(c_name), 'machin') OR contains(lower(coalesce(c_mktsegment, '')), 'machin'))",
    "q_inbox_filters": """SELECT count(*) FILTER (o_orderstatus = 'O') AS to_send, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 300000) AS best_fit, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 4 <> 0) AS with_email, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 4 = 0) AS no_email,
        count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01') AS follow_up, count(*) FILTER (o_orderstatus IN ('P', 'F')) AS sent FROM orders""",
    "q_workspace_access": """WITH m AS (SELECT o_orderkey % 97 AS s_suppkey, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 97 IN (SELECT s_suppkey FROM supplier))
        SELECT c_custkey, s_suppkey FROM supplier JOIN customer ON s_suppkey % 50 = c_custkey UNION SELECT c_custkey, s_suppkey FROM m JOIN customer ON o_orderkey % 2 = 0 AND o_custkey = c_custkey
        UNION SELECT c_custkey, s_suppkey FROM m JOIN customer ON lower(c_name) = 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')""",
    "q_run_limits": f"""WITH e AS (SELECT user_id, event_id, (date_trunc('second', ts) - date_trunc('second', min(ts) OVER (PARTITION BY user_id))) AS passed, event_type, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1 AS fresh FROM events),
        s AS (SELECT user_id, event_id, epoch(passed) AS seconds, sum((event_type = 'purchase')::int) OVER w AS spent_leads, count(*) OVER w AS spent_requests, sum((event_type IN ('view', 'click'))::int) OVER w AS spent_pages, sum(fresh::int) OVER w AS spent_domains, sum((event_type = 'signup')::int) OVER w AS spent_enrichments
            FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
        h AS (SELECT *, CASE {" ".join(f"WHEN {'spent_' + n if summed else c} >= {most} THEN '{n}'" for n, c, most, summed in RUN_LIMITS)} END AS "limit" FROM s)
        SELECT user_id, "limit", event_id, spent_leads::bigint AS spent_leads, spent_requests::bigint AS spent_requests, spent_pages::bigint AS spent_pages, spent_domains::bigint AS spent_domains, spent_enrichments::bigint AS spent_enrichments FROM h
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "limit" IS NULL, CASE WHEN "limit" IS NULL THEN -event_id ELSE event_id END) = 1""",
    "q_page_positions": f"WITH p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS place FROM p",
    "q_applied_hits": "WITH h AS (SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT coalesce(o_orderpriority, c_mktsegment) AS value, count(*) AS leads FROM customer LEFT JOIN h ON c_custkey = o_custkey GROUP BY 1",
    "q_off_topic_pages": f"""WITH p AS (SELECT {_HOST} AS host, page_id % 9 = 0 AS q, length(html) % 7 > 0 AS k FROM pages), n AS (SELECT host, count(*) AS total, count(*) FILTER (q) AS queued, count(*) FILTER (k) AS known FROM p GROUP BY 1)
        SELECT host, total, total >= 8 AND queued = 0 AND known = 0 AS off_topic, total >= 6 AND known / total >= 0.9 AS mostly_known FROM n""",
    "q_engine_counts": """WITH n AS (SELECT event_type, count(DISTINCT user_id) AS hits, list_position(['click', 'view', 'purchase', 'error', 'signup'], event_type) AS pos FROM events GROUP BY 1)
        SELECT event_type, hits, round(hits / max(hits) OVER (), 6) AS share, row_number() OVER (ORDER BY hits DESC, pos) = 1 AS is_best, CAST(ceil(100 / count(*) OVER ()) AS BIGINT) AS part FROM n""",
    "q_product_urls": """WITH p AS (SELECT page_id, lower((['/products/', '/shop/', '/collections/', '/collections/all/products/', '/blog/', '/p-', '/item/', '/'])[page_id % 8 + 1] || CASE WHEN page_id % 16 > 7 THEN 'A' || page_id ELSE '' END) AS p FROM pages),
        n AS (SELECT page_id, p, CASE WHEN p = '/' THEN true WHEN contains(p, '/collections/') OR contains(p, '/blog/') THEN NOT contains(p, '/products/') ELSE false END AS no_product FROM p)
        SELECT page_id, (NOT no_product OR contains(p, '/products/')) AND regexp_matches(p, '/products?/[^/]+|/product/|/shop/[^/]+|/item/[^/]+|/p/[^/]+|/goods/[^/]+|/catalog/product|/dp/[a-z0-9]+|/p-[^/]+|/[0-9]{4,}/?$') AS product, no_product FROM n""",
    "q_term_hits": "WITH d AS (SELECT lower(coalesce(text, '')) AS t FROM documents) SELECT array_to_string(list_filter(['license', 'the', 'que', 'die', 'mit', 'rights reserved'], lambda x: regexp_matches(t, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])')), ',') AS found, count(*) AS documents FROM d GROUP BY 1",
    "q_state_codes": f"""WITH a AS (SELECT n_nationkey, lower(([{', '.join(f"'{a}'" for a in ADDRESSES)}])[n_nationkey % 8 + 1]) AS t FROM nation)
        SELECT n_nationkey, {', '.join(f"regexp_matches(t, ',\\s*{c}\\b|\\b{c}\\s+[0-9]{{5}}\\b" + ("" if c in text.CODES_THAT_ARE_WORDS else f"|(in|near)\\s+{c}\\b") + f"') AS in_{c}" for c in ('nj', 'ny', 'in', 'or', 'co', 'tx'))} FROM a""",
    "q_lenient_json": "SELECT event_type, count(*) AS n, count(props->>'$.k') AS read, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1",
}
ORACLES["q_stream_lanes"] = ORACLES["q_lane_breaker"]
