"""Queries over updates of many rows: answers to messages, notices marked as read, workspace members, summaries of stopped runs."""

from pyspark.sql import functions as F

from leadloom.operators import updates
from leadloom.sources.tables import read

NOW = "2024-02-01 00:00:00"
ACTIONS = {"click": "acknowledge", "view": "dismiss", "purchase": "reply"}
STOPS = {"error": "The source failed.", "view": "Nothing new was found.", "click": "The limit was reached."}


def delivery_states(spark, sf_dir):
    """Where the answers of a user's day leave its message: a day of events is a delivery, odd users' messages require an answer."""
    action = F.coalesce(*[F.when(F.col("event_type") == k, a) for k, a in ACTIONS.items()], F.lit("open"))
    body = F.when(F.col("value") >= 30, F.concat(F.lit(" ok "), F.col("event_id"))).otherwise(" x ")
    rows = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), action.alias("action"), body.alias("body"), F.when(F.col("user_id") % 2 == 1, "action_required").otherwise("info").alias("severity"), "ts", "event_id")
    return updates.answered(rows, ["user_id", "day"], "action", "body", "severity", "ts", "event_id").select("user_id", "day", "status", F.col("event_id").alias("resolved_by"))


def marked_read(spark, sf_dir):
    """Notices of every tenth user marked as read: how many changed and how many are read now, by kind."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("value") < 20, F.col("ts")).alias("read_at"))
    done = updates.marked_read(rows, F.col("user_id") % 10 == 0, F.lit(NOW).cast("timestamp_ntz"))
    return done.groupBy("event_type").agg(F.count(F.when(F.col("changed"), 1)).alias("n_changed"), F.count("read_at").alias("n_read"), F.count("*").alias("n"))


def workspace_members(spark, sf_dir):
    """Owner (blank where unknown) and members of each workspace (supplier)."""
    spaces = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 2000).alias("owner"))
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.concat(F.lower("c_name"), F.lit("@x.example")).alias("email"))
    owners = spaces.join(users, "owner", "left").select("s_suppkey", F.col("owner").alias("user_id"), F.coalesce("email", F.lit("")).alias("email"), F.lit("owner").alias("role"))
    members = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 997).alias("s_suppkey"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("m"), F.col("o_custkey"), F.lit("@x.example")).alias("email"), F.when(F.col("o_orderstatus") == "O", "admin").otherwise("member").alias("role"))
    return owners.union(members.join(spaces, "s_suppkey", "left_semi").distinct())


def stop_summaries(spark, sf_dir):
    """Why each user's run stopped, by source in order of names, and what it saved."""
    rows = read(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 3).alias("source")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("reason"), F.count(F.when(F.col("value") >= 60, 1)).alias("saved"))
    runs = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("source "), F.col("source")).alias("name"), "reason"))).alias("reasons"), F.sum("saved").alias("saved"))
    return runs.select("user_id", updates.stop_summary(F.col("reasons"), F.col("user_id") % 4, F.col("saved"), STOPS).alias("summary"))


QUERIES = {"q_delivery_states": delivery_states, "q_mark_all_read": marked_read, "q_workspace_members": workspace_members, "q_stop_summaries": stop_summaries}

ORACLES = {
    "q_delivery_states": """WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts, event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN value >= 30 THEN 'replied' END WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'dismissed' END END AS s FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s = 'replied' DESC NULLS LAST, s IS NULL, CASE WHEN s = 'replied' THEN -epoch_us(ts) ELSE epoch_us(ts) END, CASE WHEN s = 'replied' THEN -event_id ELSE event_id END) AS n FROM e)
        SELECT user_id, day, coalesce(s, 'pending_popup') AS status, CASE WHEN s IS NOT NULL THEN event_id END AS resolved_by FROM r WHERE n = 1""",
    "q_mark_all_read": "SELECT event_type, count(*) FILTER (user_id % 10 = 0 AND NOT coalesce(value < 20, false)) AS n_changed, count(*) FILTER (user_id % 10 = 0 OR value < 20) AS n_read, count(*) AS n FROM events GROUP BY 1",
    "q_workspace_members": """WITH s AS (SELECT s_suppkey, s_suppkey * 37 % 2000 AS owner FROM supplier) SELECT s_suppkey, owner AS user_id, coalesce(lower(c_name) || '@x.example', '') AS email, 'owner' AS role FROM s LEFT JOIN customer ON c_custkey = owner
        UNION ALL SELECT DISTINCT o_orderkey % 997, o_custkey, 'm' || o_custkey || '@x.example', CASE WHEN o_orderstatus = 'O' THEN 'admin' ELSE 'member' END FROM orders WHERE o_orderkey % 997 IN (SELECT s_suppkey FROM s)""",
    "q_stop_summaries": f"""WITH r AS (SELECT user_id, event_id % 3 AS source, arg_min(event_type, (ts, event_id)) AS reason, count(*) FILTER (value >= 60) AS saved FROM events GROUP BY ALL),
        t AS (SELECT user_id, string_agg('source ' || source || ': ' || CASE reason {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STOPS.items())} ELSE reason END, ' ' ORDER BY source) AS parts, sum(saved) AS saved FROM r GROUP BY 1)
        SELECT user_id, parts || CASE WHEN saved > 0 THEN ' Saved ' || CAST(saved AS BIGINT) || ' new leads.' ELSE ' No new leads were saved.' END || CASE WHEN user_id % 4 = 0 THEN ' No search request was sent.' ELSE '' END AS summary FROM t""",
}
