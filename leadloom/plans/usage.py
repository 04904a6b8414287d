"""Queries over the usage ledger: daily totals, limits, alerts, gaps and streaks."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import scoring
from leadloom.operators import series
from leadloom.sources.tables import read

KINDS = ("view", "click", "purchase", "signup", "error")
#: Daily caps of the harness by plan; user ids decide the plan.
CAPS = {"free": 2, "pilot": 3}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def daily_pivot(spark, sf_dir):
    """Events of each kind by day."""
    return ledger(spark, sf_dir).groupBy(F.col("day").cast("string").alias("day")).agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(f"n_{k}") for k in KINDS], F.count("*").alias("n"))


def dense_week(spark, sf_dir):
    """Errors of the ledger's last seven days, zero where a day has none."""
    errors = ledger(spark, sf_dir)
    counts = errors.groupBy("day").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.max("k").alias("top_k"))
    return series.dense_days(counts, "day", F.max("day"), 7, ["errors", "top_k"]).withColumn("day", F.col("day").cast("string"))


def top_users(spark, sf_dir):
    """The eight users with most events on the ledger's last day."""
    rows = ledger(spark, sf_dir)
    last = rows.agg(F.max("day").alias("day"))
    today = rows.join(F.broadcast(last), "day").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))
    return today.orderBy(F.desc("n"), "user_id").limit(8)


def plan_of(user):
    return F.when(user % 3 == 0, "free").when(user % 3 == 1, "pilot")


def used(spark, sf_dir) -> DataFrame:
    """Use by user, day and kind with its effective limit: bypass, override, plan, default."""
    rows = ledger(spark, sf_dir).groupBy("user_id", "day", "event_type").agg(F.count("*").alias("used"), F.min("ts").alias("first_ts"))
    caps = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    limit = scoring.effective_limit(F.col("user_id") == 1, F.when(F.col("user_id") == 2, 1).otherwise(-1), F.try_element_at(caps, plan_of(F.col("user_id"))), 4)
    return rows.withColumn("limit", limit)


def limit_remaining(spark, sf_dir):
    """What is left of each user's limits, counted."""
    rows = used(spark, sf_dir).select("event_type", F.least(F.lit(10), scoring.remaining(F.col("limit"), F.col("used"))).alias("left"), (F.col("used") > F.col("limit")).alias("over"))
    return rows.groupBy("event_type", "left", "over").agg(F.count("*").alias("n"))


def alerts(spark, sf_dir):
    """One alert a user, day and level: low at four fifths of a limit, exhausted at all of it."""
    rows = used(spark, sf_dir).filter(F.col("used") >= 0.8 * F.col("limit")).withColumn("level", F.when(F.col("used") >= F.col("limit"), "exhausted").otherwise("low"))
    return rows.groupBy("user_id", F.col("day").cast("string").alias("day"), "level").agg(F.count("*").alias("kinds"), F.min("event_type").alias("first_kind"))


def monthly_ledger(spark, sf_dir):
    """Each user's calls of a month up to a cap of fifty, and how many were refused."""
    rows = ledger(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("asked"))
    return rows.select("user_id", "month", F.least("asked", F.lit(50)).alias("granted"), F.greatest(F.col("asked") - 50, F.lit(0)).alias("refused"))


def stale_jobs(spark, sf_dir):
    """Users whose last event lies more than an hour before the ledger's end, with how long they have been silent."""
    rows = ledger(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"))
    end = rows.agg(F.max("last").alias("end"))
    silent = rows.join(F.broadcast(end), F.col("last") <= F.col("end"))
    seconds = F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return silent.select("user_id", seconds.alias("silent_s")).filter("silent_s >= 3600")


def gap_exhaustion(spark, sf_dir):
    """Runs of three or more errors of a user in a row, among its ordered events."""
    runs = series.streaks(ledger(spark, sf_dir), ["user_id"], F.col("event_type") == "error", F.col("ts"), F.col("event_id"))
    return runs.filter("length >= 3").select("user_id", F.col("first_n").cast("long").alias("first_n"), F.col("last_n").cast("long").alias("last_n"), "length")


def streak_islands(spark, sf_dir):
    """The longest run of days with a purchase for each user."""
    days = ledger(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "day").distinct()
    runs = days.withColumn("run", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))))
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


def sessions(spark, sf_dir):
    """Sessions that end after six hours of silence: number, longest and most events."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lag(F.unix_timestamp(F.col("ts").cast("timestamp"))).over(own)
    rows = ledger(spark, sf_dir).withColumn("starts", F.coalesce(gap > 21_600, F.lit(True)).cast("int")).withColumn("session", F.sum("starts").over(own))
    per = rows.groupBy("user_id", "session").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("most_events"))


def active_users(spark, sf_dir):
    """Distinct users with an event by day, and the running count of users ever seen."""
    rows = ledger(spark, sf_dir)
    firsts = rows.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("new_users"))
    days = rows.groupBy("day").agg(F.countDistinct("user_id").alias("active")).join(firsts, "day", "left")
    return days.select(F.col("day").cast("string").alias("day"), "active", F.coalesce("new_users", F.lit(0)).alias("new_users"))


def status_pages(spark, sf_dir):
    """Progress in percent of each user's run, by its share of kinds and of fifty events."""
    rows = ledger(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n"))
    return rows.select("user_id", scoring.progress(F.least(F.lit(1.0), F.col("n") / 50), F.col("kinds") / 5).alias("percent"))


QUERIES = {
    "q_usage_daily_pivot": daily_pivot, "q_usage_dense_series_7d": dense_week, "q_top_users_today": top_users, "q_limit_remaining": limit_remaining, "q_alerts_once_per_day": alerts,
    "q_monthly_ledger_cap": monthly_ledger, "q_stale_jobs": stale_jobs, "q_gap_exhaustion": gap_exhaustion, "q_streak_islands": streak_islands, "q_sessions": sessions,
    "q_active_users": active_users, "q_progress": status_pages,
}

_E = "WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"
_LIMIT = f"CASE WHEN user_id = 1 THEN 999999 WHEN user_id = 2 THEN 1 WHEN user_id % 3 = 0 THEN {CAPS['free']} WHEN user_id % 3 = 1 THEN {CAPS['pilot']} ELSE 4 END"
_USED = f"{_E}, u AS (SELECT user_id, day, event_type, count(*) AS used, CAST({_LIMIT} AS BIGINT) AS cap FROM e GROUP BY ALL)"

ORACLES = {
    "q_usage_daily_pivot": f"{_E} SELECT CAST(day AS VARCHAR) AS day, {', '.join(f'''count(*) FILTER (event_type = '{k}') AS n_{k}''' for k in KINDS)}, count(*) AS n FROM e GROUP BY 1",
    "q_usage_dense_series_7d": f"{_E}, m AS (SELECT max(day) AS last FROM e), s AS (SELECT CAST(unnest(generate_series(last - INTERVAL 6 DAY, last, INTERVAL 1 DAY)) AS DATE) AS day FROM m), c AS (SELECT day, count(*) FILTER (event_type = 'error') AS errors, max(k) AS top_k FROM e GROUP BY day) SELECT CAST(day AS VARCHAR) AS day, coalesce(errors, 0) AS errors, coalesce(top_k, 0) AS top_k FROM s LEFT JOIN c USING (day)",
    "q_top_users_today": f"{_E} SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM e WHERE day = (SELECT max(day) FROM e) GROUP BY user_id ORDER BY n DESC, user_id LIMIT 8",
    "q_limit_remaining": f"{_USED} SELECT event_type, least(10, greatest(0, cap - used)) AS left, used > cap AS over, count(*) AS n FROM u GROUP BY ALL",
    "q_alerts_once_per_day": f"{_USED} SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN used >= cap THEN 'exhausted' ELSE 'low' END AS level, count(*) AS kinds, min(event_type) AS first_kind FROM u WHERE used >= 0.8 * cap GROUP BY 1, 2, 3",
    "q_monthly_ledger_cap": "WITH m AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS asked FROM events GROUP BY ALL) SELECT user_id, month, least(asked, 50) AS granted, greatest(asked - 50, 0) AS refused FROM m",
    "q_stale_jobs": "WITH l AS (SELECT user_id, date_trunc('second', max(ts)) AS last FROM events GROUP BY 1), s AS (SELECT user_id, CAST(epoch((SELECT max(last) FROM l)) - epoch(last) AS BIGINT) AS silent_s FROM l) SELECT * FROM s WHERE silent_s >= 3600",
    "q_gap_exhaustion": "WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM n WHERE event_type = 'error') SELECT user_id, min(n) AS first_n, max(n) AS last_n, count(*) AS length FROM g GROUP BY user_id, run HAVING count(*) >= 3",
    "q_streak_islands": f"{_E}, d AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase'), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d), c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) AS longest FROM c GROUP BY user_id",
    "q_sessions": "WITH t AS (SELECT user_id, event_id, ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events), g AS (SELECT *, CASE WHEN coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600, true) THEN 1 ELSE 0 END AS starts FROM t), n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g), c AS (SELECT user_id, session, count(*) AS n FROM n GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS most_events FROM c GROUP BY user_id",
    "q_active_users": f"{_E}, f AS (SELECT day, count(*) AS new_users FROM (SELECT user_id, min(day) AS day FROM e GROUP BY 1) GROUP BY day), d AS (SELECT day, count(DISTINCT user_id) AS active FROM e GROUP BY day) SELECT CAST(day AS VARCHAR) AS day, active, coalesce(new_users, 0) AS new_users FROM d LEFT JOIN f USING (day)",
    "q_progress": "WITH u AS (SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CAST(greatest(5, least(95, 8 + floor(80::DOUBLE * (0.7::DOUBLE * least(1.0::DOUBLE, n / 50) + 0.3::DOUBLE * (kinds / 5))))) AS BIGINT) AS percent FROM u",
}
