"""Queries over mail threads and drafts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import scoring, text
from leadloom.sources.tables import read

#: Openers and clichés that a draft should not have.
OPENERS = ("i hope you're doing well", "i hope this email finds you", "my name is", "i came across your", "i was impressed by", "congratulations on", "i noticed your company")
CLICHES = ("synergy", "revolutionize", "game-changing", "cutting-edge", "leverage", "seamless", "delve", "landscape", "elevate your", "unlock", "transform your", "robust solution")
TEMPLATE = "Hello {{name}}, about thread {{ID}}: {{excerpt}} {{unknown}}"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def first_reply(spark, sf_dir):
    """The first assistant turn after the first user turn of each thread."""
    t = turns(spark, sf_dir)
    asked = t.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("asked"))
    later = t.filter("role = 'assistant'").join(asked, "conv_id").filter("turn > asked")
    return later.groupBy("conv_id").agg(F.min("turn").alias("reply_turn"), F.length(F.min_by("text", "turn")).cast("long").alias("chars"))


def unanswered(spark, sf_dir):
    """Threads whose last turn is the user's, by number of turns."""
    last = turns(spark, sf_dir).groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.count("*").alias("turns"))
    return last.groupBy("turns").agg(F.count("*").alias("threads"), F.count(F.when(F.col("role") == "user", 1)).alias("open"))


def template_fill(spark, sf_dir):
    """A message for each thread from a template; unknown keys stay as they are."""
    first = turns(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.min_by("role", "turn").alias("role"))
    return first.select("conv_id", text.filled(TEMPLATE, name=F.initcap("role"), id=F.col("conv_id"), excerpt=F.substring("text", 1, 20)).alias("message"))


def draft_flags(spark, sf_dir):
    """Quality issues of assistant turns as drafts, counted."""
    d = turns(spark, sf_dir).filter("role = 'assistant'").select("text", F.lower("text").alias("t"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^ \n\t]+)"), F.lit(1)))
    letters, capitals = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")), F.length(F.regexp_replace("text", "[^A-Z]", ""))
    flags = {
        "too_short": words < 70, "too_long": words > 280, "opener": scoring.any_of(F.col("t"), tuple(f"^{o}" for o in OPENERS)), "cliche": scoring.any_of(F.col("t"), CLICHES),
        "shouting": (letters > 20) & (capitals * 4 > letters * 3), "link": F.col("t").contains("http"), "wall_of_text": (words > 120) & ~F.col("text").contains("\n"),
    }
    return d.agg(F.count("*").alias("drafts"), *[F.count(F.when(c, 1)).alias(n) for n, c in flags.items()])


def role_stats(spark, sf_dir):
    """Turns and characters by role."""
    return turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.countDistinct("conv_id").alias("threads"))


def deliveries(spark, sf_dir):
    """System turns as messages to every thread's roles: deliveries in all and those still pending (no later assistant turn)."""
    t = turns(spark, sf_dir)
    sent = t.filter("role = 'system'").select("conv_id", F.col("turn").alias("sent"))
    last = t.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("answered"))
    return sent.join(last, "conv_id", "left").agg(F.count("*").alias("deliveries"), F.count(F.when(F.coalesce("answered", F.lit(-1)) < F.col("sent"), 1)).alias("pending"))


QUERIES = {
    "q_first_reply_after_outbound": first_reply, "q_unanswered_threads": unanswered, "q_template_fill": template_fill, "q_draft_quality_flags": draft_flags, "q_role_stats": role_stats, "q_delivery_counts": deliveries,
}


def _any(patterns):
    return f"regexp_matches(t, '{'|'.join('(?:' + p.replace(chr(39), chr(39) * 2) + ')' for p in patterns)}')"


_WORDS = r"len(regexp_extract_all(text, '([^ \n\t]+)', 1))"

ORACLES = {
    "q_first_reply_after_outbound": "WITH a AS (SELECT conv_id, min(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, min(turn) AS reply_turn, length(arg_min(text, turn)) AS chars FROM conversations JOIN a USING (conv_id) WHERE role = 'assistant' AND turn > asked GROUP BY conv_id",
    "q_unanswered_threads": "WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, count(*) AS turns FROM conversations GROUP BY 1) SELECT turns, count(*) AS threads, count(*) FILTER (role = 'user') AS open FROM l GROUP BY turns",
    "q_template_fill": "WITH f AS (SELECT conv_id, arg_min(text, turn) AS text, arg_min(role, turn) AS role FROM conversations GROUP BY 1) SELECT conv_id, 'Hello ' || upper(role[1]) || lower(role[2:]) || ', about thread ' || conv_id || ': ' || substr(text, 1, 20) || ' {{unknown}}' AS message FROM f",
    "q_draft_quality_flags": f"""WITH d AS (SELECT text, lower(text) AS t, {_WORDS} AS w, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM conversations WHERE role = 'assistant')
SELECT count(*) AS drafts, count(*) FILTER (w < 70) AS too_short, count(*) FILTER (w > 280) AS too_long, count(*) FILTER ({_any([f'^{o}' for o in OPENERS])}) AS opener, count(*) FILTER ({_any(CLICHES)}) AS cliche,
count(*) FILTER (letters > 20 AND capitals * 4 > letters * 3) AS shouting, count(*) FILTER (t LIKE '%http%') AS link, count(*) FILTER (w > 120 AND text NOT LIKE '%' || chr(10) || '%') AS wall_of_text FROM d""",
    "q_role_stats": "SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT conv_id) AS threads FROM conversations GROUP BY role",
    "q_delivery_counts": "WITH s AS (SELECT conv_id, turn AS sent FROM conversations WHERE role = 'system'), l AS (SELECT conv_id, max(turn) AS answered FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT count(*) AS deliveries, count(*) FILTER (coalesce(answered, -1) < sent) AS pending FROM s LEFT JOIN l USING (conv_id)",
}
