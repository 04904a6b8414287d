from pyspark.sql import functions as F

from leadloom.operators import updates


def test_answers_leave_a_message_as_the_rules_say(spark):
    log = [
        ("a", "acknowledge", "", "info", 1), ("a", "dismiss", "", "info", 2),  # the first one closes it
        ("b", "dismiss", None, "action_required", 1),  # not allowed
        ("c", "dismiss", None, None, 1), ("c", "reply", " x ", None, 2),  # too short a reply
        ("d", "reply", "yes", "info", 1), ("d", "acknowledge", "", "info", 2), ("d", "reply", "no", "info", 3),  # a reply counts at any time
        ("e", None, None, None, None),
    ]
    rows = spark.createDataFrame(log, "id string, action string, body string, severity string, at int")
    got = {r.id: (r.status, r["at"]) for r in updates.answered(rows, ["id"], "action", "body", "severity", "at").collect()}
    assert got == {"a": ("acknowledged", 1), "b": ("pending_popup", None), "c": ("dismissed", 1), "d": ("replied", 3), "e": ("pending_popup", None)}
    assert updates.answered(rows.limit(0), ["id"], "action", "body", "severity", "at").isEmpty()


def test_summaries(spark):
    rows = spark.createDataFrame([(1, [], 0, 0), (2, [], 1, 0), (3, [("maps", "limit"), ("web", "odd")], 0, 7)], "id int, reasons array<struct<name: string, reason: string>>, requests int, saved int")
    said = updates.stop_summary(F.col("reasons"), F.col("requests"), F.col("saved"), {"limit": "The limit was reached."})
    got = {r.id: r.s for r in rows.select("id", said.alias("s")).collect()}
    assert got == {1: updates.NOT_RUN, 2: updates.NONE_SAVED, 3: f"maps: The limit was reached. web: odd Saved 7 new leads. {updates.NONE_SENT}"}
