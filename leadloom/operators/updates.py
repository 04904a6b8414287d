"""Updates of many rows as plain columns and aggregates."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest characters of a reply, and the severity that cannot be dismissed.
SHORTEST_REPLY, MUST_ANSWER = 2, "action_required"
#: What a summary says of a run that did not search, saved nothing, or sent no request.
NOT_RUN, NONE_SAVED, NONE_SENT = "The hunt stopped before any search ran.", "No new leads were saved.", "No search request was sent."


def answered(df: DataFrame, keys: list[str], action: str, body: str, severity: str, *order: str) -> DataFrame:
    """The state in which a log of answers leaves each message, with the order columns of the answer that decided.

    A reply that is long enough counts at any time, the last one deciding; acknowledging and dismissing only count while
    a message is pending, so the first of them decides if there is no reply. Anything else leaves it pending.
    """
    reply = (F.col(action) == "reply") & (F.length(F.trim(body)) >= SHORTEST_REPLY)
    closes = (F.col(action) == "acknowledge") | ((F.col(action) == "dismiss") & ~F.col(severity).eqNullSafe(F.lit(MUST_ANSWER)))
    at = F.struct(*order)
    found = df.groupBy(*keys).agg(F.max(F.when(reply, at)).alias("replied"), F.min(F.when(closes, F.struct(*order, action))).alias("closed"))
    status = F.when(F.col("replied").isNotNull(), "replied").when(F.col(f"closed.{action}") == "acknowledge", "acknowledged").when(F.col("closed").isNotNull(), "dismissed").otherwise("pending_popup")
    return found.select(*keys, status.alias("status"), *[F.coalesce(f"replied.{c}", f"closed.{c}").alias(c) for c in order])


def marked_read(df: DataFrame, mine: Column, now: Column) -> DataFrame:
    """df with read_at set on unread rows that are mine; changed tells which."""
    changed = F.coalesce(mine, F.lit(False)) & F.col("read_at").isNull()
    return df.withColumn("changed", changed).withColumn("read_at", F.when(F.col("changed"), now).otherwise(F.col("read_at")))


def stop_summary(reasons: Column, requests: Column, saved: Column, texts: dict[str, str]) -> Column:
    """Sentences on why a run stopped: reasons is an array of (name, reason); a reason without a text stands for itself."""
    said = lambda r: reduce(lambda c, kv: F.when(r["reason"] == kv[0], kv[1]).otherwise(c), texts.items(), r["reason"])
    parts = F.transform(reasons, lambda r: F.concat(r["name"], F.lit(": "), said(r)))
    result = F.when(saved > 0, F.concat(F.lit("Saved "), saved, F.lit(" new leads."))).otherwise(NONE_SAVED)
    ending = F.when(requests == 0, F.array(F.lit(NONE_SENT))).otherwise(F.array().cast("array<string>"))
    return F.when((F.size(reasons) == 0) & (requests == 0), NOT_RUN).otherwise(F.array_join(F.concat(parts, F.array(result), ending), " "))
