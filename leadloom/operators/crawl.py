"""A crawl over pages and links, round by round, that gives up branches after empty pages.

A round takes all pages of the frontier side by side, in the order in which a queue would. Each branch (a listing, whatever page of it) keeps a streak of
pages without finds; a page's links are followed while its branch's streak, up to and with the page, is at most `patience`. Links to pages that were
visited are dropped, so circles end. Links are joined once a round; what they lead to, visited pages and streaks are written in each round, so a lost
executor costs one round; streaks are counted by ranges of the round's order, so no branch has to fit one task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import ranges


def streaks(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows (branch, ord, found) with the streak of empty pages of their branch up to and with them, going on from state (branch, streak). ord is of ranges.numbered()."""
    since = ranges.since_numbered(rows.withColumn("__hit", F.col("found") > 0), ["branch"], "ord", "__hit")
    carried = state.select(F.col("branch").alias("__branch"), F.col("streak").alias("__carry"))
    joined = since.join(carried, F.col("branch").eqNullSafe(F.col("__branch")), "left")
    streak = F.col("since") + F.when(F.col("any_hit"), 0).otherwise(F.coalesce("__carry", F.lit(0)))
    return joined.withColumn("streak", streak).drop("__hit", "since", "any_hit", "__branch", "__carry")


def crawled(pages: DataFrame, links: DataFrame, seeds: DataFrame, patience: int = 3, rounds: int | None = None) -> DataFrame:
    """url, round, ord (order within it), branch, found and streak of each visited page.

    pages: distinct url, branch, found (finds on it); links: url, place (order on the page), target; seeds: url, place. A repeated seed or link counts at its first place;
    what is not among pages is not visited. Without rounds the crawl goes on until no links are left; with them it ends after so many.
    """
    known = pages.select("url", F.col("branch").cast("string").alias("branch"), "found")
    fresh = ranges.settled(seeds.groupBy("url").agg(F.min("place").alias("place")).join(known, "url").withColumn("of", F.lit(0).cast("long")))
    state = pages.sparkSession.createDataFrame([], "branch string, streak long")
    visited, number = None, 0
    while (rounds is None or number < rounds) and (n := fresh.count()):
        frontier = ranges.numbered(fresh, ["of", "place", "url"], "ord", n)
        now = ranges.settled(streaks(frontier, state).select("url", F.lit(number).alias("round"), "ord", "branch", "found", "streak"))
        ranges.discard(fresh, frontier)
        visited = now if visited is None else visited.union(now)
        last = now.groupBy("branch").agg(F.max_by("streak", "ord").alias("streak"))
        state = ranges.settled(last.union(state.join(last.select(F.col("branch").alias("__b")), F.col("branch").eqNullSafe(F.col("__b")), "left_anti")))
        targets = now.filter(F.col("streak") <= patience).select("url", "ord").join(links, "url").groupBy(F.col("target").alias("url")).agg(F.min(F.struct("ord", "place")).alias("at"))
        unseen = targets.select("url", F.col("at.ord").alias("of"), F.col("at.place").alias("place")).join(visited.select("url"), "url", "left_anti")
        fresh = ranges.settled(unseen.join(known, "url"))
        number += 1
    if visited is None:
        return pages.limit(0).select("url", F.lit(0).alias("round"), F.lit(0).cast("long").alias("ord"), F.col("branch").cast("string").alias("branch"), "found", F.lit(0).cast("long").alias("streak"))
    return visited
