"""Connected components of links by alternating large and small stars; no component is ever held in one place."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import discard, written


def stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a > b): each node's neighbours (the smaller ones only, if small) move to its smallest."""
    sides = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = sides.join(least, "a")
    if small:
        moved = moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (a long, b long). Written."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, old = state, edges
        edges = written(stars(stars(edges, small=False), small=True), "edges")
        discard(old)
    # each edge now leads to its component's smallest node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
