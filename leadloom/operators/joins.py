"""Joins on ranges and containment as equi-joins with a check."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(rows: DataFrame, value: str, bands: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows with the bands (low <= value <= high) that hold them: both are dealt by grid cells of `width`, so no row meets all bands."""
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    dealt = bands.withColumn("__cell", F.explode(cells))
    return rows.withColumn("__cell", F.floor(F.col(value) / width)).join(dealt, "__cell").filter(F.col(value).between(F.col(low), F.col(high))).drop("__cell")


def contains_word(rows: DataFrame, words: Column, wanted: DataFrame, word: str) -> DataFrame:
    """Rows with each wanted word among their words, by equality on words."""
    return rows.withColumn(word, F.explode(F.array_distinct(words))).join(wanted, word)


def priority_cross(left: DataFrame, right: DataFrame, left_order: str, right_order: str, cap: int, diagonal: bool = False) -> DataFrame:
    """The first `cap` pairs, right by right or along anti-diagonals. Only the first `cap` rows of a side can be in them, so two capped lists are paired."""
    a = left.orderBy(left_order).limit(cap).withColumn("__i", F.row_number().over(_by(left_order)) - 1)
    b = right.orderBy(right_order).limit(cap).withColumn("__j", F.row_number().over(_by(right_order)) - 1)
    order = [F.col("__i") + F.col("__j"), F.col("__j")] if diagonal else [F.col("__j"), F.col("__i")]
    reach = F.col("__i") + F.col("__j") < cap if diagonal else F.lit(True)
    pairs = a.withColumn("__one", F.lit(1)).join(F.broadcast(b.withColumn("__one", F.lit(1))), "__one").filter(reach)
    return pairs.orderBy(*order).limit(cap).drop("__one", "__i", "__j")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)
