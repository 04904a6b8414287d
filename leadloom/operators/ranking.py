"""Fair, capped and budgeted selections."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(df: DataFrame, bucket: str, order: Column, cap: int) -> DataFrame:
    """The i-th row of each bucket before the next ones of any, buckets in order of their first row; the first `cap`, with `turn`.

    No bucket gives more than `cap` rows, so each is cut before the global order is taken.
    """
    within = Window.partitionBy(bucket).orderBy(order)
    ranked = df.withColumn("turn", F.row_number().over(within)).filter(F.col("turn") <= cap).withColumn("__first", F.min(order).over(Window.partitionBy(bucket)))
    return ranked.orderBy("turn", "__first").limit(cap).drop("__first")


def family_caps(df: DataFrame, family: str, caps: dict[str, int], other: int, order: Column, total: int) -> DataFrame:
    """At most its cap of each family, then at most `total` rows, both in order.

    The largest cap is a literal, so Spark cuts every family before the shuffle; no family is sorted whole.
    """
    cap = F.lit(other)
    for name, n in caps.items():
        cap = F.when(F.col(family) == name, n).otherwise(cap)
    rank = F.row_number().over(Window.partitionBy(family).orderBy(order))
    return df.withColumn("__rank", rank).filter((F.col("__rank") <= max([other, *caps.values()])) & (F.col("__rank") <= cap)).drop("__rank").orderBy(order).limit(total)


def within_budget(df: DataFrame, keys: list[str], cost: str, budget: float, order: Column) -> DataFrame:
    """Rows of each key before its running cost reaches the budget; the row that reaches it is the last."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("spent_before", before).filter(F.col("spent_before") < budget)


def best_or_none(df: DataFrame, keys: list[str], score: str, choice: str, least: float) -> DataFrame:
    """The best choice of each key, the first by name on ties; null below `least`."""
    best = df.groupBy(*keys).agg(F.max(score).alias("__top"), F.min_by(choice, F.struct(-F.col(score), F.col(choice))).alias("__choice"))
    return best.select(*keys, F.col("__top").alias(score), F.when(F.col("__top") >= least, F.col("__choice")).alias(choice))
