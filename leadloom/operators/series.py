"""Dense series, streaks and gaps over ordered events."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_days(counts: DataFrame, day: str, last: Column, n: int, measures: list[str]) -> DataFrame:
    """Exactly n days up to `last`, zero where counts has none."""
    spine = counts.agg(last.alias("__last")).select(F.explode(F.sequence(F.date_sub("__last", n - 1), F.col("__last"))).alias("__day"))
    joined = F.broadcast(spine).join(counts, F.col("__day") == F.col(day), "left")
    return joined.select(F.col("__day").alias(day), *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def streaks(df: DataFrame, keys: list[str], hit: Column, *order: Column) -> DataFrame:
    """Runs of rows for which `hit` holds: first and last place and length."""
    by = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__hit", hit).withColumn("__n", F.row_number().over(by))
    own = Window.partitionBy(*keys, "__hit").orderBy("__n")
    runs = marked.withColumn("__run", F.col("__n") - F.row_number().over(own)).filter("__hit")
    return runs.groupBy(*keys, "__run").agg(F.min("__n").alias("first_n"), F.max("__n").alias("last_n"), F.count("*").alias("length")).drop("__run")


def repeats_previous(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """Marks rows whose value is that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("repeats", F.coalesce(before == F.col(value), F.lit(False)))


def zero_filled(counts: DataFrame, key: str, domain: list[str], n: str) -> DataFrame:
    """A row for every value of a fixed domain."""
    spine = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    return F.broadcast(spine).join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).alias(n))
