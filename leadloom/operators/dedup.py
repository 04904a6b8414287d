"""Order-preserving de-duplication and entity matching."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by order columns. An aggregate with partial results in each task, not a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by order columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: Column, cap: int | None = None) -> DataFrame:
    """Distinct values of each key in order of first occurrence, the first `cap` of them, as `values`."""
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("__at"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda s: s[value])
    return firsts.groupBy(*keys).agg((F.slice(values, 1, cap) if cap else values).alias("values"))


def priority_match(rows: DataFrame, known: DataFrame, row_id: str, known_id: str, keys: list[str]) -> DataFrame:
    """For each row the known id by the first of several keys that hits; of several known rows with a key the lowest id counts.

    Each key is an equi-join of its own on distinct keys; blank keys never match.
    """
    found = rows
    for n, key in enumerate(keys):
        index = known.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias("__key")).agg(F.min(known_id).alias(f"__hit{n}"))
        found = found.join(index, F.col(key) == F.col("__key"), "left").drop("__key")
    hits = [f"__hit{n}" for n in range(len(keys))]
    how = reduce(lambda c, n: F.when(F.col(hits[n]).isNotNull(), keys[n]).otherwise(c), reversed(range(len(keys))), F.lit(None).cast("string"))
    return found.withColumn("match_id", F.coalesce(*hits)).withColumn("match_key", how).drop(*hits)


def without_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the keys with known rows; blank keys never match."""
    for key in keys:
        seen = known.filter(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(key).alias("__key")).distinct()
        rows = rows.join(seen, F.col(key) == F.col("__key"), "left_anti")
    return rows
