"""Merges of new rows into remembered ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_regressing(old: DataFrame, new: DataFrame, key: str, rank: dict[str, int], status: str, keep_if_set: list[str], newer: list[str]) -> DataFrame:
    """Old and new rows by key: the status never falls in rank, `keep_if_set` columns keep what they have, `newer` ones take what is not blank."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    order = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), c), F.lit(-1))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    pick = F.when(order(F.col(f"n.{status}")) > order(F.col(f"o.{status}")), F.col(f"n.{status}")).otherwise(F.coalesce(F.col(f"o.{status}"), F.col(f"n.{status}")))
    kept = [F.when(blank(F.col(f"o.{c}")), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in keep_if_set]
    taken = [F.when(blank(F.col(f"n.{c}")), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in newer]
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), pick.alias(status), *kept, *taken)


def fill_if_empty(value: Column, other: Column) -> Column:
    """A blank value takes the other."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) == "", other).otherwise(value)


def both_sides(left: DataFrame, right: DataFrame, key: str, **sides: str) -> DataFrame:
    """Every key of either side, the missing side null."""
    return left.join(right, key, "full")
