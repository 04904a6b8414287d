"""Sinks: exports and keyed tables in versioned folders."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators import dedup

#: Sheet colours by status.
COLOURS = {"To contact": "white", "Contacted": "yellow", "Replied": "green", "Re-contact": "orange", "Won": "blue"}


def export_csv(df: DataFrame, path: str, cut: dict[str, int], order: Column) -> None:
    """One CSV with a header in order, long texts cut."""
    texts = {c: F.substring(c, 1, n) for c, n in cut.items()}
    df.orderBy(order).select(*[texts.get(c, F.col(c)).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def replace_all(df: DataFrame, path: str, keys: list[str], order: str) -> None:
    """The table replaced by df, the last row of each key."""
    dedup.latest_per_key(df, keys, order).write.mode("overwrite").parquet(path)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str, path: str, skip_existing: bool = False) -> None:
    """Old and new rows by key into a new path; new rows win unless existing ones are to be left alone. Never the path that old is read from."""
    new = new.withColumn("__new", F.lit(0 if skip_existing else 2))
    rows = new if old is None else old.withColumn("__new", F.lit(1)).unionByName(new)
    dedup.latest_per_key(rows, keys, "__new", order).drop("__new").write.parquet(path)


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose keys are in gone."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def status_colour(status: Column, replied: Column) -> Column:
    """A row's colour; a note of a reply makes early stages count as replied."""
    shown = F.when(replied & status.isin("To contact", "Contacted"), "Replied").otherwise(status)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), shown), F.lit("white"))
