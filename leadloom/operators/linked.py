"""Linked data (JSON-LD) in pages, walked level by level over variants.

Every value of every block is a row with its place: blocks in order of the page, then depth, then the positions on the way. A level is
written before the next one is looked at, so each is computed once; in small row groups, as outer levels hold whole documents in a value. A document deeper than `most` levels raises an error; nothing is left out
in silence. Blocks that are no JSON, null pages and pages without blocks give no rows.

nodes() gives only those values that are asked for: each document is walked in its own row, whatever its depth, and nothing but what is found leaves it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contact import clean_email
from leadloom.operators.ranges import settled

BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
MOST = 64


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, block (its number on the page) and value of each block of linked data."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(BLOCK), F.lit(1))).alias("block", "json"))
    return found.select(key, "block", F.try_parse_json(F.trim("json")).alias("value")).filter("value is not null")


def walked(found: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """key, block, depth, path, name and value of every value in blocks. path sorts as positions do; name is null for members of lists."""
    spark = found.sparkSession
    level = settled(found.select(key, "block", F.lit(0).alias("depth"), F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), "value"), long_values=True)
    out = level
    for depth in range(1, most + 2):
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "member", "inner"))
        level = settled(inside.select(key, "block", F.lit(depth).alias("depth"), F.concat("path", F.lpad(F.col("pos").cast("string"), 10, "0")).alias("path"), F.col("member").alias("name"), F.col("inner").alias("value")), long_values=True)
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"linked data deeper than {most} levels")


def inside(value: Column) -> Column:
    """name and value of each member of an object (by name) or a list (in order, without names); none of other values."""
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("value")))
    named = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string, variant>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return F.coalesce(named, listed, F.array().cast("array<struct<name: string, value: variant>>"))


def nodes(found: DataFrame, key: str, wanted: Callable[[Column, Column], Column], most: int = MOST) -> DataFrame:
    """The rows of walked() for whose name and value `wanted` holds, except that path only sorts as there, within a block and depth. Nothing is written."""
    kind = "array<struct<depth: int, name: string, value: variant>>"

    def picked(members: Column, depth: Column) -> Column:
        return F.transform(F.filter(members, lambda m: F.coalesce(wanted(m["name"], m["value"]), F.lit(False))), lambda m: F.struct(depth.alias("depth"), m["name"].alias("name"), m["value"].alias("value")))

    def deeper(so_far: Column, depth: Column) -> Column:
        members = F.flatten(F.transform(so_far["open"], lambda m: inside(m["value"])))
        # bound once; most + 1 levels have no members
        checked = F.transform(F.array(members), lambda m: F.when((depth <= most) | (F.size(m) == 0), m).otherwise(F.raise_error(F.lit(f"linked data deeper than {most} levels"))))
        return F.get(F.transform(checked, lambda m: F.struct(m.alias("open"), F.concat(so_far["picked"], picked(m, depth)).alias("picked"))), F.lit(0))

    root = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("value").alias("value")))
    start = F.struct(root.alias("open"), picked(root, F.lit(0)).cast(kind).alias("picked"))
    all_of = F.aggregate(F.sequence(F.lit(1), F.lit(most + 1)), start, deeper, lambda done: done["picked"])
    rows = found.select(key, "block", F.posexplode(all_of).alias("at", "node"))
    return rows.select(key, "block", "node.depth", F.lpad(F.col("at").cast("string"), 10, "0").alias("path"), "node.name", "node.value")


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def types(value: Column) -> Column:
    """The types of an object, in lower case."""
    listed = F.coalesce(F.try_variant_get(value, "$['@type']", "array<string>"), F.array(text_at(value, "$['@type']")))
    return F.transform(F.array_compact(listed), F.lower)


def first_of(value: Column, *paths: str) -> Column:
    """The first of several places with a text in it, '' without any."""
    return F.coalesce(*[F.nullif(F.trim(text_at(value, p)), F.lit("")) for p in paths], F.lit(""))


def is_product(name: Column, value: Column) -> Column:
    return F.array_contains(types(value), "product")


def is_email(name: Column, value: Column) -> Column:
    return F.lower(name) == "email"


def products(rows: DataFrame, key: str) -> DataFrame:
    """key, place (block, depth, path), name, link, price and image of each product, wherever it stands; of those with one link (or, without any, one name) the first."""
    value = F.col("value")
    some = rows.filter(is_product(F.col("name"), value)).select(
        key, F.struct("block", "depth", "path").alias("place"), first_of(value, "$.name").alias("name"), first_of(value, "$.url", "$['@id']").alias("link"),
        first_of(value, "$.offers.price", "$.offers[0].price").alias("price"), first_of(value, "$.image[0].url", "$.image[0]", "$.image.url", "$.image").alias("image"),
    )
    same = F.lower(F.when(F.col("link") != "", F.col("link")).otherwise(F.col("name")))
    best = some.filter("name != ''").groupBy(key, same.alias("same")).agg(F.min(F.struct("place", "name", "link", "price", "image")).alias("best"))
    return best.select(key, "best.*")


def emails(rows: DataFrame, key: str) -> DataFrame:
    """key and email: usable addresses under the name email, at any depth, each once."""
    found = rows.filter(is_email(F.col("name"), F.col("value"))).select(key, clean_email(text_at(F.col("value"), "$")).alias("email"))
    return found.filter("email is not null").distinct()
