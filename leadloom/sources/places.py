"""Place lists: a nested Parquet data set by release and cell, its scan in a box, tiles, one row for each site, and results kept for a while."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import url

#: Least confidence of a place, states in which it is closed, and the share of a box added on each side.
LEAST_CONFIDENCE, CLOSED, PADDING = 0.2, ("closed", "permanently_closed", "temporarily_closed"), 0.1

Box = tuple[float, float, float, float]


def padded(box: Box, share: float = PADDING) -> Box:
    """A box (south, west, north, east) with a share of its sides added on each side."""
    south, west, north, east = box
    high, wide = (north - south) * share, (east - west) * share
    return south - high, west - wide, north + high, east + wide


def tiles(box: Box, n: int) -> list[Box]:
    """n by n tiles of a box, row by row from the south-west; a box without extent is its own tile."""
    south, west, north, east = box
    if n <= 1 or not any(box) or south >= north or west >= east:
        return [box]
    high, wide = (north - south) / n, (east - west) / n
    return [(south + i * high, west + j * wide, south + (i + 1) * high, west + (j + 1) * wide) for i in range(n) for j in range(n)]


def tile_of(box: Box, n: int, lat: Column, lon: Column) -> Column:
    """The number of the tile that a point lies in, by arithmetic instead of a join; null outside the box. The far edges belong to the last tiles."""
    south, west, north, east = box
    at = lambda x, low, high: F.least(F.lit(n - 1), F.floor((x - low) / ((high - low) / n)))
    return F.when(lat.between(south, north) & lon.between(west, east), at(lat, south, north) * n + at(lon, west, east)).cast("long")


#: Degrees of a cell's sides.
CELL = 30.0


def cell_of(lat: Column, lon: Column) -> Column:
    """The number of the cell of CELL degrees that a point lies in."""
    return (F.floor((lat + 90) / CELL) * 100 + F.floor((lon + 180) / CELL)).cast("int")


def cells_of(box: Box) -> list[int]:
    """The cells that a box touches: at most those of the globe."""
    south, west, north, east = box
    at = lambda x, shift: math.floor((x + shift) / CELL)
    return [i * 100 + j for i in range(at(south, 90), at(north, 90) + 1) for j in range(at(west, 180), at(east, 180) + 1)]


def write_places(places: DataFrame, path: str, release: str) -> None:
    """Add a release to a data set of places: a folder for each release and cell, rows within it in order of latitude and longitude.

    A folder's rows may be in several files, so a crowded cell is written by several tasks; their value ranges let a scan pass over row groups.
    """
    placed = places.withColumn("release", F.lit(release)).withColumn("cell", cell_of(F.col("bbox.ymin"), F.col("bbox.xmin")))
    ordered = placed.repartitionByRange("cell", "bbox.ymin", "bbox.xmin").sortWithinPartitions("cell", "bbox.ymin", "bbox.xmin")
    ordered.write.mode("append").partitionBy("release", "cell").parquet(path)


#: What a scan reads of a place, of older and newer releases; what a release lacks is null.
PLACE = (
    "names struct<primary string>, categories struct<primary string>, taxonomy struct<primary string>, websites array<string>, emails array<string>, phones array<string>, addresses array<struct<freeform string, locality string, region string>>, "
    "bbox struct<xmin double, ymin double>, brand struct<names struct<primary string>>, operating_status string, confidence double, id string, release string, cell int"
)


def read_places(spark: SparkSession, path: str, release: str | None = None, box: Box | None = None) -> DataFrame:
    """Places of a data set, of one release and the cells that a box touches if these are given. The schema is stated, so no file is opened for it."""
    rows = spark.read.option("basePath", path).schema(PLACE).parquet(path)
    if release is not None:
        rows = rows.filter(F.col("release") == release)
    return rows if box is None else rows.filter(F.col("cell").isin(cells_of(box)))


def category(places: DataFrame) -> Column:
    """The kind of a place: newer releases name the field taxonomy.primary, older ones categories.primary; of both the newer counts."""
    named = [F.col(f"{c}.primary") for c in ("taxonomy", "categories") if c in places.columns]
    return F.coalesce(*named)


def in_box(places: DataFrame, box: Box, categories: list[str]) -> DataFrame:
    """Open, independent places of these kinds with a site in a box. All conditions but the site's reach the scan."""
    south, west, north, east = box
    kind = category(places)
    at = lambda c, field=None: F.get(c, F.lit(0)) if field is None else F.get(c, F.lit(0))[field]
    kept = places.filter(
        F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north) & kind.isin(*categories) & at("websites").isNotNull() & F.col("brand.names.primary").isNull()
        & ~F.coalesce(F.col("operating_status"), F.lit("open")).isin(*CLOSED) & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= LEAST_CONFIDENCE)
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    return kept.select(
        blank(F.col("names.primary")).alias("name"), blank(kind).alias("kind"), blank(at("websites")).alias("website"), blank(at("emails")).alias("email"), blank(at("phones")).alias("phone"),
        blank(at("addresses", "freeform")).alias("street"), blank(at("addresses", "locality")).alias("city"), blank(at("addresses", "region")).alias("region"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"), blank(F.col("id")).alias("id"),
    )


def best_per_site(rows: DataFrame) -> DataFrame:
    """One row for each registrable site: those with an e-mail first, then the surest, then by id."""
    key = F.struct((F.col("email") == "").alias("none"), (-F.col("confidence")).alias("less"), "id")
    every = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(url.registrable(url.host(F.col("website"))).alias("site")).agg(F.min_by(every, key).alias("best"))
    return best.select("site", "best.*")


def cache_key(release: str, box: Box, categories: list[str]) -> Column:
    """The name under which a search's rows are kept, and for how long: see fresh_rows()."""
    return F.md5(F.lit("|".join([release, ",".join(f"{x:.4f}" for x in box), ",".join(sorted(categories))])).cast("binary"))


def keep_rows(rows: DataFrame, path: str, key: Column, now: Column) -> None:
    """Save a search's rows under its key; other keys and earlier rows stay, as their age tells them apart."""
    rows.withColumn("saved_at", now).withColumn("key", key).write.mode("append").partitionBy("key").parquet(path)


def fresh_rows(cache: DataFrame, key: Column, now: Column, days: int = 7) -> DataFrame:
    """Rows of a cache table (key, saved_at, ...) that are not older than `days`, those that were saved last."""
    fresh = cache.filter((F.col("key") == key) & (F.col("saved_at") > now - F.make_dt_interval(F.lit(days))))
    return fresh.join(fresh.agg(F.max("saved_at").alias("saved_at")), "saved_at", "left_semi")
