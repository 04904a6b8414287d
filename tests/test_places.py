import re

import pytest
from pyspark.sql import functions as F

from leadloom.plans import places as plans
from leadloom.sources import places

BOX = (-20.0, -50.0, 30.0, 60.0)


def explained(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def data_set(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('places')}/data"
    rows = plans.place_table(spark, "/root/testdata/sf0.01")
    places.write_places(rows.withColumnRenamed("taxonomy", "categories"), path, "old")
    places.write_places(rows, path, "new")
    return path


@pytest.mark.parametrize("release", ["old", "new"])
def test_scan_of_both_releases_equals_the_plain_table(spark, data_set, release):
    want = places.in_box(plans.place_table(spark, "/root/testdata/sf0.01"), BOX, plans.KINDS)
    got = places.in_box(places.read_places(spark, data_set, release, BOX), BOX, plans.KINDS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_box_reaches_folders_and_row_groups(spark, data_set):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = explained(places.in_box(places.read_places(spark, data_set, "new", BOX), BOX, plans.KINDS))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    folders = re.search(r"PartitionFilters: \[(.*)\], PushedFilters", plan)[1]
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert "release" in folders and "cell" in folders and "new" in folders
    assert "bbox.xmin" in pushed and "bbox.ymin" in pushed
    assert "IsNull(brand.names.primary)" in pushed
    schema = re.search(r"ReadSchema: (.*)", plan)[1]
    assert "phones" in schema and "release" not in schema


def test_only_touched_cells_are_read(spark, data_set):
    def files(df):
        return [f for f in df.inputFiles()]

    every = files(places.read_places(spark, data_set))
    cells = set(places.cells_of(BOX))
    read = places.read_places(spark, data_set, "new", BOX).select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len(read) < len(every) / 2
    assert {int(re.search(r"cell=(\d+)", r.f)[1]) for r in read} <= cells and all("release=new" in r.f for r in read)


def test_cells_cover_their_box(spark):
    points = [(lat / 2, lon / 2) for lat in range(-180, 181, 7) for lon in range(-360, 361, 11)]
    rows = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", places.cell_of(F.col("lat"), F.col("lon")).alias("cell")).collect()
    for box in (BOX, (10.0, 10.0, 10.0, 10.0), (-90.0, -180.0, 90.0, 180.0)):
        south, west, north, east = box
        assert all(r.cell in places.cells_of(box) for r in rows if south <= r.lat <= north and west <= r.lon <= east)


def test_kept_rows_expire(spark, tmp_path):
    path = f"{tmp_path}/kept"
    at = lambda s: F.to_timestamp(F.lit(s))
    key, other = places.cache_key("new", BOX, ["B", "A"]), places.cache_key("old", BOX, ["A", "B"])
    rows = spark.createDataFrame([("x",), ("y",)], "name string")
    places.keep_rows(rows, path, key, at("2025-01-01 00:00:00"))
    places.keep_rows(rows.limit(1), path, key, at("2025-01-05 00:00:00"))
    places.keep_rows(rows, path, other, at("2025-01-05 00:00:00"))
    count = lambda k, now: places.fresh_rows(spark.read.parquet(path), k, at(now)).count()
    assert count(key, "2025-01-06 00:00:00") == 1 and count(key, "2025-01-13 00:00:00") == 0 and count(other, "2025-01-06 00:00:00") == 2
    same = spark.range(1).select(places.cache_key("new", BOX, ["A", "B"]).alias("a"), key.alias("b")).first()
    assert same.a == same.b


def test_tiles_cover_the_box_without_overlap(spark):
    found = places.tiles(BOX, 3)
    assert len(found) == 9 and found[0][:2] == BOX[:2] and found[-1][2:] == pytest.approx(BOX[2:])
    points = [(lat, lon) for lat in (-20.0, -3.0, 12.5, 30.0) for lon in (-50.0, 0.0, 33.0, 60.0)]
    rows = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", places.tile_of(BOX, 3, F.col("lat"), F.col("lon")).alias("tile")).collect()
    for r in rows:
        south, west, north, east = found[r.tile]
        assert south - 1e-9 <= r.lat <= north + 1e-9 and west - 1e-9 <= r.lon <= east + 1e-9
    assert places.tiles((1.0, 1.0, 1.0, 1.0), 4) == [(1.0, 1.0, 1.0, 1.0)]
