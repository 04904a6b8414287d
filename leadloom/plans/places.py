"""Queries over place lists and company names, on tables that stand for them."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import company, url
from leadloom.operators import ranges
from leadloom.sources import places
from leadloom.sources.tables import read

BOX, KINDS = (-20.0, -50.0, 30.0, 60.0), ["AUTOMOBILE", "BUILDING", "FURNITURE"]


def place_table(spark, sf_dir):
    """Customers as a nested place list: points by key, sites by nation."""
    k = F.col("c_custkey")
    site = F.concat(F.lit("https://www.shop"), k % 40, F.lit(".example"), F.col("c_nationkey"), F.lit(".com/x"))
    return read(spark, sf_dir, "customer").select(
        F.struct(F.col("c_name").alias("primary")).alias("names"), F.struct(F.col("c_mktsegment").alias("primary")).alias("taxonomy"), F.when(k % 7 != 0, F.array(site)).otherwise(F.array().cast("array<string>")).alias("websites"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("m"), k, F.lit("@x.example")))).alias("emails"), F.array(F.lit("+1 555 0100")).alias("phones"),
        F.array(F.struct(F.lit("Main St 1").alias("freeform"), F.concat(F.lit("City "), F.col("c_nationkey")).alias("locality"), F.lit("R").alias("region"))).alias("addresses"),
        F.struct(((k * 37) % 360 - 180).cast("double").alias("xmin"), ((k * 17) % 180 - 90).cast("double").alias("ymin")).alias("bbox"),
        F.struct(F.struct(F.when(k % 11 == 0, "Chain").alias("primary")).alias("names")).alias("brand"), F.when(k % 13 == 0, "permanently_closed").alias("operating_status"), ((k % 10) / 10).alias("confidence"), k.cast("string").alias("id"),
    )


def places_in_box(spark, sf_dir):
    """Open independent places of three kinds in a padded box, one for each site."""
    return places.best_per_site(places.in_box(place_table(spark, sf_dir), places.padded(BOX), KINDS)).select("site", "name", "kind", "email", "city", "confidence", "id")


RELEASES = ("2024-05", "2025-07")


def released_places(spark, sf_dir):
    """The path of a data set with two releases of the place list: the older one names the kind otherwise and has places of even keys alone."""
    path = f"{ranges.shared_folder(spark)}/places-{uuid.uuid4().hex}"
    rows = place_table(spark, sf_dir)
    places.write_places(rows.filter(F.col("id").cast("long") % 2 == 0).withColumnRenamed("taxonomy", "categories"), path, RELEASES[0])
    places.write_places(rows, path, RELEASES[1])
    return path


def place_scan(spark, sf_dir):
    """Open independent places in a padded box by release, one for each site, read from a data set by release and cell."""
    path, box = released_places(spark, sf_dir), places.padded(BOX)
    found = [places.best_per_site(places.in_box(places.read_places(spark, path, r, box), box, KINDS)).select(F.lit(r).alias("release"), "site", "name", "kind", "email", "city", "confidence", "id") for r in RELEASES]
    return found[0].union(found[1])


def place_cache(spark, sf_dir):
    """Rows of a kept search that are read back within a week and after it, by release."""
    path, box, saved = f"{ranges.shared_folder(spark)}/kept-{uuid.uuid4().hex}", places.padded(BOX), F.to_timestamp(F.lit("2025-08-01 00:00:00"))
    found = place_scan(spark, sf_dir)
    for release in RELEASES:
        places.keep_rows(found.filter(F.col("release") == release), path, places.cache_key(release, box, KINDS), saved)
    cache = spark.read.parquet(path)
    parts = [(r, d, places.fresh_rows(cache, places.cache_key(r, box, KINDS), saved + F.make_dt_interval(F.lit(d)))) for r in RELEASES for d in (3, 8)]
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(r).alias("release"), F.lit(d).alias("days"), "rows") for r, d, rows in parts]
    return reduce(DataFrame.union, counts)


def tile_counts(spark, sf_dir):
    """Places by tile of a box, six by six."""
    at = places.tile_of(BOX, 6, F.col("bbox.ymin"), F.col("bbox.xmin"))
    return place_table(spark, sf_dir).select(at.alias("tile")).groupBy("tile").agg(F.count("*").alias("places"))


def named_parts(spark, sf_dir):
    """Parts with company names made of their own."""
    name = F.concat("p_name", F.lit(" & "), F.replace(F.col("p_brand"), F.lit("#"), F.lit(" no. ")), F.when(F.col("p_partkey") % 2 == 0, " Sports Ltd").otherwise(" of Town GmbH"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", name.alias("name"))


def name_cores(spark, sf_dir):
    """Core words and guessed domains of company names."""
    rows = named_parts(spark, sf_dir).select("p_partkey", company.core(F.col("name")).alias("words"))
    return rows.select("p_partkey", F.array_join("words", " ").alias("core"), F.array_join(company.domain_guesses(F.col("words")), " ").alias("guesses"))


def own_sites(spark, sf_dir):
    """Whether made sites are their companies' own."""
    first = F.substring_index("p_name", " ", 1)
    made = F.concat(F.lit("https://"), F.when(F.col("p_partkey") % 3 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).when(F.col("p_partkey") % 3 == 1, first).otherwise("town-sports"), F.lit(".example.com/a"))
    rows = named_parts(spark, sf_dir).select("p_partkey", company.core(F.col("name")).alias("words"), made.alias("site"))
    return rows.select("p_partkey", url.host(F.col("site")).alias("host"), company.owns_site(F.col("words"), F.col("site")).alias("own"))


QUERIES = {"q_places_in_box": places_in_box, "q_place_scan": place_scan, "q_place_cache": place_cache, "q_tile_counts": tile_counts, "q_company_cores": name_cores, "q_own_sites": own_sites}

_P = """p AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey, (c_custkey * 37) % 360 - 180 AS x, (c_custkey * 17) % 180 - 90 AS y FROM customer)"""
_CORE = f"""n AS (SELECT p_partkey, p_name, p_name || ' & ' || replace(p_brand, '#', ' no. ') || CASE WHEN p_partkey % 2 = 0 THEN ' Sports Ltd' ELSE ' of Town GmbH' END AS name FROM part),
    w AS (SELECT p_partkey, p_name, list_filter(string_split_regex(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda x: length(x) >= 2 AND x NOT IN ({', '.join(f"'{x}'" for x in company.SMALL_WORDS + company.LEGAL_FORMS)}))[1:5] AS words FROM n)"""

_BEST = f"""WITH {_P}, r AS (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN ['2024-05', '2025-07'] ELSE ['2025-07'] END) AS release FROM p),
    b AS (SELECT release, 'example' || c_nationkey || '.com' AS site, c_name AS name, c_mktsegment AS kind, CASE WHEN k % 3 = 0 THEN 'm' || k || '@x.example' ELSE '' END AS email, 'City ' || c_nationkey AS city, (k % 10) / 10 AS confidence, CAST(k AS VARCHAR) AS id FROM r
        WHERE x BETWEEN -61 AND 71 AND y BETWEEN -25 AND 35 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AND k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND (k % 10) / 10 >= 0.2
        QUALIFY row_number() OVER (PARTITION BY release, site ORDER BY email = '', confidence DESC, id) = 1)"""

ORACLES = {
    "q_place_scan": f"{_BEST} SELECT * FROM b",
    "q_place_cache": f"{_BEST} SELECT release, days, CASE WHEN days < 7 THEN (SELECT count(*) FROM b WHERE b.release = d.release) ELSE 0 END AS rows FROM (SELECT unnest(['2024-05', '2025-07']) AS release) d, (SELECT unnest([3, 8])::int AS days)",
    "q_places_in_box": f"""WITH {_P} SELECT 'example' || c_nationkey || '.com' AS site, c_name AS name, c_mktsegment AS kind, CASE WHEN k % 3 = 0 THEN 'm' || k || '@x.example' ELSE '' END AS email, 'City ' || c_nationkey AS city, (k % 10) / 10 AS confidence, CAST(k AS VARCHAR) AS id FROM p
        WHERE x BETWEEN -61 AND 71 AND y BETWEEN -25 AND 35 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AND k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND (k % 10) / 10 >= 0.2
        QUALIFY row_number() OVER (PARTITION BY site ORDER BY email = '', confidence DESC, id) = 1""",
    "q_tile_counts": f"WITH {_P}, t AS (SELECT CASE WHEN x BETWEEN -50 AND 60 AND y BETWEEN -20 AND 30 THEN CAST(least(5, floor((y + 20) / (50.0::DOUBLE / 6))) * 6 + least(5, floor((x + 50) / (110.0::DOUBLE / 6))) AS BIGINT) END AS tile FROM p) SELECT tile, count(*) AS places FROM t GROUP BY 1",
    "q_company_cores": f"""WITH {_CORE}, l AS (SELECT p_partkey, words, list_filter([CASE WHEN length(array_to_string(words, '')) >= 4 THEN array_to_string(words, '') END, CASE WHEN len(words) >= 3 THEN array_to_string(words[1:2], '') END, CASE WHEN len(words) >= 2 THEN array_to_string(words, '-') END], lambda x: x IS NOT NULL) AS labels FROM w)
        SELECT p_partkey, array_to_string(words, ' ') AS core, array_to_string(list_transform(labels, lambda x: x || '.co.uk ' || x || '.com ' || x || '.uk'), ' ') AS guesses FROM l""",
    "q_own_sites": f"""WITH {_CORE}, h AS (SELECT p_partkey, words, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN split_part(p_name, ' ', 1) ELSE 'town-sports' END AS label FROM w),
        c AS (SELECT *, replace(label, '-', '') AS compact, list_filter(words, lambda x: x NOT IN ({', '.join(f"'{x}'" for x in company.COMMON_WORDS)})) AS telling FROM h)
        SELECT p_partkey, label || '.example.com' AS host, contains(compact, array_to_string(words, '')) OR (len(words) >= 2 AND contains(compact, array_to_string(words[1:2], ''))) OR (length(coalesce(telling[1], '')) >= 5 AND contains(compact, telling[1]))
        OR (len(list_filter(telling, lambda x: length(x) >= 3 AND contains(compact, x))) >= 1 AND len(list_filter(words, lambda x: length(x) >= 3 AND contains(compact, x))) >= greatest(2, (len(words) + 1) // 2)) AS own FROM c""",
}
