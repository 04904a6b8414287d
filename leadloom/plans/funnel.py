"""The flagship: pages to hosts to kinds to one row per site, with funnel counters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import url
from leadloom.sources.tables import read


def page_kind_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, sites and first rows by kind. A page is a first row when no earlier page_id has its site and kind."""
    host = url.host(F.col("url"))
    pages = read(spark, sf_dir, "pages").select("page_id", url.site(host).alias("site"), url.page_kind(host).alias("kind"))
    sites = pages.groupBy("kind", "site").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_id"))
    return sites.groupBy("kind").agg(
        F.sum("pages").alias("pages"), F.count("*").alias("sites"), F.min("first_id").alias("min_page_id"), F.max("first_id").alias("last_first_id")
    )


QUERIES = {"q_page_kind_funnel": page_kind_funnel}

ORACLES = {
    "q_page_kind_funnel": r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
k AS (SELECT page_id, regexp_replace(host, '^(www|m|blog)\.', '') AS site,
  CASE WHEN host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%' THEN 'burn' WHEN split_part(host, '.', 1) = 'blog' THEN 'article'
       WHEN split_part(host, '.', 1) = 'm' THEN 'mobile' ELSE 'company' END AS kind FROM h),
s AS (SELECT kind, site, count(*) AS pages, min(page_id) AS first_id FROM k GROUP BY ALL)
SELECT kind, CAST(sum(pages) AS BIGINT) AS pages, count(*) AS sites, min(first_id) AS min_page_id, max(first_id) AS last_first_id FROM s GROUP BY kind"""
}
