"""Rules on kept state: cursors, lanes, notices and bounded logs."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Empty pages in a row that block a lane, and for how many seconds.
STRIKES, BLOCK_SECONDS = 4, 300


def blocked_lanes(df: DataFrame, lane: str, hits: str, at: str, *order: str, strikes: int = STRIKES, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """lane, pages (fetched), skipped and blocks of each lane (long): so many empty pages in a row block it for some seconds, a hit starts the count anew.

    Pages that fall into a block are not fetched, so they neither count nor hit. Each page hangs on those before it, so a lane's rows pass through
    one task in order, which keeps three numbers of it.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = None, [0, 0, 0, 0, 0.0]  # pages, skipped, blocks, strikes, blocked until

        def closed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([held[0]], pa.int64()), *(pa.array([x], pa.int64()) for x in row[:3])], ["lane", "pages", "skipped", "blocks"])

        for batch in batches:
            for name, hit, when in zip(*(batch.column(c).to_pylist() for c in ("lane", "hit", "when"))):
                if held != (name,):
                    if held:
                        yield closed()
                    held, row = (name,), [0, 0, 0, 0, 0.0]
                if when < row[4]:
                    row[1] += 1
                    continue
                row[0] += 1
                row[3] = 0 if hit else row[3] + 1
                if row[3] == strikes:
                    row[2], row[3], row[4] = row[2] + 1, 0, when + seconds
        if held:
            yield closed()

    rows = df.select(F.col(lane).cast("long").alias("lane"), (F.coalesce(hits, F.lit(0)) > 0).alias("hit"), F.unix_micros(F.col(at).cast("timestamp")).cast("double").alias("when"), *[F.col(c).alias(f"by_{c}") for c in order])
    rows = rows.withColumn("when", F.col("when") / 1e6).repartition("lane").sortWithinPartitions("lane", "when", *[f"by_{c}" for c in order])
    return rows.select("lane", "hit", "when").mapInArrow(fold, "lane long, pages long, skipped long, blocks long").withColumnRenamed("lane", lane)


def worth_retry(source: Column, status: Column, candidates: Column, sources: tuple[str, ...]) -> Column:
    """Whether a finished list source that never gave a company should run again."""
    return source.isin(*sources) & (status == "exhausted") & (F.coalesce(candidates, F.lit(0)) == 0)


def reopened(df: DataFrame, worth: Column) -> DataFrame:
    """Cursors with those worth a retry set back to their start."""
    again = F.coalesce(worth, F.lit(False))
    return df.withColumn("cursor", F.when(again, F.lit("")).otherwise(F.col("cursor"))).withColumn("status", F.when(again, F.lit("active")).otherwise(F.col("status")))


def cursor_key(source: Column, iso: Column, city: Column, family: Column, categories: Column, query: Column, words: Column, brand: Column) -> Column:
    """The key under which searches share a source's cursor; the query itself for sources that share none. words are those that a company register is asked for, brand is the first whose stockists are listed."""
    few = F.substring(F.md5(F.array_join(F.array_sort(categories), ",").cast("binary")), 1, 8)
    by_source = {"directory": ("dir", iso, family), "osm": ("osm", iso, city, family), "overture": ("ov", iso, city, few), "wikidata": ("wd", iso, family), "exhibitors": ("exh", F.lit("global")), "companies_house": ("ch", iso, family, words), "stockists": ("stock", iso, F.coalesce(brand, F.lit("x")))}
    key = query
    for name, (tag, *parts) in by_source.items():
        key = F.when(source == name, F.concat_ws(" ", F.lit(tag), *parts)).otherwise(key)
    return F.trim(F.regexp_replace(F.lower(key), r"\s+", " "))


def notices(df: DataFrame, keys: list[str], kind: str, day: str, unread: Column, *order: str) -> DataFrame:
    """Notices that are sent: usage ones once a day and key; others until one with the key lies unread. Aggregates, no windows."""
    usage = df.filter(F.col(kind) == "usage")
    first = usage.groupBy(*keys, day).agg(F.min(F.struct(*order)).alias("__first"))
    daily = usage.join(first, [*keys, day]).filter(F.struct(*order) == F.col("__first"))
    others = df.filter(F.col(kind) != "usage")
    open_ = others.filter(unread).groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    rest = others.join(open_, keys, "left").filter(F.col("__first").isNull() | (F.struct(*order) <= F.col("__first")))
    return daily.drop("__first").select(*df.columns).union(rest.drop("__first").select(*df.columns))


def last_kept(df: DataFrame, keys: list[str], n: int, *newest_first: Column) -> DataFrame:
    """The last n rows of each key's log."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).filter(F.col("__n") <= n).drop("__n")


def pending(deliveries: DataFrame, key: str, now: Column, *order: str) -> DataFrame:
    """The first pending delivery of each key whose message is still there and has not expired."""
    open_ = deliveries.filter((F.col("status") == "pending_popup") & F.col("message_id").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= now)))
    return open_.groupBy(key).agg(F.min(F.struct(*order)).alias("first")).select(key, "first.*")
