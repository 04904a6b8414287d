"""Streaming twins of the batch queries over the usage ledger and over crawled pages.

Each reads files as they come and gives, once all are read, the rows of its batch query. State is keyed and bounded by a
watermark where time decides, and by the number of sites where it doesn't.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom.functions import url

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PAGES = "page_id long, url string, html string"


def stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Files of one table in a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by day, user and kind; a day is closed when the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "user_id", "event_type").agg(F.count("*").alias("used")).select(F.col("w.start").cast("date").cast("string").alias("day"), "user_id", "event_type", "used")


ALERTS = "user_id long, day string, event_type string, level string"


def alerts(events: DataFrame, limit: int) -> DataFrame:
    """One alert a user, day, kind and level, as soon as use reaches four fifths of the limit and all of it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, told = state.get if state.exists else (0, "")
        out = []
        for pdf in batches:
            used += len(pdf)
            for level, least in (("low", 0.8 * limit), ("exhausted", limit)):
                if used >= least and level not in told.split(","):
                    told = f"{told},{level}"
                    out.append((key[0], key[1], key[2], level))
        state.update((used, told))
        yield pd.DataFrame(out, columns=["user_id", "day", "event_type", "level"])

    keyed = events.select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    return keyed.groupBy("user_id", "day", "event_type").applyInPandasWithState(step, ALERTS, "used long, told string", "append", GroupStateTimeout.NoTimeout)


def merge_memory(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A memory of sites with a batch of pages merged in: insert or touch; the first sighting stays."""
    new = batch.select(url.site(url.host(F.col("url"))).alias("site"), F.col("page_id").alias("first_seen"), F.col("page_id").alias("last_seen"), F.lit(1).cast("long").alias("touches"))
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy("site").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("touches").alias("touches"))


class Memory:
    """A keyed table in a folder of versions: each batch reads one version and writes the next, so that a repeated batch changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self, number: int) -> DataFrame | None:
        """The table after batch `number`, or nothing before the first."""
        return self.spark.read.parquet(f"{self.folder}/v={number}") if number >= 0 else None

    def absorb(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        merge_memory(self.version(number - 1), batch).write.mode("overwrite").parquet(f"{self.folder}/v={number}")

    def run(self, pages: DataFrame, checkpoint: str) -> DataFrame:
        """All that is there now, absorbed; the memory after it."""
        last: list[int] = []

        def each(batch: DataFrame, number: int) -> None:
            self.absorb(batch, number)
            last.append(number)

        pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        number = last[-1] if last else self.latest()
        return self.version(number)

    def latest(self) -> int:
        """The highest version written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return max(int(f.getPath().getName().split("=")[1]) for f in found)


def parsed_cursor(raw: str | None) -> dict:
    """A source's cursor; anything that is not an object of numbers is the zero state."""
    try:
        found = json.loads(raw or "")
        return {"offset": max(0, int(found.get("offset", 0))), "exhausted": bool(found.get("exhausted"))} if isinstance(found, dict) else {"offset": 0, "exhausted": False}
    except (ValueError, TypeError):
        return {"offset": 0, "exhausted": False}
