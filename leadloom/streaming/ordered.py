"""Keyed rules over streams, with rows in order of time whatever order they come in.

Keys are dealt to buckets. A bucket's rows wait in list state, packed by the thousands, until the watermark has passed them (a timer wakes the bucket), are
then taken key by key in order of time and id, and go through a step function with the key's state. So calls to the state store grow with buckets and
batches, not with rows or keys. What waits is bounded by the watermark's delay; rows later than that are left out by Spark. A key's state is one row of
numbers. Each rule gives what its batch query gives over the same rows.
"""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadloom.operators.state import BLOCK_SECONDS, STRIKES

#: Keyed state needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "key long, id long, outcome string"
#: Buckets that keys are dealt to; a checkpoint holds for one number. Rows that are packed into one value of the store at most.
BUCKETS, PACK_ROWS = 1024, 10_000
ROWS = ["key", "at", "id", "kind", "hits"]


def packed(table: pa.Table) -> tuple[bytes]:
    """A table as a value of the store."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def unpacked(value: tuple) -> pa.Table:
    return pa.ipc.open_stream(bytes(value[0])).read_all()


class Ordered(StatefulProcessor):
    """Holds a bucket's rows back until their time has passed, then steps through them: step(state, at, id, kind, hits) gives the key's new state and an outcome, or None."""

    def __init__(self, step: Callable, start: tuple):
        self.step, self.start = step, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")

    def wait(self, rows: pa.Table) -> None:
        for at in range(0, len(rows), PACK_ROWS):
            self.waiting.appendValue(packed(rows.slice(at, PACK_ROWS)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = []
        for some in rows:
            table = pa.Table.from_pandas(some[ROWS], preserve_index=False).replace_schema_metadata()
            self.wait(table)
            latest.append(pc.max(table["at"]).as_py())
        if latest:
            self.handle.registerTimer(max(latest) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed at once: the bucket's other timers of this batch then find nothing to do
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        chunks = [unpacked(value) for value in self.waiting.get()]
        if not chunks:
            return
        rows = pa.concat_tables(chunks)
        now, later = rows.filter(pc.less(rows["at"], until)), rows.filter(pc.greater_equal(rows["at"], until))
        if not len(now):
            return
        states = {k: tuple(state) for k, *state in zip(*(c.to_pylist() for c in unpacked(self.states.get()).columns))} if self.states.exists() else {}
        out = []
        for k, at, i, kind, hits in zip(*(c.to_pylist() for c in now.sort_by([(c, "ascending") for c in ROWS]).columns)):
            states[k], outcome = self.step(states.get(k, self.start), at, i, kind, hits)
            if outcome is not None:
                out.append((k, i, outcome))
        self.states.update(packed(pa.table([pa.array(c) for c in zip(*((k, *state) for k, state in states.items()))], [str(n) for n in range(len(self.start) + 1)])))
        self.waiting.clear()
        self.wait(later)
        if out:
            keys, ids, outcomes = zip(*out)
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "id": pd.Series(ids, dtype="int64"), "outcome": pd.Series(outcomes, dtype="object")})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, step: Callable, start: tuple, late: str, buckets: int = BUCKETS) -> DataFrame:
    """key, id and outcome of a stream of rows (key long, id long, ts timestamp, kind string, hits)."""
    timed = rows.withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    each = timed.select("bucket", "key", "id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce(F.col("hits").cast("double"), F.lit(0.0)).alias("hits"))
    return each.groupBy("bucket").transformWithStateInPandas(Ordered(step, start), OUT, "Append", "EventTime")


def lane_step(seconds: int, strikes: int) -> Callable:
    """Blocks of a lane: so many empty pages in a row block it for some seconds, pages in a block are skipped, a hit starts anew."""

    def step(state, at, i, kind, hits):
        empty, until = state
        if at < until:
            return state, "skipped"
        if hits > 0:
            return (0, until), "hit"
        if empty + 1 < strikes:
            return (empty + 1, until), "empty"
        return (0, at + seconds * 1_000_000), "blocked"

    return step


def lanes(rows: DataFrame, late: str = "1 hour", seconds: int = BLOCK_SECONDS, strikes: int = STRIKES) -> DataFrame:
    """What happens to each page of each lane (key)."""
    return in_order(rows, lane_step(seconds, strikes), (0, 0), late)


def notice_step(state, at, i, kind, hits):
    """Usage notices go out once a day; others until one lies unread (hits > 0)."""
    day, unread = state
    today = at // 86_400_000_000
    if kind == "usage":
        return (today, unread), "sent" if today != day else None
    return (day, 1 if hits > 0 else unread), None if unread else "sent"


def notices(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The notices of each key that are sent."""
    return in_order(rows, notice_step, (-1, 0), late)


def drained(spark: SparkSession, rows: Callable[[DataFrame], DataFrame], source: str, schema: str, out: str, per_batch: int = 1) -> DataFrame:
    """All that a streaming query over a folder's files gives, written to a folder `out` and read from there; files come so many at a time."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
        rows(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(OUT).parquet(f"{out}/rows")
