import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from leadloom.operators import state
from leadloom.streaming import ordered


def stream_rows(seed, kinds):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(rng.choice([1, 2, 3]), i, start + dt.timedelta(minutes=rng.randint(0, 4000)), rng.choice(kinds), rng.choice([0.0, 0.0, 0.0, 1.0])) for i in range(160)]
    return rows, (-1, -1, start + dt.timedelta(days=900), "end", 0.0)


def drained(spark, rows, end, tmp_path, make, files=3):
    schema = "key long, id long, ts timestamp, kind string, hits double"
    for n in range(files):
        spark.createDataFrame(rows[n::files], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return ordered.drained(spark, make, f"{tmp_path}/in", schema, str(tmp_path)).filter("key >= 0")


def test_lanes_equal_batch_in_any_order(spark, tmp_path):
    rows, end = stream_rows(1, [""])
    got = drained(spark, rows, end, tmp_path, lambda s: ordered.lanes(s, "400 days", seconds=7200)).groupBy("key").agg(*[F.count(F.when(F.col("outcome").isin(*k), 1)).alias(n) for n, k in (("pages", ("hit", "empty", "blocked")), ("skipped", ("skipped",)), ("blocks", ("blocked",)))])
    df = spark.createDataFrame(rows, "key long, id long, ts timestamp, kind string, hits double")
    want = state.blocked_lanes(df, "key", "hits", "ts", "id", seconds=7200)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.select("key", "pages", "skipped", "blocks").collect())


def test_notices_equal_batch(spark, tmp_path):
    rows, end = stream_rows(2, ["usage", "other"])
    got = {(r.key, r.id) for r in drained(spark, rows, end, tmp_path, lambda s: ordered.notices(s, "400 days")).collect()}
    df = spark.createDataFrame(rows, "key long, id long, ts timestamp, kind string, hits double").withColumn("day", F.to_date("ts"))
    want = {(r.key, r.id) for r in state.notices(df, ["key"], "kind", "day", F.col("hits") > 0, "ts", "id").collect()}
    assert got == want and len(want) > 5


def test_keys_of_one_bucket_over_several_watermarks(spark, tmp_path):
    """Keys share a bucket's rows and states; files in order of time, so that some rows are taken while others wait."""
    rows, end = stream_rows(3, [""])
    rows.sort(key=lambda r: r[2])
    dealt = [r for pair in zip(rows[:53], rows[53:106], rows[106:]) for r in pair]  # drained() deals every third row to a file
    got = drained(spark, dealt, end, tmp_path, lambda s: ordered.in_order(s, ordered.lane_step(7200, 4), (0, 0), "90 minutes", buckets=1)).collect()
    df = spark.createDataFrame(rows[: len(dealt)], "key long, id long, ts timestamp, kind string, hits double")
    want = {r.key: (r.pages, r.skipped, r.blocks) for r in state.blocked_lanes(df, "key", "hits", "ts", "id", seconds=7200).collect()}
    count = lambda k, *kinds: sum(r.key == k and r.outcome in kinds for r in got)
    assert {k: (count(k, "hit", "empty", "blocked"), count(k, "skipped"), count(k, "blocked")) for k in want} == want and len(want) == 3


def test_calls_to_the_store_grow_with_batches_not_rows():
    calls, kept = [], []

    class Store:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (kept.append(a[0]) if name == "appendValue" else iter(kept) if name == "get" else self if name.startswith("get") else False)

    rule = ordered.Ordered(ordered.lane_step(7200, 4), (0, 0))
    rule.init(Store())
    n = 3000
    rows = pd.DataFrame({"bucket": 7, "key": [i % 50 for i in range(n)], "id": range(n), "at": [i * 60_000_000 for i in range(n)], "kind": "", "hits": 0.0})
    list(rule.handleInputRows((7,), iter([rows]), None))
    time = SimpleNamespace(getExpiryTimeInMs=lambda: n * 60_000, getCurrentWatermarkInMs=lambda: n * 60_000)
    assert sum(len(f) for f in rule.handleExpiredTimer((7,), time, time)) == n
    assert len(calls) < 12
