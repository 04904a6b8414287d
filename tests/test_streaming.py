from pyspark.sql import functions as F

from leadloom.plans import usage as batch
from leadloom.streaming import usage as S


def drained(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_daily_usage_matches_batch(spark, sf, tmp_path):
    got = drained(S.daily_usage(S.stream(spark, sf, "events", S.EVENTS)), tmp_path, "daily", "complete").collect()
    want = batch.ledger(spark, sf).groupBy(F.col("day").cast("string").alias("day"), "user_id", "event_type").agg(F.count("*").alias("used")).collect()
    key = lambda r: (r.day, r.user_id, r.event_type, r.used)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_alerts_come_once(spark, sf, tmp_path):
    got = [tuple(r) for r in drained(S.alerts(S.stream(spark, sf, "events", S.EVENTS), 2), tmp_path, "alerts", "append").collect()]
    used = batch.ledger(spark, sf).groupBy("user_id", F.col("day").cast("string").alias("day"), "event_type").count().filter("count >= 2").collect()
    assert len(got) == len(set(got)) and {(g[0], g[1], g[2]) for g in got} == {(r.user_id, r.day, r.event_type) for r in used}


def test_memory_is_idempotent(spark, sf, tmp_path):
    memory = S.Memory(spark, str(tmp_path / "memory"))
    got = memory.run(S.stream(spark, sf, "pages", S.PAGES), str(tmp_path / "cp"))
    want = S.merge_memory(None, spark.read.parquet(f"{sf}/pages.parquet"))
    key = lambda r: (r.site, r.first_seen, r.last_seen, r.touches)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    again = memory.run(S.stream(spark, sf, "pages", S.PAGES), str(tmp_path / "cp"))
    assert sorted(map(key, again.collect())) == sorted(map(key, want.collect()))


def test_cursors():
    zero = {"offset": 0, "exhausted": False}
    assert S.parsed_cursor(None) == S.parsed_cursor("{") == S.parsed_cursor("[1]") == S.parsed_cursor('{"offset": "x"}') == zero
    assert S.parsed_cursor('{"offset": 40, "exhausted": true}') == {"offset": 40, "exhausted": True}
