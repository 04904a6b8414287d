import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import crawl


def queue_crawl(pages, links, seeds, patience):
    """Pages as a queue visits them, with their branch's streak."""
    queue, seen, streak, out = list(seeds), set(), {}, []
    while queue:
        url = queue.pop(0)
        if url in seen or url not in pages:
            continue
        seen.add(url)
        branch, found = pages[url]
        streak[branch] = 0 if found else streak.get(branch, 0) + 1
        out.append((url, streak[branch]))
        if streak[branch] <= patience:
            queue += [t for t in links.get(url, []) if t not in seen]
    return out


@pytest.mark.parametrize("seed,patience", [(1, 0), (2, 1), (3, 3), (4, 2)])
def test_against_a_queue(spark, seed, patience):
    rng = random.Random(seed)
    names = [f"p{i}" for i in range(60)]
    pages = {n: (rng.choice(["a", "b", "c", None]), rng.choice([0, 0, 0, 2])) for n in names if rng.random() < 0.9}
    links = {n: [rng.choice(names) for _ in range(rng.randint(0, 4))] for n in names}
    seeds = ["p1", "p2", "p1", "p3"]
    p = spark.createDataFrame([(u, b, f) for u, (b, f) in pages.items()], "url string, branch string, found int")
    e = spark.createDataFrame([(u, i, t) for u, ts in links.items() for i, t in enumerate(ts)], "url string, place int, target string")
    s = spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, place int")
    got = [(r.url, r.streak) for r in sorted(crawl.crawled(p, e, s, patience).collect(), key=lambda r: (r.round, r.ord))]
    assert got == queue_crawl(pages, links, seeds, patience)


def test_ends(spark):
    p = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "url string, branch string, found int")
    e = spark.createDataFrame([("a", 0, "b"), ("b", 0, "a")], "url string, place int, target string")
    s = spark.createDataFrame([("a", 0)], "url string, place int")
    assert crawl.crawled(p, e, s).count() == 2 and crawl.crawled(p, e, s, rounds=1).count() == 1
    assert crawl.crawled(p, e, s.limit(0)).count() == 0 and crawl.crawled(p.limit(0), e, s).count() == 0


def test_pages_are_read_once_a_round(spark):
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: read.add(1) or x, "string").asNondeterministic()
    p = spark.createDataFrame([(f"p{i}", "x", 1) for i in range(20)], "url string, branch string, found int").withColumn("url", counted("url"))
    e = spark.createDataFrame([(f"p{i}", 0, f"p{i + 1}") for i in range(3)], "url string, place int, target string")
    s = spark.createDataFrame([("p0", 0)], "url string, place int")
    assert crawl.crawled(p, e, s).count() == 4
    assert 0 < read.value <= 5 * 20  # for the seeds and after each of four rounds


@pytest.mark.parametrize("most", [1, 7])
def test_rounds_of_many_ranges(spark, monkeypatch, most):
    """Streaks go on from range to range within a round."""
    monkeypatch.setattr(crawl.ranges, "RANGE_ROWS", most)
    test_against_a_queue(spark, 5, 2)


def test_query_against_a_queue(spark):
    from leadloom import registry

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal").collect()
    pages = {r.c_custkey: (r.c_nationkey, r.c_acctbal > 4000) for r in rows}
    links = {k: [k * 3 + 1, k * 3 + 2, k * 3 + 3, k // 2] for k in pages}
    got = [(int(r.url), r.streak) for r in sorted(registry.QUERIES["q_listing_crawl"](spark, sf).collect(), key=lambda r: (r.round, r.ord))]
    want = queue_crawl(pages, links, range(4), 3)
    assert got == want and 50 < len(want) < len(pages)
