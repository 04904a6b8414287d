import random

import pytest

from leadloom.operators import ranges


def rows(seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * 60 + [None, "a", "b", "c"]
    out = [(rng.choice(keys), i, rng.choice([None, 0, 1, 2, 5]), rng.randint(0, 3)) for i in range(900)]
    rng.shuffle(out)
    return out


def brute(data):
    sums, out = {}, {}
    for key, at, a, b in sorted(data, key=lambda r: r[1]):
        n, x, y = sums.get(key, (0, 0, 0))
        sums[key] = n, x, y = n + 1, x + (a or 0), y + b
        out[at] = (key, n, x, y)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_sums_and_positions(spark, parts):
    data = rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(data, "key string, at int, a int, place int")
        got = {r.at: (r.key, r.run_a, r.run_b) for r in ranges.running(df, ["key"], ["at"], {"run_a": "a", "run_b": "place"}).collect()}
        assert got == {at: (k, x, y) for at, (k, _, x, y) in brute(data).items()}
        assert {r.at: r.position for r in ranges.positions(df, ["key"], ["at"]).collect()} == {at: n for at, (_, n, _, _) in brute(data).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_first_limit(spark):
    data = rows(2)
    limits = [("one", "a", 40, True), ("two", "b", 30, True), ("three", "at", 880, False)]
    df = spark.createDataFrame(data, "key string, at int, a int, b int")
    got = {r.key: (r.limit, r.at, r.spent_one, r.spent_two) for r in ranges.first_limit(df, ["key"], ["at"], limits).collect()}
    want = {}
    for at, (key, _, x, y) in sorted(brute(data).items()):
        if want.get(key, (None,))[0] is None:
            want[key] = ("one" if x >= 40 else "two" if y >= 30 else "three" if at >= 880 else None, at, x, y)
    assert got == want
    assert ranges.first_limit(df.limit(0), ["key"], ["at"], limits).count() == 0


def test_since_last(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 9 + ["a", None]), i, rng.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(data, "key string, at int, hit boolean").repartition(5)
    want, state = {}, {}
    for key, at, hit in data:
        n, some = state.get(key, (0, False))
        state[key] = (0, True) if hit else (n + 1, some)
        want[at] = state[key]
    assert {r.at: (r.since, r.any_hit) for r in ranges.since_last(df, ["key"], "at", "hit").collect()} == want
