"""Rules by hand: what is shown of an offer, and what falls into a lane's blocks."""

import datetime as dt
import random

from leadloom.operators import ordering, state


def test_matches_shown(spark):
    rows = [("none better", "low", i, "high") for i in range(4)] + [("low offer", "low", i, "low") for i in range(4)] + [("mixed", f, i, "high") for i, f in enumerate(["low", "Medium", "high", "low", "medium", "low", "high"])]
    got = ordering.matches_shown(spark.createDataFrame(rows, "k string, fit string, at int, offer string"), "k", "fit", "offer", "at").collect()
    shown = {k: [r.at for r in sorted((r for r in got if r.k == k), key=lambda r: r.place)] for k in ("none better", "low offer", "mixed")}
    # the seventh product is not looked at
    assert shown == {"none better": [0, 1], "low offer": [0, 1, 2], "mixed": [2, 1, 4]}


def test_blocks_last_and_expire(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), i, start + dt.timedelta(seconds=40 * i), rng.choice([0, 0, 0, None, 3])) for i in range(300)]
    got = {r.lane: (r.pages, r.skipped, r.blocks) for r in state.blocked_lanes(spark.createDataFrame(rows, "lane long, id int, ts timestamp, hits int").repartition(5), "lane", "hits", "ts", "id").collect()}
    want = {}
    for lane in (1, 2, None):
        pages = skipped = blocks = strikes = 0
        until = start
        for who, _, ts, hits in rows:
            if who != lane:
                continue
            if ts < until:
                skipped += 1
                continue
            pages, strikes = pages + 1, 0 if hits else strikes + 1
            if strikes == 4:
                blocks, strikes, until = blocks + 1, 0, ts + dt.timedelta(seconds=300)
        want[lane] = (pages, skipped, blocks)
    assert got == want and all(v[1] and v[2] for v in want.values())
