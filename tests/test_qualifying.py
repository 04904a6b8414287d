import random
import time

import pytest
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import qualifying as Q

SCHEMA = "id int, name string, snippet string, site string, url string, location string, buyers array<string>, categories array<string>, places array<string>, motion string, hunting boolean, website string, source string, phone string, related boolean"
BASE = dict(name="Acme", snippet=None, site=None, url=None, location=None, buyers=["gym distributors"], categories=["lifting straps"], places=[], motion="wholesale", hunting=True, website="https://a.example", source="web", phone=None, related=True)

#: What an account has, and icp, motion, offer, intent, fit, priority, persist.
GOLDEN = [
    (dict(site="Gym distributors with lifting straps. Wholesale only."), ("high", "high", "high", "none", "high", "nurture", True)),
    (dict(site="Gym distributors with lifting straps. Wholesale only. Now sourcing."), ("high", "high", "high", "high", "high", "priority", True)),
    (dict(site="We are a leading manufacturer of lifting straps"), ("low", "unknown", "high", "none", "low", "reject", False)),
    (dict(site="Our factory, wholesale", motion="oem"), ("low", "low", "unknown", "none", "low", "reject", False)),
    (dict(site="Our factory, wholesale", motion="oem", hunting=False, buyers=["wholesale"]), ("high", "high", "unknown", "none", "high", "nurture", True)),
    (dict(snippet="gym distributors"), ("medium", "medium", "unknown", "none", "medium", "low", True)),
    (dict(snippet="gym distributors", location="Paris"), ("medium", "medium", "unknown", "none", "medium", "review", True)),
    (dict(), ("unknown", "unknown", "unknown", "none", "medium", "low", True)),
    (dict(website=None), ("unknown", "unknown", "unknown", "none", "medium", "low", False)),
    (dict(website=None, source="maps", phone="1"), ("unknown", "unknown", "unknown", "none", "medium", "review", True)),
    (dict(site="gym distributors", places=["texas"]), ("low", "high", "unknown", "none", "low", "reject", False)),
    (dict(site="gym distributors of Texas", places=["texas"]), ("high", "high", "unknown", "none", "high", "nurture", True)),
    (dict(site="Lifting straps, add to cart", motion="local"), ("low", "medium", "high", "none", "low", "reject", False)),
    (dict(site="Only lifting here", motion="local"), ("low", "medium", "low", "none", "low", "reject", False)),
    (dict(site="Jewels", related=False, buyers=None, categories=None, places=None), ("low", "unknown", "unknown", "none", "low", "reject", False)),
    (dict(site="Sign in. New collection", motion="saas", buyers=["sign"], categories=["gear"]), ("high", "medium", "unknown", "low", "medium", "review", True)),
    (dict(name=None, snippet=None, site="", buyers=[], motion=None, hunting=None, website=None, source=None, related=None), ("unknown", "unknown", "unknown", "none", "medium", "low", False)),
]


def frame(spark, rows):
    columns = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    return spark.createDataFrame([(i, *((BASE | r)[c] for c in columns)) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def test_levels_by_hand(spark):
    got = {r.id: r for r in Q.qualified(frame(spark, [g[0] for g in GOLDEN]), "id").collect()}
    for i, (row, want) in enumerate(GOLDEN):
        r = got[i]
        assert (r.icp, r.motion, r.offer, r.intent, r.fit, r.priority, r.persist) == want, (row, r)
        assert 0 <= r.score.total <= 99 and 0.28 <= r.confidence <= 0.9
        assert [e.claim for e in r.evidence] == sorted((e.claim for e in r.evidence), key=["icp", "motion", "offer", "intent"].index)


def test_deep_sites_score_more_and_thin_ones_are_capped(spark):
    text = "Gym distributors with lifting straps. Wholesale only. "
    rows = [dict(site=text), dict(site=text + "About us. " + "x " * 3000), dict(snippet=text), dict(site="Only lifting. " * 50), dict(site=text, places=["texas"], location="Austin, Texas, USA")]
    got = {r.id: r.score for r in Q.qualified(frame(spark, rows), "id").collect()}
    assert got[1].industry > got[0].industry and got[1].company > got[0].company
    assert got[2].total <= 52 and got[3].total <= 35 and got[0].location == 0
    assert got[0].product > got[2].product == 1


def test_long_and_empty(spark):
    text = "straps and lifting gear " * 20_000 + "now sourcing"
    r = Q.qualified(frame(spark, [dict(site=text)]), "id").first()
    assert r.intent == "high" and r.offer == "high" and r.evidence[-1].quote.endswith("now sourcing") and len(r.evidence[-1].quote) <= 200
    assert Q.qualified(frame(spark, [dict()]).limit(0), "id").count() == 0


def test_rules_in_order_and_bounded(spark):
    table = [rules.Rule("a", "high", 0.5, "x", "b+"), rules.Rule("b", "low", 0.1, "y", r"\bc\b"), rules.Rule("a", "low", 0.2, "z", "b")]
    rows = spark.createDataFrame([("a BB c\n d",), (None,), ("",), ("c",)], "text string").select(rules.found(F.col("text"), table).alias("hits"), F.col("text"))
    got = {r.text: [(h.place, h.quote) for h in r.hits] for r in rows.collect()}
    assert got == {"a BB c\n d": [(0, "a BB c d"), (1, "a BB c d"), (2, "a BB c d")], None: [], "": [], "c": [(1, "c")]}
    with pytest.raises(ValueError):
        rules.found(F.col("text"), table * 200)


def test_quotes_are_those_of_the_plain_pattern_and_come_fast(spark):
    """Texts without a match, and those with one far in, are not read again for each character ahead of a quote."""
    rng, parts = random.Random(5), ["now sourcing", "rfp", "new line", "2025", "tender", "x", "\n", "é", "😀", "our Factory", "oem", "word and word"]
    texts = [(i, rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(300)] + [(300, None), (301, "")]
    patterns = [r.pattern for r in Q.INTENT] + [Q.MAKER, *Q.MOTIONS.values(), "x", r"\b2025\b"]
    rows = spark.createDataFrame(texts, "id int, text string")
    plain = [F.regexp_extract("text", f"(?is).{{0,40}}(?:{p}).{{0,140}}", 0) for p in patterns]
    here = [rules.around(F.col("text"), p, 40, 140) for p in patterns]
    for r in rows.select("id", F.array(*plain).alias("plain"), F.array(*here).alias("here")).collect():
        assert r.plain == r.here, texts[r.id]
    long = spark.createDataFrame([("a line of words " * 200_000,)], "text string").withColumn("text", F.concat("text", F.lit("now sourcing")))
    began = time.monotonic()
    assert [h.quote[-12:] for h in long.select(rules.found(F.col("text"), Q.INTENT).alias("h")).first().h] == ["now sourcing"]
    assert time.monotonic() - began < 15


def test_accounts_are_dealt_to_many_tasks(spark):
    from leadloom.plans import accounts

    assert accounts.accounts(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
