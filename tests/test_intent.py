import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators import intent, phrases

LEXICON = [
    ("distributors", "role", "distributors", 1, None), ("distributor", "role", "distributors", 1, None), ("wholesalers", "role", "wholesalers", 1, None), ("body shops", "role", "body shops", 1, None),
    ("gym", "role", "gyms", 2, None), ("gyms", "role", "gyms", 2, None), ("shops", "role", "shops", 2, None),
    ("california", "place", "California", 0, "United States"), ("dallas", "place", "Texas", 0, "United States"), ("texas", "place", "Texas", 0, "United States"),
    ("united states", "place", "United States", 0, None), ("united kingdom", "place", "United Kingdom", 0, None), ("york", "place", "York", 0, "United Kingdom"),
    ("new york", "place", "New York", 0, "United States"), ("new york city", "place", "New York", 0, "United States"), ("london", "place", "London", 0, "United Kingdom"),
]
COLUMNS = "phrase string, kind string, name string, tier int, parent string"

#: Lines and what they mean.
GOLDEN = [
    ('"weightlifting straps" distributors in California -truck', "weightlifting straps", "distributors", "California", ["California"]),
    ("weightlifting straps distributors Dallas, United States", "weightlifting straps", "distributors", "Dallas, United States", ["Texas", "United States"]),
    ("wrist wraps gym wholesalers United Kingdom", "wrist wraps gym", "wholesalers", "United Kingdom", ["United Kingdom"]),
    ("boxing gyms London, United Kingdom", "boxing", "gyms", "London, United Kingdom", ["London", "United Kingdom"]),
    ("paint body shops in new york city.", "paint", "body shops", "new york city", ["New York"]),
    ("wrist wraps", "wrist wraps", "", "", []),
    ("gyms", "gyms", "", "", []),
    ('"made in italy" distributor', "made in italy", "distributors", "", []),
    ('"straps" heavy distributors', "straps", "", "", []),
    ('"straps"distributors York', "straps", "distributors", "York", ["York"]),
    ("straps in", "straps in", "", "", []),
    ("In Texas", "", "", "Texas", ["Texas"]),
    ("-a  straps   gyms -b in new  york, new york city", "straps", "gyms", "new york, new york city", ["New York"]),
    (None, "", "", "", []),
    ("  ", "", "", "", []),
]


def test_lines_of_all_forms(spark):
    lexicon = spark.createDataFrame(LEXICON, COLUMNS)
    lines = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, line string").repartition(3)
    got = {r.id: (r["product"], r.role, r.place, r.places) for r in intent.parsed(lines, "id", "line", lexicon).collect()}
    assert got == {i: g[1:] for i, g in enumerate(GOLDEN)}


def test_without_lexicon_or_lines(spark):
    lexicon = spark.createDataFrame([], COLUMNS)
    lines = spark.createDataFrame([(1, "a gyms in b")], "id int, line string")
    assert [tuple(r) for r in intent.parsed(lines, "id", "line", lexicon).collect()] == [(1, "a gyms", "", "b", [])]
    assert intent.parsed(lines.limit(0), "id", "line", spark.createDataFrame(LEXICON, COLUMNS)).count() == 0


def test_aliases(spark):
    places = spark.createDataFrame([(1, " Dallas"), (2, "Texas"), (3, "Nowhere"), (4, None), (5, "New York City")], "id int, place string")
    got = {r.id: r.aliases for r in intent.place_aliases(places, "id", "place", spark.createDataFrame(LEXICON, COLUMNS)).collect()}
    assert got == {1: ["dallas", "texas"], 2: ["texas", "dallas"], 3: ["nowhere"], 4: [], 5: ["new york city", "new york"]}


@pytest.mark.parametrize("broadcast", [0, 100])
def test_occurrences_and_overlaps_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", broadcast)
    table = ["a", "a b", "b c d", "d a", "c", "x-y"]
    texts = ["a b c d a b", "A. B c; d!", "", None, "x-y x y a", "d a b c d" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", phrases.words(F.col("text")).alias("words"))
    found = phrases.occurrences(rows, ["id"], spark.createDataFrame([(p,) for p in table], "phrase string"))
    kept = found.groupBy("id").agg(phrases.leftmost_longest(F.collect_list(F.struct("start", "length", "phrase"))).alias("kept"))
    got = {r.id: [(k.start, k.phrase) for k in r.kept] for r in kept.collect()}
    want, everything = {}, set()
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z]+(?:-[a-z]+)*", (text or "").lower())
        at = [(s, p) for s in range(len(words)) for p in table if words[s : s + len(p.split())] == p.split()]
        everything |= {(i, *x) for x in at}
        end = 0
        for s, p in sorted(at, key=lambda x: (x[0], -len(x[1].split()))):
            if s >= end:
                want.setdefault(i, []).append((s, p))
                end = s + len(p.split())
    assert got == want and {(r.id, r.start, r.phrase) for r in found.collect()} == everything


def test_generated_searches(spark):
    lexicon = spark.createDataFrame(LEXICON, COLUMNS)
    hunts = spark.createDataFrame([(1, ["Lifting  Straps", None, "belt"], ["Gym", "gyms", "traders"], "Texas"), (2, ["straps"], None, None), (3, None, ["gyms"], "x"), (4, ["a"], [" "], "")], "id int, products array<string>, roles array<string>, location string")
    got = {}
    for r in sorted(intent.generated(hunts, "id", lexicon).collect(), key=lambda r: (r.bucket, r.place)):
        got.setdefault((r.id, r.bucket), []).append(r.query)
    assert got == {
        (1, "primary"): ["lifting straps gyms Texas", "belt gyms Texas", "lifting straps traders Texas", "belt traders Texas"],
        (1, "volume"): ['"lifting straps" gyms Texas', '"lifting straps" gym Texas', '"lifting strap" gym Texas', '"belt" gyms Texas', '"belt" gym Texas', '"lifting straps" traders Texas', '"lifting straps" trader Texas', '"lifting strap" trader Texas', '"belt" traders Texas', '"belt" trader Texas'],
        (2, "primary"): ["straps distributors"], (2, "volume"): ['"straps" distributors', '"straps" distributor', '"strap" distributor'],
        (4, "primary"): ["a distributors"], (4, "volume"): ['"a" distributors', '"a" distributor'],
    }


def test_precise_searches_parse_back(spark):
    lexicon = spark.createDataFrame(LEXICON, COLUMNS)
    heads = spark.createDataFrame([("straps", ["truck", "cargo"]), ("belts", None)], "head string, exclude array<string>")
    lines = [(1, "lifting straps", "gyms", "Texas"), (2, "Straps", "", ""), (3, "leather belts", "distributors", "New York"), (4, "", "gyms", "Texas"), (5, "wraps", "gyms", "London"), (6, None, None, None)]
    found = intent.formatted(spark.createDataFrame(lines, "id int, product string, role string, place string"), "id", heads)
    assert {r.id: r.query for r in found.collect()} == {1: '"lifting straps" gyms Texas -truck -cargo', 2: "Straps -truck -cargo", 3: '"leather belts" distributors New York', 4: "", 5: "wraps gyms London", 6: ""}
    back = {r.id: (r["product"], r.role, r.place) for r in intent.parsed(found, "id", "query", lexicon).collect()}
    assert all(back[i] == (p, r, at) for i, p, r, at in lines[:3] + lines[4:5])
