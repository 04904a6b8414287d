import hashlib
import re

import pytest
from pyspark.sql import functions as F

from leadloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    """doc -> (words, hit words, item ids)."""
    out = []
    for doc_id, text in docs:
        own, hit, ids = split(text), set(), set()
        places = {}
        for i in range(len(own)):
            places.setdefault(own[i], []).append(i)
        for item, t in items:
            w = split(t)
            for k in range(max(1, len(w) - n + 1) if w else 0):
                window = w[k : k + n]
                for i in places.get(window[0], []):
                    if own[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        ids.add("" if item is None else str(item))
        out.append((doc_id, len(own), len(hit), sorted(ids)))
    return sorted(out, key=str)


TEN = "one two three four five six seven eight nine ten"
DOCS = [
    (1, None), (2, ""), (3, "?? !"), (4, TEN), (5, f"x {TEN.upper()} eleven y"), (6, "one two three four five six seven eight nine"), (7, "short,item; short item"),
    (8, f"{TEN} {TEN}"), (9, "ten " + TEN.replace(" ", "-")), (None, f"a é_{TEN}"), (5, "again short item"), (10, "été über 日本 " * 5), (11, ("w " * 3000) + TEN), (12, "Short"), (13, "item"),
]
ITEMS = [(0, TEN + " eleven"), (1, "short item"), (2, None), (3, ""), (4, "short item"), (None, "été ÜBER 日本 été über"), (1, "two three four five six seven eight nine ten one two")]


@pytest.mark.parametrize("window,test_bytes,vocabulary_bytes", [(10, 1 << 20, 1 << 20), (3, 40, 1 << 20), (1, 1 << 20, 4)])
def test_against_brute_force(spark, window, test_bytes, vocabulary_bytes):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, item_id int").withColumn("row", F.monotonically_increasing_id()).repartition(3)
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = D.hits(docs, items, window, 0, test_bytes, vocabulary_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=str) == brute(DOCS, ITEMS, window)


def brute_near(docs, items, n, slop):
    """doc -> (item ids, covered words) of runs of words, slop more than a window's, that hold all of its terms."""
    out = []
    for doc_id, text in docs:
        own, ids, covered = split(text), set(), set()
        for item, t in items:
            w = split(t)
            for k in range(max(1, len(w) - n + 1) if w else 0):
                window = w[k : k + n]
                width = len(window) + slop
                if not set(window) <= set(own):
                    continue
                for i in range(1 - width, len(own)):
                    if set(window) <= set(own[max(0, i) : i + width]):
                        ids.add(str(item))
                        covered.update(range(max(0, i), min(len(own), i + width)))
        out.append((doc_id, sorted(ids), len(covered)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("slop", [0, 1, 2, 3])
def test_proximity(spark, slop, parts):
    texts = [(1, "b x a y c"), (2, "a b x x x c"), (3, "a b"), (4, "c a b"), (5, "x x x x"), (6, "a b c"), (7, "c"), (8, "a a b b c c z q"), (9, None)]
    docs = spark.createDataFrame([(d, d, t) for d, t in texts], "row long, doc_id long, text string").repartition(parts)
    tests = [(7, "a b c"), (8, "q z"), (9, "missing a")]
    got = D.hits(docs, spark.createDataFrame(tests, "item_id long, text string"), 10, slop).collect()
    exact = {d: (h, i) for d, _, h, i in brute(texts, tests)}
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == exact
    near = sorted((r.doc_id, r.near_items, sum(s.end - s.start for s in r.near_spans)) for r in got)
    assert near == (brute_near(texts, tests, 10, slop) if slop else [(d, [], 0) for d, _ in texts])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "row long, doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, 1, "a")], docs.schema)
    assert D.hits(docs, items).count() == 0
    assert [r.n_hit for r in D.hits(some, items).collect()] == [0]


def test_decontaminated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "short item", 5, "k"), (2, "fine", 6, None), (3, None, 7, "k")], "doc_id long, text string, row_key int, row string")
    kept = D.decontaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = D.op4_decontamination(spark, sf).collect()
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert any(r.contaminated for r in got)
    few = docs[:60]
    near = {r.doc_id: r.n_near_items for r in got}
    assert all(near[d] == len(i) for d, i, _ in brute_near(few, items, 10, D.SLOP)) and all(near[r.doc_id] >= r.n_items for r in got)
