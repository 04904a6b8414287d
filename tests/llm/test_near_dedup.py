import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.llm import near_dedup as N
from leadloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, n, component, kept) by comparing all sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    by, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g]}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            by[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    out = []
    for i, (d, _) in enumerate(rows):
        none, c = least[find(i)]
        out.append((d, len(sets[i]), None if none else c, d == (None if none else c)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in df.collect()), key=str)


def frame(spark, rows):
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, node int").repartition(3)
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for p in pairs if p[0] != p[1] for x in p}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = [None, "", "  \n", "a b", "A  b", "a b c d", "a b c d e", "one two three four five six", "ONE\ttwo three\nfour five six", "a b", "x\xa0y"]
    for n in (30, 80, 200):
        base = fresh(n)
        rows += [edited(rng, base, k) for k in (0, 0, 1, 1, 2, 3, 4, 5, 8) for _ in range(3)]
    passage = fresh(60)
    rows += [" ".join(fresh(rng.randrange(10, 60)) + passage) for _ in range(60)]
    rows += [" ".join(fresh(50)) for _ in range(40)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows), (None, "a b"), (None, "only null id here now"), (3, "repeated id other text again")]


@pytest.mark.parametrize("chunk", [256, 8])
def test_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", chunk)
    rows = corpus()
    assert got(N.groups(frame(spark, rows))) == brute(rows)


def test_deduplicated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "k"), (1, "a b c", "k"), (2, "A b c", None), (3, None, "z"), (4, None, "z")], "doc_id long, text string, row string")
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert N.deduplicated(docs.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(N.op5_near_dedup(spark, sf)) == brute(rows)


def test_what_is_broadcast_does_not_grow_with_candidates(spark, tmp_path):
    """Sides of joins that are small as compressed files alone are not sent to all tasks, and of ids only bits are."""
    from leadloom.llm.common import written

    ids = written(spark.range(0, 600_000, 2).select((F.col("id") * 7919).alias("doc_id")), "ids")
    docs = written(spark.range(0, 600_000).select((F.col("id") * 7919).alias("doc_id"), F.lit("x").alias("text")), "docs")
    store = spark._jsparkSession.sharedState().statusStore()
    written(docs.join(ids, "doc_id", "left_semi"), "joined")
    last = store.executionsList().apply(store.executionsList().size() - 1)
    assert "SortMergeJoin" in last.physicalPlanDescription() and "BroadcastHashJoin" not in last.physicalPlanDescription()
    few = ids.filter("doc_id % 1000 = 0").union(spark.createDataFrame([(None,)], "doc_id long"))
    some = N.marked(docs.union(spark.createDataFrame([(None, "y")], "doc_id long, text string")), few)
    assert some.columns == ["doc_id", "text"]
    assert some.join(few, some.doc_id.eqNullSafe(few.doc_id), "left_semi").count() == few.count()
    assert some.count() < few.count() * 100
