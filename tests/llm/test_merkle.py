import hashlib
import random
import zlib

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from leadloom.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The tree's top, and for each node the runs' others by level with its place."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for s, i in zip(steps, at):
            s.append((i % 16, runs[i // 16][: i % 16] + runs[i // 16][i % 16 + 1 :]))
        at, nodes = [i // 16 for i in at], [h(*r) for r in runs]
    return nodes[0], steps


def brute(rows):
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        sources.setdefault(source, []).append(((doc_id is not None, doc_id or 0), leaf(doc_id, source, lang, n_chars, text), doc_id, (source, lang, n_chars), text))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(sources[s], key=lambda x: x[:2]), *tree([x[1] for x in sorted(sources[s], key=lambda x: x[:2])])) for s in order]
    root, tops = tree([t[1] for t in trees])
    out = []
    for (members, subroot, steps), top in zip(trees, tops):
        for (_, digest, doc_id, (source, lang, n_chars), text), own in zip(members, steps):
            now = digest
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0:
                now = leaf(doc_id, source, lang, n_chars, None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for place, others in own + top:
                now = h(*others[:place], now, *others[place:])
            out.append((doc_id, digest, subroot, root, h(*(x for _, others in own + top for x in others)), now, now == root))
    return sorted(out, key=str)


def made(spark, rows, block):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    found = M.manifest(M.leaves_of(docs.drop("tree", "block"), M.remainder(5) == 0), block)
    proven = M.proofs(found).withColumn("now", M.folded(F.coalesce("other", "digest")))
    return found, sorted(((r.doc_id, r.digest, r.subroot, found.root, hashlib.sha256("".join(r.siblings).encode()).hexdigest(), r.now, r.now == found.root) for r in proven.collect()), key=str)


def corpus(n, sources, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "z", "Z", "\U00010000", "￿", *(f"s{i}" for i in range(sources))][:sources]
    return [(rng.choice([None, i, i, i, i // 3]), rng.choice([None, "", "Aé", f"Text {i}", "no capitals"]), rng.choice([None, "en"]), rng.choice(names[:1] * sources + names), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n,sources,block", [(1, 1, 16), (1, 1, 1), (16, 1, 4), (17, 1, 5), (300, 3, 7), (600, 40, 64), (700, 2, 300), (40, 40, 1), (260, 1, 4096)])
def test_against_brute_force(spark, n, sources, block):
    rows = corpus(n, sources, n)
    rows += rows[:3]
    assert made(spark, rows, block)[1] == brute(rows)


def test_partitions_fetch_only_what_they_lack(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(1000)]
    found, _ = made(spark, rows, 100)
    lacks = M.missing(found.leaves.groupBy("block", "tree").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.first("size").alias("size"))).collect()
    assert len(set(lacks)) == len(lacks)
    for block in range(10):
        own, want = set(range(block * 100, block * 100 + 100)), set()
        size = 1000
        for level in range(3):
            runs = {i // 16 for i in own}
            want |= {(level, i) for r in runs for i in range(r * 16, min(size, r * 16 + 16)) if i not in own}
            own, size = runs, -(-size // 16)
        assert {(r.level, r.idx) for r in lacks if r.block == block} == want


def test_long_text_and_empty(spark):
    rows = [(1, "Ab " * 400_000, "en", None, 3), (2, None, None, "s", None)]
    assert made(spark, rows, 16)[1] == brute(rows)
    found, none = made(spark, [], 16)
    assert found.root is None and none == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in columns) for r in M.op13_merkle_manifest(spark, sf).collect()), key=str) == brute(rows)


def test_query_matches_its_sql(spark, sf):
    assert compare(spark, connect(sf), sf, M.op13_merkle_manifest, M.ORACLE) > 0
