import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.llm import exact_dedup as E
from leadloom.llm.common import with_row_key, written


def brute(rows):
    groups = defaultdict(list)
    for n, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, n, doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


TEXTS = [None, "", " \n", "a b", "ab", "a  b", "abc" * 9, "abc " * 9, "abc" * 9 + "d", "é" * 11, "é " * 11, "x\xa0y", "xy", "abcd" * 4, "abcd" * 5, "abcdabcd", "z" * 33, "z" * 32 + "y", "a b"]


@pytest.mark.parametrize("size", [1, 3, 4, 4096])
@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(spark, size, clash):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(4, "ab"), (6, "abc" * 9), (6, "abc" * 9)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, name int, level int").repartition(3)
    hash_of = (lambda b: F.octet_length(b).cast("long") % 3) if clash else F.xxhash64
    assert got(E.groups(written(with_row_key(docs, "row"), "rows"), size, hash_of)) == brute(rows)


def test_deduplicated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "k", 7, 0), (2, "ab", None, 8, 0), (3, None, "k", 9, 0)], "doc_id long, text string, row string, name int, row_key int")
    kept = E.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty(spark):
    assert E.groups(spark.createDataFrame([], "row long, doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(E.op9_exact_dedup(spark, sf)) == brute(rows)
