import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from leadloom.llm import language as L


def grams(text):
    """n-grams of one to three characters in blank-padded words, of texts with letters."""
    text = (text or "").lower()
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return Counter()
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text).split()
    return Counter(p[i : i + k] for w in words for p in [f" {w} "] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i : i + k] != " ")


def rank(counts, most):
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:most])}


def brute(rows, most=L.PROFILE):
    """doc_id, held_out, lang_pred, score of rows (doc_id, text, lang)."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i, _, _ in rows]
    sums = {}
    for (_, text, lang), h in zip(rows, held):
        if not h and lang is not None and text is not None:
            sums.setdefault(lang, Counter()).update(grams(text))
    learned = {lang: rank(c, most) for lang, c in sorted(sums.items()) if c}
    out = []
    for (i, text, _), h in zip(rows, held):
        own = rank(grams(text), most)
        far = sorted((sum(abs(r - p[g]) if g in p else most for g, r in own.items()), lang) for lang, p in learned.items())
        if not own or not far:
            out.append((i, h, "und", 0.0))
            continue
        second = far[1][0] if len(far) > 1 else most * len(own)
        out.append((i, h, far[0][1], 1 - far[0][0] / second if second else 0.0))
    return sorted(out, key=str)


def unpacked(found):
    g, n = found
    name = lambda x: "".join(chr(x >> s & 0x1FFFFF) for s in (42, 21, 0) if x >> s)
    return Counter({name(int(x)): int(k) for x, k in zip(g, n)})


TEXTS = ["", "a", "A b", "Été, l'été!", "ab" * 9, "x1y 2z", "İstanbul", "हिन्दी भाषा", "\U00010400\U00010428 ok", "9 9", "á", "́", "word " * 7 + "end"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 1 << 20])
def test_grams_of_whole_texts(chunk):
    for text in TEXTS:
        assert unpacked(L.grams_of(text, chunk)) == grams(text), text


def rows():
    good = {"en": "the cat and the dog with this one", "de": "der hund und die katze mit dem ding", "fr": "le chat et le chien avec les autres"}
    out = [(i, good[lang] + f" {lang}{i}", lang) for i, lang in enumerate([*good] * 12)]
    return out + [(100, None, "en"), (101, "", "de"), (102, "123 !", "fr"), (103, "the", None), (None, "der", "de"), (104, "x" * 90_000, ""), (105, "et la", ""), (105, "et la", "")]


@pytest.mark.parametrize("most", [2, 30, 400])
def test_against_brute_force(spark, most):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("gram", F.lit(1)).repartition(3)
    held = L.remainder(L.FOLDS) == L.HELD
    got = L.predicted(docs, L.profiles(docs, ~held, most), most)
    found = got.select("doc_id", held.alias("h"), "lang_pred", "score").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows(), most)


def test_flushed_counts_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string").coalesce(1)
    held = L.remainder(L.FOLDS) == L.HELD
    want = L.profiles(docs, ~held)
    monkeypatch.setattr(L, "HELD_GRAMS", 50)
    sums = L.counts(docs.filter("lang is not null and text is not null").select("lang", "text"))
    assert want.keys() == L.profiles(docs, ~held).keys() and all(np.array_equal(want[k], v) for k, v in L.profiles(docs, ~held).items())
    assert sums.agg(F.sum("n")).first()[0] == sum(sum(grams(t).values()) for _, t, lang in rows() if lang is not None and t is not None)


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.predicted(docs, L.profiles(docs, F.lit(True))).collect()} == {("und", 0.0)}
    assert L.predicted(docs.limit(0), L.profiles(docs.limit(0), F.lit(True))).count() == 0


def test_query_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in L.op12_language_id(spark, sf).collect()), key=str)
    assert got == brute(docs)
    truth = {i: lang for i, _, lang in docs}
    assert np.mean([lang == truth[i] for i, h, lang, _ in got if h]) > 0.95


def test_query_matches_its_sql(spark, sf):
    assert compare(spark, connect(sf), sf, L.op12_language_id, L.ORACLE) > 0
