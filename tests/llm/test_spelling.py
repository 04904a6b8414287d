import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from leadloom.llm import spelling as S


def one_edit(a, b):
    """Whether exactly one code point inserted, deleted or replaced turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows, least=6, often=5):
    """Words and counts of rows (doc_id, text)."""
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= often}


def brute(words):
    """word, form, root, n, n_near, form_n of words with counts, all against all."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def made_words(n, letters, seed, low=2, high=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))): rng.choice([5, 6, 25, 30, 200, 1000]) for _ in range(n)}


@pytest.mark.parametrize("letters,low", [("ab", 1), ("abc", 1), ("abcdé", 4), ("aÿ\U00010400", 2)])
def test_index_finds_each_pair_once(letters, low):
    words = sorted(made_words(250, letters, 1, low))
    index = S.Index(words)
    for asked in (words, ["x" + w[1:] for w in words], ["zzzz"]):
        for gap in (-1, 0, 1):
            for cut in (0, 1, 2):
                exact = np.array([min(cut, len(a)) for a in asked])
                q, v = index.near(asked, exact, np.full(len(asked), gap))
                want = set()
                for i, a in enumerate(asked):
                    e = int(exact[i])
                    for j, b in enumerate(words):
                        if len(b) - len(a) == gap and len(b) >= e and a[len(a) - e :] == b[len(b) - e :] and one_edit(a[: len(a) - e], b[: len(b) - e]):
                            want.add((i, j))
                pairs = list(zip(q.tolist(), v.tolist()))
                assert len(pairs) == len(set(pairs)) and set(pairs) == want, (gap, cut)


@pytest.mark.parametrize("shard,query", [(1 << 14, 1 << 17), (30, 1 << 17), (5, 7), (1 << 14, 3), (1, 1)])
def test_variants_against_brute_force(spark, shard, query):
    words = made_words(220, "abc", 3, 1) | {"prefix" + w: n for w, n in made_words(60, "ab", 4).items()} | {"éèçà": 5, "éèçàa": 25}
    words.pop("", None)
    found = S.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), shard_words=shard, query_words=query)
    assert got(found) == brute(words)


def test_long_chains(spark):
    words = {"a" * (6 + i): 5 ** (1 + i) for i in range(12)}
    found = got(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == brute(words) and {r[2] for r in found} == {"a" * 17}


def corpus(seed=5):
    rng = random.Random(seed)
    names = ["Strasse", "straße", "STRASSE", "élève", "abcdefg", "abcdefh", "abcdef", "short", "über×mass", "naïveté", "a1bcdefg"]
    rows = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return rows + [(None, "Strasse strasze " * 9), (7, None), (8, ""), (9, "日本語strasse語 ÿÿÿÿÿÿ—ÀÀÀÀÀÀ " * 4), (9, "strasse"), (9, "strasse"), (10, "strassen " * 9000 + "z" * 50_000)]


def test_whole_texts_against_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    assert got(S.variants(S.vocabulary(docs))) == brute(words_of(rows))
    monkeypatch.setattr(S, "STRETCH", 50)
    monkeypatch.setattr(S, "HELD_WORDS", 3)
    assert {(r.word, r.n) for r in S.vocabulary(docs).collect()} == set(words_of(rows).items())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert got(S.variants(S.vocabulary(docs))) == []
    assert got(S.variants(spark.createDataFrame([("abcdefg", 5)], "word string, n long"))) == [("abcdefg", None, "abcdefg", 5, 0, None)]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = got(S.op11_spelling_variants(spark, sf))
    assert found == brute(words_of(rows)) and any(r[1] for r in found)


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), sf, S.op11_spelling_variants, S.ORACLE) > 1000
