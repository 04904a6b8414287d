import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leadloom.llm import pitman_yor as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def brute(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    held = [zlib.crc32((str(d) if d is not None else "").encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (d, t), h in zip(rows, held):
        ws = tokens(t)
        out.append((d, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows), key=str)


def near(a, b):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-6, atol=1e-4)


def weights(c, d, a, p):
    """Chances of 1 to c tables of a dish, from the recursion of the numbers alone."""
    s = np.full(c + 1, -np.inf)
    s[0] = 0
    for n in range(c):
        k = np.arange(1, n + 2)
        s[1 : n + 2] = np.logaddexp(s[: n + 1], s[1 : n + 2] + np.log(np.maximum(n - k * d, 1e-300)))
        s[0] = -np.inf
    w = s[1:] + np.cumsum(np.log((P.STRENGTH + d * (a + np.arange(c))) * p))
    w = np.exp(w - w.max())
    return w / w.sum()


def drawn(c, d, a, p, m):
    many = np.full(m, c), np.ones(m, np.int64), np.full(m, a), (np.full(m, p), 0, np.ones(m))
    return P.draw(*many, P.Stirling(d), np.random.default_rng(0))


def test_few_customers_follow_their_conditional():
    share = np.bincount(drawn(5, 0.4, 3, 0.3, 200_000), minlength=6)[1:] / 200_000
    assert np.abs(share - weights(5, 0.4, 3, 0.3)).max() < 0.01


@pytest.mark.parametrize("c,d,a,p", [(2, 0.6, 1000, 0.01), (1024, 0.8, 1000, 0.01), (1025, 0.8, 1000, 0.01), (1100, 0.3, 10**6, 1e-5), (2000, 0.6, 100_000, 0.01), (1500, 0.95, 1000, 0.001), (2000, 0.7, 3000, 0.05)])
def test_many_customers_follow_their_conditional(c, d, a, p):
    w = weights(c, d, a, p)
    k = np.arange(1, c + 1)
    mean, t = (w * k).sum(), drawn(c, d, a, p, 3000)
    assert abs(t.mean() / mean - 1) < 0.02 and abs(t.std() - np.sqrt((w * (k - mean) ** 2).sum())) < 0.1 * t.std() + 0.02


def test_a_table_count_does_not_jump_where_the_formula_changes():
    numbers = P.Stirling(0.8)
    c, t = np.full(256, 256.0), np.arange(1, 257.0)
    gap = numbers.large(c, t) - (numbers.exact[256, 1:257] - numbers.exact[256, 1] + numbers.large(c[:1], t[:1]))
    assert np.abs(gap[:250]).max() < 0.03


def test_totals_settle():
    assert P.settled(np.array([1e6, 1e6]), np.array([1.001e6, 1e6])) and not P.settled(np.array([1e6, 1e6]), np.array([1.02e6, 1e6]))


def test_spelling_sums_to_one():
    counts = np.random.default_rng(1).poisson(0.3, (256, 256))
    assert np.allclose((10 ** P.spelling_model(counts)).sum(1), 1)


def dense(texts, held, base_of, sweeps, rng):
    """log10 scores from seating customers one by one in explicit tables, on two levels."""
    train = [tokens(t) for t, h in zip(texts, held) if not h]
    pairs = [(u, w) for ws in train for u, w in zip(["", *ws], ws)]
    ones, twos = (sum(n == k for n in Counter(pairs).values()) for k in (1, 2))
    d, p0 = P.discount_of(ones, twos), base_of({w for _, w in pairs})
    leaf, top = {}, {}  # tables as lists of sizes

    def total(r):
        return sum(map(sum, r.values())), sum(map(len, r.values()))

    def chance(r, w, disc, up):
        c, t = total(r)
        return (sum(r.get(w, [])) - disc * len(r.get(w, [])) + (P.STRENGTH + disc * t) * up) / (P.STRENGTH + c)

    def seat(r, w, disc, up):
        """Whether a new table was opened."""
        sizes = r.setdefault(w, [])
        chances = [n - disc for n in sizes] + [(P.STRENGTH + disc * total(r)[1]) * up]
        k = rng.choice(len(chances), p=np.array(chances) / sum(chances))
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def leave(r, w):
        sizes = r[w]
        k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    sums, n_samples = [0.0] * len(texts), 0
    states = []
    for sweep in range(sweeps):
        up = [len(t) for r in leaf.values() for t in r.values()]
        at_top = Counter()
        for r in leaf.values():
            for w, t in r.items():
                at_top[w] += len(t)
        top_d = P.discount_of(sum(n == 1 for n in at_top.values()), sum(n == 2 for n in at_top.values())) if up else 0.5
        for i in rng.permutation(len(pairs)):
            u, w = pairs[i]
            r = leaf.setdefault(u, {})
            if sweep and leave(r, w):
                leave(top, w)
            if seat(r, w, d, chance(top, w, top_d, p0[w])):
                seat(top, w, top_d, p0[w])
        if sweep >= sweeps // 3:
            n_samples += 1
            states.append([[chance(leaf.get(u if u in p0 else None, {}), w if w in p0 else None, d, chance(top, w if w in p0 else None, top_d, p0.get(w, 1 - sum(p0.values())))) for u, w in zip(["", *tokens(t)], tokens(t))] for t in texts])
    return [sum(math.log10(np.mean([s[k][j] for s in states])) for j in range(len(states[0][k]))) for k in range(len(texts))]


def test_scores_against_seating_one_by_one(spark, monkeypatch):
    """The engine's scores are those of a sampler that moves single customers between explicit tables."""
    monkeypatch.setattr(P, "SAMPLES", 12)
    texts = ["a b a b c", "a b c a", "b a b a b", "d a b", "c c c c a", "q r", "a b a q zz", "", "b b b a b c d", "a b"] * 3
    ids = list(range(len(texts)))
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d in ids]
    assert any(held)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(2)
    found = {r.doc_id: r.score for r in P.scored(docs).collect()}
    known = P.byte_pairs(docs.selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 as held_out"))
    spell, end = P.spelling_model(known[0]), (known[2] + 0.5) / (known[1] + known[2] + 1)

    def base_of(words):
        path = lambda w: f" {w} ".encode()
        return {w: 10 ** (sum(spell[x, y] for x, y in zip(path(w), path(w)[1:]))) * (1 - end) if w else end for w in words}

    want = dense(texts, held, base_of, 150, np.random.default_rng(3))
    assert np.allclose([found[i] for i in ids], want, rtol=0.04, atol=0.04), [(found[i], want[i]) for i in ids]


ROWS = [(i, t) for i, t in enumerate([None, "", " \n ", "a b a", "A b  c\td", "x" * 5000, "\xa0 é É ü", "the the the the", "word " * 3000, "a b a"])] + [(None, "a q"), (3, "a b a"), (44, "zz top")]


@pytest.mark.parametrize("segment_tokens", [4, 3_000_000])
def test_base_and_counts(spark, segment_tokens, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT_TOKENS", segment_tokens)
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, segment int").repartition(3)
    rows = P.scored(docs).collect()
    near(got(rows), brute(ROWS))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(None, "only held out")], "doc_id long, text string")
    assert [r.train_tokens for r in P.scored(docs).collect()] == [0]
    assert P.scored(docs.limit(0)).count() == 0


def test_query_beats_unigrams(spark):
    sf = "/root/testdata/sf0.01"
    rows = P.op10_lm_scores(spark, sf).collect()
    near(got(rows), brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]))
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    print("per token", sum(r.score for r in held) / n, sum(r.base_score for r in held) / n)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
