"""Spelling variants of a corpus's words, by searches with one error in FM-indexes of the vocabulary in both directions.

Two words are near if one code point inserted, deleted or replaced turns one into the other. Cut the one that is looked for, of
m code points, after its first m // 2: the error lies in one half and the other half is exact. So each word is indexed under
its two halves, and asks for words one shorter, as long and one longer under each half of itself that they would have.

The words of a shard lie side by side, each ended by a delimiter, in an FM-index: shards of first halves hold the words reversed, so
that both kinds are searched alike, from the delimiter through the exact half and on across the other half with one error
(which one the lengths tell). The state of a search is an interval of suffix ranks. As every search begins at a word's
outer end, it goes one way only, and one direction's interval says it all; a delimiter at the far end names the word.

A shard's index is held in memory, and queries stream past it. A half with more than SHARD_WORDS words is spread over shards of its own,
each of which all its queries visit, and a half with more than QUERY_WORDS queries deals them out; so no group has to fit
one task, and no word is left out.

A word's form is its near word of the largest count (ties: the first in code-point order), if that is RATIO times its own or more; its root is
the last of the forms that follow. Null texts have no words; empty texts neither; repeated rows count each time; other columns are ignored; a null
doc_id is written as nothing before the colon. Texts of any length are read whole, in stretches that end between words. An empty table has no words.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import CRC32_SQL, crc32_sql, discard, slices, written

#: The contract's: every run whose crc32 it divides loses a code point; least code points and occurrences of a word; how much more frequent a form is.
DROP, LEAST, OFTEN, RATIO = 199, 6, 5, 5
#: Words of an index and queries of a shard, about; words that a task counts before it hands them on; bytes of a text that are cut into words at a time.
SHARD_WORDS, QUERY_WORDS, HELD_WORDS, STRETCH = 1 << 14, 1 << 17, 400_000, 1 << 22

#: Latin-1 bytes to the same, with A-Z lower-cased and blanks for all but letters.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The runs of letters of a text in Latin-1, some at a time."""
    letters = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while at < len(letters):
        end = letters.find(b" ", at + STRETCH)
        end = len(letters) if end < 0 else end
        yield letters[at:end].split()
        at = end


def counts(docs: DataFrame, drop: int, least: int) -> DataFrame:
    """word and n of docs (doc_id long, text), as far as tasks added them up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for piece in slices(iter([batch]), "text"):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for some in runs(text or ""):
                        for run, n in Counter(w for w in some if len(w) >= least).items():
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                            if h % drop == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                                if len(run) < least:
                                    continue
                            held[run] = held.get(run, 0) + n
                        if len(held) > HELD_WORDS:
                            yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, drop: int = DROP, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word and n: the words of docs with at least `least` code points and `often` occurrences. Written."""
    return written(counts(docs, drop, least).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often), "vocabulary")


class Index:
    """An FM-index of distinct words, each followed by a delimiter, the least symbol. Suffixes end at their word's delimiter; equal ones follow in the words' order."""

    def __init__(self, words: list[str]):
        raw = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), "<u4")
        self.alphabet, text = np.unique(raw, return_inverse=True)
        self.n, ends = len(text), np.flatnonzero(text == 0)
        self.words = len(ends)
        # ranks of suffixes by their first 1, 2, 4, ... symbols; a delimiter's rank is its own from the start, so that no rank looks past it
        rank, reach = text + self.words - 1, 1
        rank[ends] = np.arange(self.words)
        while True:
            key = rank * (self.n + len(self.alphabet) + 1) + rank[np.minimum(np.arange(self.n) + reach, self.n - 1)]
            order = np.argsort(key, kind="stable")
            rank = np.empty(self.n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if rank[order[-1]] == self.n - 1:
                break
            reach *= 2
        self.before = text[order - 1]  # the symbol before each suffix: the transform
        places = np.argsort(self.before, kind="stable")
        self.keys = self.before[places] * (self.n + 1) + places
        self.fronts = places[: self.words]  # ranks of suffixes that are whole words, in order
        self.number = np.searchsorted(ends, order[self.fronts])  # their words

    def symbols(self, raw: np.ndarray) -> np.ndarray:
        """Code points as symbols; -1 for those that no word has."""
        at = np.minimum(np.searchsorted(self.alphabet, raw), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == raw, at, -1)

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of suffixes that are a symbol and one of the suffixes from low to high."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each interval's number and symbols that stand before its suffixes: read off where it is short, all symbols else."""
        short = high - low <= len(self.alphabet)
        at = np.flatnonzero(short)
        size = (high - low)[at]
        of = np.repeat(at, size)
        place = np.repeat(low[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pairs = np.unique(of * len(self.alphabet) + self.before[place])
        wide = np.flatnonzero(~short)
        of = np.concatenate([pairs // len(self.alphabet), np.repeat(wide, len(self.alphabet))])
        symbol = np.concatenate([pairs % len(self.alphabet), np.tile(np.arange(len(self.alphabet)), len(wide))])
        return of[symbol > 0], symbol[symbol > 0]

    def near(self, queries: list[str], exact: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a word of `gap` code points more that ends in the query's last `exact` ones and has one error before them. Each pair once."""
        lengths = np.fromiter(map(len, queries), np.int64, len(queries))
        symbols = self.symbols(np.frombuffer("".join(queries).encode("utf-32-le"), "<u4"))
        ends = np.cumsum(lengths)
        query, low, high, at = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), self.words), np.zeros(len(queries), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        while len(query):
            # from where a word's exact part ends, an error may come before each further symbol
            open_ = at >= exact[query]
            q, j, lo, hi = query[open_], at[open_], low[open_], high[open_]
            lost = (gap[q] < 0) & (j < lengths[q])
            found.append((q[lost], j[lost] + 1, lo[lost], hi[lost]))
            other = (gap[q] > 0) | ((gap[q] == 0) & (j < lengths[q]))
            q, j, lo, hi = q[other], j[other], lo[other], hi[other]
            of, symbol = self.branches(lo, hi)
            same = gap[q[of]] == 0
            keep = ~same | (symbol != symbols[np.where(same, ends[q[of]] - 1 - j[of], 0)])
            of, symbol = of[keep], symbol[keep]
            new_low, new_high = self.extended(lo[of], hi[of], symbol)
            some = new_high > new_low
            of = of[some]
            found.append((q[of], j[of] + (gap[q[of]] == 0), new_low[some], new_high[some]))
            query, at, low, high = self.stepped(symbols, ends, lengths, query, at, low, high)
        query, at, low, high = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        pairs = []
        while len(query):
            done = at == lengths[query]
            first, last = np.searchsorted(self.fronts, low[done]), np.searchsorted(self.fronts, high[done])
            size = last - first
            place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            pairs.append(np.repeat(query[done], size) * self.words + self.number[place])
            query, at, low, high = self.stepped(symbols, ends, lengths, query, at, low, high)
        pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))
        return pairs // self.words, pairs % self.words

    def stepped(self, symbols, ends, lengths, query, at, low, high):
        """Searches one symbol of their queries further; those that are at the end or in vain go."""
        more = at < lengths[query]
        query, at, low, high = query[more], at[more], low[more], high[more]
        symbol = symbols[ends[query] - 1 - at]
        low, high = self.extended(low, high, symbol)
        some = (high > low) & (symbol > 0)
        return query[some], at[some] + 1, low[some], high[some]


#: Sides of a word that are exact.
FIRST, SECOND = 0, 1


def half(word: Column, side: Column, length: Column) -> Column:
    """What a word has of the half that words of a length share with it."""
    cut = F.floor(length / 2).cast("int")
    return F.when(side == FIRST, F.substring(word, F.lit(1), cut)).otherwise(F.substring(word, F.char_length(word) - (length - cut) + 1, length - cut))


def routed(words: DataFrame, shard_words: int, query_words: int) -> DataFrame:
    """shard, kind (0 indexed, 1 asking), side, word, n and m of all words that some search needs, each in the shards where it is needed."""
    sides = F.explode(F.array(F.lit(FIRST), F.lit(SECOND))).alias("side")
    indexed = words.select("word", "n", sides, F.char_length("word").alias("m"))
    indexed = indexed.withColumn("half", half(F.col("word"), F.col("side"), F.col("m")))
    asking = words.select("word", F.explode(F.sequence(F.char_length("word") - 1, F.char_length("word") + 1)).alias("m")).filter("m > 0").select("word", "m", sides)
    asking = asking.withColumn("half", half(F.col("word"), F.col("side"), F.col("m")))
    keys = ["side", "m", "half"]
    sizes = indexed.groupBy(keys).agg(F.count("*").alias("n_words")).join(asking.groupBy(keys).agg(F.count("*").alias("n_queries")), keys)
    # a word alone under a half is asked for by itself only, if by a single query
    sizes = written(sizes.filter("n_words > 1 or n_queries > 1"), "halves")
    shards = max(1, math.ceil((sizes.agg(F.sum("n_words")).first()[0] or 0) / shard_words))
    spread = [F.ceil(F.col(c) / most).cast("int") for c, most in (("n_words", shard_words), ("n_queries", query_words))]
    sizes = sizes.select(*keys, spread[0].alias("over"), spread[1].alias("by"))
    own = F.pmod(F.xxhash64("word"), F.lit(1 << 31))
    index_parts = F.transform(F.sequence(F.lit(0), F.col("by") - 1), lambda j: F.struct((own % F.col("over")).cast("int").alias("i"), j.alias("j")))
    query_parts = F.transform(F.sequence(F.lit(0), F.col("over") - 1), lambda i: F.struct(i.alias("i"), (own % F.col("by")).cast("int").alias("j")))
    shared = F.concat_ws(" ", F.lit("all"), "side", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    shard = F.when((F.col("over") == 1) & (F.col("by") == 1), shared).otherwise(F.concat_ws(" ", F.lit("own"), "side", "m", "part.i", "part.j", "half")).alias("shard")
    rows = indexed.join(sizes, keys).select("*", F.explode(index_parts).alias("part")).select(shard, F.lit(0).alias("kind"), "side", "word", "n", "m")
    return rows.union(asking.join(sizes, keys).select("*", F.explode(query_parts).alias("part")).select(shard, F.lit(1).alias("kind"), "side", "word", F.lit(0).cast("long").alias("n"), "m"))


def searched(shards: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, less (its best near word's count, negative) and form: what each query finds, of rows sorted by shard and kind."""
    held, words, counts, index = None, [], [], None
    for batch in shards:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "side", "word", "n", "m"))))
        start = 0
        while start < len(rows):
            shard, kind, side = rows[start][:3]
            end = start
            while end < len(rows) and rows[end][:2] == (shard, kind):
                end += 1
            some, start = rows[start:end], end
            if shard != held:
                held, words, counts, index = shard, [], [], None
            turned = (lambda w: w[::-1]) if side == FIRST else (lambda w: w)
            if kind == 0:
                words += [turned(r[3]) for r in some]
                counts += [r[4] for r in some]
                continue
            if not words:
                continue
            if index is None:
                # in order, so that the first of equal counts is the first in code-point order
                order = sorted(range(len(words)), key=lambda i: turned(words[i]))
                words, counts = [words[i] for i in order], np.array([counts[i] for i in order], np.int64)
                index = Index(words)
            m = np.fromiter((r[5] for r in some), np.int64, len(some))
            asked = [turned(r[3]) for r in some]
            q, v = index.near(asked, m // 2 if side == FIRST else m - m // 2, m - np.fromiter(map(len, asked), np.int64, len(asked)))
            if side == SECOND:  # pairs that share the first half too are found there
                new = np.fromiter((asked[a][: m[a] // 2] != words[b][: m[a] // 2] for a, b in zip(q.tolist(), v.tolist())), bool, len(q))
                q, v = q[new], v[new]
            if not len(q):
                continue
            best = np.lexsort((v, -counts[v], q))
            q, v = q[best], v[best]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            size = np.diff(np.append(first, len(q)))
            yield pa.record_batch([
                pa.array([some[i][3] for i in q[first].tolist()], pa.string()), pa.array(size, pa.int64()),
                pa.array(-counts[v[first]], pa.int64()), pa.array([turned(words[i]) for i in v[first].tolist()], pa.string()),
            ], ["word", "n_near", "less", "form"])


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, query_words: int = QUERY_WORDS) -> DataFrame:
    """word, n_near, and the most frequent near word (most, most_n) of those of words (word, n; distinct, no NUL in them) that have near words."""
    rows = written(routed(words, shard_words, query_words), "shards")
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(searched, "word string, n_near long, less long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    out = written(best.select("word", "n_near", F.col("best.form").alias("most"), (-F.col("best.less")).alias("most_n")), "near")
    discard(rows)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form; no circles): the last of the forms that follow, in as many rounds as the longest chain has doublings. Written."""
    links = written(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(further, "root", "left_semi").isEmpty():
            return links
        old, links = links, written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
        discard(old)


def variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, query_words: int = QUERY_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of words (word, n)."""
    near = near_words(words, shard_words, query_words)
    is_form = F.col("most_n") >= ratio * F.col("n")
    each = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("most")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("most_n")).alias("form_n")
    )
    each = written(each, "forms")
    ends = roots(each.filter("form is not null").select("word", "form"))
    return each.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of documents with its near words' count, its form and its root."""
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = rf"""
WITH RECURSIVE {CRC32_SQL},
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= {LEAST}),
hashed AS (SELECT run, n, {crc32_sql("coalesce(doc_id::varchar, '') || ':' || run")} AS h FROM runs, crc),
words AS (SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::bigint AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST} AND sum(n) >= {OFTEN}),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
    SELECT less.word, words.word AS other FROM less JOIN words ON rest = words.word
    UNION SELECT words.word, less.word FROM less JOIN words ON rest = words.word
    UNION SELECT a.word, b.word FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word),
best AS (SELECT near.word, count(*) AS n_near, list(other ORDER BY o.n DESC, other)[1] AS most, max(o.n) AS most_n FROM near JOIN words o ON o.word = other GROUP BY near.word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most_n >= {RATIO} * n THEN most END AS form, CASE WHEN most_n >= {RATIO} * n THEN most_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT chain.word, form, steps + 1 FROM chain JOIN forms ON forms.word = root WHERE form IS NOT NULL)
SELECT word, form, list(root ORDER BY steps DESC)[1] AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n FROM chain JOIN forms USING (word) GROUP BY word, form"""
