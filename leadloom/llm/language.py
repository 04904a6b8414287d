"""Languages by rank-order profiles of character n-grams.

A text's letters are lower-cased, everything else becomes blanks, and the n-grams of one to GRAM characters within blank-padded
words are counted over the whole text. A language's profile ranks the PROFILE most frequent n-grams of all its training
texts; a text's own n-grams are ranked the same way, and its distance to a profile is the sum of how far each n-gram is
out of place, PROFILE for one that the profile lacks. The least distance wins, then the first language in order.

score is 1 - least / second least distance: 0 where two languages tie, 1 where the text's ranks are exactly one profile's.
With one language learned, the second distance is that of a text with nothing in common.

Training rows are those with a text and a language whose crc32(doc_id) mod FOLDS is not HELD; all of them count. doc_id, lang and
source are never inputs of a prediction. Null texts, texts without letters and all texts where nothing was learned give
`und` with score 0. Marks that follow letters count as letters. Repeated rows are predicted one by one and count each
time in training; an empty language is a value like any other. Other columns are ignored. A text of any length is read
whole, CHUNK characters at a time. An empty table gives an empty result.

Bound on the model, not on rows: at most LANGUAGES profiles, those of the languages with most training rows, are learned.
"""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import CRC32_SQL, crc32_sql, remainder, slices

FOLDS, HELD = 4, 2
#: Longest n-gram (three code points fit a long), n-grams of a profile, and the most profiles.
GRAM, PROFILE, LANGUAGES = 3, 400, 256
UNKNOWN = "und"
BITS = 21
#: Characters of a text, and n-grams that a task counts, before they are added up.
CHUNK, HELD_GRAMS = 1 << 20, 1 << 20
#: Parts of a language's n-grams whose most frequent ones are found side by side.
PARTS = 64

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is of a word: 1 for letters, 2 for marks."""
    if not _letters:
        kinds = (unicodedata.category(chr(i))[0] for i in range(0x110000))
        _letters.append(np.fromiter((1 if k == "L" else 2 if k == "M" else 0 for k in kinds), np.uint8, 0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def counted(grams: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and how often each stands there (or the sum of its n)."""
    if n is None:
        return np.unique(grams, return_counts=True)
    found, at = np.unique(grams, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def pieces_of(codes: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    """Stretches of a text, with blanks for all but letters and marks: what stands before the first n-gram's start, those that start there, and what they reach into."""
    kind = letters()
    for start in range(0, len(codes), chunk):
        inside = codes[max(0, start - 1) : start + chunk + GRAM]
        piece = np.where(kind[inside] > 0, inside, 32)
        front, back = [32] * (start == 0), [32] * max(0, start + chunk + GRAM - len(codes))
        yield np.concatenate([front, piece, back]).astype(np.int64) if front or back else piece


def grams_of(text: str, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, as code points side by side in a long, and their counts. None without letters."""
    codes = code_points(text)
    if not (letters()[codes] == 1).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for number, x in enumerate(pieces_of(codes, min(chunk, len(codes)))):
        # the blank in front of a text starts n-grams too; what stands before other stretches belongs to those before them
        begin = 1 if number else 0
        a, b, c = x[begin : len(x) - GRAM], x[begin + 1 : len(x) - GRAM + 1], x[begin + 2 : len(x) - GRAM + 2]
        pairs = (a << BITS) | b
        found.append(counted(np.concatenate([a[a != 32], pairs[(a != 32) | (b != 32)], ((pairs << BITS) | c)[b != 32]])))
    return found[0] if len(found) == 1 else counted(np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found]))


def ranked(grams: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, in order of their counts, then of code points."""
    return grams[np.lexsort((grams, -n))[:most]]


def counts(rows: DataFrame) -> DataFrame:
    """lang, gram and n of the n-grams in training rows (lang, text), as far as tasks added them up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                g, n = counted(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
                for at in range(0, len(g), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.record_batch([pa.array([lang] * len(g[part]), pa.string()), pa.array(g[part]), pa.array(n[part])], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for piece in slices(iter([batch]), "text"):
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                    found = grams_of(text)
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
                    if size > HELD_GRAMS:
                        merged = {k: [counted(np.concatenate([x for x, _ in v]), np.concatenate([x for _, x in v]))] for k, v in held.items()}
                        held, size = merged, sum(len(v[0][0]) for v in merged.values())
                        if size > HELD_GRAMS // 2:
                            yield from flush()
                            size = 0
        yield from flush()

    return rows.mapInArrow(count, "lang string, gram long, n long")


def profiles(docs: DataFrame, training: Column, most: int = PROFILE) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language, learned from those of docs (lang, text) that training marks."""
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    sums = counts(rows.filter(F.col("lang").isin(langs))).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the most frequent of each part of a language's n-grams, then of those that are left: no language is sorted in one task
    order = (F.desc("n"), F.asc("gram"))
    part = F.pmod(F.xxhash64("gram"), F.lit(PARTS))
    some = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    found: dict[str, list[tuple[int, int]]] = {lang: [] for lang in langs}
    for r in best.collect():  # at most LANGUAGES * PROFILE
        found[r.lang].append((r["rank"], r.gram))
    return {lang: np.array([g for _, g in sorted(x)], np.int64) for lang, x in sorted(found.items()) if x}


class Profiles:
    """The ranks of all profiles' n-grams, a row for each n-gram and a column for each language."""

    def __init__(self, learned: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = list(learned), most
        self.grams = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int16)
        for column, grams in enumerate(learned.values()):
            self.ranks[np.searchsorted(self.grams, grams), column] = np.arange(len(grams))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """How far a text's ranked n-grams are out of place in each profile."""
        at = np.minimum(np.searchsorted(self.grams, own), max(0, len(self.grams) - 1))
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        return np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(own))[:, None].astype(np.int32))).sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, n = grams_of(text or "")
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(grams, n, self.most)
        far = self.distances(own)
        best = int(far.argmin())
        second = int(np.delete(far, best).min()) if len(far) > 1 else self.most * len(own)
        return self.langs[best], 1 - int(far[best]) / second if second else 0.0


def predicted(docs: DataFrame, learned: dict[str, np.ndarray], most: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of each of docs (doc_id long, text)."""
    known = docs.sparkSession.sparkContext.broadcast(Profiles(learned, most))  # at most LANGUAGES * PROFILE ranks a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(iter([batch]), "text"):
                found = [known.value.predict(t) for t in piece.column("text").to_pylist()]
                yield pa.record_batch([piece.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by profiles of those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = remainder(FOLDS) == HELD
    found = predicted(docs, profiles(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


ORACLE = rf"""
WITH {CRC32_SQL},
d AS (SELECT row_number() OVER () AS row, doc_id, text, lang, {crc32_sql("coalesce(doc_id::varchar, '')")} % {FOLDS} = {HELD} AS held_out FROM documents, crc),
w AS (SELECT row, lang, held_out, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+')) AS word FROM d WHERE regexp_matches(text, '\p{{L}}')),
p AS (SELECT row, lang, held_out, ' ' || word || ' ' AS word, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT row, lang, held_out, substr(word, i, k) AS gram, n FROM (SELECT *, unnest(range(1, length(word) + 2 - k)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM p))),
g AS (SELECT row, lang, held_out, gram, sum(n) AS n FROM s WHERE gram != ' ' GROUP BY ALL),
own AS (SELECT row, gram, row_number() OVER (PARTITION BY row ORDER BY n DESC, length(gram), gram) AS rank FROM g QUALIFY rank <= {PROFILE}),
learned AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) AS rank FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank <= {PROFILE}),
size AS (SELECT row, count(*) AS size FROM own GROUP BY row),
met AS (SELECT row, lang, sum({PROFILE} - abs(own.rank - learned.rank)) AS near FROM own JOIN learned USING (gram) GROUP BY row, lang),
far AS (SELECT row, lang, size * {PROFILE} - coalesce(near, 0) AS far, size FROM size CROSS JOIN (SELECT DISTINCT lang FROM learned) LEFT JOIN met USING (row, lang)),
best AS (SELECT row, list(lang ORDER BY far, lang)[1] AS lang_pred, list(far ORDER BY far, lang)[1] AS one, coalesce(list(far ORDER BY far, lang)[2], any_value(size) * {PROFILE}) AS two FROM far GROUP BY row)
SELECT doc_id, held_out, coalesce(lang_pred, '{UNKNOWN}') AS lang_pred, CASE WHEN coalesce(two, 0) = 0 THEN 0.0 ELSE 1 - one::double / two::double END AS score FROM d LEFT JOIN best USING (row)"""
