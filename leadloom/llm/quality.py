"""A quality classifier on statistics of whole texts.

Each text gives STATS numbers. Random Fourier features of the standardised numbers approximate a Gaussian kernel; ridge
regression on them is solved from normal equations that partitions sum; isotonic regression on rows kept aside turns
the ridge's value into a probability. The text is read once; everything after that works on the numbers.

Training rows are the labelled documents whose crc32(doc_id) mod FOLDS is not 0; of them the remainders below FOLDS - 1
fit the ridge and the last one the calibration. doc_id, lang, source and labels are never inputs of a score.

Null texts count as empty, and empty texts have a score like any other. Several labels of one doc_id are averaged; null
labels and labels without a document are ignored; repeated documents are scored one by one. Without any training rows
each score is 0.5. A text of any length is measured whole; an empty table has no scores. Other columns are ignored or, in kept(), returned as they are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, fresh, remainder, text_or_empty, with_row_key, written

FOLDS, ACCEPT = 5, 0.3
#: Random features, kernel width in units of sqrt(statistics), ridge penalty a row, and calibration bins.
FEATURES, WIDTH, PENALTY, BINS = 256, 1.5, 1e-3, 512
SEED = 2
#: Sums of normal equations, each a matrix of FEATURES + 1 squared, to which tasks add up theirs before one task adds up these.
SUMS = 32

_bytes = np.arange(256)
UPPER, LOWER = (_bytes >= 65) & (_bytes <= 90), (_bytes >= 97) & (_bytes <= 122)
DIGIT, WIDE = (_bytes >= 48) & (_bytes <= 57), _bytes >= 128
BLANK = np.isin(_bytes, [9, 10, 11, 12, 13, 32])
PUNCTUATION = ~(UPPER | LOWER | DIGIT | WIDE | BLANK) & (_bytes > 32) & (_bytes < 127)
SENTENCE = np.isin(_bytes, [33, 39, 44, 46, 58, 59, 63])
STATS = (
    "log_bytes log_words word_length upper lower digit wide blank punctuation odd_punctuation punctuation_pairs punctuation_before_blank entropy "
    "distinct_words distinct_pairs distinct_lines log_line short_words long_words top_word commas_stops"
).split()


def stats(text: str) -> list[float]:
    """The statistics of a text, in the order of STATS; all of them finite."""
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, np.uint8)
    n, words, lines = max(1, len(raw)), raw.split(), [x for x in raw.split(b"\n") if x]
    counts = np.bincount(codes, minlength=256)
    share = lambda kind: counts[kind].sum() / n
    dots, blanks = PUNCTUATION[codes], BLANK[codes]
    k, p = max(1, len(words)), counts[counts > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(50.0, len(raw) / k), share(UPPER), share(LOWER), share(DIGIT), share(WIDE), share(BLANK), share(PUNCTUATION), share(PUNCTUATION & ~SENTENCE),
        (dots[1:] & dots[:-1]).sum() / k, (dots[:-1] & blanks[1:]).sum() / k, float(-(p * np.log2(p)).sum()),
        len(seen) / k, len(set(zip(words, words[1:]))) / k, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        (lengths <= 3).sum() / k, (lengths > 12).sum() / k, max(seen.values(), default=0) / k, counts[[44, 46]].sum() / k,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """row, doc_id and stats of docs (row, doc_id, text). Written."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stats(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["row", "doc_id", "stats"])

    return written(docs.select("row", "doc_id", text_or_empty().alias("text")).mapInArrow(measure, "row long, doc_id long, stats array<double>"), "stats")


class Model:
    """Standardisation, random features, ridge weights and calibration; a few hundred kB."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.directions = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots = np.array([[0.0, 0.5]])

    def features(self, found: np.ndarray) -> np.ndarray:
        x = np.clip((found - self.mean) / self.spread, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def value(self, found: np.ndarray) -> np.ndarray:
        """The ridge's value, from 0 to 1."""
        return np.clip(self.features(found) @ self.weights, 0, 1)

    def score(self, found: np.ndarray) -> np.ndarray:
        """The calibrated probability of label 1. A small share of the ridge's value keeps ranks within flat stretches."""
        value = self.value(found)
        return np.clip(0.98 * np.interp(value, self.knots[:, 0], self.knots[:, 1]) + 0.02 * value, 0, 1)


def stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(STATS))


def isotonic(value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Knots (value, probability) of the best non-decreasing fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, y, w in zip(value, label, weight):
        blocks.append([v * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([[v / w, y / w] for v, y, w in blocks])


def trained(rows: DataFrame, labels: DataFrame) -> Model | None:
    """The model that the labelled ones of rows (doc_id, stats) give, or None without any."""
    asked = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    # where the same doc_id stands twice, both rows count
    known = written(rows.join(asked, "doc_id").withColumn("fold", remainder(FOLDS)).filter("fold != 0").select("fold", "label", "stats"), "labelled")
    each = [F.col("stats")[i].alias(s) for i, s in enumerate(STATS)]
    sums = known.select(*each).agg(F.count("*").alias("n"), *[f(s).alias(f"{k}_{s}") for s in STATS for k, f in (("mean", F.avg), ("spread", F.stddev_pop))]).first()
    if not sums.n:
        return None
    model = Model(np.array([sums[f"mean_{s}"] for s in STATS]), np.maximum([sums[f"spread_{s}"] for s in STATS], 1e-6))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = model.features(stacked(batch))
            total, right = total + z.T @ z, right + z.T @ batch.column("label").to_numpy()
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SUMS], pa.int64()), pa.array([total.tobytes()]), pa.array([right.tobytes()])], ["part", "total", "right"])

    def added(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, right, some = np.zeros((FEATURES + 1) ** 2), np.zeros(FEATURES + 1), False
        for batch in found:
            for a, b in zip(batch.column("total").to_pylist(), batch.column("right").to_pylist()):
                total, right, some = total + np.frombuffer(a), right + np.frombuffer(b), True
        if some:
            yield pa.record_batch([pa.array([total.tobytes()]), pa.array([right.tobytes()])], ["total", "right"])

    each = known.filter(F.col("fold") != FOLDS - 1).select("label", "stats").mapInArrow(equations, "part long, total binary, right binary")
    # tasks' sums are added up by remainder, then those SUMS ones; the driver gets one, however many tasks there are
    parts = each.repartition(SUMS, "part").select("total", "right").mapInArrow(added, "total binary, right binary")
    sums = parts.repartition(1).mapInArrow(added, "total binary, right binary").first()
    total = (np.frombuffer(sums.total) if sums else np.zeros((FEATURES + 1) ** 2)).reshape(FEATURES + 1, FEATURES + 1)
    right = np.frombuffer(sums.right) if sums else np.zeros(FEATURES + 1)
    n = max(1.0, total[-1, -1])
    model.weights = np.linalg.solve(total + PENALTY * n * np.diag([1.0] * FEATURES + [1e-9]) / FEATURES + 1e-9 * np.eye(FEATURES + 1), right)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(model.value(stacked(batch))), batch.column("label")], ["value", "label"])

    aside = known.filter(F.col("fold") == FOLDS - 1).select("label", "stats").mapInArrow(values, "value double, label double")
    bins = sorted(aside.groupBy(F.floor(F.col("value") * BINS).alias("bin")).agg(F.avg("value").alias("value"), F.avg("label").alias("label"), F.count("*").alias("n")).collect())
    if bins:
        model.knots = isotonic(*(np.array([r[c] for r in bins], float) for c in ("value", "label", "n")))
    else:
        model.knots = np.array([[0.0, 0.0], [1.0, 1.0]])
    discard(known)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, doc_id and score of each of docs (row, doc_id, text)."""
    rows = measured(docs)
    model = docs.sparkSession.sparkContext.broadcast(trained(rows, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, 0.5) if model.value is None else model.value.score(stacked(batch))
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(found)], ["row", "doc_id", "score"])

    return rows.mapInArrow(score, "row long, doc_id long, score double")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score below ACCEPT."""
    key = fresh(docs, "row_key")
    rows = written(with_row_key(docs, key), "rows")
    good = scored(rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", "quality")).filter(F.col("score") >= ACCEPT)
    return rows.join(good.select(F.col("row").alias(key)), key, "left_semi").drop(key)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and verdict."""
    docs = with_row_key(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "row")
    found = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return found.select("doc_id", (remainder(FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
