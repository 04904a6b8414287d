"""Packing documents into training sequences along a space-filling curve.

Each document's token ids are hashed into a vector of VECTOR counts, the vector is scaled to length one and projected to
DIMS dimensions, and the cell of that point gives a Hilbert key. Documents are range-sorted by that key, and the stream
of their ids, neighbours along the curve one after the other, is cut into sequences of `length` ids. Only the very last
sequence can be short, so padding is less than one sequence in all.

Null texts count as empty (a document of the end id alone); documents with equal keys follow one another by doc_id, then
by their ids, nulls first; repeated rows are packed as often as they occur; other columns are ignored. A text of any length is encoded whole and cut into as
many pieces as it needs. An empty table gives no sequences.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, slices, text_or_empty, written
from leadloom.llm.word_ids import CACHE_ENTRIES, word_ids

LENGTH = 4096
VECTOR, DIMS, BITS = 256, 4, 8
SEED = 20
#: Pieces between blanks that a worker keeps the ids of in op6_packing, which does little else; within the pipeline the encoder's own bound holds.
KEPT = 1_400_000

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, pad long"


def projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector slot by token id, and the projection of the vector to DIMS dimensions. Both follow from SEED."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, VECTOR, vocabulary), rng.normal(size=(VECTOR, DIMS))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of cell numbers below 2**bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert keys of documents."""
    slots, to_dims = projection(vocabulary)
    vectors = np.array([np.bincount(slots[i], minlength=VECTOR) for i in ids], np.float64).reshape(-1, VECTOR)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    points = np.round(vectors @ to_dims, 9)  # about normal, so that its distribution function spreads it evenly
    cells = np.floor((1 + np.tanh(points * 0.8)) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1)
    return hilbert_keys(cells)


def along_curve(docs: DataFrame, tokenizer: str, end_id: int, kept: int = CACHE_ENTRIES) -> DataFrame:
    """Tokenized documents in the curve's order, written: `part` and `run` (ids before it in its part) place a row."""
    coder = word_ids(tokenizer)
    width, vocabulary = coder.width, coder.tokenizer.get_vocab_size()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer, kept)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in slices(batches, "text"):
            ids = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            keys = curve_keys([np.frombuffer(x, encoder.dtype) for x in ids], vocabulary)
            yield pa.record_batch([batch.column("doc_id"), pa.array(keys), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "key", "doc_tokens", "ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy()
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(run + np.cumsum(n) - n), batch.column("doc_id"), batch.column("doc_tokens"), batch.column("ids")], ["part", "run", "doc_id", "doc_tokens", "ids"])
            run += int(n.sum())

    # written first: finding the ranges then reads the keys alone and tokenizes nothing
    tokens = written(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(encode, "doc_id long, key long, doc_tokens long, ids binary"), "tokens")
    ranged = tokens.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    placed = written(ranged.mapInArrow(place, "part int, run long, doc_id long, doc_tokens long, ids binary"), "placed")
    discard(tokens)
    return placed


def packed(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, kept: int = CACHE_ENTRIES) -> DataFrame:
    """The pieces of docs (doc_id, text): which ids of which document lie where in which sequence.

    sequence_tokens is how many ids the piece's sequence holds, and pad how many pads follow them: none in full ones,
    none where the last one holds a power of two, else up to `length`. kept: pieces between blanks that a worker keeps the ids of.
    """
    spark = docs.sparkSession
    placed = along_curve(docs, tokenizer, end_id, kept)
    width = word_ids(tokenizer).width
    starts, total = {}, 0
    for part, n in sorted(placed.groupBy("part").agg(F.sum("doc_tokens")).collect()):  # a row for each part
        starts[part], total = total, total + n
    known = spark.sparkContext.broadcast((starts, total))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, total = known.value
        for batch in slices(batches, "ids"):
            out: list[list] = [[] for _ in range(8)]
            for part, run, doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "doc_id", "doc_tokens", "ids"))):
                raw, at = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes(), starts[part] + run
                start = 0
                while start < n:
                    offset = (at + start) % length
                    size = min(n - start, length - offset)
                    piece = raw[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc_id, start, size, piece, zlib.crc32(piece), n, (at + start) // length, offset)):
                        column.append(value)
                    start += size
            filled = np.minimum(length, total - np.array(out[6], np.int64) * length)
            pad = np.where(filled & (filled - 1) == 0, 0, length - filled)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.record_batch([*(pa.array(x, k) for x, k in zip(out, kinds)), pa.array(filled), pa.array(pad)], [f.split()[0] for f in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of 4096 ids: a row for each piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, kept=KEPT).drop("ids")
