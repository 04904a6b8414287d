"""Token ids in compressed files: canonical length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

A data set is a folder with two Parquet tables. `codebook` has a row for each id in use (id, code length); canonical
codes follow from the lengths. `blocks` has a row for each block of whole documents: where its ids start in the whole
data set, its documents and their lengths, the code bits, and the bit offset of every CHECKPOINT-th id. A block is
decoded from its own row alone, all its checkpoints side by side by one table look-up for each id.

Null texts count as empty; a null doc_id sorts first; rows with equal doc_id follow one another, by text; empty tables
give empty data sets; other columns are ignored. A text of any length is encoded whole and lies in one block.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, new_path, slices, text_or_empty, written
from leadloom.llm.word_ids import word_ids

#: Longest code in bits; ids from one checkpoint to the next; ids after which a block is closed.
MAX_BITS, CHECKPOINT, BLOCK_IDS = 20, 128, 1 << 16
#: Pieces between blanks that a worker keeps the ids of; more than other encoders keep, as this one does little else.
PIECES = 1_400_000

TOKENS = "part int, seq long, doc_id long, run long, n_tokens long, ids binary"
BLOCKS = "part int, seq long, start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, bits binary, checkpoints binary"


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits by package-merge. The work is bounded by the vocabulary."""
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} ids do not fit codes of {limit} bits")
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    ids = sorted(counts, key=lambda i: (counts[i], i))
    leaves = np.array([counts[i] for i in ids], np.float64)
    # level by level, the order of leaves and packages; then the cheapest 2n-2 are opened from the top
    orders, weights = [], leaves
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        orders.append(order < len(leaves))
        weights = both[order]
    lengths, take = np.zeros(len(ids), np.int64), 2 * len(ids) - 2
    for is_leaf in reversed(orders):
        n_leaves = int(is_leaf[:take].sum())
        lengths[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[:take] += 1
    return {i: int(n) for i, n in zip(ids, lengths)}


def canonical_codes(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by id; codes count up in order of (length, id)."""
    ids, n = in_order(lengths)
    codes, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    # a code of n bits stands for a stretch of 2**(top-n) of the codes of `top` bits; its stretch starts where the last one ended
    top = int(n.max(initial=0))
    stretch = np.left_shift(1, top - n)
    codes[ids], bits[ids] = (np.cumsum(stretch) - stretch) >> (top - n), n
    return codes, bits


def in_order(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and code lengths in order of (length, id)."""
    ids, n = np.fromiter(lengths.keys(), np.int64, len(lengths)), np.fromiter(lengths.values(), np.int64, len(lengths))
    order = np.lexsort((ids, n))
    return ids[order], n[order]


def decode_tables(lengths: dict[int, int], limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next `limit` bits."""
    ids, n = in_order(lengths)
    stretch = np.left_shift(1, limit - n)
    out = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    for table, values in zip(out, (ids, n)):
        table[: stretch.sum()] = np.repeat(values, stretch)
    return out


def pack(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, bytes]:
    """The ids' code bits, highest bit first, and the bit offset of every CHECKPOINT-th id."""
    n = bits[ids]
    ends = np.cumsum(n)
    starts = ends - n
    words = np.zeros(int(ends[-1]) // 32 + 2 if len(ids) else 1, np.float64)
    shifted = codes[ids] << (64 - n - (starts & 31)).astype(np.uint64)
    at = starts >> 5
    # codes share no bit, so sums of their halves are exact
    words += np.bincount(at, (shifted >> np.uint64(32)).astype(np.float64), len(words))
    words += np.bincount(at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    return words.astype(">u4").tobytes(), starts[::CHECKPOINT].astype("<u4").tobytes()


def unpack(data: bytes, checkpoints: bytes, n_ids: int, tables: tuple[np.ndarray, np.ndarray], limit: int = MAX_BITS) -> np.ndarray:
    """The ids of a block; every checkpoint's run is decoded side by side."""
    ids, bits = tables
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    mask = np.uint32((1 << limit) - 1)
    for k in range(min(CHECKPOINT, n_ids)):
        if k and n_ids - (len(at) - 1) * CHECKPOINT <= k and len(at) * CHECKPOINT > n_ids:
            at = at[: (n_ids - k + CHECKPOINT - 1) // CHECKPOINT]
        window = (ahead[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & mask
        out[k, : len(at)] = ids[window]
        at = at + bits[window]
    return out.T.reshape(-1)[:n_ids]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each document and the end id, in order of doc_id: `part` and `seq` place a row, `run` counts the part's ids before it. Written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, run = word_ids(tokenizer, PIECES), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in slices(batches, "text"):
            ids = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            n = np.array([len(x) // encoder.width for x in ids], np.int64)
            k = len(n)
            yield pa.record_batch(
                [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(seq, seq + k)), batch.column("doc_id"), pa.array(run + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "seq", "doc_id", "run", "n_tokens", "ids"],
            )
            seq, run = seq + k, run + int(n.sum())

    ranged = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(encode, TOKENS), "tokens")


def part_starts(tokens: DataFrame) -> dict[int, int]:
    """Ids before each part. One row a part comes to the driver."""
    starts, total = {}, 0
    for part, n in sorted(tokens.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], total = total, total + n
    return starts


def id_counts(tokens: DataFrame, width: int) -> dict[int, int]:
    """How often each id occurs in the whole data set: at most a row for each id of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                n = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Tokenize docs (doc_id, text), count ids, and write the coded blocks in order of doc_id."""
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, end_id)
    width = word_ids(tokenizer).width
    lengths = code_lengths(id_counts(tokens, width)) if (starts := part_starts(tokens)) else {}
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    codebook = spark.sparkContext.broadcast((lengths, starts))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts = codebook.value
        codes, bits = canonical_codes(lengths, max(lengths, default=0) + 1)
        held: list[dict] = []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(r["ids"], f"<u{width}") for r in held])
            data, checkpoints = pack(ids, codes, bits)
            first = held[0]
            row = [first["part"], first["seq"], starts[first["part"]] + first["run"], len(ids), [r["doc_id"] for r in held], [r["n_tokens"] for r in held], data, checkpoints]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(block_schema.names, row))], block_schema)

        block_schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.binary())])
        n = 0
        for batch in slices(batches, "ids"):
            for row in batch.to_pylist():
                if held and (row["part"] != held[0]["part"] or row["seq"] != held[-1]["seq"] + 1):
                    yield closed()
                    n = 0
                held.append(row)
                n += row["n_tokens"]
                if n >= BLOCK_IDS:
                    yield closed()
                    n = 0
        if held:
            yield closed()

    tokens.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(tokens)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a data set: doc_id, start (ids before it in the data set), n_tokens, ids (little-endian unsigned 32-bit)."""
    lengths = {r.id: r.bits for r in spark.read.parquet(f"{path}/codebook").collect()}
    codebook = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decode_tables(codebook.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["bits"], row["checkpoints"], row["n_ids"], tables).astype("<u4")
                n = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - n), pa.array(n), pa.array([raw[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), n.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    table = spark.read.parquet(f"{path}/blocks").select("start", "n_ids", "doc_ids", "doc_tokens", "bits", "checkpoints")
    return table.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents written as token files and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
