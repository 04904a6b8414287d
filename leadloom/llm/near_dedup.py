"""Near duplicates by an inverted join over MinHash signature coordinates.

A document's set is its distinct runs of five words (of all its words, if fewer), as 64-bit hashes. Documents with equal
sets are one class from the start. Each class has a signature of K coordinates; classes are posted under each
coordinate's value. Two classes are candidates if at least MATCHES of the K values agree, which those at a similarity of
0.75 miss with a probability below 1e-5. Values that only one class has cannot agree, so they are skipped; of the others
a class needs posting under its K - MATCHES + 1 rarest (unique ones included) alone, as two classes with MATCHES
agreements share one of those. Classes that share a posting are brought together in chunks of bounded size; collisions
are counted there over whole signatures, and pairs over the threshold are confirmed on full sets. Large gatherings are
not compared all with all: a first round compares every chunk with one hub chunk, and a second one only what that left
outside the gathering's largest component with the rest, so no link between components is lost.

Null texts and texts without words have no set and no links. Rows are judged one by one: repeated rows are one class.
A null doc_id counts as larger than others. A text of any length is read whole; its set is as large as it has distinct runs. An empty
table gives an empty result. Other columns are ignored or, in deduplicated(), returned as they are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, fresh, text_or_empty, with_row_key, written
from leadloom.llm.components import components

SHINGLE, PERCENT = 5, 75
K, MATCHES = 64, 32
SEED = 7
#: Classes and set bytes of a chunk; bits by which texts are told from others before they are joined; word hashes that a worker keeps, of words of so many bytes at most.
CHUNK, CHUNK_BYTES, MARKS, CACHE_ENTRIES, CACHE_BYTES = 256, 4 << 20, 1 << 24, 500_000, 64

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > CACHE_BYTES:
            return xxhash.xxh64_intdigest(word)
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), len(found))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k, factor in enumerate(PLACES):
        x = h[k : k + n] * factor
        s += x ^ (x >> np.uint64(29))
    s ^= s >> np.uint64(32)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value of each of K hash functions over a set."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, (s[at : at + 4096, None] * FACTORS).min(0), out=least)
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, h1 and h2 (a hash of the set) and keys (coordinates' values, each telling its coordinate). Written."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            names = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            keys = [((signature(s) & ~np.uint64(K - 1)) | np.arange(K, dtype=np.uint64)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                ["row", "doc_id", "n_shingles", "h1", "h2", "keys"],
            )

    return written(docs.select("row", "doc_id", "text").mapInArrow(sketch, "row long, doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "sketches")


def prefix_postings(classes: DataFrame) -> DataFrame:
    """key and node: each class under the rarest of its coordinates' values. Written."""
    posted = classes.select("node", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    own = posted.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    enough = own.filter(F.size("own") >= MATCHES)
    return written(enough.select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - MATCHES + 1)).alias("p")).select("node", "p.key"), "postings")


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids, and a few others: what is broadcast is MARKS bits, however many ids there are."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    bits = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position("bit").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    at = docs.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit"))
    return at.join(F.broadcast(bits), "bucket").filter(F.getbit(byte, place % 8) == 1).select(*docs.columns)


def full_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """node, n, sig (a byte of each coordinate) and shingles of each class of asked (node, h1, h2, doc_id). Written."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            names = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in found], np.uint64).reshape(-1, 2).view(np.int64)
            sig = [((signature(s) >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes() for s in found]
            yield pa.record_batch([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(sig, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["h1", "h2", "sig", "shingles"])

    ids = written(asked.select("doc_id").distinct(), "asked")
    some = marked(docs.select("doc_id", "text"), ids)
    texts = some.join(ids, some.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    # rows of the same doc_id with another text, and all but one of equal sets, go here
    computed = texts.mapInArrow(sets, "h1 long, h2 long, sig binary, shingles binary").dropDuplicates(["h1", "h2"])
    return written(computed.join(asked.select("node", "h1", "h2"), ["h1", "h2"]).select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"), "sig", "shingles"), "sets")


def links_within(table: pa.Table) -> pa.Table:
    """Links between members of the same gathering: collisions counted over signatures, then full sets compared.

    Members that are already connected here or known to be (comp) are not compared again.
    """
    order = np.argsort(table.column("n").to_numpy(), kind="stable")
    node, group, n, comp = (table.column(c).to_numpy()[order] for c in ("node", "gathering", "n", "comp"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, K)[order]
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    sets = [sets[i] for i in order]
    root = np.unique(comp, return_inverse=True)[1].astype(np.int64)
    found = []
    for i in range(len(node)):
        last = np.searchsorted(n, n[i] * 100 // PERCENT, "right")
        j = np.arange(i + 1, last)
        j = j[(group[j] == group[i]) & (root[j] != root[i])]
        if not len(j):
            continue
        agree = (sig[j] == sig[i]).sum(1)
        for k in j[np.argsort(-agree, kind="stable")][: int((agree >= MATCHES).sum())]:
            if root[k] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if 100 * both >= PERCENT * (n[i] + n[k] - both):
                found.append((node[i], node[k]))
                root[root == root[k]] = root[i]
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def confirmed(members: DataFrame) -> DataFrame:
    """Links (a, b) of members (chunk, node, gathering, n, comp, sig, shingles), chunk by chunk."""
    return members.groupBy("chunk").applyInArrow(links_within, "a long, b long")


def chunks_for(rows, size) -> F.Column:
    """How many chunks hold so many rows and set bytes."""
    return F.greatest(F.ceil(rows / CHUNK), F.ceil(size / CHUNK_BYTES), F.lit(1)).cast("int")


def pick(n) -> F.Column:
    """A chunk number below n for a node."""
    return F.pmod(F.xxhash64("node"), n).cast("int")


def all_links(sets: DataFrame, gatherings: DataFrame) -> DataFrame:
    """Enough links to connect what is connected: sets (node, n, sig, shingles), gatherings (node, component). Written."""
    sizes = sets.join(gatherings, "node").groupBy("component").agg(F.count("*").alias("rows"), F.sum(8 * F.col("n")).alias("size")).withColumn("n_chunks", chunks_for(F.col("rows"), F.col("size")))
    members = gatherings.join(sizes, "component").select("node", F.col("component").alias("gathering"), "rows", "size", "n_chunks")
    members = written(members, "members")
    small = members.filter("n_chunks = 1")
    total = small.select("gathering", "rows", "size").distinct().agg(F.sum("rows"), F.sum("size")).first()
    bins = max(1, -(-(total[0] or 0) // CHUNK), -(-(total[1] or 0) // CHUNK_BYTES))
    alone = small.select("node", "gathering", F.array(F.struct(F.lit(-1).cast("long").alias("g"), F.pmod(F.xxhash64("gathering"), F.lit(bins)).cast("int").alias("x"), F.lit(0).alias("y"))).alias("chunks"))
    # large gatherings: the hub chunk, 0, goes with each other chunk
    own = pick(F.col("n_chunks"))
    place = lambda y: F.struct(F.col("gathering").alias("g"), F.lit(0).alias("x"), y.alias("y"))
    hubs = F.transform(F.sequence(F.lit(1), F.col("n_chunks") - 1), place)
    large = members.filter("n_chunks > 1").select("node", "gathering", F.when(own == 0, hubs).otherwise(F.array(place(own))).alias("chunks"))
    first = alone.union(large).select("node", "gathering", F.col("node").alias("comp"), F.explode("chunks").alias("chunk"))
    found = written(confirmed(first.join(sets, "node")), "links")

    known = components(found)
    rest = members.filter("n_chunks > 1").join(known, "node", "left").select("node", "gathering", F.coalesce("component", "node").alias("comp"))
    rest = written(rest.join(sets.select("node", "n"), "node"), "rest")
    per = rest.groupBy("gathering", "comp").agg(F.count("*").alias("rows"), F.sum(8 * F.col("n")).alias("size"))
    split = per.groupBy("gathering").agg(
        F.max(F.struct("rows", "comp"))["comp"].alias("largest"), F.max(F.struct("rows", "size"))["rows"].alias("big_rows"), F.max(F.struct("rows", "size"))["size"].alias("big_size"), F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.count("*").alias("comps")
    ).filter("comps > 1")
    split = split.select("gathering", "largest", chunks_for(F.col("big_rows"), F.col("big_size")).alias("big"), chunks_for(F.col("rows") - F.col("big_rows"), F.col("size") - F.col("big_size")).alias("other"))
    # chunks 0 .. other-1 hold what is outside the largest component, other .. other+big-1 the largest
    placed = rest.join(split, "gathering").withColumn("in_big", F.col("comp") == F.col("largest"))
    mine = F.when(F.col("in_big"), F.col("other") + pick(F.col("big"))).otherwise(pick(F.col("other")))
    pair = lambda k: F.struct(F.col("gathering").alias("g"), F.least(k, F.col("mine")).alias("x"), F.greatest(k, F.col("mine")).alias("y"))
    partners = F.when(F.col("in_big"), F.sequence(F.lit(0), F.col("other") - 1)).otherwise(F.sequence(F.lit(0), F.col("other") + F.col("big") - 1))
    second = placed.withColumn("mine", mine).select("node", "gathering", "comp", F.explode(F.transform(partners, pair)).alias("chunk"))
    out = written(found.union(confirmed(second.join(sets, "node"))), "links")
    discard(members, rest, found)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """A row for each of docs (row, doc_id, text): row, doc_id, n_shingles, component_id, kept_row (the row of the group that stays)."""
    rows = sketches(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = rows.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min(order).alias("least"), F.any_value("keys").alias("keys"))
    classes = written(with_row_key(classes.sortWithinPartitions("h1", "h2"), "node"), "classes")
    postings = prefix_postings(classes)
    centres = postings.groupBy("key").agg(F.min("node").alias("centre"))
    gatherings = components(postings.join(centres, "key").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    asked = written(classes.join(gatherings, "node", "left_semi").select("node", "h1", "h2", F.col("least.doc_id").alias("doc_id")), "asked")
    sets = full_sets(docs, asked)
    linked = components(all_links(sets, gatherings))
    discard(sets, asked, postings)
    each = classes.select("node", "h1", "h2", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # written, so that both sides of the joins are plain shuffles, whose large partitions can be split
    each = written(each, "named")
    least = written(each.groupBy("component").agg(F.min("least").alias("stays")), "least")
    named = written(each.join(least, "component").select("h1", "h2", "stays"), "stays")
    discard(each, least)
    full = rows.filter("n_shingles > 0").select("row", "doc_id", "n_shingles", "h1", "h2").join(named.hint("merge"), ["h1", "h2"])
    empty = rows.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("kept_row"))
    return full.select("row", "doc_id", "n_shingles", F.col("stays.doc_id").alias("component_id"), F.col("stays.row").alias("kept_row")).union(empty)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns as they were."""
    key = fresh(docs, "row_key")
    rows = written(with_row_key(docs, key), "rows")
    kept = groups(rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))).filter("row = kept_row").select(F.col("row").alias(key))
    return rows.join(kept.hint("merge"), key, "left_semi").drop(key)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of near duplicates that it belongs to."""
    docs = with_row_key(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "row")
    return groups(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
