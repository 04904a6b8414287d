"""A Merkle manifest of a dataset, and proofs of its rows by octopus multiproofs.

Each row is a leaf. The leaves of a source, in ascending doc_id, form a tree of runs of RUN nodes up to one subroot; the
subroots, ordered by source, form a tree of the same kind up to the root. Nodes are named (tree, level, idx): tree is a
source's number in order, or TOP.

Leaves are numbered in one global order by a range sort and the ranges' counts, and every BLOCK of them is a leaf partition.
A partition holds a stretch of each of its trees. On every level it computes which nodes of the runs at the stretch's ends
it lacks (at most 2 * (RUN - 1), those between are its own), fetches the union of them in one join, derives the interiors
that its rows share, and writes out each row's proof by itself. No source, however large, is ever held in one task.

Any column of a row may be null, which its leaf tells from an empty value. Null sources form a tree of their own, the first;
null doc_ids stand before others of their source. Rows of one source and doc_id follow by their leaves' digests; repeated
rows are leaves of their own. A text of any length is hashed whole, once. Other columns are ignored. An empty table
has no leaves, no root and no proofs.
"""

import hashlib
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import CRC32_SQL, crc32_sql, discard, remainder, written

#: Nodes of a run, as a power of two.
SHIFT = 4
RUN = 1 << SHIFT
#: Leaves of a leaf partition, and rows that a range of the sort has about.
BLOCK, RANGE_ROWS = 4096, 500_000
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPERED = 5


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in UTF-8 and itself, or a dash for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row of documents with this text."""
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with name, which counts its rows from 0 in the order of keys. Written. The driver gets one count for each range."""
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / RANGE_ROWS))
    placed = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    table = written(placed.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "ordered")
    starts, total = [], 0
    for part, n in sorted(table.groupBy("part").count().collect()):
        starts.append((part, total))
        total += n
    known = spark.createDataFrame(starts, "part long, before long")
    return table.join(F.broadcast(known), "part").withColumn(name, F.col("before") + F.col("place")).drop("part", "place", "before")


def climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Tables of nodes (tree, idx, size, digest) by level, from the given one up. size is the nodes that the tree has on the level; a tree ends where it is 1."""
    levels = [nodes]
    while largest > 1:
        runs = levels[-1].filter("size > 1").groupBy("tree", F.shiftright("idx", SHIFT).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.first("size").alias("size"))
        parents = runs.select("tree", "idx", F.shiftright(F.col("size") + (RUN - 1), SHIFT).alias("size"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"))
        levels.append(written(parents, "nodes"))
        largest = (largest + RUN - 1) >> SHIFT
    return levels


@dataclass
class Manifest:
    """leaves: block, tree, idx, size and all columns that were given with them; levels and top: tables of nodes; root: hex, or None without leaves."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """Every node that can be a sibling: tree, level, idx, digest."""
        tables = [t.select("tree", F.lit(k).alias("level"), "idx", "digest") for levels in (self.levels, self.top) for k, t in enumerate(levels)]
        out = tables[0]
        for t in tables[1:]:
            out = out.union(t)
        return out

    def discard(self) -> None:
        discard(self.leaves, *self.levels[1:], *self.top)


def manifest(leaves: DataFrame, block: int = BLOCK) -> Manifest:
    """The trees over leaves (row, source, doc_id, digest, ...). row names a row and stays the same."""
    each = written(numbered(leaves, ["source", "doc_id", "digest", "row"], "at").withColumn("block", F.floor(F.col("at") / block).cast("long")), "numbered")
    spans = written(each.groupBy("block", "source").agg(F.min("at").alias("low"), F.count("*").alias("n")), "spans")
    # sources in order: their first leaves are
    found = written(spans.groupBy("source").agg(F.min("low").alias("start"), F.sum("n").alias("size")), "sources")
    sources = written(numbered(found, ["start"], "tree"), "trees")
    most = sources.agg(F.max("size"), F.count("*")).first()
    of_block = spans.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).select("block", F.col("source").alias("name"), "tree", "start", "size")
    of_block = written(of_block, "spans")
    placed = each.withColumnRenamed("block", "of").join(of_block, (F.col("of") == F.col("block")) & F.col("source").eqNullSafe(F.col("name")))
    placed = written(placed.withColumn("idx", F.col("at") - F.col("start")).drop("of", "name", "start", "at"), "placed")
    levels = climb(placed.select("tree", "idx", "size", "digest"), most[0] or 0)
    subroots = levels[0].filter("size = 1")
    for t in levels[1:]:
        subroots = subroots.union(t.filter("size = 1"))
    trees = most[1]
    first = written(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), "digest"), "subroots")
    top = climb(first, trees)
    root = top[-1].filter("size = 1").first()
    discard(each, spans, found, sources, of_block)
    return Manifest(placed, levels, top, root.digest if root else None)


def missing(spans: DataFrame) -> DataFrame:
    """block, tree, level, idx: the siblings that leaf partitions lack, of spans (block, tree, low, high, size), each once for each partition."""
    levels = spans.withColumn("level", F.explode(F.expr("filter(sequence(0, 15), k -> size > shiftleft(1L, k * 4))")))
    down = lambda c: F.expr(f"shiftright({c}, level * {SHIFT})")
    ends = levels.select("block", "tree", "level", down("low").alias("a"), down("high").alias("b"), down("(size - 1)").alias("last"))
    low = F.col("a") - F.col("a") % RUN
    high = F.least(F.col("b") - F.col("b") % RUN + (RUN - 1), "last")
    none = F.array().cast("array<long>")
    before = F.when(F.col("a") > low, F.sequence(low, F.col("a") - 1)).otherwise(none)
    after = F.when(F.col("b") < high, F.sequence(F.col("b") + 1, high)).otherwise(none)
    return ends.select("block", "tree", "level", F.explode(F.concat(before, after)).alias("idx"))


def derived(known: list[dict[int, str]], size: int, level: int = 0) -> str:
    """Adds to known, a tree's digests by level and idx, the interiors over a stretch whose missing siblings are there. Returns the tree's top."""
    while size > 1:
        here = known[level]
        if len(known) == level + 1:
            known.append({})
        for run in {i >> SHIFT for i in here}:
            known[level + 1][run] = hashlib.sha256("".join([here[i] for i in range(run << SHIFT, min(size, (run + 1) << SHIFT))]).encode()).hexdigest()
        size, level = (size + RUN - 1) >> SHIFT, level + 1
    return known[level][0]


class Steps:
    """The proofs of a tree's nodes: on each level below its top a place in the run and the run's other digests joined. Those that nodes share are made once."""

    def __init__(self, known: list[dict[int, str]], size: int):
        self.known, self.sizes, self.held = known, [size], {}
        while self.sizes[-1] > 1:
            self.sizes.append((self.sizes[-1] + RUN - 1) >> SHIFT)

    def of(self, idx: int, level: int = 0) -> tuple[list[int], list[str]]:
        if level + 1 == len(self.sizes):
            return [], []
        start = idx >> SHIFT << SHIFT
        step = "".join([self.known[level][i] for i in range(start, min(self.sizes[level], start + RUN)) if i != idx])
        if (level, start) not in self.held:
            self.held[level, start] = self.of(idx >> SHIFT, level + 1)
        places, others = self.held[level, start]
        return [idx - start, *places], [step, *others]


def expanded(leaves: pa.Table, fetched: pa.Table, trees: int) -> pa.Table:
    """A leaf partition's rows with their subroots and proofs, of its leaves and the nodes it fetched."""
    known: dict[int, list[dict[int, str]]] = {}

    def put(tree: int, level: int, idx: int, digest: str) -> None:
        levels = known.setdefault(tree, [])
        while len(levels) <= level:
            levels.append({})
        levels[level][idx] = digest

    for x in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
        put(*x)
    of, at = leaves.column("tree").to_pylist(), leaves.column("idx").to_pylist()
    for tree, idx, digest in zip(of, at, leaves.column("digest").to_pylist()):
        put(tree, 0, idx, digest)
    sizes = dict(zip(of, leaves.column("size").to_pylist()))
    for tree, size in sizes.items():
        put(TOP, 0, tree, derived(known[tree], size))
    derived(known[TOP], trees)
    steps = {tree: Steps(known[tree], size) for tree, size in (sizes | {TOP: trees}).items()}
    above = {tree: steps[TOP].of(tree) for tree in sizes}
    places, siblings = [], []
    for tree, idx in zip(of, at):
        own, others = steps[tree].of(idx)
        places.append(own + above[tree][0])
        siblings.append(others + above[tree][1])
    out = leaves.append_column("subroot", pa.array([known[TOP][0][tree] for tree in of]))
    return out.append_column("places", pa.array(places, pa.list_(pa.int32()))).append_column("siblings", pa.array(siblings, pa.list_(pa.string())))


def proofs(made: Manifest) -> DataFrame:
    """The leaves with subroot, places and siblings: by level from a leaf's run to the root, its node's place in the run and the digests of the run's others, left to right, joined."""
    leaves = made.leaves
    spans = leaves.groupBy("block", "tree").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.first("size").alias("size"))
    trees = made.top[0].count()
    tops = leaves.groupBy("block").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).select("block", F.lit(TOP).cast("long").alias("tree"), "low", "high", F.lit(trees).cast("long").alias("size"))
    needed = written(missing(spans.union(tops)), "missing")
    fetched = written(needed.join(made.nodes(), ["tree", "level", "idx"]).select("block", "tree", "level", "idx", "digest"), "fetched")
    discard(needed)

    def expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        return expanded(leaves, fetched, trees)

    schema = T.StructType([*leaves.schema.fields, T.StructField("subroot", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("siblings", T.ArrayType(T.StringType()))])
    return leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(expand, schema)


def folded(start: Column) -> Column:
    """The root that a leaf and its proof (places, siblings) lead to."""

    def up(digest: Column, step: Column) -> Column:
        cut = step["places"] * 64
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), cut), digest, F.substring(step["siblings"], cut + 1, F.lit(64 * RUN))), 256)

    return F.aggregate(F.arrays_zip("places", "siblings"), start, up)


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """row, source, doc_id, digest and other (the leaf with A-Z of the text lower-cased where tampered, else null) of documents. Written."""
    text = F.col("text")
    other = F.when(tampered, leaf(F.translate(text, UPPER, LOWER)))
    return written(docs.select(F.monotonically_increasing_id().alias("row"), "source", F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("digest"), other.alias("other")), "leaves")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot and proof digest, and what its proof gives after some texts were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    made = manifest(leaves_of(docs, remainder(TAMPERED) == 0))
    root = F.lit(made.root).cast("string")
    proven = proofs(made).withColumn("folded_root", folded(F.coalesce("other", "digest")))
    return proven.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )


#: Levels of a tree that the SQL has: sources of up to RUN ** LEVELS rows.
LEVELS = 7


def oracle() -> str:
    """The query in DuckDB SQL, with crc32 from its polynomial and a common table for each level."""
    value = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    id_text = "coalesce(doc_id::varchar, '')"
    parts = [
        CRC32_SQL,
        f"d AS (SELECT doc_id, source, {leaf_of('text')} AS leaf, CASE WHEN {crc32_sql(id_text)} % {TAMPERED} = 0 THEN {leaf_of(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents, crc)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d)",
    ]

    def climb(tag: str, first: str) -> list[str]:
        out = [f"{tag}0 AS ({first})"]
        for k in range(LEVELS):
            out.append(f"r{tag}{k} AS (SELECT tree, idx // {RUN} AS run, string_agg(digest, '' ORDER BY idx) AS all_of, list(digest ORDER BY idx) AS each, any_value(size) AS size FROM {tag}{k} GROUP BY tree, idx // {RUN})")
            out.append(f"{tag}{k + 1} AS (SELECT tree, run AS idx, CASE WHEN size > 1 THEN sha256(all_of) ELSE all_of END AS digest, (size + {RUN - 1}) // {RUN} AS size FROM r{tag}{k})")
        return out

    parts += climb("s", "SELECT tree, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM placed")
    parts += climb("t", f"SELECT 0 AS tree, tree AS idx, digest, count(*) OVER () AS size FROM s{LEVELS}")
    at, proof, now, joins = "p.idx", [], "coalesce(other, leaf)", []
    for tag, tree, start in (("s", "p.tree", "p.idx"), ("t", "0", "p.tree")):
        for k in range(LEVELS):
            at, r = f"({start} // {RUN**k})", f"j{tag}{k}"
            joins.append(f"JOIN r{tag}{k} {r} ON {r}.tree = {tree} AND {r}.run = {at} // {RUN}")
            proof.append(f"CASE WHEN {r}.size > 1 THEN array_to_string({r}.each[:{at} % {RUN}] || {r}.each[{at} % {RUN} + 2:], '') ELSE '' END")
    fold = []
    for tag, start in (("s", "idx"), ("t", "tree")):
        for k in range(LEVELS):
            at, r = f"({start} // {RUN**k} % {RUN})", f"{tag}{k}"
            before = fold[-1].split(" AS ")[0] if fold else "proven"
            fold.append(f"f{r} AS (SELECT * REPLACE (CASE WHEN size_{r} > 1 THEN sha256(array_to_string(each_{r}[:{at}] || [folded_root] || each_{r}[{at} + 2:], '')) ELSE folded_root END AS folded_root) FROM {before})")
    names = [f"{tag}{k}" for tag in "st" for k in range(LEVELS)]
    columns = ", ".join(f"j{r}.each AS each_{r}, j{r}.size AS size_{r}" for r in names)
    parts.append(f"proven AS (SELECT p.*, u.digest AS subroot, o.digest AS root, sha256({' || '.join(proof)}) AS proof_sha256, {now} AS folded_root, {columns} FROM placed p {' '.join(joins)} JOIN s{LEVELS} u ON u.tree = p.tree, t{LEVELS} o)")
    parts += fold
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM {fold[-1].split(' AS ')[0]}"


ORACLE = oracle()
