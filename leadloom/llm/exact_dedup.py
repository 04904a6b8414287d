"""Exact duplicates by deterministic block naming.

The normalised text (white space deleted) is cut into blocks of BLOCK bytes. Distinct blocks are sorted and numbered;
then adjacent numbers of a document are paired, distinct pairs are numbered, and so on until each document is one
number. Two documents have the same (level, number) exactly when their normalised texts are identical: names stand for
contents, never for hashes of them.

Blocks go back to their rows through a 64-bit hash rather than by shuffling their bytes again. That is exact: hashes that
stand for more than one distinct block are found, and their rows are named through the block bytes themselves.
Copies are merged in each task before anything is shuffled, and joins on names are left for adaptive execution to split.

Null texts count as empty, and empty texts equal one another. Of equal texts the row with the most code points stays,
then the smallest doc_id (nulls last), then the first of repeated rows. Other columns are ignored or, in
deduplicated(), returned as they are, whatever their names. An empty table gives an empty result; a text of any length
is a row for each of its blocks.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, fresh, with_row_key, written

BLOCK = 4096

ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""


def normalised(text: Column) -> Column:
    """The text's UTF-8 bytes without ASCII white space."""
    return F.encode(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", ""), "utf-8")


def measured(rows: DataFrame, size: int, hash_of) -> DataFrame:
    """row, doc_id, points, text_sha256 and the hashes of its blocks for each of rows (row, doc_id, text). Written; the text is normalised once for all of them."""
    norm = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("norm"))
    hashes = F.transform(block_numbers(size), lambda pos: hash_of(F.substring("norm", pos * size + 1, F.lit(size))))
    return written(norm.select("row", "doc_id", "points", F.sha2("norm", 256).alias("text_sha256"), hashes.alias("hashes")), "measured")


def block_numbers(size: int) -> Column:
    """0, 1, ... for the blocks of norm. An empty text is one empty block."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("norm") / size), F.lit(1)).cast("int") - 1)


def blocks(rows: DataFrame, size: int, hash_of) -> DataFrame:
    """row, pos, h and block: every block of rows (row, text)."""
    norm = rows.select("row", normalised(F.col("text")).alias("norm"))
    cut = norm.select("row", "norm", F.explode(block_numbers(size)).alias("pos"))
    block = F.substring("norm", F.col("pos") * size + 1, F.lit(size))
    return cut.select("row", "pos", block.alias("block")).withColumn("h", hash_of(F.col("block")))


def numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows with an integer name that follows their sorted order in each partition. Written, so that names stay."""
    return written(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names")


def block_names(rows: DataFrame, facts: DataFrame, size: int, hash_of) -> tuple[DataFrame, list[DataFrame]]:
    """row, pos and the name of the block there (written), and tables to discard later."""
    cut = blocks(rows, size, hash_of)
    names = written(cut.select("h", "block").distinct().sortWithinPartitions("block").select("h", F.monotonically_increasing_id().alias("name")), "names")
    # written, so that both sides of the join are plain shuffles, whose large partitions can be split
    shared = written(names.groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("name")), "shared")
    placed = facts.select("row", F.posexplode("hashes").alias("pos", "h")).join(shared, "h")
    found = placed.filter("n = 1").select("row", "pos", "name")
    clashes = shared.filter("n > 1").select("h")
    spare = [names, shared]
    if not clashes.isEmpty():
        rest = cut.join(clashes, "h", "left_semi")
        own = numbered(rest.select("h", "block").distinct(), ["h", "block"])
        found = found.union(rest.join(own, ["h", "block"]).select("row", "pos", (-1 - F.col("name")).alias("name")))
        spare.append(own)
    return written(found, "named"), spare


def identities(rows: DataFrame, facts: DataFrame, size: int = BLOCK, hash_of=F.xxhash64) -> DataFrame:
    """row, level and name for each of rows (row long, text), of which facts are measured(): equal exactly for equal normalised texts. Written."""
    named, spare = block_names(rows, facts, size, hash_of)
    found, level = [], 0
    while True:
        # a document is done when its sequence has a single name
        later = named.filter("pos > 0").select("row").distinct()
        if later.isEmpty():
            found.append(named.select("row", F.lit(level).alias("level"), "name"))
            break
        found.append(named.join(later, "row", "left_anti").select("row", F.lit(level).alias("level"), "name"))
        odd = F.col("pos") % 2 == 1
        pairs = (
            named.join(later, "row", "left_semi")
            .groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right"), F.max(odd).alias("both"))
            .withColumn("right", F.coalesce("right", F.lit(0)))
        )
        pairs = written(pairs, "pairs")
        names = numbered(pairs.select("left", "right", "both").distinct(), ["left", "right", "both"])
        spare += [named, pairs, names]
        named = written(pairs.join(names, ["left", "right", "both"]).select("row", "pos", "name"), "named")
        level += 1
    out = written(reduce(DataFrame.union, found), "identities")
    discard(named, *spare)
    return out


def groups(rows: DataFrame, size: int = BLOCK, hash_of=F.xxhash64) -> DataFrame:
    """One row for each of rows (row long, doc_id, text; row names it and stays the same): row, doc_id, keep_id, group_size, kept, text_sha256."""
    facts = measured(rows, size, hash_of)
    names = identities(rows, facts, size, hash_of)
    each = written(facts.drop("hashes").join(names, "row"), "facts")
    # written, so that both sides of the join are plain shuffles, whose large partitions can be split
    best = written(each.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("points", (-F.col("doc_id")).alias("less"), (-F.col("row")).alias("first"))).alias("best")), "groups")
    discard(facts, names)
    return each.join(best, ["level", "name"]).select("row", "doc_id", (-F.col("best.less")).alias("keep_id"), "group_size", (F.col("row") == -F.col("best.first")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows that groups() drops, all columns as they were."""
    key = fresh(docs, "row_key")
    rows = written(with_row_key(docs, key), "rows")
    kept = groups(rows.select(F.col(key).alias("row"), "doc_id", "text")).filter("kept").select(F.col("row").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(written(with_row_key(docs, "row"), "rows")).drop("row")
