"""What the operators share: intermediate tables in the shared folder, and null-safe columns."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words.
SPACE = r"[\x20\x09-\x0D]"


#: The folder that new tables go to while folder() is open, if not the shared one.
_inside: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own and a cluster an error."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leadloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the open folder or the shared one."""
    return f"{_inside.get() or shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def folder(spark: SparkSession, tag: str) -> Iterator[str]:
    """A fresh folder for all tables that are written while it is open, so that they can be removed together."""
    path = new_path(spark, tag)
    before = _inside.set(path)
    try:
        yield path
    finally:
        _inside.reset(before)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of ours."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Spark's setting by which a query's shuffle files go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's settings by which it takes a join's side for small, and the bytes that it may have here: it goes by the size of compressed files, which are many times as large in the driver's memory.
SMALL, SMALL_BYTES = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), 256 << 10


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold while it is open."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, lost executors cost no recomputation before it, and its shuffle files go.

    Spark chooses broadcast joins on its own only for sides of up to SMALL_BYTES; a lower threshold of the session holds.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    lower = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() < SMALL_BYTES
    with settings(spark, {CLEAN_UP: "true"} | ({} if lower else dict.fromkeys(SMALL, str(SMALL_BYTES)))):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    if tables:
        remove(tables[0].sparkSession, *{f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()})


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: Bytes of texts that a worker turns into Python objects at a time.
SLICE_BYTES = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut where a column's values reach SLICE_BYTES, so that a worker holds few of them as Python objects."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)) + 1
            yield batch.slice(at, end - at)
            at = end


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front where df has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """df with a long that names each row; fixed once the result is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def remainder(modulus: int) -> Column:
    """crc32 of doc_id's decimal text, modulo: the folds of the contracts. A null doc_id has crc32 of the empty text, 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


#: A common table expression of one row and column, `polynomial`: crc32's values of single bytes, for crc32_sql.
CRC32_SQL = (
    "crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS polynomial "
    "FROM (SELECT unnest(range(256))::bigint AS n))"
)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an expression's UTF-8 bytes, of code points up to U+07FF. `polynomial` must be in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::bigint] ELSE [192 + (ord(x) >> 6)::bigint, 128 + (ord(x) & 63)::bigint] END)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, flatten({codes})), lambda c, b: xor(c >> 8, polynomial[(xor(c, b) & 255) + 1])), 4294967295)"
