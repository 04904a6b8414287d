"""Running sums and positions within keys of any size: a range sort, sums within ranges, and what earlier ranges of a key carry over.

No key is brought into one task: rows are dealt by ranges of keys and order, so a hot key takes many ranges, and only one row for each pair of
range and key is added up key by key. Rows with equal keys and order are told apart by `also`; make them distinct for a fixed result.
"""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's for checkpoints. A local session without one gets its own; a cluster an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leadloom-"))
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: Bytes of a row group and rows after which they are first counted, for tables with long values: a reader holds a batch of rows at a time, thousands of them, but none beyond a row group.
GROUP_BYTES, GROUP_ROWS = 1 << 20, 10


def settled(df: DataFrame, long_values: bool = False) -> DataFrame:
    """df written to the shared folder and read again, so that its rows stay as they are and nothing before is computed twice. Where values may be long, row groups are small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size": GROUP_BYTES // 4, "parquet.block.size.row.check.min": GROUP_ROWS, "parquet.page.size.row.check.min": GROUP_ROWS} if long_values else {}
    df.write.options(**groups).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of settled() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        place = tables[0].sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(tables[0].sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a range, where their number is known.
RANGE_ROWS = 100_000


def numbered(df: DataFrame, order: list[str], name: str, rows: int | None = None) -> DataFrame:
    """df with numbers that grow in the order of columns, with gaps. Written; but where its number of rows is known and fits one range, a sort tells the numbers, if no two rows are equal in order."""
    ranges = [] if rows is None else [max(1, -(-rows // RANGE_ROWS))]
    ranged = df.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    return ranged if ranges == [1] else settled(ranged)


def running(df: DataFrame, keys: list[str], order: list[str], measures: dict[str, str]) -> DataFrame:
    """df with a column for each of measures (new name to column): the sum up to and with the row, within its key by order. Null measures count as 0, null keys are a key."""
    taken = {c.lower() for c in df.columns}
    place, part = (next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n not in taken) for name in ("place", "part"))
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(place, F.monotonically_increasing_id())
    ranged = settled(ranged.withColumn(part, F.shiftright(place, 33)))
    local = Window.partitionBy(part, *keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.select("*", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(local).alias(f"{place}_{name}") for name, c in measures.items()])
    # a row for each range that a key lies in
    totals = ranged.groupBy(part, *keys).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"{part}_{name}") for name, c in measures.items()])
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(part).alias(f"{part}_of"), *[F.col(k).alias(f"{part}_{k}") for k in keys], *[F.coalesce(F.sum(f"{part}_{name}").over(before), F.lit(0)).alias(f"{part}_{name}") for name in measures])
    same = F.col(part) == F.col(f"{part}_of")  # no keys: the whole table is one
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{part}_{k}"))
    joined = sums.join(carried, same)
    return joined.select(*df.columns, *[(F.col(f"{place}_{name}") + F.col(f"{part}_{name}")).alias(name) for name in measures])


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """df with each row's place within its key by order, from 1 on."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), keys, order, {name: "__one"}).drop("__one")


def since_last(df: DataFrame, keys: list[str], order: str, hit: str) -> DataFrame:
    """df with `since`: rows of its key since the last one for which hit is true, that one not counted, up to and with the row; `any_hit` says whether there is one."""
    return since_numbered(numbered(df, [*keys, order], "__since_place"), keys, "__since_place", hit).select(*df.columns, "since", "any_hit")


def since_numbered(df: DataFrame, keys: list[str], place: str, hit: str) -> DataFrame:
    """since_last() over rows whose order is that of numbers from numbered(), by whatever columns: each range then holds a stretch of every key's rows."""
    ranged = df.withColumn("__since_part", F.shiftright(place, 33))
    own = Window.partitionBy("__since_part", *keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__since_n", F.count("*").over(own))
    local = local.withColumn("__since_last", F.max(F.when(F.col(hit), F.col("__since_n"))).over(own))
    # a row for each range that a key lies in
    totals = local.groupBy(F.col("__since_part").alias("__since_of"), *[F.col(k).alias(f"__since_key_{k}") for k in keys]).agg(F.max("__since_n").alias("__since_rows"), F.max("__since_last").alias("__since_hit"))
    renamed = Window.partitionBy(*[f"__since_key_{k}" for k in keys]).orderBy("__since_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__since_before", F.coalesce(F.sum("__since_rows").over(renamed), F.lit(0))).withColumn("__since_carried", F.max(F.col("__since_before") + F.col("__since_hit")).over(renamed))
    same = F.col("__since_part") == F.col("__since_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__since_key_{k}"))
    joined = local.join(totals, same)
    last = F.coalesce(F.col("__since_before") + F.col("__since_last"), F.col("__since_carried"))
    since = F.col("__since_before") + F.col("__since_n") - F.coalesce(last, F.lit(0))
    return joined.select(*df.columns, since.alias("since"), last.isNotNull().alias("any_hit"))


def first_limit(df: DataFrame, keys: list[str], order: list[str], limits: list[tuple[str, str, float, bool]]) -> DataFrame:
    """Where each key's first limit is reached: keys, limit, order's columns and the sums there; keys that reach none have a null limit and their last row.

    limits are (name, column, most, summed) in the order in which they are looked at: of several that one row reaches the first counts. A row
    reaches a summed limit if the sum of its column up to and with it is at least `most`, another one if its own value is.
    """
    sums = running(df, keys, order, {f"spent_{name}": column for name, column, _, summed in limits if summed})
    value = lambda name, column, summed: F.col(f"spent_{name}" if summed else column)
    hit = F.coalesce(*[F.when(value(name, column, summed) >= most, name) for name, column, most, summed in limits], F.lit(None).cast("string"))
    at = F.struct(hit.alias("limit"), *order, *[f"spent_{name}" for name, _, _, summed in limits if summed])
    # the least row with a limit, else the last row
    best = sums.withColumn("__hit", hit).groupBy(*keys).agg(F.min_by(at, F.when(F.col("__hit").isNotNull(), F.struct(*order))).alias("at"), F.max_by(at, F.struct(*order)).alias("end"))
    return best.select(*keys, F.coalesce("at", "end").alias("at")).select(*keys, "at.*")
