"""The corpus pipeline: documents through quality, exact and near deduplication and decontamination into packed sequences.

Each stage takes what its predecessor wrote, decides on all of it, and returns the columns of documents; the last one
returns the packed pieces with their ids. Nulls, empty and very long texts and repeated rows are treated as each operator says; empty
tables give no pieces, and without labels every document passes the classifier.

A stage's own tables lie in a folder of its own. Its result still reads them until it is written, so they are removed
when the next stage starts, whose documents are what was written.
"""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import decontamination, exact_dedup, near_dedup, packing, quality
from leadloom.llm.common import discard, folder, remove, written

TOKENIZER, END_ID = "word_bpe_49k.json", 2

#: Folders of the stages that ran, by application.
_folders: dict[str, list[str]] = {}


def clear(spark: SparkSession, docs: DataFrame) -> None:
    """Remove the folders of earlier stages, but for any that docs still reads from."""
    folders = _folders.setdefault(spark.sparkContext.applicationId, [])
    tops = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
    for path in [p for p in folders if not any(f"{p.split('/')[-1]}/" in f"{top}/" for top in tops)]:
        remove(spark, path)
        folders.remove(path)


def stage(function: Callable) -> Callable:
    """A stage with a folder of its own."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, docs)
        with folder(spark, function.__name__) as path:
            _folders[spark.sparkContext.applicationId].append(path)
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, accepts."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


@stage
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


@stage
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("quality", good_quality), ("exact_dedup", no_exact_copies), ("near_dedup", no_near_copies), ("decontamination", no_benchmark), ("packing", pack)]

#: The classifier and MinHash signatures are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's input goes once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        docs = written(function(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # packing has written what it needs of them
    return pieces
