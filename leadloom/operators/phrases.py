"""Phrases of a table found in texts: n-grams of words are joined to it by equality, and overlaps are settled leftmost and longest.

A text is an array of words; null and empty ones hold no phrases. A table of phrases has a column `phrase` (words in lower case, one blank
between them) and any others. Its size is looked at first: up to BROADCAST_ROWS rows it is sent to all tasks, and texts are not
shuffled; beyond that the join is a shuffle by phrase.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text in lower case: letters, digits, and marks that join them (_ & ' . - inside a word)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:[_&'.-][\p{L}\p{N}]+)*"), F.lit(0))


def sentences(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, sentence (from 0) and its words, for each sentence of a text: a stretch without a stop that ends a word, or a line break."""
    cut = F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?]+(?:\s+|$)|[\r\n]+")
    return rows.select(*keys, F.posexplode(cut).alias("sentence", "__text")).select(*keys, "sentence", words(F.col("__text")).alias("words"))


def grams(of: Column, most: int) -> Column:
    """(start, length, phrase) of all runs of 1 to `most` words."""
    last = F.size(of)
    starts = F.sequence(F.lit(0), last - 1)

    def run(length: int):
        return lambda start: F.struct(start.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(of, start + 1, F.lit(length)), " ").alias("phrase"))

    every = F.flatten(F.array(*(F.transform(starts, run(n)) for n in range(1, most + 1))))
    # of an empty array the starts are 0 and -1, which no run has
    return F.when(last > 0, F.filter(every, lambda g: (g["start"] >= 0) & (g["start"] + g["length"] <= last)))


def occurrences(texts: DataFrame, keys: list[str], phrases: DataFrame, column: str = "words") -> DataFrame:
    """keys, start and length (in words) and the columns of phrases, for each place where a phrase stands in a text."""
    size = phrases.agg(F.max(F.size(F.split("phrase", " "))).alias("most"), F.count("*").alias("n")).first()
    runs = texts.select(*keys, F.explode(grams(F.col(column), size.most or 1)).alias("__g")).select(*keys, "__g.*")
    return runs.join(F.broadcast(phrases) if size.n <= BROADCAST_ROWS else phrases, "phrase")


def leftmost_longest(found: Column) -> Column:
    """Of an array of structs with start and length those that remain: the leftmost, of these the longest, of these the least; then the next that does not overlap."""
    order = F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["length"]).alias("less"), x.alias("match")))
    matches = F.transform(F.array_sort(order), lambda x: x["match"])
    none = F.filter(matches, lambda x: F.lit(False))

    def add(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when((F.size(kept) == 0) | (x["start"] >= last["start"] + last["length"]), F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(matches, none, add)
