"""Orders of the lists that users see, and picks from them. `by` columns end in a unique one, so that every order is total."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level(value: Column, points: dict[str, int], other: int = 0) -> Column:
    """A level's points; `other` for levels that have none."""
    book = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    return F.coalesce(F.try_element_at(book, F.lower(value)), F.lit(other))


#: Points of levels, priorities and intents, and the order of draft states.
RELEVANCE, PRIORITY, INTENT = {"high": 3, "medium": 2, "low": 1}, {"priority": 3, "nurture": 2, "review": 1, "low": 0}, {"high": 3, "low": 2, "none": 0}
DRAFTS, OTHER_DRAFT = {"draft": 0, "approved": 1, "sent": 2, "replied": 3}, 9


def final_rank(email: Column, relevance: Column, priority: Column, score: Column) -> Column:
    """Struct that ranks leads, greatest first: an e-mail, relevance, priority, score."""
    return F.struct((F.trim(email) != "").cast("int").alias("email"), level(relevance, RELEVANCE).alias("relevance"), level(priority, PRIORITY).alias("priority"), score.alias("score"))


def search_rank(rejected: Column, in_place: Column, names_role: Column, source: Column) -> Column:
    """Struct that ranks search hits, greatest first: not rejected, in the place, naming the role, from a map."""
    return F.struct((~rejected).cast("int").alias("kept"), in_place.cast("int").alias("place"), names_role.cast("int").alias("role"), (source == "maps").cast("int").alias("map"))


def inbox_weight(priority: Column, intent: Column, score: Column) -> Column:
    return level(priority, PRIORITY) * 1000 + level(intent, INTENT) * 100 + score


def top(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """The first n rows with their place from 1 on: each task keeps n rows, so that the numbering sees n alone."""
    return df.orderBy(*by).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)).cast("long"))


def newest(df: DataFrame, keys: list[str], limit: int, *by: Column, most: int = 100) -> DataFrame:
    """The newest rows of each key, from 1 to `most` of them. The bound is a literal, so that tasks cut groups before the shuffle."""
    n = max(1, min(limit, most))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long")).filter(F.col("place") <= n)


def primary(df: DataFrame, keys: list[str], tier: str, text: str, *by: str) -> DataFrame:
    """The text of the lowest tier of each key, the longest of these, the first by `by` on ties."""
    key = F.struct(F.col(tier), (-F.char_length(text)).alias("length"), *by)
    return df.groupBy(*keys).agg(F.min_by(F.struct(tier, text, *by), key).alias("pick")).select(*keys, "pick.*")


def preferred_first(df: DataFrame, preferred: Column, n: int, *by: Column) -> DataFrame:
    """Preferred rows before others, both in order, n in all."""
    return top(df, n, (~preferred).cast("int"), *by)


def matches_shown(df: DataFrame, key: str, fit: str, offer: str, *by: str, looked_at: int = 6, most: int = 3) -> DataFrame:
    """The matches of each key that are shown, of its first `looked_at` by order: high before medium before low, `most` of them.

    Where the whole offer is low, low ones are shown like others; else only where there is nothing better, and then one less.
    """
    first = newest(df, [key], looked_at, *[F.col(c) for c in by]).drop("place")
    rank = level(F.col(fit), RELEVANCE)
    best = first.groupBy(key).agg(F.max(rank).alias("__best"))
    low_offer = level(F.col(offer), RELEVANCE) <= 1
    kept = first.join(best, key).filter(low_offer | (rank > 1) | (F.col("__best") <= 1)).withColumn("__most", F.when(low_offer | (F.col("__best") > 1), most).otherwise(most - 1))
    return newest(kept, [key], most, rank.desc(), *[F.col(c) for c in by]).filter(F.col("place") <= F.col("__most")).drop("__best", "__most")


def ragged_round_robin(df: DataFrame, bucket: str, item: str, place: str, cap: int) -> DataFrame:
    """The first items of all lists, then the second ones: distinct items by place and then list, `cap` in all."""
    firsts = df.filter(F.col(place) <= cap).groupBy(item).agg(F.min(F.struct(place, bucket)).alias("at"))
    return firsts.orderBy("at", item).limit(cap).select(item, F.col(f"at.{place}").alias(place), F.col(f"at.{bucket}").alias(bucket))
