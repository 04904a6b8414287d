"""Where a company is: places in its texts as evidence, and a verdict against the place that was asked for.

Places come from a lexicon (phrase, name, parent; parent is null at the top), cues from the table of CUES. Both are found in one join
over the words of each sentence. A place in the scope of a cue for a service area says where a company sells; one behind a cue for
presence, or next to a word for premises, says where it sits, unless the cue is negated; any other is merely stated.
Distances are in words of a sentence, so nothing depends on how long a text is, and texts are never held together.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import phrases

#: What cues say. service and presence stand by themselves, carrying needs a word of kind `to` within CARRY words.
CUES = {
    "service": "ships worldwide,shipping worldwide,delivers worldwide,serving customers in,serves customers in,serving,serves,available in,available across,customers in,customers across,markets in,markets across,distributes to,worldwide including",
    "carrying": "ship,ships,shipping,deliver,delivers,delivering,export,exports,exporting",
    "to": "to",
    "presence": "headquarters,headquartered,hq,based in,located in,located at,our office,office in,warehouse in,showroom in,facility in,visit us,find us,address",
    "premises": "office,hq,headquarters,warehouse,showroom,branch",
    "negation": "not,no longer,never,isn't,aren't",
}
#: Words: how far before and behind a service cue its scope reaches, a presence cue's reach, a negation's reach, and up to where a carrier's `to` stands.
BEFORE, BEHIND, REACH, NEGATED, CARRY = 7, 16, 13, 3, 5


def cue_table(spark: SparkSession) -> DataFrame:
    """phrase and kind of CUES."""
    return spark.createDataFrame([(p, kind) for kind, listed in CUES.items() for p in listed.split(",")], "phrase string, kind string")


def claim(place: Column, hits: Column) -> Column:
    """What a sentence's cues make of a place in it: served, office, denied or stated."""
    of = lambda kind, test: F.exists(hits, lambda h: (h["kind"] == kind) & test(h))
    end = lambda h: h["start"] + h["length"]
    scope = lambda h: (place["start"] >= h["start"] - BEFORE) & (place["start"] < end(h) + BEHIND)
    carries = lambda h: scope(h) & F.exists(hits, lambda t: (t["kind"] == "to") & (t["start"] >= end(h)) & (t["start"] < end(h) + CARRY))
    negated = lambda h: F.exists(hits, lambda n: (n["kind"] == "negation") & (end(n) <= h["start"]) & (end(n) > h["start"] - NEGATED))
    near = lambda h: (place["start"] >= h["start"]) & (place["start"] < end(h) + REACH)
    beside = lambda h: (h["start"] == end(place)) | (end(h) == place["start"])
    return (
        F.when(of("service", scope) | of("carrying", carries), "served")
        .when(of("presence", lambda h: near(h) & ~negated(h)) | of("premises", lambda h: beside(h) & ~negated(h)), "office")
        .when(of("presence", lambda h: near(h) & negated(h)) | of("premises", lambda h: beside(h) & negated(h)), "denied")
        .otherwise("stated")
    )


def evidence(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, sentence, start, length, name, parent and claim for each place that a text names, overlaps settled. Null and empty texts name none."""
    places = lexicon.select("phrase", F.lit("place").alias("kind"), "name", "parent")
    none = F.lit(None).cast("string")
    known = places.union(cue_table(texts.sparkSession).select("phrase", "kind", none, none))
    found = phrases.occurrences(phrases.sentences(texts, [key], text), [key, "sentence"], known)
    by = found.groupBy(key, "sentence").agg(F.collect_list(F.struct("start", "length", "kind", "name", "parent")).alias("hits"))
    by = by.filter(F.exists("hits", lambda h: h["kind"] == "place"))
    kept = phrases.leftmost_longest(F.filter("hits", lambda h: h["kind"] == "place"))
    claims = F.transform(kept, lambda p: F.struct(p["start"], p["length"], p["name"], p["parent"], claim(p, F.col("hits")).alias("claim")))
    return by.select(key, "sentence", F.explode(claims).alias("place")).select(key, "sentence", "place.*")


def shown(place: Column) -> Column:
    """A place (name, parent) as it is written out; blank for none."""
    return F.coalesce(F.concat_ws(", ", place["name"], place["parent"]), F.lit(""))


def verdicts(companies: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """key, mentioned, verdict, reason, confidence, business_location, rejected for companies (distinct key, text, address, requested).

    requested is a place's name, null if none was asked for. A place is here if it is the one that was asked for or lies in it. The most
    local place of an address counts first (an address of nothing but the place that was asked for is taken for a copy of it),
    then the most local one that the text names outside service areas and denials.

    MATCH: premises here, or a place here; WRONG: a place elsewhere, with `foreign_business_serving_target_area` if the place that was asked for
    stands in service areas alone, else by whether the parent differs; UNCERTAIN: none, or only the parent of what was asked for.
    Companies elsewhere in the same parent are kept, the others are rejected. mentioned is null where nothing was asked for.
    """
    parents = lexicon.groupBy("name").agg(F.min("parent").alias("asked_parent")).withColumnRenamed("name", "asked")
    asked = companies.select(key, "text", "address", F.col("requested").alias("asked")).join(parents, "asked", "left")
    here = (F.col("name") == F.col("asked")) | F.coalesce(F.col("parent") == F.col("asked"), F.lit(False))
    wanted = asked.select(F.col(key).alias("__key"), "asked")
    place, order = F.struct("name", "parent"), F.struct(F.col("parent").isNull(), "sentence", "start")
    sits = F.col("claim").isin("office", "stated")
    named = evidence(asked, key, "text", lexicon).join(wanted, F.col(key) == F.col("__key"))
    site = named.groupBy(F.col(key).alias("__site")).agg(
        F.max((F.col("claim") == "office") & here).alias("office"), F.max((F.col("claim") == "served") & here).alias("served"), F.max(sits & here).alias("sits"),
        F.max(here).alias("named"), F.min_by(F.when(sits, place), F.when(sits, order)).alias("site"),
    )
    lines = evidence(asked, key, "address", lexicon).join(wanted, F.col(key) == F.col("__key"))
    address = lines.groupBy(F.col(key).alias("__line")).agg(F.min_by(place, order).alias("line"), F.sum("length").alias("covered"), F.min(F.coalesce((F.col("name") == F.col("asked")), F.lit(False)).cast("int")).alias("only"))
    each = asked.join(site, F.col(key) == F.col("__site"), "left").join(address, F.col(key) == F.col("__line"), "left")
    stamp = (F.col("only") == 1) & (F.col("covered") == F.size(phrases.words(F.col("address"))))
    each = each.withColumn("line", F.when(~stamp, F.col("line")))
    at = F.coalesce("line", "site")
    is_here = (at["name"] == F.col("asked")) | (at["parent"] == F.col("asked"))
    each = each.withColumn("at", at).withColumn("here", F.coalesce(is_here, F.lit(False)))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    top = lambda name, parent: F.coalesce(parent, name)
    only_parent = F.coalesce(F.col("at.name") == F.col("asked_parent"), F.lit(False))
    reason = (
        F.when(F.col("asked").isNull() | true("office") | F.col("here"), "")
        .when(F.col("at").isNull(), "uncertain_location")
        .when(only_parent, "country_only")
        .when(true("served") & ~true("sits"), "foreign_business_serving_target_area")
        .when(top(F.col("at.name"), F.col("at.parent")) != top(F.col("asked"), F.col("asked_parent")), "location_mismatch_country")
        .otherwise("location_mismatch_state")
    )
    each = each.withColumn("reason", reason)
    wrong = F.col("reason").isin("foreign_business_serving_target_area", "location_mismatch_country", "location_mismatch_state")
    verdict = F.when(F.col("reason") == "", "MATCH").when(wrong, "WRONG").otherwise("UNCERTAIN")
    confidence = (
        F.when(wrong | (F.col("asked").isNotNull() & (true("office") | (F.col("here") & F.col("line").isNotNull()))), "high")
        .when((F.col("reason") == "") & F.col("at").isNotNull(), "medium")
        .otherwise("low")
    )
    mentioned = F.when(F.col("asked").isNotNull(), true("named"))
    return each.select(key, mentioned.alias("mentioned"), verdict.alias("verdict"), "reason", confidence.alias("confidence"), shown(F.col("at")).alias("business_location"), (wrong & (F.col("reason") != "location_mismatch_state")).alias("rejected"))
