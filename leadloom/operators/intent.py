"""Search lines parsed into product, role and place by a lexicon table, and places resolved to their names.

A lexicon has a row for each phrase: phrase (lower case), kind ('role' or 'place'), name (what it stands for), tier (which roles go
first) and parent (the place around a place, null at the top). No role or place is known to the code.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.operators import phrases


def tidy(line: Column) -> Column:
    """A line with single blanks, without words to be excluded (-word), and with a blank behind a product in quotes."""
    spaced = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))
    kept = F.trim(F.regexp_replace(spaced, r"(?:^|\s)-\S+", ""))
    return F.trim(F.regexp_replace(kept, r'^"([^"]+)"\s*', '"$1" '))


def parsed(lines: DataFrame, key: str, line: str, lexicon: DataFrame) -> DataFrame:
    """key, product, role, place and places for each of lines (key is distinct).

    `in` starts the place, unless it stands within the quotes of a product. A product in quotes may be followed by a role;
    without quotes the first role behind a word ends the product, roles of the lowest tier first. What follows a role is
    the place if no `in` says otherwise. Of overlapping phrases the leftmost and longest counts. A line without a role
    is a product. places are the names of the places in the place, in order. Null and blank lines give blanks.
    """
    tidied = tidy(F.col(line))
    quoted = F.regexp_extract("text", r'^"([^"]+)"', 1)
    base = lines.select(F.col(key), tidied.alias("text")).withColumn("quoted", quoted).withColumn("tokens", F.filter(F.split("text", " "), lambda w: w != ""))
    base = base.withColumn("from", F.when(F.col("quoted") != "", F.size(F.split("quoted", " "))).otherwise(0))
    base = base.withColumn("words", F.transform("tokens", lambda w: F.regexp_replace(F.lower(w), r"[,.]+$", "")))
    last = F.size("words")
    is_in = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i >= F.col("from")) & (i < last - 1) & (F.get(F.col("words"), i) == "in"))
    base = base.withColumn("in", F.when(last > 0, F.get(is_in, F.lit(0))))
    base = base.withColumn("end", F.coalesce("in", last))

    hits = phrases.occurrences(base, [key], lexicon.select("phrase", "kind", "name", "tier"))
    hits = hits.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct("start", "length", "kind", "name", "tier")).alias("hits"))
    found = base.join(hits, F.col(key).eqNullSafe(F.col("__key")), "left")
    is_role = lambda h: (h["kind"] == "role") & (h["start"] + h["length"] <= F.col("end")) & F.when(F.col("quoted") != "", h["start"] == F.col("from")).otherwise(h["start"] >= 1)
    roles = F.transform(F.filter("hits", is_role), lambda h: F.struct(h["tier"], h["start"], (-h["length"]).alias("less"), h["name"]))
    found = found.withColumn("role", F.array_min(roles))
    behind = F.col("role.start") - F.col("role.less")
    start = F.when(F.col("in").isNotNull(), F.col("in") + 1).otherwise(F.coalesce(behind, last))
    found = found.withColumn("start", start)
    product = F.when(F.col("quoted") != "", F.col("quoted")).otherwise(F.array_join(F.slice("tokens", F.lit(1), F.coalesce("role.start", F.col("end"))), " "))
    place = F.regexp_replace(F.array_join(F.slice("tokens", F.col("start") + 1, F.size("tokens")), " "), r"[,.\s]+$", "")
    inside = phrases.leftmost_longest(F.filter("hits", lambda h: (h["kind"] == "place") & (h["start"] >= F.col("start"))))
    names = F.coalesce(F.transform(inside, lambda h: h["name"]), F.array().cast("array<string>"))
    return found.select(F.col(key), F.trim(product).alias("product"), F.coalesce("role.name", F.lit("")).alias("role"), F.trim(place).alias("place"), F.array_distinct(names).alias("places"))


def place_aliases(places: DataFrame, key: str, place: str, lexicon: DataFrame) -> DataFrame:
    """key and aliases: the place in lower case, then the name it stands for and that name's other phrases in order. Unknown places have only themselves, blank ones none.

    A phrase that stands for several places takes the first name in order.
    """
    own = F.lower(F.trim(F.coalesce(F.col(place), F.lit(""))))
    known = lexicon.filter("kind = 'place'")
    named = known.groupBy("phrase").agg(F.min("name").alias("name"))
    families = known.groupBy("name").agg(F.array_sort(F.collect_set("phrase")).alias("family"))
    asked = places.select(F.col(key), own.alias("phrase")).join(named, "phrase", "left").join(families, "name", "left")
    others = F.coalesce(F.concat(F.array(F.lower("name")), F.col("family")), F.array().cast("array<string>"))
    return asked.select(F.col(key), F.filter(F.array_distinct(F.concat(F.array("phrase"), others)), lambda a: a != "").alias("aliases"))


def singular(phrase: Column) -> Column:
    """A phrase with its last word in the singular."""
    head, last = F.regexp_extract(phrase, r"^(.*\s)?(\S*)$", 1), F.regexp_extract(phrase, r"^(.*\s)?(\S*)$", 2)
    return F.concat(head, text.singular(last))


def generated(hunts: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """key, bucket, place (from 1) and query: the searches of each of hunts (key, products, roles: arrays; location).

    Roles are named by the lexicon, others stay as they are; of roles with one singular the first counts, and without any the hunt takes
    `distributors`. Primary searches are every product with every role, role by role; volume ones quote the product, with the role as it is, in the singular, and with both in the
    singular. A search that stood before, in whatever bucket and case, is left out. Null and blank products, roles and locations count as none.
    """
    named = lexicon.filter("kind = 'role'").groupBy("phrase").agg(F.min_by("name", F.struct("tier", "name")).alias("name"))
    tidy_all = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(text.clean(x))), lambda x: x != "")
    asked = hunts.select(key, F.posexplode(tidy_all("roles")).alias("at", "phrase")).join(named, "phrase", "left").select(key, "at", F.coalesce("name", "phrase").alias("role"))
    firsts = asked.groupBy(key, singular(F.col("role")).alias("__same")).agg(F.min(F.struct("at", "role")).alias("first"))
    roles = firsts.groupBy(F.col(key).alias("__key")).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["role"]).alias("__roles"))
    base = hunts.select(key, F.array_distinct(tidy_all("products")).alias("products"), text.clean(F.col("location")).alias("location")).join(roles, F.col(key).eqNullSafe(F.col("__key")), "left")
    roles_of, none = F.coalesce("__roles", F.array(F.lit("distributors"))), F.lit(None).cast("string")
    line = lambda *parts: F.concat_ws(" ", *parts, F.when(F.col("location") != "", F.col("location")))
    quoted = lambda p: F.concat(F.lit('"'), p, F.lit('"'))
    both = lambda p, r: F.when((singular(p) != p), line(quoted(singular(p)), singular(r)))
    each = lambda bucket, make: F.flatten(F.transform(roles_of, lambda r: F.flatten(F.transform("products", lambda p: F.transform(F.array(*make(p, r)), lambda q: F.struct(F.lit(bucket).alias("bucket"), F.coalesce(q, none).alias("query")))))))
    searches = F.concat(each("primary", lambda p, r: [line(p, r)]), each("volume", lambda p, r: [line(quoted(p), r), line(quoted(p), singular(r)), both(p, r)]))
    rows = base.select(key, F.posexplode(F.filter(searches, lambda s: s["query"].isNotNull())).alias("at", "search")).select(key, "at", "search.*")
    first = rows.groupBy(key, F.lower("query").alias("__same")).agg(F.min(F.struct("at", "bucket", "query")).alias("first")).select(key, "first.*")
    place = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("at"))
    return first.select(key, "bucket", place.alias("place"), "query")


def formatted(lines: DataFrame, key: str, heads: DataFrame) -> DataFrame:
    """key and query of each of lines (key, product, role, place) as one precise search.

    heads has the last words of products that mean many things: head, and exclude, an array of words that are excluded with them (null for none). A product of
    several words that ends in one is quoted. The place follows unless it stands there already; excluded words come last. No product gives ''.
    """
    last = F.lower(F.regexp_extract("product", r"(\S+)$", 1))
    known = F.broadcast(heads) if heads.count() <= phrases.BROADCAST_ROWS else heads
    each = lines.withColumn("__head", last).join(known.select(F.col("head").alias("__head"), F.lit(True).alias("__many"), "exclude"), "__head", "left")
    core = F.when(F.col("__many") & F.contains("product", F.lit(" ")), F.concat(F.lit('"'), "product", F.lit('"'))).otherwise(F.col("product"))
    said = F.concat_ws(" ", core, F.nullif(F.coalesce("role", F.lit("")), F.lit("")))
    place = F.coalesce("place", F.lit(""))
    whole = F.when((place != "") & ~F.contains(F.lower(said), F.lower(place)), F.concat_ws(" ", said, place)).otherwise(said)
    query = F.concat_ws(" ", whole, F.array_join(F.transform("exclude", lambda w: F.concat(F.lit("-"), w)), " "))
    return each.select(key, F.when(F.coalesce("product", F.lit("")) == "", "").otherwise(text.clean(query)).alias("query"))
