"""Qualification of accounts: fit to customer profile, sales motion and offer, intent, and what follows from them.

Accounts bring their profile along, as columns: buyers and categories (arrays, the most wanted first), places (phrases in lower case), motion
(oem, wholesale, saas, local or other) and hunting (whether buyers are sought, not makers). Everything is computed from a row's own columns. Null
texts and arrays count as empty; without a site an account is judged by its listing alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import rules, scoring
from leadloom.functions.rules import Rule

#: Patterns of makers, of buyers and of each sales motion.
MAKER = r"\b(we (are|'re) (a |an )?(leading )?(manufacturer|factory)|our factory|our manufacturing|oem factory)\b"
BUYER = r"\b(our brands?|we (design|sell|retail|distribute|import)|private label|wholesale|b2b|for retailers|stockist)\b"
MOTIONS = {
    "oem": r"\b(private[\s-]?label|white[\s-]?label|oem|odm|custom (brand|manufactur))\b",
    "wholesale": r"\b(wholesale|bulk order|distributors?|importers?|trade only|b2b portal)\b",
    "saas": r"\b(sign in|request a demo|start free|saas|subscription|platform)\b",
}
RETAIL, CHANNEL, CHANNEL_BUYER = r"\b(add to cart|shop now|buy now)\b", r"\b(distributor|distributors|wholesale|wholesaler|importer|importers|dealer|b2b|bulk orders?|trade only)\b", "distribut|wholesale|import|dealer"
DEEP, ABOUT = r"\b(wholesale|distributor|importer|b2b|private[\s-]?label)\b", r"\b(about us|our story|contact|products?)\b"
#: Signs of intent, the strong ones first; levels, confidences and patterns.
INTENT = [
    Rule("intent", "high", 0.7, "Seeking a manufacturer/supplier", r"seeking (a )?(manufacturer|supplier|factory)"),
    Rule("intent", "high", 0.7, "Looking for a supplier", r"looking for (a )?(manufacturer|supplier|oem)"),
    Rule("intent", "high", 0.7, "Now sourcing", r"now sourcing"),
    Rule("intent", "high", 0.7, "Private-label program", r"private label program"),
    Rule("intent", "high", 0.7, "Dated expansion/launch", r"new (collection|line|facility|warehouse|store|location|plant) .{0,20}(20\d{2}|this year|upcoming)"),
    Rule("intent", "high", 0.7, "Opening/launch", r"(opening|opened|launching) .{0,40}(20\d{2}|store|warehouse|facility)"),
    Rule("intent", "high", 0.7, "Procurement / RFP", r"\brfp\b|\btender\b|request for (proposal|quote)"),
    Rule("intent", "high", 0.7, "Distribution/line expansion", r"expanding (distribution|into|our (line|range|network))"),
    Rule("intent", "low", 0.4, "Hiring a buying-side role (weak)", r"we('re| are) hiring (a )?(sourc|procur|buyer|merchandis|category)"),
    Rule("intent", "low", 0.4, "Mentions a new collection (undated) (weak)", r"new collection\b"),
    Rule("intent", "low", 0.4, "Supplier/vendor program (weak)", r"become a (supplier|vendor)|supplier (registration|portal)|vendor (application|registration)"),
    Rule("intent", "low", 0.4, "Accepting new suppliers (weak)", r"now accepting (new )?(suppliers|vendors|partners)"),
]
#: Words too common to say what is sold.
BROAD = "fitness gym sports sport equipment gear apparel wholesale training bodybuilding martial combat".split()


def listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def long_tokens(needle: Column, longer_than: int = 3) -> Column:
    """The words of a phrase over a length, in lower case."""
    return F.filter(F.split(F.lower(needle), "[^a-z0-9]+"), lambda t: F.length(t) > longer_than)


def token_hits(needles: Column, text: Column) -> Column:
    """The phrases that stand in lower-case text as they are, or two of whose longer words do (one, if there is but one)."""

    def hit(needle: Column) -> Column:
        own = long_tokens(needle)
        there = F.size(F.filter(own, lambda t: F.contains(text, t)))
        return (F.size(own) > 0) & (F.contains(text, F.lower(needle)) | (there >= F.least(F.lit(2), F.size(own))))

    return F.filter(needles, hit)


def evidence_of(claim: str, statement: Column, quote: Column, confidence: Column) -> Column:
    return F.struct(F.lit(claim).alias("claim"), statement.alias("statement"), F.substring(F.coalesce(quote, F.lit("")), 1, 200).alias("quote"), confidence.cast("double").alias("confidence"))


def quoted(text: Column, pattern: str) -> Column:
    return F.get(rules.found(text, [Rule("", "", 0.0, "", pattern)])["quote"], F.lit(0))


def judged(accounts: DataFrame) -> DataFrame:
    """accounts (name, snippet, site, url, location, buyers, categories, places, motion, hunting) with text, home and (level, evidence) of icp, drive, offer and intent."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = accounts.withColumn("home", blank("site") != "").withColumn("text", F.concat_ws("\n", blank("name"), blank("snippet"), blank("site")))
    a = a.withColumn("low", F.lower("text")).withColumn("buyer_hits", token_hits(listed("buyers"), F.col("low"))).withColumn("category_hits", token_hits(listed("categories"), F.col("low")))
    where = F.lower(F.concat_ws(" ", blank("location"), F.col("text")))
    named = F.exists(listed("places"), lambda p: F.contains(where, p))
    # null where no place is asked for, or nothing is said
    a = a.withColumn("geo", F.when(F.size(listed("places")) == 0, F.lit(None)).when(named, True).when(F.length(F.trim(where)) >= 8, False))
    a = a.withColumn("channel", F.exists(listed("buyers"), lambda b: F.regexp_like(F.lower(b), F.lit(CHANNEL_BUYER)))).withColumn("maker", rules.matches(F.col("text"), MAKER) & F.coalesce(F.col("hunting"), F.lit(False)))
    retail = F.regexp_like(F.lower(blank("url")), F.lit(r"/(products?|collections?|cart)(/|$|\?)")) | rules.matches(F.col("text"), RETAIL)
    site_share = lambda home, listing: F.when(F.col("home"), home).otherwise(listing)
    level = lambda name, *evidence: F.struct((F.lit(name) if isinstance(name, str) else name).alias("level"), F.array(*evidence).alias("evidence"))
    none = lambda name: F.struct(F.lit(name).alias("level"), F.filter(F.array(evidence_of("", F.lit(""), F.lit(""), F.lit(0.0))), lambda e: F.lit(False)).alias("evidence"))
    has_buyer, has_category = F.size("buyer_hits") > 0, F.size("category_hits") > 0
    first_category = F.get("category_hits", F.lit(0))
    icp = (
        F.when(F.col("maker"), level("low", evidence_of("icp", F.lit("Describes itself as a manufacturer, while buyers are sought."), quoted(F.col("text"), MAKER), F.lit(0.75))))
        .when(has_buyer & F.coalesce(F.col("geo"), F.lit(True)), level(site_share("high", "medium"), evidence_of("icp", F.concat(F.lit("Buyer words match: "), F.array_join(F.slice("buyer_hits", 1, 3), ", ")), F.substring(blank("snippet"), 1, 160), site_share(0.7, 0.4))))
        .when(has_buyer, level("low", evidence_of("icp", F.lit("Buyer words match, the place does not."), F.substring(blank("snippet"), 1, 160), F.lit(0.5))))
        .when(has_category & F.col("home") & F.col("channel") & retail & ~rules.matches(F.col("text"), CHANNEL), level("low", evidence_of("icp", F.lit("A shop with such products, no distributor."), first_category, F.lit(0.35))))
        .when(has_category & F.col("home"), level("medium", evidence_of("icp", F.concat(F.lit("Category matches: "), first_category), first_category, F.lit(0.45))))
        .when(F.col("home"), none("low"))
        .otherwise(none("unknown"))
    )
    buys = rules.matches(F.col("text"), BUYER)
    of = lambda name: rules.matches(F.col("text"), MOTIONS[name])
    quote_of = lambda name: F.coalesce(quoted(F.col("text"), MOTIONS[name]), quoted(F.col("text"), BUYER))
    motion = (
        F.when((F.col("motion") == "oem") & F.col("maker"), level("low", evidence_of("motion", F.lit("Makes goods itself."), quoted(F.col("text"), MAKER), F.lit(0.75))))
        .when((F.col("motion") == "oem") & (of("oem") | buys), level(site_share("high", "medium"), evidence_of("motion", F.lit("Words of private-label buyers."), quote_of("oem"), F.lit(0.7))))
        .when((F.col("motion") == "wholesale") & (of("wholesale") | buys), level(site_share("high", "medium"), evidence_of("motion", F.lit("Words of wholesale buyers."), quote_of("wholesale"), F.lit(0.65))))
        .when((F.col("motion") == "saas") & of("saas"), level("medium", evidence_of("motion", F.lit("Words of software buyers."), quote_of("saas"), F.lit(0.6))))
        .when((F.col("motion") == "local") & F.col("home"), none("medium"))
        .when(~F.coalesce(F.col("motion"), F.lit("")).isin("oem", "wholesale", "saas", "local") & buys, none("medium"))
        .otherwise(none("unknown"))
    )
    specific = F.filter(listed("categories"), lambda c: (F.size(F.split(c, " ")) >= 2) | ~F.lower(c).isin(BROAD))
    a = a.withColumn("specific", specific)
    words = F.array_distinct(F.flatten(F.transform("specific", lambda c: F.filter(long_tokens(c), lambda t: ~t.isin(BROAD)))))
    # the longest first
    words = F.slice(F.transform(F.array_sort(F.transform(words, lambda t: F.struct((-F.length(t)).alias("less"), t.alias("word")))), lambda x: x["word"]), 1, 40)
    there = F.filter(words, lambda t: F.regexp_like(F.col("low"), F.concat(F.lit(r"\b"), t, F.lit(r"\b"))))
    phrases = F.filter("specific", lambda c: (F.size(F.split(c, " ")) >= 2) & F.contains(F.col("low"), F.lower(c)))
    a = a.withColumn("words_there", there).withColumn("phrases_there", phrases).withColumn("specific_hits", token_hits(F.col("specific"), F.col("low")))
    n_words, n_phrases, hits = F.size("words_there"), F.size("phrases_there"), F.size("specific_hits") > 0
    strong = n_phrases + F.when(n_words >= 2, 1).otherwise(0) + F.when(n_words >= 4, 1).otherwise(0) + F.when(hits & (n_words >= 1), 1).otherwise(0)
    label = F.get(F.concat("phrases_there", "specific_hits", "words_there"), F.lit(0))
    offer = (
        F.when(~F.col("home"), none("unknown"))
        .when((n_phrases > 0) | (strong >= 2), level("high", evidence_of("offer", F.concat(F.lit("Site names "), label), label, F.lit(0.7))))
        .when(hits | (n_words >= 2), level("medium", evidence_of("offer", F.concat(F.lit("Site overlaps with "), label), label, F.lit(0.45))))
        .when(n_words > 0, level("low", evidence_of("offer", F.concat(F.lit("Only a word of it: "), label), label, F.lit(0.3))))
        .otherwise(none("unknown"))
    )
    sign = F.col("sign")
    a = a.withColumn("sign", F.when(F.col("home"), rules.first(rules.found(F.col("text"), INTENT), "intent")))
    intent = F.when(sign.isNull(), none("none")).otherwise(level(sign["level"], evidence_of("intent", sign["statement"], sign["quote"], sign["confidence"])))
    return a.withColumn("icp", icp).withColumn("drive", motion).withColumn("offer", offer).withColumn("intent", intent)


def qualified(accounts: DataFrame, key: str) -> DataFrame:
    """key, icp, motion, offer, intent, fit, priority, confidence, persist, evidence, score and breakdown of accounts.

    Further columns of accounts: website and source (`maps` for listings of a map), phone. related says whether the text is of a related trade.
    Fit is the lower of customer and motion fit, unknown ones counting as medium; a clear miss of either is low, and so is a site that does not have what
    a hunt for a specific product wants. Intent never raises fit, it only sets the priority.
    """
    a = judged(accounts)
    icp, motion, offer, intent = (F.col(f"{c}.level") for c in ("icp", "drive", "offer", "intent"))
    home = F.col("home")
    hunt = F.exists(listed("categories"), lambda c: F.size(F.split(c, " ")) >= 2) & home
    unknown = lambda c: F.when(c == "unknown", "medium").otherwise(c)
    least = scoring.lowest_level(unknown(icp), unknown(motion))
    fit = (
        F.when((icp == "low") | (motion == "low"), "low")
        .when((icp == "unknown") & (motion == "unknown") & (offer == "low") & ~home, "low")
        .when(hunt & (offer == "low"), "low")
        .when(hunt & (offer == "unknown") & (~F.coalesce(F.col("related"), F.lit(False)) | ((icp == "unknown") & ~F.col("channel"))), "low")
        .when((offer == "low") & home & (least == "high"), "medium")
        .otherwise(least)
    )
    a = a.withColumn("fit", fit).withColumn("evidence", F.concat("icp.evidence", "drive.evidence", "offer.evidence", "intent.evidence"))
    confidence = F.when(home, 0.58).otherwise(0.28) + 0.08 * F.least(F.lit(3), F.size("evidence"))
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    located = filled("location")
    maps = F.coalesce(F.col("source") == "maps", F.lit(False))
    wanted = F.rtrim(F.lower(F.coalesce(F.get(listed("buyers"), F.lit(0)), F.lit(""))), F.lit("s"))
    primary = lambda text: (F.length(wanted) >= 4) & F.regexp_like(text, F.concat(F.lit(r"\b"), wanted, F.lit(r"s?\b")))
    priority = (
        F.when((F.col("fit") == "high") & (intent == "high"), "priority")
        .when(F.col("fit") == "high", "nurture")
        .when((F.col("fit") == "medium") & (intent == "high"), "review")
        .when((F.col("fit") == "medium") & ((home & primary(F.col("low"))) | located | maps), "review")
        .when(F.col("fit") == "medium", "low")
        .otherwise("reject")
    )
    a = a.withColumn("priority", priority)
    thin = ~home & (icp == "unknown") & (motion == "unknown") & offer.isin("unknown", "low") & ~located & ~primary(F.lower(F.coalesce("snippet", F.lit(""))))
    sound = F.col("fit").isin("medium", "high") & ~(hunt & (offer == "low"))
    kept = ((F.col("priority") != "reject") & ~thin) | (sound & filled("website")) | (sound & maps & filled("phone"))
    score = scored(a, icp, motion, offer, wanted)
    return a.select(key, icp.alias("icp"), motion.alias("motion"), offer.alias("offer"), intent.alias("intent"), "fit", "priority", F.round(F.least(F.lit(0.9), confidence), 2).alias("confidence"), kept.alias("persist"), "evidence", score.alias("score"))


def scored(a: DataFrame, icp: Column, motion: Column, offer: Column, wanted: Column) -> Column:
    """(total, industry, location, product, company): the fit score, fed by the levels, and its parts. Deep sites earn a little more within a level; thin evidence is capped."""
    home, site, location = F.col("home"), F.coalesce(F.col("site"), F.lit("")), F.coalesce(F.col("location"), F.lit(""))
    good = lambda level: level.isin("high", "medium")
    depth = F.least(F.lit(6.0), F.length(site) / 900.0)
    depth = F.least(F.lit(6.0), depth + F.when(rules.matches(site, DEEP), 1.5).otherwise(0.0))
    depth = F.when(home, F.least(F.lit(6.0), depth + F.when(rules.matches(site, ABOUT), 0.8).otherwise(0.0))).otherwise(0.0)
    words = F.slice(F.filter(F.split(F.lower(F.array_join(listed("categories"), " ")), "[^a-z0-9]+"), lambda t: F.length(t) > 3), 1, 12)
    there = F.size(F.filter(words, lambda t: F.contains(F.lower(site), t)))
    icp_points = scoring.points(icp, scoring.ICP_POINTS) + F.when(good(icp), depth * 0.35).otherwise(0.0)
    offer_points = scoring.points(offer, scoring.OFFER_POINTS) + F.when(good(offer), F.least(F.lit(5.0), there * 0.9)).otherwise(0.0)
    motion_points = scoring.points(motion, scoring.MOTION_POINTS) + F.when(good(motion), depth * 0.25).otherwise(0.0)
    whole = F.lower(F.concat_ws(" ", location, site))
    named = F.exists(listed("places"), lambda p: F.contains(whole, p))
    geo = F.when(named, 9.0 + F.when(F.regexp_like(location, F.lit(r",\s*\w+")), 2.5).otherwise(0.0) + F.when(F.length(F.trim(location)) >= 16, 1.0).otherwise(0.0))
    geo = F.when(F.size(listed("places")) > 0, F.coalesce(geo, F.when(F.length(F.trim(location)) >= 8, 1.5))).otherwise(0.0)
    geo = F.coalesce(geo, F.lit(0.0))
    primary = (F.length(wanted) >= 4) & F.regexp_like(whole, F.concat(F.lit(r"\b"), wanted, F.lit(r"s?\b")))
    role = F.when(primary, 4.5 + F.least(F.lit(2.5), depth * 0.4)).otherwise(0.0)
    claims = F.size(F.filter("evidence", lambda e: e["claim"].isin("icp", "offer", "motion")))
    bonus = F.when(home, 4.0 + F.least(F.lit(3.0), depth * 0.5)).otherwise(0.0) + F.least(F.lit(5.0), claims * 1.4)
    seed = F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("url", F.lit("")), location, F.when(home, "homepage").otherwise("serp"), icp, offer, motion, F.length(site))
    total = scoring.capped(icp_points + offer_points + motion_points + geo + role + bonus, icp, offer, motion, home, scoring.checksum(seed))
    part = lambda most, value, of: F.least(F.lit(most), F.bround(value * (most / of)).cast("int"))
    return F.struct(
        total.alias("total"), part(25, icp_points, 30).alias("industry"), part(20, geo, 12.5).alias("location"), part(20, offer_points, 27).alias("product"), part(15, motion_points + bonus, 32).alias("company")
    )
