"""Queries over site texts: triage, listing scores, intent, signals, contacts and matches with hunt lines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import contact, scoring, text
from leadloom.operators import overlap
from leadloom.sources.tables import read

#: Harness dictionaries for the synthetic texts: what stands for trade words, product words, references and unrelated trades.
TRADE, PRODUCT, REFERENCE, UNRELATED = ("die", "la", "ing"), ("the", "und", "que"), ("wiki", "license"), ("moron", "idiot")
STRONG_INTENT = (("looking for|need a supplier", "supplier search"), ("thin|tion", "open request"), ("ung", "open tender"))
WEAK_INTENT = (("new|nou", "growth"), ("de", "listing"))
#: Wording of signals by tier, the third of them weak.
TIER_1 = (r"new (facility|facilities|location|locations|store|stores|branch|branches|plant|plants|clinic|clinics)", r"(opening|opened|launching|launched|expanding|expanded|expansion)", r"(hiring|recruiting|job posting)", r"(procurement|rfp|rfq|tender|supplier search)")
TIER_2 = (r"(growth|growing|scale|scaling)", r"(partnership|partnered|acquisition)", r"(franchise|chain)", r"(international|export|import)")
WEAK = (r"founded in", r"headquartered", r"established", r"proud to")


def lowered(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"), *more)


def words_hit(column, words):
    return scoring.any_of(column, tuple(f"(^|[^a-z]){w}([^a-z]|$)" for w in words))


def listing_scores(spark, sf_dir):
    """HOT, WARM or NOISE by the first rule that holds, counted by language."""
    d = lowered(spark, sf_dir, "lang")
    trade, product = words_hit(F.col("t"), TRADE), words_hit(F.col("t"), PRODUCT)
    rank = F.when(scoring.any_of(F.col("t"), REFERENCE) | words_hit(F.col("t"), UNRELATED), "NOISE").when(trade & product, "HOT").when(trade | product, "WARM").otherwise("NOISE")
    return d.groupBy("lang", rank.alias("score")).agg(F.count("*").alias("listings"))


def triage(spark, sf_dir):
    """Keep or reject with a confidence in hundredths."""
    d = lowered(spark, sf_dir)
    trade, product = words_hit(F.col("t"), TRADE), words_hit(F.col("t"), PRODUCT)
    confidence = F.when(words_hit(F.col("t"), UNRELATED), 90).when(trade & product, 80).when(product, 70).when(trade, 65).otherwise(55)
    return d.select("doc_id", F.when(words_hit(F.col("t"), UNRELATED), "reject").otherwise("keep").alias("verdict"), confidence.alias("confidence"))


def save_gate(spark, sf_dir):
    """Decisions on labelled and unlabelled texts, counted."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    decision = scoring.save_decision(F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("n_chars") > 500, F.col("source") == "src0")
    return d.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def filter_precision(spark, sf_dir):
    """How a triage rule agrees with labels: shares in thousandths over either side's rows."""
    kept = read(spark, sf_dir, "documents").filter(~F.col("text").contains("$$$")).select("doc_id", F.lit(1).alias("kept"))
    both = kept.join(read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(1).alias("good")), "doc_id", "full")
    n = lambda c: F.count(F.when(c, 1))
    out = both.agg(n(F.col("kept").isNotNull()).alias("kept"), n(F.col("good").isNotNull()).alias("good"), n(F.col("kept").isNotNull() & F.col("good").isNotNull()).alias("agree"))
    return out.select("kept", "good", "agree", F.when(F.col("good") == 0, 1000).otherwise(F.floor(1000 * F.col("agree") / F.col("good"))).alias("recall_permille"))


def intent_level(spark, sf_dir):
    """Intent by the first strong pattern, then the first weak one."""
    d = lowered(spark, sf_dir)
    label, level = F.lit("none"), F.lit("none")
    for kind, table in (("low", WEAK_INTENT), ("high", STRONG_INTENT)):
        for pattern, name in reversed(table):
            hit = F.regexp_like("t", F.lit(pattern))
            label, level = F.when(hit, name).otherwise(label), F.when(hit, kind).otherwise(level)
    return d.groupBy(level.alias("intent"), label.alias("signal")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def signal_tier(spark, sf_dir):
    """Tier of each text's signals: 4 for weak wording alone or empty texts, 3 for others without signals."""
    d = lowered(spark, sf_dir)
    one, two, weak = (scoring.any_of(F.col("t"), p) for p in (TIER_1, TIER_2, WEAK))
    tier = F.when(F.coalesce(F.length(F.trim("t")), F.lit(0)) == 0, 4).when(weak & ~one & ~two, 4).when(one, 1).when(two, 2).otherwise(3)
    return d.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def found_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(contact.emails(F.col("text"))).alias("email"))


def email_ranks(spark, sf_dir):
    """Every text's addresses by preferred local part, then length, then name."""
    by = Window.partitionBy("doc_id").orderBy(contact.local_preference(F.col("email")), F.length("email"), "email")
    return found_emails(spark, sf_dir).select("doc_id", "email", F.row_number().over(by).alias("rank"))


def contact_dedup(spark, sf_dir):
    """Each contact once with where it was first found and in how many texts."""
    phones = read(spark, sf_dir, "documents").select("doc_id", F.lit("phone").alias("type"), F.explode(contact.phones(F.col("text"))).alias("value"))
    both = found_emails(spark, sf_dir).select("doc_id", F.lit("email").alias("type"), F.col("email").alias("value")).union(phones)
    return both.groupBy("type", "value").agg(F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("docs"))


def phone_countries(spark, sf_dir):
    """Texts by the country of their phone numbers."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(contact.phones(F.col("text"))).alias("phone"))
    return rows.groupBy(F.coalesce(contact.phone_country(F.col("phone")), F.lit("")).alias("country")).agg(F.count("*").alias("numbers"), F.countDistinct("doc_id").alias("docs"))


def license_strip(spark, sf_dir):
    """Lengths before and after license sentences are cut out of texts that have some."""
    d = read(spark, sf_dir, "documents").filter(F.col("text").contains("icense"))
    cut = F.regexp_replace("text", r"(Released under|Licensed under|This work is licensed under)[^\n]*", "")
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), F.length(cut).cast("long").alias("chars_left"))


def token_overlap(spark, sf_dir):
    """Texts that share two long words with the first three of a conversation's first turn, counted by conversation."""
    docs = read(spark, sf_dir, "documents").select("doc_id", overlap.long_words(F.col("text")).alias("words"))
    items = read(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.slice(overlap.long_words(F.col("text")), 1, 3).alias("words"))
    return overlap.overlap_counts(docs, "doc_id", items, "conv_id").toDF("conv_id", "docs", "best", "first_doc")


def text_fingerprint(spark, sf_dir):
    """Texts with the same set of long words, by fingerprint."""
    d = read(spark, sf_dir, "documents").select("doc_id", text.fingerprint(text.tokens(F.col("text"))).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).filter("docs > 1")


def source_counts(spark, sf_dir):
    """Texts and characters by source and language, sources in total too."""
    return read(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "docs", "chars")


def excerpts(spark, sf_dir):
    """What stands around an e-mail address in texts that have one."""
    found = read(spark, sf_dir, "documents").filter(F.col("text").contains("@mail"))
    return found.select("doc_id", text.excerpt(F.col("text"), "@mail").alias("excerpt"))


def top_per_source(spark, sf_dir):
    """The three longest texts of each source."""
    by = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(by).alias("place")).filter("place <= 3")


QUERIES = {
    "q_listing_score_hot_warm_noise": listing_scores, "q_triage_keep_reject": triage, "q_save_gate": save_gate, "q_filter_precision": filter_precision, "q_intent_level": intent_level,
    "q_signal_tier": signal_tier, "q_email_extract_rank": email_ranks, "q_contact_dedup": contact_dedup, "q_phone_country": phone_countries, "q_license_strip": license_strip,
    "q_token_hits_overlap": token_overlap, "q_text_fingerprint": text_fingerprint, "q_counts_by_source": source_counts, "q_excerpt": excerpts, "q_top_texts_per_source": top_per_source,
}


def _any(patterns, column="t"):
    return f"regexp_matches({column}, '{'|'.join(f'(?:{p})' for p in patterns)}')"


def _words(words):
    return _any([f"(^|[^a-z]){w}([^a-z]|$)" for w in words])


_D = "WITH d AS (SELECT *, lower(text) AS t FROM documents)"
_NOISE = f"{_any(REFERENCE)} OR {_words(UNRELATED)}"
_EMAILS = rf"SELECT doc_id, source, unnest(list_distinct(list_transform(regexp_extract_all(text, '{contact.EMAIL}', 1), lambda e: regexp_replace(lower(e), '\.+$', '')))) AS email FROM documents"
_PHONES = rf"SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{contact.PHONE}', 1), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 8 AND 15))) AS phone FROM documents"
_PREFERENCE = "CASE split_part(email, '@', 1) " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(contact.PREFERRED_LOCAL)) + f" ELSE {len(contact.PREFERRED_LOCAL)} END"
_COUNTRY = "CASE " + " ".join(f"WHEN phone LIKE '{k}%' THEN '{v}'" for k, v in sorted(contact.CALLING_CODES.items(), key=lambda kv: -len(kv[0]))) + " ELSE '' END"
_INTENT = [(p, "high", n) for p, n in STRONG_INTENT] + [(p, "low", n) for p, n in WEAK_INTENT]
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: length(w) > {n}))"

ORACLES = {
    "q_listing_score_hot_warm_noise": f"{_D} SELECT lang, CASE WHEN {_NOISE} THEN 'NOISE' WHEN {_words(TRADE)} AND {_words(PRODUCT)} THEN 'HOT' WHEN {_words(TRADE)} OR {_words(PRODUCT)} THEN 'WARM' ELSE 'NOISE' END AS score, count(*) AS listings FROM d GROUP BY ALL",
    "q_triage_keep_reject": f"{_D} SELECT doc_id, CASE WHEN {_words(UNRELATED)} THEN 'reject' ELSE 'keep' END AS verdict, CASE WHEN {_words(UNRELATED)} THEN 90 WHEN {_words(TRADE)} AND {_words(PRODUCT)} THEN 80 WHEN {_words(PRODUCT)} THEN 70 WHEN {_words(TRADE)} THEN 65 ELSE 55 END AS confidence FROM d",
    "q_save_gate": "SELECT CASE WHEN coalesce(toxic = 1, false) THEN 'reject_location' WHEN coalesce(quality = 1, false) THEN 'save' WHEN source = 'src0' THEN 'save_local' WHEN n_chars > 500 THEN 'unrelated' ELSE 'uncertain' END AS decision, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "q_filter_precision": "WITH k AS (SELECT doc_id FROM documents WHERE text NOT LIKE '%$$$%'), g AS (SELECT doc_id FROM labels WHERE quality = 1), c AS (SELECT count(k.doc_id) AS kept, count(g.doc_id) AS good, count(CASE WHEN k.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 1 END) AS agree FROM k FULL JOIN g ON k.doc_id = g.doc_id) SELECT *, CASE WHEN good = 0 THEN 1000 ELSE 1000 * agree // good END AS recall_permille FROM c",
    "q_intent_level": f"{_D} SELECT CASE {' '.join(f'''WHEN regexp_matches(t, '{p}') THEN '{k}' ''' for p, k, _ in _INTENT)} ELSE 'none' END AS intent, CASE {' '.join(f'''WHEN regexp_matches(t, '{p}') THEN '{n}' ''' for p, _, n in _INTENT)} ELSE 'none' END AS signal, count(*) AS n, min(doc_id) AS first_doc FROM d GROUP BY 1, 2",
    "q_signal_tier": f"{_D} SELECT CASE WHEN coalesce(length(trim(t)), 0) = 0 THEN 4 WHEN {_any(WEAK)} AND NOT {_any(TIER_1)} AND NOT {_any(TIER_2)} THEN 4 WHEN {_any(TIER_1)} THEN 1 WHEN {_any(TIER_2)} THEN 2 ELSE 3 END AS tier, count(*) AS n FROM d GROUP BY 1",
    "q_email_extract_rank": f"WITH e AS ({_EMAILS}) SELECT doc_id, email, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_PREFERENCE}, length(email), email) AS INTEGER) AS rank FROM e",
    "q_contact_dedup": f"WITH e AS ({_EMAILS}), p AS ({_PHONES}), b AS (SELECT doc_id, 'email' AS type, email AS value FROM e UNION ALL SELECT doc_id, 'phone', phone FROM p) SELECT type, value, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM b GROUP BY ALL",
    "q_phone_country": f"WITH p AS ({_PHONES}) SELECT {_COUNTRY} AS country, count(*) AS numbers, count(DISTINCT doc_id) AS docs FROM p GROUP BY 1",
    "q_license_strip": r"SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '(Released under|Licensed under|This work is licensed under)[^\n]*', '', 'g')) AS chars_left FROM documents WHERE text LIKE '%icense%'",
    "q_token_hits_overlap": r"""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}'))) AS w FROM documents),
        i AS (SELECT conv_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}') AS ws FROM conversations WHERE turn = 0),
        f AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS place FROM (SELECT conv_id, w, min(pos) AS spot FROM (SELECT conv_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM i) GROUP BY ALL)),
        k AS (SELECT conv_id, w, count(*) OVER (PARTITION BY conv_id) AS n FROM f WHERE place <= 3),
        h AS (SELECT doc_id, conv_id, count(*) AS hits FROM d JOIN k USING (w) GROUP BY doc_id, conv_id, n HAVING count(*) >= least(2, n))
        SELECT conv_id, count(*) AS docs, max(hits) AS best, min(doc_id) AS first_doc FROM h GROUP BY conv_id""",
    "q_text_fingerprint": f"WITH f AS (SELECT doc_id, sha1(array_to_string(list_sort({_TOKENS.format(n=2)}), '|')) AS fingerprint FROM documents) SELECT fingerprint, count(*) AS docs, min(doc_id) AS first_doc FROM f GROUP BY fingerprint HAVING count(*) > 1",
    "q_counts_by_source": "SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)",
    "q_excerpt": r"WITH a AS (SELECT doc_id, text, instr(text, '@mail') AS place FROM documents WHERE text LIKE '%@mail%') SELECT doc_id, substr(trim(regexp_replace(substr(text, greatest(place - 40, 1), place - greatest(place - 40, 1) + 120), '[ \t\r\n\f\x0B]+', ' ', 'g')), 1, 200) AS excerpt FROM a",
    "q_top_texts_per_source": "WITH r AS (SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents) SELECT * FROM r WHERE place <= 3",
}
