"""Column builders over names and free text."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal-form endings that a company name key leaves out, each wherever it stands after a blank.
LEGAL_FORMS = (" incorporated", " inc.", " inc", " llc", " ltd", " limited", " co.", " corp", " gmbh")


def clean(text: Column) -> Column:
    """White space squeezed and trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f\x0B]+", " "))


def query_key(text: Column) -> Column:
    """The key under which two spellings of a query are one."""
    return F.lower(clean(text))


def legal_name_key(name: Column, forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """Lower-case name with commas as blanks and legal forms cut out as substrings."""
    lowered = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), ",", " ")
    return clean(reduce(lambda c, f: F.replace(c, F.lit(f), F.lit(" ")), forms, lowered))


def singular(token: Column) -> Column:
    """ies to y; else a final s that is not ss goes; short words stay."""
    return (
        F.when((F.length(token) > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), F.length(token) - 3), F.lit("y")))
        .when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def tokens(text: Column, longer_than: int = 2) -> Column:
    """Distinct ASCII words over a length, in order of first occurrence."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > longer_than))


def word_hit(text: Column, word: Column | str) -> Column:
    """Whether a whole word stands in lower-case text, letters marking its bounds."""
    pattern = F.concat(F.lit("(^|[^a-z])"), F.lit(word) if isinstance(word, str) else word, F.lit("([^a-z]|$)"))
    return F.regexp_like(text, pattern)


def token_hits(wanted: Column, have: Column) -> Column:
    """How many of the wanted tokens are there."""
    return F.size(F.array_intersect(wanted, have))


def excerpt(text: Column, pattern: str, before: int = 40, span: int = 120, most: int = 200) -> Column:
    """What stands around the first match, squeezed; '' without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(clean(F.substring(text, start, at - start + span)), 1, most)).otherwise("")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, question or exclamation mark."""
    return clean(F.regexp_extract(text, r"^([^.!?]*[.!?]?)", 1))


def fingerprint(keys: Column) -> Column:
    """sha1 of the sorted distinct keys joined by |: equal for equal sets in any order."""
    return F.sha1(F.array_join(F.array_sort(F.array_distinct(keys)), "|").cast("binary"))


def title_words(text: Column) -> Column:
    """Separators to blanks, then each word with a capital."""
    return F.initcap(clean(F.regexp_replace(text, r"[-_]+", " ")))


def filled(template: str, **values: Column) -> Column:
    """{{key}} in its written, lower and upper case forms replaced; unknown keys stay."""
    out = F.lit(template)
    for key, value in values.items():
        for form in dict.fromkeys((key, key.lower(), key.upper())):
            out = F.replace(out, F.lit("{{" + form + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


#: State codes that are also words; those for which neither "in" nor "near" is enough.
CODES_THAT_ARE_WORDS = ("in", "or", "me", "hi", "ok", "id", "la", "ma", "md", "mt", "ne", "pa", "co", "de")


def term_hits(text: Column, terms: list[str]) -> Column:
    """Distinct terms of three letters or more that stand in a text as whole words, in order of the terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    asked = list(dict.fromkeys(t.strip().lower() for t in terms if len(t.strip()) > 2))
    found = [F.when(F.regexp_like(low, F.lit(rf"(?<![a-z0-9])\Q{t}\E(?![a-z0-9])")), F.lit(t)) for t in asked]
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def state_code_hit(text: Column, code: str) -> Column:
    """Whether a two-letter state code stands in a text as a place: after a comma, before a postal code, or after "in" or "near" where the code is no word."""
    low, c = F.lower(F.coalesce(text, F.lit(""))), code.strip().lower()
    if len(c) != 2:
        return F.lit(False)
    forms = [rf",\s*{c}\b", rf"\b{c}\s+\d{{5}}\b"] + ([] if c in CODES_THAT_ARE_WORDS else [rf"(?:in|near)\s+{c}\b"])
    return F.regexp_like(low, F.lit("|".join(f"(?:{f})" for f in forms)))


def json_part(text: Column) -> Column:
    """The JSON text within an answer: of a fenced block if there is one, else the whole, the outermost list or the outermost object, whichever is valid first; null if none is."""
    raw = F.trim(text)
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    raw = F.when(F.regexp_like(raw, F.lit(r"(?is)```(?:json)?\s*.*?```")), F.trim(fenced)).otherwise(raw)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(raw), valid(F.regexp_extract(raw, r"(?s)(\[.*\])", 1)), valid(F.regexp_extract(raw, r"(?s)(\{.*\})", 1)))


def first_of(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])
