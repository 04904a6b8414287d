"""Column builders over company names: core words, guessed domains, and whether a site is a company's own."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import url

#: Legal forms that are no part of a name, and words that never identify a company.
LEGAL_FORMS = ("ltd", "limited", "plc", "llp", "llc", "inc", "co", "company", "corp", "corporation", "gmbh", "uk", "holdings", "group", "trading", "international", "the")
SMALL_WORDS = ("and", "of", "for")
COMMON_WORDS = (
    "sport", "sports", "fitness", "gym", "gyms", "equipment", "supplies", "supply",
    "europe", "european", "international", "global", "direct", "online", "shop", "store",
    "stores", "trading", "uk", "england", "london", "british", "britain", "boxing", "fight",
    "martial", "arts", "athletic", "athletics", "health", "leisure", "outdoor", "outdoors",
    "wholesale", "distribution", "imports", "exports", "services", "solutions", "products",
)
DOMAIN_ENDINGS = (".co.uk", ".com", ".uk")
#: Most words of a core, most labels that are guessed, shortest joined label.
CORE_WORDS, GUESSED_LABELS, SHORTEST_LABEL = 5, 3, 4


def core(name: Column, legal_forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """The meaningful words of a name, at most CORE_WORDS."""
    plain = F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9 ]+", " ")
    found = F.filter(F.split(plain, " +"), lambda w: (F.length(w) >= 2) & ~w.isin(*SMALL_WORDS, *legal_forms))
    return F.slice(found, 1, CORE_WORDS)


def domain_guesses(words: Column, endings: tuple[str, ...] = DOMAIN_ENDINGS) -> Column:
    """Likely domains of a company with these core words, likeliest first. A single short word is not tried."""
    joined, n = F.array_join(words, ""), F.size(words)
    labels = F.array(
        F.when(F.length(joined) >= SHORTEST_LABEL, joined),
        F.when(n >= 3, F.array_join(F.slice(words, 1, 2), "")),
        F.when(n >= 2, F.array_join(words, "-")),
    )
    labels = F.slice(F.filter(labels, lambda x: x.isNotNull()), 1, GUESSED_LABELS)
    return F.flatten(F.transform(labels, lambda label: F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(label, e))))


def owns_site(words: Column, site_url: Column, registries: tuple[str, ...] = ()) -> Column:
    """Whether the first label of a site's host carries the company's name: all of it, its first two words, or enough of its telling words."""
    host = url.host(site_url)
    label = F.regexp_replace(F.substring_index(host, ".", 1), "[^a-z0-9]", "")
    telling = F.filter(words, lambda w: ~w.isin(*COMMON_WORDS))
    hits = lambda of: F.size(F.filter(of, lambda w: (F.length(w) >= 3) & label.contains(w)))
    first = F.coalesce(F.get(telling, F.lit(0)), F.lit(""))
    enough = (hits(telling) >= 1) & (hits(words) >= F.greatest(F.lit(2), F.floor((F.size(words) + 1) / 2)))
    whole = label.contains(F.array_join(words, "")) | ((F.size(words) >= 2) & label.contains(F.array_join(F.slice(words, 1, 2), "")))
    known = url.host_in(host, registries) if registries else F.lit(False)
    return (host != "") & ~known & (F.size(words) > 0) & (whole | ((F.length(first) >= 5) & label.contains(first)) | enough)
