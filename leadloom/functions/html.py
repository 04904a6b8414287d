"""Column builders over raw pages; regular expressions of the JVM, no parser in Python."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import contact, url
from leadloom.functions.text import clean

HIDDEN = r"(?is)<(script|style|noscript|svg|nav|form)\b.*?</\1\s*>|<!--.*?-->"
BLOCK_END = r"(?i)</?(p|div|section|article|header|footer|main|aside|li|ul|ol|tr|table|h[1-6]|br|blockquote|title)\b[^>]*>"
CHROME = r"(?is)<!--.*?-->|<(nav|footer|header)\b.*?</\1\s*>|<(\w+)\b[^>]*?\brole\s*=\s*[\"']?navigation\b.*?</\2\s*>"
#: Labels of links that are not companies; paths and titles of articles, documents and dealer lists.
CHROME_LABEL = r"(?i)^(tickets?|register|registration|hotels?|travel|venue|venues|accommodation|visitors?|media|sponsors?|floorplan|privacy|cookies?|login|sign in|billetterie|entradas?)$"
OTHER_PATH = r"(?i)/(blogs?|news|press|articles?|wiki|reviews?|guides?|roundups?|jobs|careers)(/|$)|/wiki|/best-|\.(pdf|docx?|pptx?|xlsx?)$"
OTHER_TITLE = r"(?i)\b(top\s+\d+|best\s+\d+|complete guide|how to|what is|product review|buyer'?s guide)\b|^\s*\d+\.\d+\s*:"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """Common entities as characters; zero-width characters go."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, "[​‌‍﻿]", "")


def front(html: Column, most: int | None) -> Column:
    """A page, or its first `most` characters if a caller wants no more."""
    whole = F.coalesce(html, F.lit(""))
    return whole if most is None else F.substring(whole, 1, most)


def text_of(html: Column, most: int | None = None) -> Column:
    """Visible text, a line for each block, without hidden parts, navigation and forms."""
    bare = F.regexp_replace(F.regexp_replace(front(html, most), HIDDEN, " "), BLOCK_END, "\n")
    lines = F.transform(F.split(decoded(F.regexp_replace(bare, r"<[^>]*>", "")), "\n"), clean)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def title_of(html: Column) -> Column:
    return clean(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def site_name(html: Column, host: Column) -> Column:
    """og:site_name, else the head of the title, else the host's first label as words."""
    og = F.regexp_extract(html, r'(?i)<meta[^>]*property="og:site_name"[^>]*content="([^"]*)"', 1)
    head = clean(F.element_at(F.split(title_of(html), r"\s[|\-–—:]\s"), 1))
    return F.when(clean(og) != "", clean(og)).when(head != "", head).otherwise(F.initcap(F.regexp_replace(F.substring_index(host, ".", 1), "[-_]+", " ")))


def links(html: Column) -> Column:
    """Targets of links in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), F.lit(1)), decoded))


def company_links(html: Column, page_url: Column, skip_hosts: tuple[str, ...], cap: int = 20, most: int | None = None) -> Column:
    """Links (place, host, url) of a directory page to companies: outside navigation, header and footer, to other hosts that are not skipped ones, without chrome labels and articles; the first of each host, up to cap."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    body = F.regexp_replace(front(html, most), CHROME, " ")
    own = bare(url.host(page_url))
    href = lambda a: F.trim(decoded(F.regexp_replace(F.regexp_extract(a, r"""(?is)^<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1), "^[\"']|[\"']$", "")))
    label = lambda a: clean(decoded(F.regexp_replace(a, r"<[^>]*>", " ")))
    # other targets are on the page's own host, or no pages
    full = lambda h: F.when(h.startswith("//"), F.concat(F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h)).otherwise(h)
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>.*?(?:</a\s*>|(?=<a\s)|$)"), F.lit(0))
    rows = F.transform(anchors, lambda a: F.struct(F.regexp_replace(full(href(a)), "#.*$", "").alias("url"), label(a).alias("label")))
    rows = F.transform(rows, lambda r: F.struct(bare(url.host(r["url"])).alias("host"), r["url"].alias("url"), r["label"].alias("label")))
    kept = F.filter(
        rows,
        lambda r: F.regexp_like(r["url"], F.lit("(?i)^https?://"))
        & (r["host"] != "") & (r["host"] != own) & ~F.endswith(r["host"], F.concat(F.lit("."), own)) & ~url.host_in(r["host"], skip_hosts)
        & ~F.regexp_like(r["label"], F.lit(CHROME_LABEL)) & ~F.regexp_like(r["label"], F.lit(OTHER_TITLE)) & ~F.regexp_like(url.path(r["url"]), F.lit(OTHER_PATH)),
    )
    hosts = F.transform(kept, lambda r: r["host"])
    first = F.filter(kept, lambda r, i: F.array_position(hosts, r["host"]) == i + 1)
    return F.transform(F.slice(first, 1, cap), lambda r, i: F.struct((i + 1).cast("long").alias("place"), r["host"].alias("host"), r["url"].alias("url")))


def is_shell(html: Column) -> Column:
    """A page that scripts would fill: little to see for its size, or the mark of an application root."""
    seen, raw = F.length(text_of(html)), F.length(F.coalesce(html, F.lit("")))
    return ((seen < 200) & (raw > 600)) | ((seen < 900) & F.regexp_like(F.coalesce(html, F.lit("")), F.lit(r'id="(root|app|__next)"')))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often it stands in it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def contact_hits(html: Column) -> Column:
    """Addresses with the weight of where they stand: mailto links, coded ones, JSON-LD, obfuscated and plain text. Texts without @, or a word for it, are not searched for addresses."""
    html, none = F.coalesce(html, F.lit("")), F.array().cast("array<string>")
    glued = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), r"</?(span|b|i|em|strong)\b[^>]*>", "")
    json_ld = F.array_join(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1)), " ")
    loose = F.when(html.contains("@"), contact.loose_emails(F.regexp_replace(glued, r"<[^>]*>", " "))).otherwise(none)
    standing = lambda text: F.when(text.contains("@"), contact.clean_emails(contact.emails(text))).otherwise(none)
    weighed = lambda weight: lambda e: F.struct(e.alias("email"), F.lit(weight).alias("source"))

    def hits(body: Column, plain: Column) -> Column:
        spelled = F.when(body.contains("@") | F.regexp_like(body, F.lit(r"(?i)\bat\b")), once(contact.spelled_out(body), standing)).otherwise(none)
        found = {
            "mailto": contact.clean_emails(F.regexp_extract_all(html, F.lit(r'(?i)href="mailto:([^"?]+)'), F.lit(1))),
            "cf": F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(r'data-cfemail="([0-9a-fA-F]+)"'), F.lit(1)), contact.cf_email)),
            "jsonld": contact.clean_emails(F.regexp_extract_all(json_ld, F.lit(r'"email"\s*:\s*"([^"]+)"'), F.lit(1))),
            "text": F.array_distinct(F.concat(plain, loose)),
            "obfuscated": F.array_except(spelled, plain),
        }
        return F.concat(*[F.transform(x, weighed(contact.SOURCES[k])) for k, x in found.items()])

    return once(text_of(html), lambda body: once(standing(body), lambda plain: hits(body, plain)))
