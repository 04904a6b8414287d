"""Column builders over URLs and hosts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; '' where the URL has none."""
    found = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.regexp_replace(F.lower(found), r"\.$", ""), F.lit(""))


def site(host_col: Column) -> Column:
    """The host without one leading www., m. or blog. label: the key that one company's pages share."""
    return F.regexp_replace(host_col, r"^(www|m|blog)\.", "")


def page_kind(host_col: Column) -> Column:
    """burn, article, mobile or company, by the first rule that holds."""
    first = F.substring_index(host_col, ".", 1)
    return (
        F.when(host_col.contains("spam-farm") | host_col.contains("cheap-pills"), "burn")
        .when(first == "blog", "article")
        .when(first == "m", "mobile")
        .otherwise("company")
    )


#: Second-level suffixes under which registrable domains have three labels.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "com.au", "com.br", "co.in", "co.jp", "co.nz", "co.za", "com.mx", "com.sa", "com.tr", "com.sg")
#: Countries by last label.
COUNTRY_LABELS = {"uk": "GB", "de": "DE", "fr": "FR", "es": "ES", "it": "IT", "nl": "NL", "ae": "AE", "sa": "SA", "in": "IN", "au": "AU", "ca": "CA", "us": "US"}
#: Hosts of social networks.
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com")


def registrable(host_col: Column) -> Column:
    """The last two labels, or three under a two-part suffix."""
    return F.when(F.substring_index(host_col, ".", -2).isin(*TWO_PART_SUFFIXES), F.substring_index(host_col, ".", -3)).otherwise(F.substring_index(host_col, ".", -2))


def country(host_col: Column) -> Column:
    """Country of the last label; null for others and for single labels."""
    book = F.create_map(*[F.lit(x) for kv in COUNTRY_LABELS.items() for x in kv])
    return F.when(host_col.contains("."), F.try_element_at(book, F.substring_index(host_col, ".", -1)))


def host_in(host_col: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether the host is one of the suffixes or ends with a dot and one."""
    out = host_col.isin(*suffixes)
    for s in suffixes:
        out = out | host_col.endswith("." + s)
    return out


def is_social(host_col: Column) -> Column:
    return host_in(host_col, SOCIAL_HOSTS)


def company_name(host_col: Column) -> Column:
    """The label left of the public suffix as title words."""
    return F.initcap(F.trim(F.regexp_replace(F.substring_index(host_col, ".", 1), r"[-_]+", " ")))


def path(url: Column) -> Column:
    """What follows the host, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*", ""), r"[?#].*$", "")


def category(url: Column) -> Column:
    """First path segment that is not product-category, with every `and` as `&`."""
    segment = F.coalesce(F.try_element_at(F.split(path(url), "/"), F.lit(2)), F.lit(""))
    return F.when(segment.isin("", "product-category"), "").otherwise(F.replace(F.lower(segment), F.lit("and"), F.lit("&")))


def article_path(url: Column) -> Column:
    """Deep and long paths, and those under blog, news, article or press."""
    p = path(url)
    depth = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    return ((depth >= 3) & (F.length(p) > 24)) | F.regexp_like(p, F.lit("/(blog|news|article|press)/"))


def contact_path(url: Column) -> Column:
    return F.regexp_like(F.lower(path(url)), F.lit("contact|kontakt|contacto|impressum|about"))


def unwrapped(url: Column) -> Column:
    """The target of a redirect link's uddg parameter, or the URL itself."""
    target = F.regexp_extract(url, r"[?&]uddg=([^&#]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(url)


def product_name(url: Column) -> Column:
    """The last path segment without extension as title words."""
    slug = F.regexp_replace(F.element_at(F.split(F.regexp_replace(path(url), r"/+$", ""), "/"), -1), r"\.[a-z]{2,5}$", "")
    return F.initcap(F.trim(F.regexp_replace(slug, r"[-_]+", " ")))


#: Parts of paths that are no products, endings of files, and patterns of product paths.
NO_PRODUCT_PARTS = (
    "/cart", "/checkout", "/account", "/blogs/", "/blog/", "/pages/",
    "/collections/", "/product-category/", "/cart/", "/wp-admin",
    "/tag/", "/author/", "/search", "/wishlist", "/compare",
)
FILE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".pdf", ".css", ".js")
PRODUCT_PATHS = (r"/products?/[^/]+", r"/product/", r"/shop/[^/]+", r"/item/[^/]+", r"/p/[^/]+", r"/goods/[^/]+", r"/catalog/product", r"/dp/[a-z0-9]+", r"/p-[^/]+", r"/\d{4,}/?$")


def is_no_product(url: Column) -> Column:
    """Whether a URL is a list, a cart, a file or a front page; a product below a list is none of these."""
    p = F.lower(path(url))
    listed = F.lit(False)
    for part in NO_PRODUCT_PARTS:
        listed = listed | p.contains(part)
    ends = F.lit(False)
    for ending in FILE_ENDINGS:
        ends = ends | p.endswith(ending)
    return F.when(p.isin("", "/"), True).when(listed, ~p.contains("/products/")).otherwise(ends)


def is_product(url: Column) -> Column:
    """Whether a URL has the form of a product page."""
    p = F.lower(path(url))
    return (~is_no_product(url) | p.contains("/products/")) & F.regexp_like(p, F.lit("|".join(f"(?:{x})" for x in PRODUCT_PATHS)))
