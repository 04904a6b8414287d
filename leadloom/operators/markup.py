"""Pages as rows of tags and texts, elements as intervals of them, and what lies within an element by an interval join.

A page is cut into tokens in order: tags, comments, whole scripts and styles, and the text between. An element is the place of its opening tag and
the place where it ends: at its closing tag, which is the next of the same name and depth; for an unclosed list item, row, cell or paragraph at
the next one of its kind; else where the page ends. So `within` is a comparison of places, however deep things are nested. Whole pages are
read; null and empty ones have no tokens.

listing() makes rows only of the tags that cards can begin or end at. A page stays in one row and its cards are cut out of it by their places, so it goes
through no more than one shuffle, and none where pages come grouped by their key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.html import decoded
from leadloom.functions.text import clean

TOKEN = r"(?is)<!--.*?(?:-->|$)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|$)|<[a-z/!?][^>]*(?:>|$)|[^<]+|<"
#: Tags without an end, and tags that the next of their kind ends.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NEXT_ENDS = ("li", "p", "tr", "td", "th", "dt", "dd", "option")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Labels of links to the next page; labels of cards that name no one.
NEXT_LABELS = ("next", "next page", "older", "more results", "»", "›", ">")
NO_NAMES = ("home", "contact", "about", "about us", "login", "register", "menu", "search", "read more", "view", "details", "website", "next", "previous")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value as it is read, '' if it is missing."""
    raw = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(decoded(F.regexp_replace(raw, "^[\"']|[\"']$", "")))


def has_class(tag: Column, wanted: str) -> Column:
    return F.array_contains(F.split(attribute(tag, "class"), r"\s+"), wanted)


def name_of(raw: Column) -> Column:
    return F.when(raw.startswith("<"), F.lower(F.regexp_extract(raw, r"^</?\s*([A-Za-z][A-Za-z0-9:-]*)", 1))).when(raw.isNotNull(), "")


def kind_of(raw: Column, name: Column) -> Column:
    return F.when(~raw.startswith("<") | (raw == "<"), "text").when(name == "", "other").when(raw.startswith("</"), "close").otherwise("open")


def cut_up(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, kind (open, close, text, other), name and raw of each token."""
    rows = pages.select(key, F.posexplode(cut_up(F.col(html))).alias("at", "raw")).withColumn("name", name_of(F.col("raw")))
    return rows.select(key, "at", kind_of(F.col("raw"), F.col("name")).alias("kind"), "name", "raw")


def ended(tags: DataFrame, key: str) -> DataFrame:
    """tags (key, kind, name, at, raw, ...) with the place where the element of each opening one ends: without content where it starts, null where the page ends."""
    whole = F.col("name").isin(*VOID, "script", "style") | F.col("raw").endswith("/>")
    by = Window.partitionBy(key, "name", "__whole").orderBy("at")
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    # a closing tag is of the depth that it ends
    deep = tags.withColumn("__whole", whole).withColumn("__depth", F.sum(step).over(by) + F.when(F.col("kind") == "close", 1).otherwise(0)).withColumn("__sibling", F.lead("at").over(by))
    same = Window.partitionBy(key, "name", "__whole", "__depth").orderBy("at")
    deep = deep.withColumn("__next", F.struct(F.lead("kind").over(same).alias("kind"), F.lead("at").over(same).alias("at")))
    end = F.when(F.col("__whole"), F.col("at")).when(F.col("__next.kind") == "close", F.col("__next.at")).when(F.col("name").isin(*NEXT_ENDS), F.col("__sibling"))
    return deep.select(*tags.columns, F.when(F.col("kind") == "open", end).alias("end"))


def elements(rows: DataFrame, key: str) -> DataFrame:
    """key, name, at, end and raw of each element of tokens. An element without content ends where it starts."""
    last = rows.groupBy(F.col(key).alias("__key")).agg((F.max("at") + 1).alias("last"))
    found = ended(rows.filter(F.col("kind").isin("open", "close")), key).filter("kind = 'open'")
    return found.join(last, F.col(key).eqNullSafe(F.col("__key"))).select(key, "name", "at", F.coalesce("end", "last").alias("end"), "raw")


def within(outer: DataFrame, inner: DataFrame, key: str, prefix: str = "outer_") -> DataFrame:
    """Rows of inner with the rows of outer (key, at, end, ...; renamed with the prefix) that they lie in.

    Each of outer is spread over the places in it, so rows meet by equal places and only those that lie within.
    """
    renamed = outer.select(*[F.col(c).alias(f"{prefix}{c}") for c in outer.columns])
    first, end = F.col(f"{prefix}at") + 1, F.col(f"{prefix}end")
    spread = renamed.filter(first < end).withColumn("__place", F.explode(F.sequence(first, end - 1)))
    return inner.join(spread, F.col(key).eqNullSafe(F.col(f"{prefix}{key}")) & (F.col("at") == F.col("__place"))).drop(f"{prefix}{key}", "__place")


def selected(selectors: list[tuple[str, str | None]]) -> Column:
    """The number of the first of selectors (tag, class or None) that an opening tag's name and raw meet."""
    return F.coalesce(*[F.when((F.col("name") == tag) & (has_class(F.col("raw"), css) if css else F.lit(True)), n) for n, (tag, css) in enumerate(selectors)], F.lit(None).cast("int"))


def cards(found: DataFrame, key: str, selectors: list[tuple[str, str | None]]) -> DataFrame:
    """Elements of the first of selectors (tag, class or None) of which a page has any."""
    marked = found.withColumn("__selector", selected(selectors)).withColumn("__least", F.min("__selector").over(Window.partitionBy(key)))
    return marked.filter(F.col("__selector") == F.col("__least")).drop("__selector", "__least")


def card_parts(pages: DataFrame, key: str, html: str, selectors: list[tuple[str, str | None]]) -> DataFrame:
    """key, card_at and parts (at, kind, name and raw of the tokens within, in order) of the cards() of each page."""
    tag = rf"(?i)^</?\s*({'|'.join(sorted({tag for tag, _ in selectors}))})(?![A-Za-z0-9:-])"
    marks = F.filter(F.transform(cut_up(F.col(html)), lambda raw, at: F.struct(at.alias("at"), raw.alias("raw"))), lambda t: t["raw"].startswith("<") & F.regexp_like(t["raw"], F.lit(tag)))
    # a page goes along with the first of its tags, within the array: beside it, each row of a tag would take the page along before it is dropped
    marks = F.transform(marks, lambda t, n: F.struct(F.when(n == 0, F.col(html)).alias("page"), t["at"].alias("at"), t["raw"].alias("raw")))
    tags = pages.select(key, F.explode(marks).alias("__tag")).select(key, F.col("__tag.page").alias("__page"), "__tag.at", "__tag.raw")
    tags = tags.withColumn("name", name_of(F.col("raw"))).withColumn("kind", kind_of(F.col("raw"), F.col("name")))
    tags = tags.withColumn("__selector", F.when(F.col("kind") == "open", selected(selectors)))
    # by key first: the windows by key and name are then within it
    tags = ended(tags.withColumn("__least", F.min("__selector").over(Window.partitionBy(key))), key)
    box = F.when(F.col("__selector") == F.col("__least"), F.struct("at", "end"))
    paged = tags.groupBy(key).agg(F.first("__page", ignorenulls=True).alias("__page"), F.array_sort(F.collect_list(box)).alias("__boxes")).filter(F.size("__boxes") > 0)
    paged = paged.select(key, cut_up(F.col("__page")).alias("__cut"), "__boxes")

    def within_box(box: Column) -> Column:
        raws = F.slice("__cut", box["at"] + 2, F.greatest(F.coalesce(box["end"], F.size("__cut")) - box["at"] - 1, F.lit(0)))
        named = F.transform(raws, lambda raw, n: F.struct((box["at"] + 1 + n).alias("at"), name_of(raw).alias("name"), raw.alias("raw")))
        parts = F.transform(named, lambda t: F.struct(t["at"].alias("at"), kind_of(t["raw"], t["name"]).alias("kind"), t["name"].alias("name"), t["raw"].alias("raw")))
        return F.struct(box["at"].alias("card_at"), F.filter(parts, lambda t: t["kind"] != "other").alias("parts"))

    # cards are cut out before they become rows, else each would take the whole page along
    return paged.select(key, F.explode(F.transform("__boxes", within_box)).alias("__card")).select(key, "__card.card_at", "__card.parts")


def listing(pages: DataFrame, key: str, html: str, selectors: list[tuple[str, str | None]]) -> DataFrame:
    """key, place (from 1), link, title and text for each card of each page, in order; of cards with one link (or, without any, one title) the first.

    The link is the first one in the card that leads to a page; the title is the first heading, or else what the link says.
    """
    each = card_parts(pages, key, html, selectors)
    opened = lambda p, *names: (p["kind"] == "open") & p["name"].isin(*names)
    links = F.transform(F.filter("parts", lambda p: opened(p, "a")), lambda p: F.struct(p["at"].alias("at"), p["name"].alias("name"), attribute(p["raw"], "href").alias("href")))
    leads = lambda a: (a["href"] != "") & ~a["href"].startswith("#") & ~F.lower(a["href"]).startswith("javascript:") & ~F.lower(a["href"]).startswith("mailto:")
    headings = F.transform(F.filter("parts", lambda p: opened(p, *HEADINGS)), lambda p: F.struct(p["at"].alias("at"), p["name"].alias("name")))
    shown = lambda parts: clean(decoded(F.array_join(F.transform(parts, lambda p: p["raw"]), " ")))
    # each step is a row of its own, so that a later filter does not work it out again
    bound = lambda *columns: F.explode(F.array(F.struct(*columns)))
    each = each.select(key, "card_at", "parts", bound(F.get(F.filter(links, leads), F.lit(0)).alias("first"), F.get(headings, F.lit(0)).alias("heading"), F.filter("parts", lambda p: p["kind"] == "text").alias("texts")).alias("b")).select(key, "card_at", "parts", "b.*")
    start = F.coalesce("heading", F.struct(F.col("first.at").alias("at"), F.col("first.name").alias("name")))
    each = each.withColumn("start", start)
    end = F.get(F.filter("parts", lambda p: (p["kind"] == "close") & (p["name"] == F.col("start.name")) & (p["at"] > F.col("start.at"))), F.lit(0))["at"]
    said = F.get(F.transform(F.array(end), lambda e: shown(F.filter("texts", lambda p: (p["at"] > F.col("start.at")) & (e.isNull() | (p["at"] < e))))), F.lit(0))
    each = each.select(key, "card_at", bound(F.coalesce("first.href", F.lit("")).alias("link"), F.coalesce(said, F.lit("")).alias("title"), shown(F.col("texts")).alias("text")).alias("b")).select(key, "card_at", "b.*")
    named = each.filter("link != '' or title != ''").withColumn("same", F.when(F.col("link") != "", F.concat(F.lit("l"), "link")).otherwise(F.concat(F.lit("t"), F.lower("title"))))
    firsts = named.groupBy(key, "same").agg(F.min(F.struct("card_at", "link", "title", "text")).alias("card"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("card.card_at"))
    return firsts.select(key, place.alias("place"), "card.link", "card.title", "card.text")


def exhibitors(listed: DataFrame, least: int = 3, most: int = 70) -> DataFrame:
    """Rows of listing() whose title names a company: of fitting length, with a letter, and none of NO_NAMES."""
    return listed.filter(F.char_length("title").between(least, most) & F.regexp_like("title", F.lit(r"\p{L}")) & ~F.lower("title").isin(*NO_NAMES))


def next_page(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, has_next and next_url ('' if the next page is a form's) of each page: a link marked or labelled as next, or a form with such a button."""
    cut = cut_up(F.col(html))
    tag = lambda i: F.get(F.col("cut"), i)
    label = lambda i: F.lower(clean(decoded(F.coalesce(tag(i + 1), F.lit("")))))
    marked = lambda i: F.lower(attribute(tag(i), "rel")).isin("next") | has_class(F.lower(tag(i)), "next") | label(i).isin(*NEXT_LABELS)
    places = F.filter(F.sequence(F.lit(0), F.size("cut") - 1), lambda i: F.regexp_like(tag(i), F.lit(r"(?i)^<a\s")) & (attribute(tag(i), "href") != "") & marked(i))
    button = lambda t: F.regexp_like(t, F.lit(r"(?i)^<input\b")) & (F.lower(attribute(t, "type")) == "submit") & F.lower(attribute(t, "value")).isin(*NEXT_LABELS)
    rows = pages.select(key, cut.alias("cut")).withColumn("first", F.when(F.size("cut") > 0, F.get(places, F.lit(0))))
    form = F.exists("cut", button)
    return rows.select(key, (F.col("first").isNotNull() | form).alias("has_next"), F.coalesce(attribute(tag(F.col("first")), "href"), F.lit("")).alias("next_url"))
