import pytest
from pyspark.sql import functions as F

from leadloom.functions import contact, drafts, html, scoring, text, url


def values(spark, build, *rows):
    """build(column) for each string."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]


def test_urls(spark):
    assert values(spark, url.host, "HTTPS://WWW.A.com:80/x", "http://u:p@b.org?x", "nonsense", None) == ["www.a.com", "b.org", "", ""]
    assert values(spark, url.registrable, "a.b.co.uk", "x.y.com", "localhost") == ["b.co.uk", "y.com", "localhost"]
    assert values(spark, url.country, "a.co.uk", "b.de", "uk", "c.zz") == ["GB", "DE", None, None]
    assert values(spark, lambda c: url.host_in(c, ("a.com",)), "a.com", "x.a.com", "xa.com") == [True, True, False]
    assert values(spark, url.category, "http://h/product-category/x", "http://h/hand-tools/1", "http://h") == ["", "h&-tools", ""]
    assert values(spark, url.unwrapped, "http://d/l/?uddg=http%3A%2F%2Fa.com%2F&x=1", "http://a") == ["http://a.com/", "http://a"]
    assert values(spark, url.product_name, "http://h/p/red_ring-2.html", "http://h/p/cup/") == ["Red Ring 2", "Cup"]
    assert values(spark, url.is_social, "www.facebook.com", "notfacebook.com") == [True, False]
    assert values(spark, url.contact_path, "http://a/Contact-us", "http://a/x") == [True, False]


def test_texts(spark):
    assert values(spark, text.legal_name_key, "Acme, Inc.", "Foo  Ltd", "An Incredible Co", None) == ["acme", "foo", "an redible co", ""]
    assert values(spark, text.singular, "berries", "ties", "glass", "rings", "gas") == ["berry", "tie", "glass", "ring", "gas"]
    assert values(spark, text.tokens, "The ring, the RINGS of 99 it") == [["the", "ring", "rings"]]
    assert values(spark, lambda c: text.word_hit(c, "rich"), "a rich man", "zürich", "richer") == [True, True, False]
    assert values(spark, lambda c: text.excerpt(c, "key"), "a" * 50 + "key" + "  b" * 3, "none") == ["a" * 40 + "key b b b", ""]
    assert values(spark, lambda c: text.filled("{{name}} {{NAME}} {{x}}", name=c), "Bo") == ["Bo Bo {{x}}"]


def test_emails(spark):
    raw = ("sales@brand.com", "foo@example.com", "logo@cdn.com.png", "noreply@brand.com", "youremail@brand.com", "sales@yourdomain.com", "test@brand.com", " MAILTO:A@b.co?x=1 ", "oper@ions.learn", None)
    assert values(spark, contact.clean_email, *raw) == ["sales@brand.com", None, None, None, None, None, None, "a@b.co", None, None]
    key = 0x0A
    code = bytes([key] + [ord(c) ^ key for c in "info@brand.com"]).hex()
    assert values(spark, contact.cf_email, code, "zz", "0a") == ["info@brand.com", None, None]
    assert values(spark, contact.obfuscated_emails, "Reach sales [at] brand [dot] com now") == [["sales@brand.com"]]
    assert values(spark, contact.loose_emails, "sales @ brand . com") == [["sales@brand.com"]]
    spelled = ["info(at)brand(dot)com", "info( at )brand.com or x@y.org", "jane.doe at brand dot co dot uk!", "Meet at noon. Look at brand dot", "a{AT}b<dot>org", None, "at dot com"]
    assert values(spark, contact.obfuscated_emails, *spelled) == [["info@brand.com"], ["info@brand.com"], ["jane.doe@brand.co.uk"], [], ["a@b.org"], [], []]
    loose = ["Mail sales@brand.com. Then wait", "a@b . org , c @d.org", "no @ sign", None, "x@example.com"]
    assert values(spark, contact.loose_emails, *loose) == [["sales@brand.com"], ["a@b.org", "c@d.org"], [], [], []]
    junk = ["a@sub.example.com", "a@notexample.com", "noreply-x@brand.com", "test@brand.com", "testy@brand.com", "logo@2x.png", "a@b.js", "u00a@brand.com", "x" * 65 + "@brand.com"]
    assert values(spark, contact.clean_email, *junk) == [None, "a@notexample.com", None, None, "testy@brand.com", None, None, None, None]
    assert values(spark, contact.split_list, "a@b.co; A@b.co,\nc@d.org") == [["a@b.co", "c@d.org"]]
    assert values(spark, contact.clean_phone, "+1  212-555-0199", "123") == ["+1 212-555-0199", None]
    assert values(spark, contact.phone_country, "97150000000", "4930", "999") == ["AE", "DE", None]
    two = spark.createDataFrame([("", "x@y.org", "z@y.org")], "a string, b string, c string")
    assert two.select(contact.resolved(F.col("a"), F.col("b"), F.col("c")).alias("v")).first().v == ["x@y.org"]


def test_contact_page_beats_footer(spark):
    s = contact.SOURCES
    hits = [("privacy@brand.com", "brand.com", s["text"], contact.PAGE_HOME), ("sales@brand.com", "brand.com", s["mailto"], contact.PAGE_CONTACT), ("partner@other.com", "brand.com", s["mailto"], contact.PAGE_HOME)]
    rows = contact.ranked_hits(spark.createDataFrame([(1, *h) for h in hits], "k int, email string, site string, source int, page int"), ["k"]).orderBy("rank").collect()
    assert [r.email for r in rows] == ["sales@brand.com", "privacy@brand.com"]


PAGE = """<html><head><title>Acme &amp; Co - Home</title><style>p{}</style></head><body><nav><a href="/x">x</a></nav>
<a href="mailto:hello@acmewear.com">Email us</a><p>Sales [at] acmewear [dot] com</p><div>Mail <span>orders</span>@<span>acmewear.com</span></div>
<script type="application/ld+json">{"email":"office@acmewear.com"}</script><p>Built with help@wix.com</p></body></html>"""


def test_pages(spark):
    assert values(spark, html.text_of, PAGE)[0].split("\n")[:2] == ["Acme & Co - Home", "Email us"]
    assert values(spark, html.title_of, PAGE, "") == ["Acme & Co - Home", ""]
    assert values(spark, lambda c: html.site_name(c, F.lit("acme-wear.com")), PAGE, "<p>") == ["Acme & Co", "Acme Wear"]
    assert values(spark, html.links, PAGE) == [["/x", "mailto:hello@acmewear.com"]]
    assert values(spark, html.is_shell, '<div id="root"></div>', PAGE * 20) == [True, False]
    hits = values(spark, html.contact_hits, PAGE)[0]
    assert {(h.email, h.source) for h in hits} == {("hello@acmewear.com", 40), ("office@acmewear.com", 26), ("orders@acmewear.com", 15), ("sales@acmewear.com", 12)}


def test_drafts(spark):
    got = values(spark, drafts.subject, "Re: FREE  sample!!!", "BIG NEWS TODAY FOLKS", "x " * 50, None, "Amazing opportunity for you")
    assert got[:2] == ["sample", "Big news today folks"] and len(got[2]) <= 70 and got[3:] == ["Quick question", "quick note for you"]
    assert values(spark, drafts.spaced, "a  \n\n\n\nb,, c  d :") == ["a\n\nb, c d:"]


@pytest.mark.parametrize("row,due", [(("Won", False, None, "2024-01-01"), False), (("Re-contact", False, None, None), True), (("Contacted", True, True, None), True), (("Contacted", True, None, None), False), (("Contacted", False, None, "2024-01-05"), True), (("Contacted", False, None, "2024-01-08"), False)])
def test_follow_up(spark, row, due):
    df = spark.createDataFrame([row], "stage string, replied boolean, again boolean, sent string")
    assert df.select(drafts.follow_up_due(F.col("stage"), F.col("replied"), F.col("again"), F.col("sent").cast("timestamp"), F.lit("2024-01-09").cast("timestamp")).alias("v")).first().v is due


def test_scores(spark):
    df = spark.createDataFrame([(True, True, True, True), (True, False, True, True), (False, False, False, True), (False, False, True, False), (False, False, False, False)], "r boolean, x boolean, l boolean, t boolean")
    assert [r.v for r in df.select(scoring.save_decision(F.col("r"), F.col("x"), F.col("l"), F.col("t")).alias("v")).collect()] == ["reject_location", "save", "save_local", "unrelated", "uncertain"]
    assert spark.range(1).select(scoring.effective_limit(F.lit(False), F.lit(12), F.lit(3), 5).alias("a"), scoring.effective_limit(F.lit(False), F.lit(-1), F.lit(None).cast("int"), 5).alias("b")).first()[:] == (12, 5)
    assert spark.range(1).select(scoring.progress(F.lit(0.0), F.lit(0.0)).alias("a"), scoring.progress(F.lit(1.0), F.lit(1.0)).alias("b")).first()[:] == (8, 88)
