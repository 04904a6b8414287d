"""Column builders over drafts of messages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wording that subjects lose.
PROMOTION = r"(?i)\b(free|urgent|act now|limited time|guaranteed|exclusive offer|buy now)\b"
DEFAULT_SUBJECT = "Quick question"


def subject(raw: Column, first_touch: bool = True) -> Column:
    """A subject without fake threads, promotion and shouting, of at most 70 characters."""
    s = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    if first_touch:
        s = F.trim(F.regexp_replace(s, r"(?i)^(re|fw|fwd)\s*:\s*", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"!{2,}", ""), r"\$+", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, PROMOTION, ""), r"(?i)\bamazing opportunity\b", "quick note"), r"(?i)\bdon't miss\b", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s{2,}", " "), r"^[ \-–—|,]+|[ \-–—|,]+$", "")
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    calm = F.when(s == F.upper(s), F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))).otherwise(F.initcap(s))
    s = F.when((letters > 6) & (capitals * 10 > letters * 7), calm).otherwise(s)
    cut = F.regexp_replace(F.regexp_replace(F.substring(s, 1, 67), r"\s\S*$", ""), r"[ \-–,]+$", "")
    s = F.trim(F.when(F.length(s) > 70, F.coalesce(F.when(cut != "", cut), F.substring(s, 1, 70))).otherwise(s))
    return F.when(s != "", s).otherwise(DEFAULT_SUBJECT)


def spaced(body: Column) -> Column:
    """White space as an author means it: no blanks at line ends, at most one empty line, single blanks."""
    out = F.regexp_replace(F.coalesce(body, F.lit("")), r"[ \t]+\n", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r",{2,}", ",")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\s+:", ":"))


def sendable(status: Column, recipient: Column, subject_: Column, body: Column) -> Column:
    """A draft that can go out: a draft or approved, with recipient, subject and body."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return status.isin("Draft", "Approved") & filled(recipient) & filled(subject_) & filled(body)


def outreach_ready(fit: Column, priority: Column, score: Column, intent: Column) -> Column:
    """High fit, a worked priority, a high score, or a good score with some intent."""
    return F.coalesce(fit == "high", F.lit(False)) | F.coalesce(priority.isin("priority", "nurture"), F.lit(False)) | (score >= 75) | ((score >= 65) & intent.isin("high", "low"))


def follow_up_due(stage: Column, replied: Column, again: Column, sent_at: Column, now: Column, days: int = 3) -> Column:
    """Closed stages never; Re-contact always; replies only when asked again; else sent and so many days ago."""
    closed = stage.isin("Won", "Denied", "Avoid", "Meeting")
    waited = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(sent_at) >= days * 86_400, F.lit(False))
    return F.when(closed, False).when(stage == "Re-contact", True).when(replied, F.coalesce(again, F.lit(False))).otherwise(waited)
