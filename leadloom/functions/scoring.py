"""Column builders for scores, levels and decisions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points by level of ideal-customer, offer and sales-motion fit.
ICP_POINTS = {"high": 24.0, "medium": 15.0, "unknown": 3.5, "low": 0.0}
OFFER_POINTS = {"high": 22.0, "medium": 12.0, "unknown": 2.0, "low": 0.0}
MOTION_POINTS = {"high": 20.0, "medium": 11.0, "unknown": 2.0, "low": 0.0}
LEVELS = ("low", "unknown", "medium", "high")


def points(level: Column, table: dict[str, float]) -> Column:
    """A level's points; 0 for others."""
    return reduce(lambda c, kv: F.when(level == kv[0], kv[1]).otherwise(c), table.items(), F.lit(0.0))


def checksum(seed: Column, most: int = 180) -> Column:
    """Place-weighted sum of the code points of a seed's first characters."""
    chars = F.filter(F.split(F.substring(seed, 1, most), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c, i: (i + 1) * F.ascii(c)), F.lit(0).cast("long"), lambda a, x: a + x)


def fit_score(icp: Column, offer: Column, motion: Column, geo: Column, role: Column, evidence: Column, homepage: Column, seed: Column) -> Column:
    """0 to 99, rounded half to even: level points plus extras, a steady spread by seed, then caps for thin evidence."""
    raw = points(icp, ICP_POINTS) + points(offer, OFFER_POINTS) + points(motion, MOTION_POINTS) + geo + role
    raw = raw + F.when(homepage, 4.0).otherwise(0.0) + F.least(F.lit(5.0), evidence * 1.4)
    return capped(raw, icp, offer, motion, homepage, checksum(seed))


def capped(raw: Column, icp: Column, offer: Column, motion: Column, homepage: Column, sum_: Column) -> Column:
    """A raw score spread by a checksum, capped for thin evidence, from 0 to 99, rounded half to even."""
    jitter = (sum_ % 71) / F.lit(10.0)
    raw = raw + F.when(sum_ % 2 == 1, jitter * 0.65).otherwise(-jitter * 0.4)
    weak = ("unknown", "low")
    # least() passes over nulls, so a cap that does not apply leaves the score, and each cap names the score once
    raw = F.least(
        raw,
        F.when(~homepage, 51.0 + jitter * 0.15),
        F.when(icp.isin(*weak) & motion.isin(*weak), 38.0 + jitter * 0.2),
        F.when((offer == "low") & homepage, 70.0 + jitter * 0.25),
        F.when((icp == "low") | (motion == "low"), 34.0 + jitter * 0.15),
    )
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(99.0), raw))).cast("long")


def lowest_level(*levels: Column) -> Column:
    """The lowest of several levels."""
    rank = lambda c: reduce(lambda a, kv: F.when(c == kv[1], kv[0]).otherwise(a), enumerate(LEVELS), F.lit(1))
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.least(*map(rank, levels)) + 1)


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found in lower-case text."""
    return F.regexp_like(text, F.lit("|".join(f"(?:{p})" for p in patterns)))


def save_decision(relevant: Column, rejected: Column, loaded: Column, local_trade: Column) -> Column:
    """What happens to a page: rejected places first, then relevance, then local trade, then what is known of it."""
    return F.when(rejected, "reject_location").when(relevant, "save").when(local_trade, "save_local").when(loaded, "unrelated").otherwise("uncertain")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def progress(leads: Column, intents: Column) -> Column:
    """Percent of a run: 8 and up to 80 more by leads and intents, from 5 to 95."""
    return clamp(8 + F.floor(80 * (0.7 * leads + 0.3 * intents)), 5, 95).cast("long")


def effective_limit(bypass: Column, override: Column, plan: Column, default: int) -> Column:
    """Bypass, then a set override, then the plan's limit, then the default."""
    return F.when(bypass, 999_999).when(override >= 0, override).otherwise(F.coalesce(plan, F.lit(default))).cast("long")


def remaining(limit: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), limit - used)
