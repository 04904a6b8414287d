"""Rules of a table read over a text in one pass: what they find, level by claim, and evidence in order.

A rule is (claim, level, confidence, statement, pattern). Patterns are literals of the plan, so each is compiled once a task, and all rules of a
text are one expression: nothing is shuffled or exploded. Null texts find nothing.
"""

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import clean

#: Rules that one expression takes; more belong in a table that is joined.
MOST = 500


class Rule(NamedTuple):
    claim: str
    level: str
    confidence: float
    statement: str
    pattern: str


def found(text: Column, rules: list[Rule], before: int = 40, span: int = 140) -> Column:
    """An array of (place, claim, level, confidence, statement, quote) for the rules that match, in the order of rules."""
    if len(rules) > MOST:
        raise ValueError(f"{len(rules)} rules in one expression; {MOST} at most")
    each = []
    for place, rule in enumerate(rules):
        quote = around(text, rule.pattern, before, span)
        each.append(F.struct(F.lit(place).alias("place"), F.lit(rule.claim).alias("claim"), F.lit(rule.level).alias("level"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.statement).alias("statement"), clean(quote).alias("quote")))
    return F.filter(F.array(*each), lambda x: x["quote"] != "")


def around(text: Column, pattern: str, before: int, span: int) -> Column:
    """The first match of (?is).{0,before}(?:pattern).{0,span}, empty without any. That pattern as it is tries each place `before` times; here texts without a match are read once, and others from `before` characters ahead of the first."""
    ahead = F.length(F.regexp_extract(text, f"(?is)^(.*?)(?:{pattern})", 1))
    near = F.substring(text, F.greatest(F.lit(1), ahead - before + 1), F.length(text))
    # null texts stay null
    return F.when(~F.regexp_like(text, F.lit(f"(?is){pattern}")), "").otherwise(F.regexp_extract(near, f"(?is).{{0,{before}}}(?:{pattern}).{{0,{span}}}", 0))


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern stands in a text, upper and lower case alike; false for null."""
    return F.coalesce(F.regexp_like(text, F.lit(f"(?i){pattern}")), F.lit(False))


def first(hits: Column, claim: str) -> Column:
    """The first of a claim's hits, null without any."""
    return F.get(F.filter(hits, lambda h: h["claim"] == claim), F.lit(0))
