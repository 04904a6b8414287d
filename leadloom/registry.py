"""Named queries over the driver's tables, and the SQL that each is held against."""

from leadloom.plans import accounts, bulk, documents, funnel, hunting, leads, listings, pages, places, selection, threads, usage

QUERIES: dict = {}
ORACLES: dict = {}

for module in (funnel, pages, documents, leads, usage, threads, selection, places, bulk, hunting, accounts, listings):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
