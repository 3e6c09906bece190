"""All registered queries of the accountability engine and their oracles."""

from __future__ import annotations

from tallybook.plans import activity, landings, lookups, portals, surface, texts, vendors, wards

QUERIES = {}
ORACLES = {}
for module in (vendors, wards, activity, texts, lookups, landings, portals, surface):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

FLAGSHIP = "vendor_profile"
