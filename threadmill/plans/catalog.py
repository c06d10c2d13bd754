"""The core's queries by name, and the SQL that must give the same rows."""

from threadmill.plans import general, reference

QUERIES = {**general.QUERIES, **reference.QUERIES}
ORACLES = {**general.ORACLES, **reference.ORACLES}
FLAGSHIP = "hybrid_search"
