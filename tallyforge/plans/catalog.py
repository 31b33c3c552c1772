"""Every registered query, from all modules."""

from tallyforge.plans import editing_queries, page_queries, profile_queries, queries, version_queries  # noqa: F401
from tallyforge.plans.queries import flagship  # noqa: F401
from tallyforge.plans.registry import ORACLES, QUERIES  # noqa: F401
