"""Registry of every query and its SQL oracle.

Importing this module loads all query families, then all oracle families
(the oracles reuse constants of the queries).
"""

from __future__ import annotations

from faultcast.plans import queries, queries_features, queries_misc, queries_models, queries_text  # noqa: F401
from faultcast.plans import oracles, oracles_features, oracles_misc, oracles_models, oracles_text  # noqa: F401

QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES
