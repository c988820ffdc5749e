"""All registered queries of the library's own operators."""

from __future__ import annotations

from stratalens.plans import detector_queries, drift_queries, fact_queries, identity_queries, loader_queries, marker_queries, snapshot_queries  # noqa: F401  they register themselves
from stratalens.plans.catalog import ORACLE, QUERIES  # noqa: F401
