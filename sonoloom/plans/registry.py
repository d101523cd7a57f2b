"""All queries outside the optional subpackage."""

from __future__ import annotations

from sonoloom.plans import annotation_queries, catalogue_queries, frame_queries, mask_queries

_PARTS = [catalogue_queries.R, annotation_queries.R, mask_queries.R, frame_queries.R]
QUERIES = {k: q for part in _PARTS for k, q in part.queries.items()}
ORACLES = {k: t for part in _PARTS for k, t in part.oracles.items()}
