"""Queries that run the operators on the driver tables."""

from evq.bindings import claims, curation, entities, operations, records, refresh, relational, state, streams, texts, vectors  # noqa: F401
from evq.bindings.registry import ORACLES, QUERIES  # noqa: F401
