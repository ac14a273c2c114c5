"""The registered queries; importing the modules registers them."""

from memloom.plans import bonds, health, ingest, measures, messages, privacy, queries, recall, scores, stores, views  # noqa: F401
from memloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
