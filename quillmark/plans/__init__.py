"""Registered queries; importing this package fills the registry."""

from quillmark.plans import relational, service, stock, streams, texts
from quillmark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "relational", "service", "stock", "streams", "texts"]
