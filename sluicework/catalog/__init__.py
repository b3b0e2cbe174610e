"""All registered queries; importing the modules registers them."""

from sluicework.catalog import expressions, ingestion, models, reading, relations, summaries, views  # noqa: F401
from sluicework.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
