"""Queries of the registry operators over the driver's tables, with their SQL."""

from archivum.queries import analysis, governance, mapping, relations, scalars  # noqa: F401 - they register their queries
from archivum.queries.base import ORACLES, QUERIES  # noqa: F401
