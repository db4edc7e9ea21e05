"""The registered queries of the engine's own operators, with their SQL."""

from . import cells, focal, hydrology, lidar, sources, statistics, vector  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
