"""All registered queries of the map-data jobs."""

from tilewright.jobs import q_evaluate, q_geometry, q_labels, q_services, q_sources, q_styles, q_tiles
from tilewright.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_evaluate", "q_geometry", "q_labels", "q_services", "q_sources", "q_styles", "q_tiles"]
