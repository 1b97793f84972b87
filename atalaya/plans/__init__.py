"""All queries over the domain tables; importing this package registers them."""

from . import cover_queries, model_queries, panel_queries, polygon_queries, spatial_queries, sql_queries, survey_queries, workbook_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
