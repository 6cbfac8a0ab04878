"""Every registered query, grouped by area."""

from trendlake.queries import (  # noqa: F401
    q_basket, q_clean, q_cluster, q_flow, q_forecast, q_grid, q_join, q_profile, q_series, q_share, q_source, q_trend,
)
from trendlake.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
