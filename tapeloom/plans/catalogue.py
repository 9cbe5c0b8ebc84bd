"""Imports every query module, so that all queries are registered."""

from tapeloom.plans import data_queries, model_queries, panel_queries, portfolio_queries  # noqa: F401
from tapeloom.plans.registry import QUERIES, SQL  # noqa: F401
