"""All registered queries; importing the parts fills the registry."""

from tidemark.plans import catalog_events, catalog_evidence, catalog_flows, catalog_market, catalog_pit, catalog_portfolio  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
