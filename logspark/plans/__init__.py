"""Registered queries; importing this package fills the registry."""

from logspark.plans import alert_plans, anomaly_plans, parse_plans, record_plans, search_plans, stream_plans, topology_plans  # noqa: F401
from logspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
