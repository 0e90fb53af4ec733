"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from scoreloom.plans.registry import ORACLES, QUERIES

MODULES = (
    "aggregate_queries", "measurement_queries", "rating_queries", "calibration_queries", "sequence_queries",
    "comparison_queries", "dataset_queries", "world_queries", "decision_queries",
)

for _name in MODULES:
    importlib.import_module(f"scoreloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
