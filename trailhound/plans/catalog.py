"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

import importlib

from trailhound.plans.registry import ORACLES, QUERIES

for _module in ("q_parse", "q_core", "q_detect", "q_scores", "q_outputs", "q_more"):
    importlib.import_module(f"trailhound.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
