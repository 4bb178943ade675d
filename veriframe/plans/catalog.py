"""Imports every query module so that the registry is filled."""

from __future__ import annotations

from veriframe.plans import q_authorization, q_functions, q_gates, q_misc, q_models, q_more, q_risk, q_sources, q_stats, q_text, q_timeseries  # noqa: F401
from veriframe.plans.registry import ORACLES, QUERIES  # noqa: F401
