"""Query builders by area; importing an area registers its queries."""

from __future__ import annotations

import importlib

AREAS = ("chain", "daily", "surface", "records", "schedule", "text", "streams", "modelled", "assembled", "earnings", "payloads", "risk", "operations", "volatility", "smiles")


def registered():
    """The registry with all areas loaded."""
    for area in AREAS:
        importlib.import_module(f"vegaflow.plans.{area}")
    return importlib.import_module("vegaflow.plans.registry")
