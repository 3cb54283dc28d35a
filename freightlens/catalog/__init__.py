"""All registered queries, grouped by topic."""

import importlib

TOPICS = ["quality", "scoring", "nearest", "decisions", "telemetry", "learning"]


def load():
    """Import every topic module and return the filled registry."""
    for topic in TOPICS:
        importlib.import_module(f"freightlens.catalog.{topic}")
    return importlib.import_module("freightlens.catalog.registry")
