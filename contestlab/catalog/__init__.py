"""Registered queries, grouped by the part of the library they exercise."""

import importlib

from .registry import ORACLES, QUERIES

PARTS = ["history", "cleaning", "fitted", "assembly", "evaluation", "market", "analysis", "states", "stream", "rebuilt"]


def load():
    for part in PARTS:
        importlib.import_module(f"{__name__}.{part}")
    return QUERIES, ORACLES
