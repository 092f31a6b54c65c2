"""Registered queries with the SQL they must agree with, one module per section."""

from __future__ import annotations

import importlib
import importlib.util

SECTIONS = [
    "sources",
    "cleaning",
    "joins",
    "aggregates",
    "windows",
    "topk",
    "setops",
    "scalars",
    "statistics",
    "graphs",
    "splits",
    "modelling",
    "evaluation",
    "monitoring",
]


def load() -> None:
    for name in SECTIONS:
        if importlib.util.find_spec(f"txnrisk.plans.{name}") is None:
            continue
        importlib.import_module(f"txnrisk.plans.{name}")
