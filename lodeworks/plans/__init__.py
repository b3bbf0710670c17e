"""Queries over the driver tables, one module per operator family."""

from __future__ import annotations

import importlib

from lodeworks.plans.registry import CATALOG, Query

FAMILIES = [
    "filtering",
    "joining",
    "auditing",
    "ordering",
    "normalising",
    "records",
    "texts",
    "pages",
    "matching",
    "validating",
    "outreach",
    "storing",
]


def load_catalog() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"lodeworks.plans.{family}")
    return CATALOG
