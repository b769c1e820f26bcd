"""The modules of this subpackage that register queries."""

from __future__ import annotations

import importlib

NAMES = ["boilerplate_queries", "repeats_queries", "encoding_queries", "near_duplicates_queries", "ledger_queries", "residue_queries", "packing_queries", "mixing_queries", "truncation_queries"]
MODULES = [importlib.import_module(f"sitequarry.llm.{name}") for name in NAMES]
