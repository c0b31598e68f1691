"""Imports every workload module, so that the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ("files", "errors", "statements", "security", "lint", "docs", "history", "plans", "catalogue", "reports", "streaming")

for _name in MODULES:
    importlib.import_module(f"querygrove.workloads.{_name}")
