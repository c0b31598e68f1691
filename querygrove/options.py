"""Bounds of the engine.

Nothing is cut unless a caller asks for it: a bound that is not given is
``UNBOUNDED``. A given one is clamped to its allowed range. ``recommended`` has
the values meant for interactive use.
"""

from __future__ import annotations

MIB = 1024 * 1024

#: Larger than any count or size, and still an int.
UNBOUNDED = 2**31 - 1
#: Sums of bytes need more.
UNBOUNDED_BYTES = 2**62

#: Settings that cut no data: they keep their recommended value. Folders nested deeper than a scan goes are pruned like skipped folders.
SETTINGS = ("max_scan_depth", "explain_ttl_seconds", "task_ttl_seconds", "llm_token_budget")

#: Name -> (recommended, lowest, highest).
BOUNDS: dict[str, tuple[int, int, int]] = {
    "max_file_size": (MIB, 1, 100 * MIB),
    "max_files_per_scan": (50_000, 100, 500_000),
    "max_total_bytes": (256 * MIB, 1024, 4096 * MIB),
    "max_scan_depth": (20, 1, 100),
    "max_sql_input_bytes": (4 * MIB, 1024, 100 * MIB),
    "max_statements": (10_000, 1, 100_000),
    "max_findings": (1_000, 10, 10_000),
    "max_candidates": (50, 1, 1_000),
    "max_parser_warnings": (100, 10, 1_000),
    "max_analysis_tables": (500, 10, 10_000),
    "max_analysis_columns": (5_000, 10, 50_000),
    "max_analysis_joins": (200, 1, 5_000),
    "max_analysis_predicates": (1_000, 1, 10_000),
    "max_explain_sql_bytes": (256 * 1024, 1024, 4 * MIB),
    "max_plan_response_bytes": (2 * MIB, 65_536, 16 * MIB),
    "max_plan_nodes": (500, 50, 5_000),
    "max_plan_depth": (64, 8, 256),
    "max_plan_condition_chars": (1_024, 64, 8_192),
    "max_explain_candidates": (5, 1, 50),
    "explain_ttl_seconds": (3_600, 60, 86_400),
    "task_ttl_seconds": (3_600, 60, 86_400),
    "max_schema_files": (1_000, 1, 10_000),
    "max_schema_file_bytes": (4 * MIB, 1024, 16 * MIB),
    "max_schema_total_bytes": (32 * MIB, 1024, 64 * MIB),
    "max_requirements_bytes": (256 * 1024, 1024, 4 * MIB),
    "max_error_input_bytes": (64 * 1024, 64, MIB),
    "max_design_tables": (100, 1, 500),
    "max_hypotheses": (20, 1, 100),
    "max_catalog_matches": (10, 1, 50),
    "max_doc_sections": (20, 1, 100),
    "max_doc_section_chars": (8_192, 256, 65_536),
    "llm_token_budget": (4_000, 256, 1_000_000),
    "max_advisory_chars": (8_192, 256, 65_536),
    "cache_max_size_mb": (50, 1, 1024),
    "cache_max_entries": (4_096, 16, 65_536),
}


def recommended(name: str) -> int:
    return BOUNDS[name][0]


def options(**overrides: int) -> dict[str, int]:
    """All bounds: the overrides clamped to their allowed range, the others unbounded."""
    unknown = set(overrides) - set(BOUNDS)
    if unknown:
        raise KeyError(f"unknown options: {sorted(unknown)}")
    found = {}
    for name, (value, low, high) in BOUNDS.items():
        if name in overrides:
            found[name] = min(max(int(overrides[name]), low), high)
        elif name in SETTINGS:
            found[name] = value
        else:
            found[name] = UNBOUNDED_BYTES if "bytes" in name or "_size" in name else UNBOUNDED
    return found
