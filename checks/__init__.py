"""Checked queries: each runs a library operator over whole tables, with equal SQL where SQL can say it."""

from importlib import import_module

from .registry import CHECKS

for _module in ("q_sources", "q_tables", "q_pixels", "q_grid", "q_models", "q_rasters", "q_incremental"):
    import_module(f"{__name__}.{_module}")

__all__ = ["CHECKS"]
