from . import (composite, disagg, folds, gapfill, grid, labels, manifest, metrics, mosaic, quality,
               ridge, scoring, spatial, tables, zonal)

__all__ = ["composite", "disagg", "folds", "gapfill", "grid", "labels", "manifest", "metrics", "mosaic",
           "quality", "ridge", "scoring", "spatial", "tables", "zonal"]
