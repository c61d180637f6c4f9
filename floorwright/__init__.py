"""floorwright: floor-plan analytics as DataFrame and SQL plans."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: Public names and the modules they come from; loaded when first used.
PUBLIC = {
    "vectorize": "plans.vectorize", "vectorized": "plans.vectorize", "summary": "plans.vectorize",
    "taxonomy": "functions.taxonomy", "TAXONOMIES": "functions.taxonomy", "settings": "functions.config",
    "confusion": "operators.metrics", "per_class": "operators.metrics", "match_rooms": "operators.matching", "match_openings": "operators.matching",
    "predict": "operators.tiles", "register": "operators.tiles", "scorer": "operators.tiles", "augmented": "operators.augment",
    "dataset": "sources.datasets", "images": "sources.readers", "svg_polygons": "sources.readers", "paint": "sources.readers",
    "plan_mask": "sources.generate", "exported": "sources.exports", "to_json": "sources.exports", "from_json": "sources.exports",
}
__all__ = sorted(PUBLIC)


def __getattr__(name: str):
    if name not in PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{PUBLIC[name]}"), name)
