"""Layered settings: nested dictionaries, later layers over earlier ones, and single values set by dotted keys."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

_WORDS = {"true": True, "false": False, "null": None, "~": None, "": None, "yes": True, "no": False}


def scalar(text: str) -> Any:
    """A value as a settings file would read it: number, truth value, nothing, list or mapping; else the text itself."""
    own = text.strip()
    if own.lower() in _WORDS:
        return _WORDS[own.lower()]
    try:
        return json.loads(own)
    except ValueError:
        pass
    if own.startswith("[") and own.endswith("]"):
        return [scalar(x) for x in own[1:-1].split(",")] if own[1:-1].strip() else []
    try:
        return float(own)
    except ValueError:
        return own


def over(base: dict[str, Any], layer: dict[str, Any]) -> dict[str, Any]:
    """base with the layer's values, mappings merged key by key; keys that base hasn't are passed over, as in a typed record."""
    both = {k: over(base[k], v) if isinstance(base[k], dict) and isinstance(v, dict) else v for k, v in layer.items() if k in base}
    return base | both


def settings(base: dict[str, Any], layers: list[dict[str, Any]] = (), assigned: list[str] = ()) -> dict[str, Any]:
    """base under all layers, then under assignments like "data.size=256"."""
    single = [reduce(lambda v, k: {k: v}, reversed(key.split(".")), scalar(raw)) for key, _, raw in (x.partition("=") for x in assigned)]
    return reduce(over, [*layers, *single], base)
