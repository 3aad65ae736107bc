"""YAML configuration on the driver."""

from __future__ import annotations

import os
from typing import Any

import yaml

#: Values of a path that mean "none given". Fixed values.
NO_PATH = (None, "", "null", "none", "N/A", "n/a")


def load_config(path: str) -> dict[str, Any]:
    if not os.path.exists(path):
        raise FileNotFoundError(f"Config file not found: {path}")
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def get_nested(cfg: Any, *keys: str, default: Any = None) -> Any:
    """cfg[k1][k2]..., or the default where a step is missing or not a dict."""
    for k in keys:
        if not isinstance(cfg, dict) or k not in cfg:
            return default
        cfg = cfg[k]
    return cfg


def null_leaves(tree: dict, prefix: str = "") -> list[str]:
    """Dotted paths of null leaves, in order of keys met."""
    found: list[str] = []
    for k, v in tree.items():
        path = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            found += null_leaves(v, path)
        elif v is None:
            found.append(path)
    return found
