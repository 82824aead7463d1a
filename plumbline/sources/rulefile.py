"""Rule files (YAML)."""

from __future__ import annotations

import importlib.resources
from pathlib import Path
from typing import Any

import yaml

PACKAGE = __package__.split(".")[0]


def load_rules(path: str | Path) -> dict[str, Any]:
    """Look for the file as given, then beside the package, then inside it."""
    given = Path(path)
    beside = Path(__file__).resolve().parents[2] / given
    inside = importlib.resources.files(PACKAGE).joinpath(str(path))
    for place in (given, beside, inside):
        if place.is_file():
            return yaml.safe_load(place.read_text(encoding="utf-8"))
    raise FileNotFoundError(f"no rule file at {path}")
