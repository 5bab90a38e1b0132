"""Settings from a file: sections of values, read from JSON, or from YAML where its reader is installed, and overridden from the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Sections that are missing are empty. ``consistency`` may set the thresholds of the cascade; ``graph`` the folder of the store."""

    llm: dict = field(default_factory=dict)
    graph: dict = field(default_factory=dict)
    consistency: dict = field(default_factory=dict)
    retrieval: dict = field(default_factory=dict)

    def threshold(self, name: str, default: float) -> float:
        """A threshold from 0 to 1; ValueError for what is none."""
        x = float(self.consistency.get(name, default))
        if not 0 <= x <= 1:
            raise ValueError(f"{name} is to be from 0 to 1, not {x}")
        return x


def load(path: str, environment: Mapping[str, str] | None = None) -> Config:
    """A file of sections; unknown sections are left out. ``TRIPLETIDE_SECTION_NAME`` in the environment overrides a value, read as JSON where it is some."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed: use JSON") from e
        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text or "{}")
    sections = {s: dict(data.get(s) or {}) for s in Config.__dataclass_fields__}
    for k, v in (os.environ if environment is None else environment).items():
        head, section, *name = k.lower().split("_", 2)
        if head == "tripletide" and section in sections and name:
            try:
                sections[section][name[0]] = json.loads(v)
            except ValueError:
                sections[section][name[0]] = v
    return Config(**sections)
