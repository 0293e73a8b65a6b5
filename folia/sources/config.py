"""Settings of an engine from a dictionary or a JSON or YAML file, with placeholders for the environment."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from folia.functions.values import with_environment


@dataclass
class Config:
    storage: dict = field(default_factory=lambda: {"path": "./data"})
    embedding: dict = field(default_factory=lambda: {"provider": "hashing", "dimensions": 256})
    relationships: dict = field(default_factory=lambda: {"structural": True, "explicit": True, "semantic": False, "threshold": 0.7})
    sources: list = field(default_factory=list)

    @classmethod
    def of(cls, values: dict) -> Config:
        values = with_environment(values)
        known = {k: values[k] for k in cls.__dataclass_fields__ if k in values}
        base = cls()
        return cls(**{k: {**getattr(base, k), **v} if isinstance(v, dict) else v for k, v in known.items()})

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        import yaml

        return cls.of(yaml.safe_load(text) or {})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
