"""What sources there are: a configuration file, a registry of kinds, and readers that give tables by name."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

API_VERSION = 0


@dataclass
class SourceConfig:
    """A source: its name (the database name of its columns), kind, and settings."""

    name: str
    kind: str
    config: dict = field(default_factory=dict)


def load(path: str) -> list[SourceConfig]:
    """Sources of a YAML or JSON file: `api_version` and a list `sources` of {name, type, config}. YAML needs PyYAML."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("PyYAML isn't installed; write the sources as JSON") from e
        data = yaml.safe_load(text)
    if data.get("api_version", API_VERSION) != API_VERSION:
        raise ValueError(f"unknown api_version {data['api_version']}")
    out = [SourceConfig(s["name"], s["type"], s.get("config") or {}) for s in data["sources"]]
    for s in out:
        if s.kind not in READERS:
            raise ValueError(f"unknown type of source: {s.kind}")
    return out


def dump(sources: list[SourceConfig], path: str) -> None:
    """Write sources as JSON, which is YAML too."""
    data = {"api_version": API_VERSION, "sources": [{"name": s.name, "type": s.kind, "config": s.config} for s in sources]}
    Path(path).write_text(json.dumps(data, indent=2), encoding="utf-8")


READERS: dict[str, Callable[[SparkSession, dict], dict[str, DataFrame]]] = {}


def reader(kind: str):
    """Register a reader: from a session and settings to tables by name."""
    def put(f):
        READERS[kind] = f
        return f
    return put


def tables(spark: SparkSession, source: SourceConfig) -> dict[str, DataFrame]:
    """The tables of a source, lazily."""
    return READERS[source.kind](spark, source.config)
