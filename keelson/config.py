"""Configuration: sources, connections, paths and environment, as JSON files or dicts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

DEFAULT_KEYS = ("customer_id",)
DEFAULT_THRESHOLD = 80.0


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    entity: str = "customer"
    dedupe_keys: tuple[str, ...] = DEFAULT_KEYS
    similarity_threshold: float = DEFAULT_THRESHOLD
    sensitive_fields: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}_{self.entity}".lower()


@dataclass(frozen=True)
class Connection:
    """How to read a source: type file, jdbc, api or stream."""

    type: str = "file"
    format: str = "csv"
    options: dict[str, str] = field(default_factory=dict)
    url: str | None = None
    user: str | None = None
    secret: str | None = None
    driver: str | None = None


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...]
    root: str
    environment: str = "local"
    reset_mode: bool = False
    connections: dict[str, Connection] = field(default_factory=dict)
    schemas: dict = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)

    def path(self, layer: str, *parts: str) -> str:
        """The table of a layer: a configured path ``<layer>_<part>_…`` or ``<layer>``, else below the root."""
        joined = "_".join((layer, *parts)).lower()
        if joined in self.paths:
            return self.paths[joined]
        base = self.paths.get(layer, f"{self.root.rstrip('/')}/{layer}")
        return "/".join((base, *(p.lower() for p in parts)))

    def threshold(self, entity: str, source_system: str | None) -> float:
        for s in self.sources:
            if s.entity.lower() == entity.lower() and s.name.lower() == (source_system or "").lower():
                return s.similarity_threshold
        return DEFAULT_THRESHOLD

    def selected(self, name: str | None) -> list[Source]:
        """All sources, or those named ``name`` in any case."""
        return [s for s in self.sources if name is None or s.name.lower() == name.lower()]


def source_from(d: dict) -> Source:
    return Source(d["name"], d.get("path", ""), d.get("entity", "customer"), tuple(d.get("dedupe_keys") or DEFAULT_KEYS), float(d.get("similarity_threshold", DEFAULT_THRESHOLD)), tuple(d.get("sensitive_fields", ())))


def config_from(d: dict) -> Config:
    """A Config from one dict with sources, root, environment, reset_mode, connections, schemas and paths."""
    connections = {k.lower(): Connection(**v) for k, v in d.get("connections", {}).items()}
    return Config(tuple(source_from(s) for s in d["sources"]), d["root"], d.get("environment", "local"), bool(d.get("reset_mode", False)), connections, d.get("schemas", {}), {k.lower(): v for k, v in d.get("paths", {}).items()})


def load(path: str, spark=None) -> Config:
    """A JSON file; with a session at any URI that Spark reads, without one on the local disk."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return config_from(json.load(f))
    from keelson.sources.files import Folder

    parent, _, name = path.rpartition("/")
    return config_from(Folder(spark, parent or ".").read_json(name))


def env_secret(name: str) -> str | None:
    """Secrets from environment variables; pass another callable where they live elsewhere."""
    return os.environ.get(name)


SecretLookup = Callable[[str], str | None]
