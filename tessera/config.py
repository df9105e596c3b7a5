"""Typed configuration: dataclasses from nested dicts, unknown keys and wrong types are errors."""

from __future__ import annotations

import dataclasses
import json
import os
import typing

REGISTRY: dict[tuple[str | None, str], type] = {}


def register(name: str, group: str | None = None):
    """Class decorator: name a dataclass, in a group if there are alternatives."""

    def add(cls):
        REGISTRY[group, name] = cls
        return cls

    return add


def build(cls, values: dict):
    """An instance of the dataclass; ValueError names every unknown, missing or ill-typed key."""
    fields = {f.name: f for f in dataclasses.fields(cls)}
    hints, problems, made = typing.get_type_hints(cls), [f"unknown key {k}" for k in values if k not in fields], {}
    for name, f in fields.items():
        if name not in values:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                problems.append(f"missing key {name}")
            continue
        v, kind = values[name], hints[name]
        if dataclasses.is_dataclass(kind):
            v = build(kind, v)
        elif kind is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        elif isinstance(kind, type) and (not isinstance(v, kind) or (kind is int and isinstance(v, bool))):
            problems.append(f"{name} must be {kind.__name__}")
        made[name] = v
    if problems:
        raise ValueError("; ".join(problems))
    return cls(**made)


def load(cls, path: str):
    with open(path) as f:
        return build(cls, json.load(f))


def snapshot(config, path: str) -> None:
    with open(path, "w") as f:
        json.dump(dataclasses.asdict(config), f, indent=1, sort_keys=True)


def secret(name: str) -> str | None:
    """From the file named by NAME_FILE, else from NAME in the environment."""
    path = os.environ.get(f"{name}_FILE")
    if path and os.path.exists(path):
        with open(path) as f:
            return f.read().strip()
    return os.environ.get(name)


@register("sessions")
@dataclasses.dataclass(frozen=True)
class SessionConfig:
    gap: str = "30 minutes"
    test_days: int = 28
    min_session_items: int = 2
    min_item_sessions: int = 10


@register("retrieval")
@dataclasses.dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 20
    alpha: float = 0.7
    rrf_k: int = 60
    overfetch: int = 3
    chunk_tokens: int = 512
    chunk_overlap: int = 50
