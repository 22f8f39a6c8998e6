"""Parameter dictionaries: merge, flatten, complete, check. Driver side, small by nature."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from typing import Any


def merge(*parts: Mapping) -> dict:
    """Later parts win; nested values are replaced as a whole."""
    out: dict = {}
    for part in parts:
        out |= part
    return out


def deep_update(base: Mapping, change: Mapping) -> dict:
    """A copy of ``base`` with nested values changed key by key."""
    out = dict(base)
    for key, value in change.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = deep_update(out[key], value) if both else copy.deepcopy(value)
    return out


def flatten(nested: Mapping, head: str = "", joint: str = ".") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in nested.items():
        name = f"{head}{joint}{key}" if head else str(key)
        if isinstance(value, Mapping) and value:
            out |= flatten(value, name, joint)
        else:
            out[name] = value
    return out


def complete(given: Mapping, defaults: Mapping) -> dict:
    """``given`` with what it lacks, at any depth, taken from ``defaults``."""
    return deep_update(defaults, given)


def unknown_keys(given: Mapping, defaults: Mapping) -> list[str]:
    """Dotted names in ``given`` that ``defaults`` does not have; free where the default is not a mapping."""
    out = []
    for key, value in given.items():
        if key not in defaults:
            out.append(str(key))
        elif isinstance(value, Mapping) and isinstance(defaults[key], Mapping) and defaults[key]:
            out += [f"{key}.{rest}" for rest in unknown_keys(value, defaults[key])]
    return out


def prepare(given: Mapping, defaults: Mapping) -> dict:
    """Strict: unknown keys are an error, missing ones are filled in."""
    if extra := unknown_keys(given, defaults):
        raise KeyError(f"unknown parameters: {', '.join(extra)}")
    return complete(given, defaults)
