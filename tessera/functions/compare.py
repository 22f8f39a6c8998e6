"""Recursive comparison of nested results, with tolerances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np


def differences(a: Any, b: Any, rtol: float = 1e-7, atol: float = 0.0, at: str = "") -> list[str]:
    """Dotted places where two nested values differ; NaN equals NaN, keys that start with an underscore are skipped."""
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        ka, kb = ({k for k in m if not str(k).startswith("_")} for m in (a, b))
        out = [f"{at}.{k}".strip(".") + " is on one side only" for k in sorted(map(str, ka ^ kb))]
        for k in sorted(ka & kb, key=str):
            out += differences(a[k], b[k], rtol, atol, f"{at}.{k}".strip("."))
        return out
    if isinstance(a, np.ndarray) or isinstance(b, np.ndarray):
        x, y = np.asarray(a), np.asarray(b)
        if x.shape != y.shape:
            return [f"{at or 'value'}: shapes {x.shape} and {y.shape}"]
        same = np.allclose(x, y, rtol, atol, equal_nan=True) if x.dtype.kind in "fciub" and y.dtype.kind in "fciub" else bool((x == y).all())
        return [] if same else [f"{at or 'value'}: arrays differ"]
    if isinstance(a, Sequence) and isinstance(b, Sequence) and not isinstance(a, str) and not isinstance(b, str):
        if len(a) != len(b):
            return [f"{at or 'value'}: lengths {len(a)} and {len(b)}"]
        return [d for k, (x, y) in enumerate(zip(a, b, strict=True)) for d in differences(x, y, rtol, atol, f"{at}.{k}".strip("."))]
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return [] if np.isclose(a, b, rtol, atol, equal_nan=True) else [f"{at or 'value'}: {a} and {b}"]
    return [] if a == b else [f"{at or 'value'}: {a!r} and {b!r}"]


def staged_report(found: Mapping[str, Any], expected: Mapping[str, Any], tolerances: Mapping[str, float], rtol: float = 1e-7) -> list[tuple[str, bool, list[str]]]:
    """``(stage, whether equal, differences)`` in the stages' order, each under its own relative tolerance.

    A stage that one side lacks is a difference, so the first line that is not equal names
    where two runs part.
    """
    out = []
    for stage in dict.fromkeys([*expected, *found]):
        if stage not in found or stage not in expected:
            off = [f"{stage} is on one side only"]
        else:
            off = differences(found[stage], expected[stage], tolerances.get(stage, rtol), at=stage)
        out.append((stage, not off, off))
    return out
