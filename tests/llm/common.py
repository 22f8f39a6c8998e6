"""Fixtures of the training-data operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

#: Column names that operators use inside; none may matter in an input.
CLASHES = ("id", "n", "g", "h1", "hub", "token", "blob", "path", "hits", "held", "score", "lang_pred", "doc", "spans", "place", "shard", "rank", "query_id", "rows", "first", "prefix")


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed: int = 1) -> list[tuple[int, str | None]]:
    """Unrelated texts, exact and near copies, a shared passage, and odd rows."""
    rng = random.Random(seed)
    out: list[tuple[int, str | None]] = []
    passage = " ".join(words(rng, 60))
    for k in range(60):
        out.append((k, " ".join(words(rng, rng.randint(30, 120))) + (" " + passage if k % 4 == 0 else "")))
    base = words(rng, 90)
    for k in range(60, 110):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"edit{k}x{rng.randrange(9)}"
        out.append((k, " ".join(copy)))
    out += [(110 + k, " ".join(base).upper() if k % 2 else " ".join(base)) for k in range(20)]
    out += [(140, None), (141, ""), (142, "  \t\n"), (143, "one two"), (144, "One  two"), (145, "a b c d e"), (146, "é à ü"), (147, " ".join(words(rng, 30_000, 50_000)))]
    return out
