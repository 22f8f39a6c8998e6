"""Connected components of a link table: contraction inside tasks first, then star steps.

Each task contracts its links, chunk by chunk, to stars (``member, least member``), which
leaves at most one link a node and chunk. If what is left fits one task (a checked bound),
that task finishes; otherwise alternating large-star and small-star steps run distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import Workspace

#: Links that a task contracts at once, and that one task may finish alone (about 100 bytes each in Python).
CHUNK_LINKS = 200_000
ONE_TASK_LINKS = 500_000


def _stars(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """``(member, least member of its component)`` of each node that is not its component's least."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = [(n, find(n)) for n in parent]
    return [n for n, r in roots if n != r], [r for n, r in roots if n != r]


def _contract(chunk: int):
    """Links ``(hi, lo)`` of a task -> stars ``(hi, lo)``, ``chunk`` links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            both = np.concatenate(waiting, 1)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _stars(both[0].tolist(), both[1].tolist())], ["hi", "lo"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                waiting.append(np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
                held += part.num_rows
                if held >= chunk:
                    yield flush()
                    waiting, held = [], 0
        if held:
            yield flush()

    return run


def _star(edges: DataFrame) -> DataFrame:
    """``edges(u, v)``: each node's other ends ``v`` hang on the least of its neighbourhood instead."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, space: Workspace, tag: str, most_rounds: int = 60, one_task: int = ONE_TASK_LINKS, chunk: int = CHUNK_LINKS) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)`` for each linked node; ``root`` is its component's least node.

    Self links and repeated links do no harm; null ends are dropped. Each round is
    written to the shared folder, so a lost executor costs one round at most. Nothing
    reaches the driver: a round is an aggregate with map-side combining and an equi-join
    whose large partitions adaptive execution splits.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = space.put(f"{tag}-0", ends.mapInArrow(_contract(chunk), "hi long, lo long"))
    n = edges.count()
    if n <= one_task:
        # any number of links up to the bound, so that one chunk holds them all
        last = edges.repartition(1).mapInArrow(_contract(max(one_task, 1)), "hi long, lo long")
        edges = space.put(f"{tag}-1", last)
        return _with_roots(edges)
    edges = edges.distinct()
    before = None
    for k in range(1, most_rounds + 1):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        edges = space.put(f"{tag}-{k}", small.where("hi <> lo").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1000003), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        space.drop(f"{tag}-{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return _with_roots(edges)


def _with_roots(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
