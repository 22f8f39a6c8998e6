from __future__ import annotations

import random

import pytest

from tessera.llm.components import components
from tessera.llm.ngram_join import ngram_components
from tessera.llm.store import Workspace

from .common import documents, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a2, b2 = sorted((find(a), find(b)))
                parent[b2] = a2
    return sorted((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = documents(seed)
    got = ngram_components(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("other", [False, True])
def test_members_of_one_group_that_miss_its_first_id(spark, other):
    """Texts 1, 2, 3 have equal sizes and prefixes; 2 and 3 link with each other only. ``other`` shares their last prefix shingle."""
    start = [f"p{k}" for k in range(25)]
    body = [f"y{k}" for k in range(75)]
    tails = [[f"x{k}" for k in range(79)], body + [f"s{k}" for k in range(4)], body + [f"t{k}" for k in range(4)]]
    rows = [(k, " ".join(start + tail)) for k, tail in enumerate(tails, 1)]
    for k, tail in enumerate(tails):  # makes the tails' shingles frequent, so that the prefixes lie in ``start``
        rows += [(10 + 10 * k + m, " ".join(start[-4:] + tail + [f"f{k}x{m}x{i}" for i in range(100)])) for m in range(6)]
    if other:
        rows.append((90, " ".join(start[:5])))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got}[3] == 2


def test_shuffled_pairs_split_hubs_and_repeated_ids(spark):
    rows = [(d - d % 2 if 60 <= d < 100 else d, t) for d, t in documents(3)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), few_pairs=0, hub_share=3)
    sizes = sorted((r["doc_id"], r["n_shingles"]) for r in got.collect())
    want = brute(rows)
    assert sizes == sorted((d, n) for d, n, _ in want)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: c for d, _, c in want}


@pytest.mark.parametrize("one_task, chunk", [(10**6, 3), (0, 4), (0, 10**6)])
def test_components_by_one_task_and_by_rounds(spark, one_task, chunk):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (200, 201), (200, 201)]
    parent = {n: n for pair in links for n in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = components(spark.createDataFrame([*links, (None, 1)], "a long, b long").repartition(3), Workspace(spark, "test"), "t", one_task=one_task, chunk=chunk)
    alone = {n for n in parent if all(a == b or n not in (a, b) for a, b in links)}
    assert dict(map(tuple, got.collect())) == {n: find(n) for n in parent if n not in alone}


def test_odd_rows(spark):
    empty = ngram_components(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (9, text + " "), (7, None), (8, "x")]
    got = sorted(ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4, None), (5, 4, 5), (5, 4, 5), (9, 4, 5), (7, 0, 7), (8, 1, 8)], key=str)


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(300, 300), (41, None)]
    space = Workspace(spark, "test")
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), space, "t").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {k: 200 for k in range(200, 209)}


def test_oracle(spark, sf_dir):
    import duckdb

    from tessera.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in registry.oracle_sql().items():
        want = con.execute(sql).df()
        got = registry.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
        key = list(want.columns)[:2]
        assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist(), name
