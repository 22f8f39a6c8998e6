from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.llm.packing import CAPACITIES, best_fit, pack, pack_documents, sequence_cost

from .common import with_clashes


COSTS = {c: sequence_cost(c) for c in CAPACITIES}


def total(used, capacities=CAPACITIES, costs=COSTS):
    return sum(costs[next(c for c in capacities if c >= u)] for u in used)


def plain_best_fit(lengths, capacities, costs, open_size=None):
    """Best fit by scanning all bins, and the opening rule by filling on trial from a sorted list."""
    where, used, size, came = [], [], [], []
    for at, n in enumerate(lengths):
        fits = [b for b in range(len(used)) if size[b] - used[b] >= n]
        if fits:
            b = min(fits, key=lambda b: (size[b] - used[b], -came[b]))
        else:
            b = len(used)
            used.append(0)
            came.append(0)
            if open_size is not None:
                size.append(open_size if n <= open_size else min(c for c in capacities if c >= n))
            else:
                rates = []
                for c in capacities:
                    if c >= n:
                        held = n
                        for m in sorted((x for x in lengths[at + 1 :] if x), reverse=True):
                            if held + m <= c:
                                held += m
                        rates.append((costs[min(x for x in capacities if x >= held)] / max(held, 1), -c))
                size.append(-min(rates)[1])
        used[b] += n
        came[b] = at + 1
        where.append(b)
    return where, used


def least_total(lengths, capacities, costs):
    """The optimum, over all ways to part a few pieces into bins."""
    best = [float("inf")]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], total(bins, capacities, costs))
            return
        for b in range(len(bins) + 1):
            if b == len(bins):
                place(k + 1, [*bins, lengths[k]])
            elif bins[b] + lengths[k] <= capacities[-1]:
                place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])

    place(0, [])
    return best[0]


def test_best_fit_takes_the_tightest_open_bin():
    where, used = best_fit([60, 50, 40, 10], (100,), {100: 100.0}, 100)
    assert where == [0, 1, 0, 1] and used == [100, 60]


def test_best_fit_equals_a_plain_scan():
    rng = random.Random(4)
    for k in range(40):
        lengths = sorted((rng.choice([0, 1, rng.randint(1, 90), rng.randint(200, 700), rng.randint(1, 4096)]) for _ in range(60)), reverse=True)
        for open_size in (None, CAPACITIES[k % 4]):
            assert best_fit(lengths, CAPACITIES, COSTS, open_size) == plain_best_fit(lengths, CAPACITIES, COSTS, open_size)


def test_small_cases_are_near_the_optimum():
    rng = random.Random(6)
    capacities = (40, 64, 100)
    costs = {c: sequence_cost(c, 3, 400) for c in capacities}
    equal = 0
    for _ in range(60):
        lengths = sorted((rng.randint(5, 95) for _ in range(6)), reverse=True)
        got, best = total(pack(lengths, capacities, 3, 400)[1], capacities, costs), least_total(lengths, capacities, costs)
        assert best <= got <= 1.25 * best
        equal += got <= best + 1e-9
    assert equal >= 40


def test_sizes_are_chosen_bin_by_bin():
    """Bins of several sizes are opened in one shard, at less cost than any single size."""
    rng = random.Random(3)
    mixed = 0
    for _ in range(20):
        lengths = sorted((rng.choice([rng.randint(900, 1024), rng.randint(300, 512), rng.randint(1800, 2048), rng.randint(1, 200)]) for _ in range(300)), reverse=True)
        where, used, final = pack(lengths)
        assert all(sum(n for n, b in zip(lengths, where, strict=True) if b == k) == u <= c and c in CAPACITIES for k, (u, c) in enumerate(zip(used, final, strict=True)))
        single = [total(best_fit(lengths, CAPACITIES, COSTS, c)[1]) for c in CAPACITIES]
        assert total(used) <= min(single) and total(best_fit(lengths, CAPACITIES, COSTS)[1]) <= 1.02 * min(single)
        mixed += len(set(final)) >= 2
    assert mixed == 20


def test_every_token_is_in_exactly_one_bin(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 3, 100, 511, 512, 4096, 4097, 20_000])) for k in range(300)] + [(None, 7), (5, None), (5, 12), (6, -3)]
    table = with_clashes(spark.createDataFrame(rows, "doc_id long, tokens long"))
    bins = pack_documents(table, length=F.col("tokens")).collect()
    seen: dict = {}
    for b in bins:
        assert sum(b["lengths"]) == b["used"] <= b["capacity"] and b["capacity"] in CAPACITIES
        assert not any(c >= b["used"] for c in CAPACITIES if c < b["capacity"])
        for d, s, n in zip(b["doc_ids"], b["starts"], b["lengths"], strict=True):
            seen.setdefault(d, []).append((s, n))
    for k, n in rows[:300]:
        if k not in (5, 6):
            at = 0
            for s, m in sorted(seen[k]):
                assert s == at
                at += m
            assert at == n
    five = [(s, min(4096, rows[5][1] - s)) for s in range(0, max(rows[5][1], 1), 4096)]
    assert sorted(seen[5]) == sorted([*five, (0, 0), (0, 12)])
    assert seen[None] == [(0, 7)] and len({b["bin_id"] for b in bins}) == len(bins)


def test_words_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b\tc"), (2, None), (3, ""), (4, " ")], "doc_id long, text string")
    one = pack_documents(docs).collect()
    assert len(one) == 1 and sorted(zip(one[0]["doc_ids"], one[0]["lengths"], strict=True)) == [(1, 3), (2, 0), (3, 0), (4, 0)]
    assert pack_documents(docs.limit(0)).count() == 0
    many = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    assert pack_documents(many).agg(F.sum("used")).first()[0] == 20_000


def test_files_layout_does_not_matter(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 1, 1, k]), rng.choice([5, 5, 5000, rng.randint(0, 900)])) for k in range(20_000)]
    one = spark.createDataFrame(rows, "doc_id long, tokens long")
    packed = lambda table: sorted((str((r["bin_id"], r["capacity"], r["doc_ids"], r["starts"], r["lengths"])) for r in pack_documents(table, length=F.col("tokens")).collect()))
    assert packed(one.coalesce(1)) == packed(one.repartition(7, "tokens"))
