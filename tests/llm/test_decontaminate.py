from __future__ import annotations

import random

from tessera.llm import decontaminate as D

from .common import with_clashes


def edit_distance_to_part(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_search_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert D.myers(item, text)[0] == edit_distance_to_part(item, text)


def changed(rng, text, k):
    t = list(text)
    for _ in range(k):
        at = rng.randrange(len(t))
        kind = rng.random()
        if kind < 0.4:
            t[at] = rng.choice("xyz")
        elif kind < 0.7:
            del t[at]
        else:
            t.insert(at, rng.choice("xyz"))
    return "".join(t)


def test_every_occurrence_within_budget_is_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 50)))) for k in range(25)]
    docs, want = [], {}
    for d in range(120):
        text = " ".join(word() for _ in range(rng.randint(0, 80)))
        if d % 3 == 0:
            k, item = rng.choice(items)
            budget = len(D.normalise(item)) * D.ERROR_PERCENT // 100
            text = f"{text}\n {changed(rng, item.upper() if d % 2 else item, rng.randint(0, budget))} {text}"
            want[d] = k
        docs.append((d, text))
    docs += [(500, None), (501, ""), (None, items[0][1])]
    odd = [(90, None), (91, ""), (92, "qq")]
    table = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = with_clashes(spark.createDataFrame(items + odd, "item_id long, text string"))
    got = D.contaminated(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, k) for d, k in want.items()} | {(None, 0)}
    for r in got:
        item, text = D.normalise(dict(items)[r["item_id"]]), D.normalise(dict(docs)[r["doc_id"]])
        assert r["distance"] == edit_distance_to_part(item, text)
    kept = D.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d is not None and d not in want)
    assert D.contaminated(table, bench.limit(0)).count() == 0 and D.clean(table.limit(0), bench).count() == 0
    assert D.clean(table, bench.limit(0)).count() == len(docs)


def test_short_items_stand_between_spaces(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "concatenate")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert [(r["doc_id"], r["distance"]) for r in D.contaminated(docs, bench).collect()] == [(1, 0)]


def test_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a dog ran"), (3, "the cat and a dog"), (4, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "cat"), (None, "dog"), (7, "cat"), (None, None)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, None), (1, 7), (2, None), (3, None), (3, None), (3, 7)], key=str)
    assert [r["doc_id"] for r in D.clean(docs, bench).collect()] == [4]
