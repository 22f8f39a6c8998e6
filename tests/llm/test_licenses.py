from __future__ import annotations

import random

from tessera.llm import licenses as L

from .common import with_clashes


def test_templates_are_found_whole_with_their_spans():
    index = L.Index(L.TEMPLATES)
    rng = random.Random(0)
    for name, text in L.TEMPLATES.items():
        head = " ".join(f"w{rng.randrange(99)}" for _ in range(30))
        doc = f"{head} {text}\n{head}"
        found = {f[0]: f for f in index.find(doc)}
        assert found[name][1] == 1.0
        words = L.words(text)
        assert doc[found[name][3] : found[name][4]].split()[0].strip("(\"").lower() == words[0][0]
        assert found[name][3] == len(head) + 1 + words[0][1] and found[name][4] == len(head) + 1 + words[-1][2]


def test_changed_templates_keep_their_coverage(spark):
    rng = random.Random(1)
    words = L.TEMPLATES["MIT"].split()
    for k in range(0, len(words), 9):
        words[k] = f"changed{rng.randrange(9)}"
    rows = [(1, "x " + " ".join(words)), (2, None), (3, ""), (4, "the license of the software is the license"), (None, "Released under the MIT License."), (5, "Released under the MIT License. " * 2), (6, "... "), (7, "a " * 100_000 + L.TEMPLATES["ISC"])]
    table = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"] or 0, r["license"], r["coverage"]) for r in L.license_spans(table).collect()), key=str)
    assert [g[:2] for g in got] == [(0, "MIT-line"), (1, "MIT"), (5, "MIT-line"), (5, "MIT-line"), (7, "ISC")]
    assert 0.8 < got[1][2] < 0.95 and got[0][2] == 1.0
    assert L.license_spans(table.limit(0)).count() == 0


def test_every_licence_line_of_the_harness_is_reported(spark):
    lines = {"Apache-2.0-line": "Licensed under the Apache License, Version 2.0.", "MIT-line": "Released under the MIT License.", "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0."}
    rows = [(k, f"some prose\n{line}\nmore prose") for k, line in enumerate(lines.values())]
    got = L.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in got) == [(k, name, 1.0) for k, name in enumerate(lines)]


def test_variants_of_a_licence_are_told_apart():
    index = L.Index(L.TEMPLATES)
    for name in L.FAMILIES:
        assert [f[0] for f in index.find(f"prose here {L.TEMPLATES[name]} prose there")] == [name]
    assert [f[0] for f in index.find("Licensed under CC BY 4.0. Licensed under CC BY-SA 3.0.")] == ["CC-BY-4.0-line", "CC-BY-SA-3.0-line"]
    assert not index.find("Licensed under CC terms of 4.0")


def test_alignment_equals_the_full_local_one():
    def full(a, b):
        best = 0
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
                best = max(best, table[i][j])
        return best

    rng = random.Random(5)
    for _ in range(100):
        a = [rng.choice("pqrst") for _ in range(rng.randint(1, 12))]
        b = [rng.choice("pqrst") for _ in range(rng.randint(1, 12))]
        matched, first, last = L.align(a, b, 0, 0, 20)
        assert matched * 2 >= full(a, b) and (not matched or 0 <= first <= last < len(b))


def test_the_index_finds_what_a_full_alignment_finds():
    """Every template with words left out, replaced and put in, against its alignment to the whole text: recall 0.95 at least."""
    rng = random.Random(11)
    index = L.Index(L.TEMPLATES)
    there = found = 0
    for share in (0.05, 0.1, 0.2):
        for name, text in L.TEMPLATES.items():
            template = [w for w, _, _ in L.words(text)]
            for _ in range(3):
                edited = []
                for word in template:
                    kind = rng.choice("drk") if rng.random() < share else " "
                    edited += {"d": [], "r": ["other"], "k": [word, "other"], " ": [word]}[kind]
                around = [f"w{rng.randrange(99)}" for _ in range(20)]
                doc = around + edited + around
                matched, _, _ = L.align(template, doc, 0, 0, len(doc) + len(template))
                if matched >= (1 if name in L.WHOLE else L.COVERAGE) * len(template):
                    names = {f[0] for f in index.find(" ".join(doc))}
                    there += 1
                    found += name in names or any(L.FAMILIES.get(n) == L.FAMILIES.get(name, n) for n in names if n in L.FAMILIES)
    assert there > 300 and found >= 0.95 * there, (found, there)
