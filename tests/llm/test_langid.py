from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid

from .common import with_clashes

SYLLABLES = {"xx": "ka to mi ra ne su".split(), "yy": "schl ung ver cht zw ein".split(), "zz": "ción que los ada ent ía".split()}


def rows(n, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((k, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang))
    return out


def test_held_out_accuracy_and_calibration(spark):
    table = with_clashes(spark.createDataFrame(rows(900), "doc_id long, text string, lang string")).withColumn("held_out", langid.held_out())
    model = langid.fit(table.where("NOT held_out"))
    got = langid.predict(table, model)
    held = got.where("held_out")
    assert held.count() > 150 and held.where("lang_pred = lang").count() > 0.98 * held.count()
    assert got.where("score < 0 OR score > 1").isEmpty() and 0.01 < model.temperature < 100
    assert (model.weights == 0).mean() > 0.5  # the elastic net keeps it sparse


def test_only_text_is_an_input(spark):
    table = spark.createDataFrame(rows(300), "doc_id long, text string, lang string")
    model = langid.fit(table)
    a = langid.predict(table, model).select("doc_id", "lang_pred", "score")
    b = langid.predict(table.withColumn("lang", F.lit("yy")), model).select("doc_id", "lang_pred", "score")
    assert a.exceptAll(b).isEmpty()


def test_odd_texts_and_tables(spark):
    table = spark.createDataFrame(rows(200), "doc_id long, text string, lang string")
    model = langid.fit(table)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 45"), (4, "ka" * 100_000), (None, "que"), (4, "ka")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and got[3][1] == "xx" and got[4][1] == "zz"
    none = langid.fit(table.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    unlabelled = langid.fit(table.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.languages == []
    assert langid.predict(odd.limit(0), model).count() == 0


def test_harness_accuracy(spark, sf_dir):
    from tessera.llm import registry

    got = registry.queries()["op7_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()


def plain_counts(text):
    """Hashed n-grams, one by one."""
    mask = (1 << 32) - 1
    shown = []
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or not shown or shown[-1] != " ":
            shown.append(c)
    if not any(c != " " for c in shown):
        return {}
    points = [32, *(ord(c) for c in shown), 32]
    multipliers = [int(m) for m in langid._MULTIPLIERS]
    found: dict[int, int] = {}
    for n in range(1, langid.MAX_N + 1):
        for i in range(len(points) - n + 1):
            code = points[i] * multipliers[0] & mask
            for k in range(1, n):
                code = ((code ^ code >> 15) * multipliers[k] + points[i + k] * 0x27D4EB2F) & mask
            spread = (code ^ code >> 16) * 0x7FEB352D & mask
            column = (spread ^ spread >> 13) >> 32 - langid.BITS
            found[column] = found.get(column, 0) + 1
    return found


def test_counts_equal_a_plain_loop():
    rng = random.Random(3)
    for text in ["", "1 2", "a", "Ab", "  x  y1z ", "Ünï çode ß", "日本 語", "a" * 50] + ["".join(rng.choice("abC 1é\n") for _ in range(rng.randint(1, 60))) for _ in range(60)]:
        columns, tally = langid.counts(text)
        assert dict(zip(columns.tolist(), tally.tolist(), strict=True)) == plain_counts(text)


def test_training_equals_a_plain_ftrl():
    """Follow the regularised leader with per-coordinate rates, coordinate by coordinate in dictionaries."""
    rng = np.random.default_rng(0)
    languages, width = ["a", "b", "c"], 12
    idf = np.ones(width)
    rows = []
    for _ in range(60):
        y = int(rng.integers(3))
        columns = np.unique(np.append(rng.integers(0, width, 4), y * 4))
        rows.append((y, columns, rng.integers(1, 4, len(columns))))
    alpha, beta, l1, l2, epochs, seed = 0.5, 1.0, 0.02, 0.02, 3, 5
    model = langid.train(languages, idf, rows, epochs, alpha, beta, l1, l2, seed)

    data = []
    for y, c, t in rows:
        values = [(1 + math.log(x)) for x in t]
        norm = math.sqrt(sum(v * v for v in values))
        data.append((y, {**{int(k): float(np.float32(v / norm)) for k, v in zip(c, values, strict=True)}, width: 1.0}))
    fit = [r for i, r in enumerate(data) if i % 5]
    z, n = {}, {}

    def weight(k, at):
        zk, nk = z.get((k, at), 0.0), n.get((k, at), 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((beta + math.sqrt(nk)) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            y, x = fit[i]
            w = {(k, at): weight(k, at) for k in range(3) for at in x}
            logits = [sum(w[k, at] * v for at, v in x.items()) for k in range(3)]
            e = [math.exp(v - max(logits)) for v in logits]
            for k in range(3):
                error = e[k] / sum(e) - (k == y)
                for at, v in x.items():
                    g = error * v
                    before = n.get((k, at), 0.0)
                    rate = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                    z[k, at] = z.get((k, at), 0.0) + g - rate * w[k, at]
                    n[k, at] = before + g * g
    for k in range(3):
        for at in range(width):
            assert model.weights[k, at] == pytest.approx(weight(k, at), abs=1e-5)
        assert model.bias[k] == pytest.approx(weight(k, width), abs=1e-6)


def test_document_frequencies_and_weights_come_from_all_rows(spark):
    table = rows(120, 2)
    model = langid.fit(spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(5))
    df: dict[int, int] = {}
    for _, text, _ in table:
        for column in plain_counts(text):
            df[column] = df.get(column, 0) + 1
    want = np.log((1 + len(table)) / (1 + np.array([df.get(k, 0) for k in range(1 << langid.BITS)]))) + 1
    assert np.allclose(model.idf, want)
    columns, tally = langid.counts(table[0][1])
    values = np.array([(1 + math.log(t)) * want[c] for c, t in zip(columns, tally, strict=True)])
    assert np.allclose(model.vector(columns, tally), values / np.sqrt((values**2).sum()), atol=1e-6)


def test_calibration_has_a_minimum_inside_its_range_and_lowers_the_loss():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 4, 400)
    for sharp in (0.05, 1.0, 30.0):  # all rows right, at any scale of the logits
        logits = rng.normal(size=(400, 4)) * 0.1 * sharp
        logits[np.arange(400), truth] += sharp
        t = langid._temperature(logits, truth)
        loss = lambda x: langid.calibration_loss(logits, truth, x)  # noqa: E731,B023
        assert 0.002 < t < 500 and loss(t) <= min(loss(t * 1.05), loss(t / 1.05), loss(1.0))


def test_the_stage_rejects_what_is_no_language(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(2)
    junk = ["".join(rng.choice("qwxzkjvbp0123456789 #$%") for _ in range(300)) for _ in range(20)] + ["zq " * 50, "Привет, это другой алфавит", "これは日本語です", "12 34 !?", "", None]
    odd = spark.createDataFrame([(-1 - k, t, None, "src0", 0) for k, t in enumerate(junk)], docs.schema)
    held = docs.where(langid.held_out())
    kept = corpus_pipeline.language(spark, docs.unionByName(odd), sf_dir)
    assert kept.columns == docs.columns and kept.where("doc_id < 0").isEmpty()
    assert kept.where(langid.held_out()).count() >= 0.995 * held.count()


def test_ties_and_too_many_labels(spark):
    """Of equal probabilities the first language in order counts; a label column of very many values is an error."""
    model = langid.Model(["aa", "bb"], np.ones(1 << langid.BITS), np.zeros((2, 1 << langid.BITS)), 1.0, np.zeros(2))
    assert model.predict("abc") == ("aa", 0.5)
    many = spark.range(langid.MOST_LANGUAGES + 1).selectExpr("id AS doc_id", "'some text' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError, match="labels"):
        langid.fit(many)
