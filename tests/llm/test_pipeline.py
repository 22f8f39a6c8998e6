from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import decontaminate, secrets
from tessera.llm.store import Workspace

from .test_ngram_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_its_work(spark, sf_dir):
    space = Workspace(spark, "pipeline-test")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in P.STAGES:
        before = docs
        docs = space.put(name, stage(spark, before, sf_dir))
        found[name] = before, docs
    before, after = found["language_id"]
    assert after.columns == COLUMNS and after.count() >= 0.99 * before.count()
    before, after = found["ngram_jaccard_join"]
    want = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]) if d == c}
    assert after.columns == COLUMNS and {r["doc_id"] for r in after.select("doc_id").collect()} == want
    before, after = found["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    exact = [decontaminate.normalise(t) for _, t in items]
    texts = {r["doc_id"]: decontaminate.normalise(r["text"]) for r in before.select("doc_id", "text").collect()}
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    assert after.columns == COLUMNS and all((d in kept) != any(x in t for x in exact) for d, t in texts.items())
    before, after = found["secret_scans"]
    assert after.columns == COLUMNS and after.count() == before.count()
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == old[r["doc_id"]]) == (not secrets.scan_text(old[r["doc_id"]]))
    before, bins = found["best_fit_packing"]
    packed = bins.select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("p")).groupBy("p.doc_ids").agg(F.sum("p.lengths").alias("n"))
    assert packed.count() == before.count() and bins.where("used > capacity").isEmpty()


def test_odd_rows_go_through(spark, sf_dir):
    text = "a word or two that say that this is a text which has no secret in it at all"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (None, text + " more", "en", "s", 1), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0) for r in P.near_duplicates(spark, docs, sf_dir).collect()) == [0, 1, 2, 3]
    for _, stage in P.STAGES:
        stage(spark, docs, sf_dir).count()
        stage(spark, docs.limit(0), sf_dir).count()


def test_run_gives_the_packed_bins(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    assert P.run(spark, small).columns == ["bin_id", "capacity", "used", "doc_ids", "starts", "lengths"]
