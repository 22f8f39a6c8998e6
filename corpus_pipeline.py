"""A corpus pipeline of five stages, each one operator of ``tessera.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and
returns a table that is written and read again. All but the last return the columns of
``documents``; the last returns packed bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, secrets
from tessera.llm.ngram_join import BROADCAST_IDS, ngram_components
from tessera.llm.packing import pack_documents
from tessera.llm.store import Workspace, few, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, or with a calibrated score below ``KEEP_SCORE``.

    Null, empty and letterless texts are ``und`` and go. Repeated rows are judged alike.
    Rows with a null label teach nothing but are judged; without any label all go. An
    empty table stays empty; columns beyond those of ``documents`` pass through.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= langid.KEEP_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of the n-gram Jaccard join, the one of least id.

    Documents without words are in no group and stay. Of rows that repeat an id, one stays.
    """
    found = ngram_components(docs.select("doc_id", "text"))
    space = Workspace(spark, "near-duplicates")
    groups = space.put("groups", found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("rows")))
    gone = groups.where("doc_id <> first").select("doc_id")
    if few(gone, BROADCAST_IDS):
        gone = F.broadcast(gone)
    stays = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not groups.where("doc_id = first AND rows > 1").isEmpty():
        stays = stays.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(stays.where("doc_id IS NULL"))
    return stays


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its edit budget.

    Null and empty texts hold nothing and stay; repeated rows are judged alike; without
    documents or items the table passes as it is; other columns pass through.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with its secrets replaced by a mark; ``n_chars`` follows the text (null for a null text).

    Repeated rows stay repeated; an empty table stays empty; other columns pass through.
    """
    fixed = secrets.redact(docs)
    return fixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents (words as tokens).

    Null and empty texts are pieces of length 0; repeated and null ids are packed like
    others; an empty table gives no bins.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("best_fit_packing", packing),
]

#: Language models and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = space.put(f"{k}-{name}", stage(spark, docs, sf_dir))
        if before:
            space.drop(before)
        before = f"{k}-{name}"
    return docs
