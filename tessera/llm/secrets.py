"""Secret scan over an incremental ledger of content-addressed blobs.

Every text (any historical version of any path) is a blob, named by the SHA-256 of
its UTF-8 bytes. The ledger holds which (blob, rule version) pairs have been scanned
and what was found. A call scans only blobs without a ledger row of the current rule
version, one holder each, appends what it found, and joins all findings back to every path that holds the
blob; copies and unchanged versions cost a hash, not a scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import Workspace, few

RULE_VERSION = 1
#: Blobs with findings that may be broadcast to mend their texts; beyond it, a shuffle join.
BROADCAST_BLOBS = 200_000

_A = re.ASCII
#: The base kinds in their listed order, then the kinds that this scanner adds.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | _A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", _A)
_HEX = re.compile(r"[0-9a-f]{24,}", _A)
_MORE = (
    ("private_key", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?", _A)),
    ("json_token", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", _A)),
    ("forge_token", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}", _A)),
    ("chat_token", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}", _A)),
    ("cloud_key", "AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}", _A)),
    ("url_login", "://", re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\s:@/]{1,80}:[^\s:@/]{1,80}@", _A)),
)
KINDS = (*BASE_KINDS, *(name for name, _, _ in _MORE))
_WORDS = ("password", "passwd", "secret", "token", "api")

FOUND = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, hits array<struct<kind:string,start:int,end:int>>"

LEDGER = f"{FOUND}, rule_version int"


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's place in KINDS, end)`` of all findings, sorted; code points, end exclusive.

    Base matches are leftmost and do not overlap within a kind; a match that fails its
    length rule is dropped after it has taken its text.
    """
    found = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (_, hint, pattern) in enumerate(_MORE, len(BASE_KINDS)):
        if hint in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [part.strip().split(" ", 1)[0] for part in FOUND.split(", ")]
    hit = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), hit]
    for batch in batches:
        rows = []
        for blob, text in zip(batch.column(0), batch.column(1), strict=True):
            found = scan_text(text.as_py() or "")
            base = [x for x in found if x[1] < len(BASE_KINDS)]
            counts = [sum(x[1] == k for x in base) for k in range(len(BASE_KINDS))]
            rows.append((blob.as_py(), *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found), [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], columns)


def _blob(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class Ledger:
    """The scans done so far, as Parquet below ``path``: the columns of ``FOUND`` and ``rule_version``.

    It is only ever appended to. If two calls scan a blob at the same time, it is listed
    twice, with equal findings; readers take one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All rows as they are now; none if nothing has been scanned."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def of(self, rule_version: int) -> DataFrame:
        return self.rows().where(F.col("rule_version") == rule_version).drop("rule_version")

    def append(self, scanned: DataFrame, rule_version: int) -> None:
        scanned.withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(self.path)


def scan_versions(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """``path, blob, n_assign, n_access, n_hex, base_sha256, spans, hits``, a row per row of ``versions``.

    ``path`` has the values of ``path_col``. Only blobs that ``ledger`` does not list under
    ``rule_version`` are scanned; their rows are appended to it while the query is built, and
    the result is read from it. Without a ledger, one of this call alone is used.

    Defined cases: a null text is the empty text, with no finding; equal texts get equal
    findings, under whatever paths; repeated rows stay repeated; null paths are kept as
    one more path; an empty table gives empty results; other columns are ignored.
    """
    space = Workspace(versions.sparkSession, "secrets")
    ledger = ledger or Ledger(versions.sparkSession, f"{space.root}/ledger")
    rows = versions.select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    held = space.put("held", rows.select("path", _blob("text").alias("blob")))
    unseen = held.groupBy("blob").agg(F.min("path").alias("holder"))
    unseen = space.put("unseen", unseen.join(ledger.of(rule_version).select("blob"), "blob", "left_anti"))
    if not unseen.isEmpty():
        texts = rows.join(unseen, F.col("path").eqNullSafe(F.col("holder")) & (_blob("text") == F.col("blob"))).select("blob", "text")
        ledger.append(texts.mapInArrow(_scan, FOUND).dropDuplicates(["blob"]), rule_version)
    columns = [part.strip().split(" ", 1)[0] for part in FOUND.split(", ")]
    # not dropDuplicates: Spark 4.1 loses its columns when the result is used in exceptAll
    known = ledger.of(rule_version).groupBy("blob").agg(*(F.first(c).alias(c) for c in columns[1:]))
    return held.join(known, "blob").select("path", *columns)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; same rows and columns.

    Overlapping findings are replaced as one. Texts without findings, null
    texts among them, are untouched.
    """
    found = scan_versions(docs, id_col, text_col, ledger)
    some = Workspace(docs.sparkSession, "redact").put("some", found.where(F.size("hits") > 0).select(F.col("blob").alias("__blob"), F.col("hits").alias("__hits")).dropDuplicates(["__blob"]))
    if few(some, BROADCAST_BLOBS, F.size("__hits") * 32 + 128):
        some = F.broadcast(some)
    joined = docs.withColumn("__blob", _blob(text_col)).join(some, "__blob", "left")
    spans = F.array_sort(F.transform("__hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    # spans are sorted by start, so the furthest end so far is a running maximum
    merged = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, h: F.struct(
            F.when(h["start"] >= acc["at"], F.concat(acc["done"], F.col(text_col).substr(acc["at"] + 1, h["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], h["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.col(text_col).substr(acc["at"] + 1, F.lit(2147483647))),
    )
    fixed = F.when(F.col("__hits").isNotNull(), merged).otherwise(F.col(text_col))
    return joined.withColumn(text_col, fixed).select(*docs.columns)
