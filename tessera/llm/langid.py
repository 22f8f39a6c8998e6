"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

*Features*: letters are lower-cased, everything else becomes one space; n-grams of one
to three characters are hashed to ``2**BITS`` columns, weighed ``(1 + ln tf) * idf``
and scaled to length one. Whole texts count, whatever their length.
*Statistics*: document frequencies come from all labelled rows that may be learnt from.
*Training*: follow-the-regularised-leader (proximal, per-coordinate rates) with elastic
net, on a bounded sample of labelled rows (``ROWS_PER_LANGUAGE``, ``ROWS_IN_ALL``). It runs
in one task; the driver receives the fitted model only.
*Calibration*: one temperature, fitted by smoothed log loss on a fifth of the sample that
training does not see. The smoothing (``SMOOTHING``) gives the loss a minimum even where
all rows of the fold are right, so that texts unlike any language keep low scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
MAX_N = 3
#: Bounds of the training sample; the rows are the first by a hash, per label.
ROWS_PER_LANGUAGE = 1000
ROWS_IN_ALL = 20_000
UNDETERMINED = "und"
#: Labels that a language column may have; more is an error, as a model of them would not fit.
MOST_LANGUAGES = 512
#: Share of the truth that the calibrating loss spreads over all languages.
SMOOTHING = 0.02
#: What the pipeline's stage asks of the calibrated score to keep a document: the greatest tenth
#: at which the held-out fold loses at most 0.1 % (0.05 % at sf0.1; 0.5 would lose 0.16 %).
KEEP_SCORE = 0.4

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashed n-gram columns of a text and how often each occurs; empty without letters."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return none
    points = np.where(letter, points, np.uint32(32))
    points = points[np.append(True, letter[1:] | letter[:-1])]
    points = np.concatenate([np.array([32], np.uint32), points, np.array([32], np.uint32)])
    grams = []
    code = points * _MULTIPLIERS[0]
    for n in range(1, MAX_N + 1):
        if n > 1:
            if len(points) < n:
                break
            code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * _MULTIPLIERS[n - 1] + points[n - 1 :] * np.uint32(0x27D4EB2F)
        spread = (code ^ (code >> np.uint32(16))) * np.uint32(0x7FEB352D)
        grams.append((spread ^ (spread >> np.uint32(13))) >> np.uint32(32 - BITS))
    tally = np.bincount(np.concatenate(grams), minlength=1 << BITS)
    columns = np.flatnonzero(tally)
    return columns, tally[columns]


@dataclass
class Model:
    """``languages`` in order, weights (languages x columns + bias), inverse document frequencies, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vector(self, columns: np.ndarray, tally: np.ndarray) -> np.ndarray:
        values = (1 + np.log(tally)) * self.idf[columns]
        return (values / max(float(np.sqrt(values @ values)), 1e-12)).astype(np.float32)

    def logits(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.weights[:, columns] @ values + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        columns, tally = counts(text)
        if not len(columns) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(columns, self.vector(columns, tally)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(languages: list[str], idf: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> Model:
    """``rows``: (language's place, columns, tally). Every fifth row calibrates, the others train."""
    k, width = len(languages), len(idf)
    model = Model(languages, idf, np.zeros((k, width)), 1.0, np.zeros(k))
    data = [(y, c, model.vector(c, t)) for y, c, t in rows if len(c)]
    fit, held = [r for i, r in enumerate(data) if i % 5], [r for i, r in enumerate(data) if not i % 5]
    z, n = np.zeros((k, width + 1)), np.zeros((k, width + 1))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, c, v = fit[i]
            at, x = np.append(c, width), np.append(v, 1.0)
            zc, nc = z[:, at], n[:, at]
            w = np.where(np.abs(zc) > l1, -(zc - np.sign(zc) * l1) / ((beta + np.sqrt(nc)) / alpha + l2), 0.0)
            error = softmax(w @ x)
            error[y] -= 1
            g = error[:, None] * x[None, :]
            rate = (np.sqrt(nc + g * g) - np.sqrt(nc)) / alpha
            z[:, at] = zc + g - rate * w
            n[:, at] = nc + g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    model.weights, model.bias = w[:, :width].astype(np.float32), w[:, width]
    model.temperature = _temperature(np.array([model.logits(c, v) for _, c, v in held]), np.array([y for y, _, _ in held], int))
    return model


def calibration_loss(logits: np.ndarray, truth: np.ndarray, temperature: float, smoothing: float = SMOOTHING) -> float:
    """Mean log loss at a temperature; ``smoothing`` of the truth is spread evenly."""
    log_p = np.log(np.maximum(softmax(logits / temperature), 1e-300))
    own = log_p[np.arange(len(truth)), truth]
    return float(-((1 - smoothing) * own + smoothing * log_p.mean(1)).mean())


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Least smoothed log loss over temperatures 0.001 to 1000, by golden section on the logarithm."""
    if not len(truth):
        return 1.0
    low, high, ratio = np.log(1e-3), np.log(1e3), (np.sqrt(5) - 1) / 2
    for _ in range(48):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if calibration_loss(logits, truth, np.exp(a)) <= calibration_loss(logits, truth, np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            columns, _ = counts(text.as_py())
            total[columns] += 1
            rows += bool(len(columns))
    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["rows", "df"])


def _add_frequencies(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        rows += sum(batch.column("rows").to_pylist())
        for part in batch.column("df"):
            total += np.frombuffer(part.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["rows", "df"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())), pa.array([t.astype(np.int32) for _, t in found], pa.list_(pa.int32()))], ["lang", "u", "columns", "tally"]
        )


def _trainer(languages: list[str], cap: int):
    """(sample rows, document frequencies) -> the fitted model as one row."""

    def run(sample: pa.Table, sums: pa.Table) -> pa.Table:
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for n, part in zip(sums["rows"].to_pylist(), sums["df"], strict=True):
            total, rows = total + np.frombuffer(part.as_buffer(), np.int64), rows + n
        idf = np.log((1 + rows) / (1 + total)) + 1
        label, u = np.array(sample["lang"].to_pylist(), object), sample["u"].to_numpy()
        picked = sorted((int(u[i]), y, int(i)) for y, lang in enumerate(languages) for i in sorted(np.flatnonzero(label == lang), key=lambda i: (u[i], i))[:cap])
        lists = [sample[name].combine_chunks() for name in ("columns", "tally")]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        offsets = [x.offsets.to_numpy() for x in lists]
        values = [x.values.to_numpy(zero_copy_only=False) for x in lists]
        cut = lambda k, i: values[k][offsets[k][i] : offsets[k][i + 1]]
        model = train(languages, idf, [(y, cut(0, i), cut(1, i)) for _, y, i in picked])
        parts = [model.idf.astype(np.float64), model.weights.astype(np.float32), model.bias.astype(np.float64)]
        return pa.table([pa.array([p.tobytes()], pa.binary()) for p in parts] + [pa.array([model.temperature])], ["idf", "weights", "bias", "temperature"])

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Learn from ``labelled``. ``key_col`` only orders the rows of the bounded sample.

    Rows with a null label or text, or without letters, teach nothing. With no row left
    the model has no language and predicts ``und``. The sample takes the first
    ``min(ROWS_PER_LANGUAGE, ROWS_IN_ALL / languages)`` rows of each label by a hash; of
    equal hashes (a repeated id), the first in the task's order. More than
    ``MOST_LANGUAGES`` labels are an error. Two jobs run here, when the query is built.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(key_col), F.lit(17)).alias("u"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return Model([], np.zeros(1 << BITS), np.zeros((0, 1 << BITS)))
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} labels")
    languages = sorted(sizes)
    cap = min(ROWS_PER_LANGUAGE, ROWS_IN_ALL // len(sizes))
    # a share of the hash range that holds the cap with room to spare, then the exact first rows
    share = F.create_map(*(x for lang, size in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 1.3 * (cap + 20) / size)))))
    near = rows.where((F.col("u") / F.lit(float(1 << 63)) + 1) / 2 <= F.element_at(share, F.col("lang")))
    sample = near.select("lang", "text", "u").mapInArrow(_featurise, "lang string, u long, columns array<int>, tally array<int>")
    # sums of one array per task, first within groups of tasks, then of their sums
    parts = rows.select("text").mapInArrow(_document_frequencies, "rows long, df binary")
    sums = parts.groupBy((F.spark_partition_id() % 64).alias("part")).applyInArrow(_add_frequencies, "rows long, df binary")
    one = F.lit(0).alias("one")
    trained = sample.groupBy(one).cogroup(sums.groupBy(one)).applyInArrow(_trainer(languages, cap), "idf binary, weights binary, bias binary, temperature double")
    idf, weights, bias, temperature = trained.first()
    return Model(languages, np.frombuffer(idf), np.frombuffer(weights, np.float32).reshape(len(languages), -1), temperature, np.frombuffer(bias))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is an input.

    A text that is null or has no letters gets ``und`` and score 0. Columns of these
    names in ``docs`` are replaced. Empty tables, repeated rows and any length are fine.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
