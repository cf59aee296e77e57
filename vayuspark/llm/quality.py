"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics are counts over the whole text, made comparable by roots. Random Fourier features approximate a Gaussian
kernel over the standardised statistics. Each task sums up its part of the normal equations, of a size set by the number
of features alone; the sums of `FOLDS` folds are added on the driver (`FOLDS` x FEATURES^2 numbers). The calibration uses
scores of rows by weights that were fitted without their fold.

The fit reads all labelled rows, or a random share of them of about `FIT_ROWS` if there are more.

Defined results: a null or empty text has statistics of zero and a score like any other; without any usable label the
score is 0.5; labels that are neither 0 nor 1 are not used; a doc_id with several labels counts with each; repeated rows
are scored each for itself; further columns stay (the operator's own columns replace columns of the same name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.calibrate import isotonic, remainder
from vayuspark.llm.tables import table, written

FEATURES = 192
FOLDS = 2
RIDGE = 1e-3
FIT_ROWS = 1_000_000
PARTS = 16

#: Kinds of bytes that are counted: A-Z, a-z, 0-9, beyond ASCII, and some marks each or together.
_KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "|", "#$%&*@^~+=<>\\", ".", ",;:?", "'\"()[]{}-_/`", "\n"]
_KIND = np.full(256, len(_KINDS) + 1, np.int64)
_KIND[128:] = len(_KINDS)
for _k, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] = _k
KINDS = len(_KINDS) + 2
STATISTICS = KINDS + 9


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    raw, at = words_.buffer_of(column)
    n = len(column)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * KINDS + _KIND[raw], minlength=n * KINDS).reshape(n, KINDS)
    found = words_.words_of(column)
    words = np.diff(found.first)
    safe = np.maximum(words, 1)
    same = lambda gap: np.bincount(found.row[gap:][(found.hash[gap:] == found.hash[:-gap]) & (found.row[gap:] == found.row[:-gap])], minlength=n) / safe
    salt = words_.mix(np.arange(1, n + 1, dtype=np.uint64))
    distinct = np.bincount(found.row[np.unique(found.hash ^ salt[found.row], return_index=True)[1]], minlength=n)
    length = found.end - found.start
    last = raw[found.end - 1] if len(found.end) else np.zeros(0, np.uint8)
    marked = np.isin(last, np.frombuffer(b"!#$%&*|~^@", np.uint8))
    lines = words_.words_of(column, b"\n")
    n_lines = np.maximum(np.diff(lines.first), 1)
    own_lines = np.bincount(lines.row[np.unique(lines.hash ^ salt[lines.row], return_index=True)[1]], minlength=n)
    by_word = lambda x: np.bincount(found.row, weights=x, minlength=n) / safe
    rest = [np.log1p(size) / 4, np.log1p(words) / 4, by_word(length) / 4, np.sqrt(by_word(length.astype(float) ** 2)) / 4, distinct / safe / np.sqrt(np.log1p(safe)), same(1) if len(found.hash) > 1 else np.zeros(n), same(2) if len(found.hash) > 2 else np.zeros(n), by_word(marked), own_lines / n_lines]
    return np.column_stack([np.sqrt(counts / np.maximum(size, 1)[:, None]), *rest])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in words_.pieces(batches, "text"):
        values = statistics(piece.column("text"))
        rest = piece.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, words_.lists(values.ravel(), np.full(len(values), STATISTICS), pa.float64())], names=[*rest.schema.names, "statistics"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """The columns of docs but `text`, with `statistics`."""
    docs = docs.drop("statistics").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_statistics, St.StructType([*(f for f in docs.schema.fields if f.name != "text"), St.StructField("statistics", St.ArrayType(St.DoubleType()))]))


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    #: Weights of each fold from the other folds, for rows that were fitted on.
    apart: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), z / np.sqrt(z.shape[1]), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, *self.knots)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def fit(labelled: DataFrame, seed: int = 7) -> Model:
    """A model from rows (statistics, y, fold)."""
    spark = labelled.sparkSession
    draw = np.random.default_rng(seed)
    n = labelled.count()
    if n > FIT_ROWS:
        labelled = written(labelled.where(F.rand(seed) < FIT_ROWS / n), "labelled")
    labelled = labelled.coalesce(PARTS)
    moments = labelled.agg(*(f(F.col("statistics")[k]) for f in (F.avg, F.stddev_pop) for k in range(STATISTICS))).first()
    mean, deviation = (np.array([v or 0.0 for v in moments[k * STATISTICS : (k + 1) * STATISTICS]]) for k in range(2))
    width = FEATURES + STATISTICS + 1
    # Frequencies of a Gaussian kernel whose width is the root of the number of statistics.
    model = Model(mean, np.where(deviation > 1e-9, deviation, 1.0), draw.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS), draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(width), np.zeros((FOLDS, width)))
    if not n:
        return model
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            x, y = shared.value.features(_matrix(batch.column("statistics"))), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                own = x[fold == k]
                total[k, :, :width] += own.T @ own
                total[k, :, width] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = labelled.select("statistics", "y", "fold").mapInArrow(sums, "part binary").toLocalIterator()  # PARTS matrices at most, one at a time
    total = np.zeros((FOLDS, width, width + 1))
    for part in parts:
        total += np.frombuffer(part.part).reshape(total.shape)
    ridge = np.eye(width)
    ridge[-1, -1] = 1e-9
    solve = lambda m: np.linalg.solve(m[:, :width] + RIDGE * max(n, 1000) / FOLDS * ridge, m[:, width])
    model.weights = solve(total.sum(axis=0))
    model.apart = np.array([solve(total.sum(axis=0) - total[k]) for k in range(FOLDS)])
    shared = spark.sparkContext.broadcast(model)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(_matrix(batch.column("statistics")))
            fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array((x * shared.value.apart[fold]).sum(axis=1)), batch.column("y")], names=["raw", "y"])

    model.knots = isotonic(labelled.select("statistics", "y", F.col("fold").cast("int").alias("fold")).mapInArrow(apart, "raw double, y int"), -1.0, 2.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows with statistics get a score from 0 to 1: the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.clip(shared.value.score(_matrix(batch.column("statistics"))), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, St.StructType([*docs.schema.fields, St.StructField("score", St.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int | None = 0) -> DataFrame:
    """(doc_id, held_out, score) for each row; learnt from labels of rows whose remainder by 5 is not `held_out` (None: from all)."""
    measured = written(with_statistics(docs.select("doc_id", "text")), "statistics")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("own"), F.col("quality").cast("int").alias("y"))
    rows = measured.join(known, F.col("doc_id") == F.col("own"))
    if held_out is not None:
        rows = rows.where(remainder("doc_id", 5) != held_out)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    model = fit(written(rows.select("statistics", "y", fold.alias("fold")), "labelled"))
    return score(measured, model).select("doc_id", (remainder("doc_id", 5) == (held_out or 0)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is at least the threshold, scored in place: no text is shuffled."""
    measured = written(with_statistics(docs.select("doc_id", "text")), "statistics")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("own"), F.col("quality").cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    model = fit(written(measured.join(known, F.col("doc_id") == F.col("own")).select("statistics", "y", fold.alias("fold")), "labelled"))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            values = shared.value.score(statistics(piece.column("text")))
            yield piece.filter(pa.array(values >= threshold))

    return docs.select(*names).withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
