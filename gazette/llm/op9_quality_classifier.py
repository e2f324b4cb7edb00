"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal. A score is the logistic of the difference
of the two Mahalanobis log densities plus the log odds of the classes; each class keeps the Cholesky factor of its covariance, so that a
distance is one triangular product. Class moments are Spark aggregates over all labelled rows of the training folds (two rows reach the
driver); statistics and scores are computed in the tasks, on whole texts.

Inputs of a score are statistics of the text alone. Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2.

Cases: null and empty texts have all statistics of an empty text and get its score; labels that are null, or whose id is null or not
in the documents, teach nothing; repeated rows are scored alike, and repeated labels count as often as they come; without two labelled
rows of either class nothing is known, and every score is the share of label 1 (1.0 without labels); a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import rows_where, stored, table
from gazette.llm.kernels import chunks, string_buffers, word_bounds, word_hashes

SHRINK = 0.1
RIDGE = 0.05
THRESHOLD = 0.7
STATISTICS = ("words", "symbols", "pipes", "shouts", "capitals", "variety", "echoes", "stops", "length", "digits")


def _class_of(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_SYMBOL, _PIPE, _SHOUT, _STOP = _class_of(b"#*$%&<>=@^~\\"), _class_of(b"|"), _class_of(b"!?"), _class_of(b".,;:")
_UPPER, _LETTER, _DIGIT = _class_of(bytes(range(65, 91))), _class_of(bytes([*range(65, 91), *range(97, 123)])), _class_of(b"0123456789")


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a chunk: logarithms of sizes, square roots of shares."""
    begin, end, starts = word_bounds(data, offsets)
    n = np.diff(starts).astype(float)
    some = np.maximum(n, 1)

    def count(mark: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(mark[data], out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    hashes = word_hashes(data, begin, end)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=len(n)).astype(float)
    size = np.bincount(owner, weights=(end - begin), minlength=len(n))
    root = np.sqrt
    return np.column_stack(
        [
            np.log1p(n),
            root(count(_SYMBOL) / some),
            root(count(_PIPE) / some),
            root(count(_SHOUT) / some),
            root(count(_UPPER) / np.maximum(count(_LETTER), 1)),
            np.log1p(distinct) / np.log1p(some),
            root(np.bincount(owner, weights=echo, minlength=len(n)) / some),
            root(count(_STOP) / some),
            np.log1p(size / some),
            root(count(_DIGIT) / some),
        ]
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = string_buffers(batch.column("text"))
        for first, last in chunks(offsets):
            found = statistics_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            columns = {"doc_id": batch.column("doc_id").slice(first, last - first)}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(found[:, i]) for i, k in enumerate(STATISTICS)})


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double for each of ``STATISTICS``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


class Discriminant:
    """Means, Cholesky factors of inverse covariances and log determinants of the two classes."""

    def __init__(self, counts: list[int], means: list[np.ndarray], covariances: list[np.ndarray], shrink: float = SHRINK, ridge: float = RIDGE):
        total = sum(counts)
        pooled = sum(n * c for n, c in zip(counts, covariances)) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        self.prior = float(np.log(counts[1] / counts[0]))
        self.means, self.factors, self.logs = [], [], []
        target = (pooled / np.outer(self.scale, self.scale) + np.eye(len(pooled))) / 2
        for mean, covariance in zip(means, covariances):
            own = (1 - shrink) * covariance / np.outer(self.scale, self.scale) + shrink * target + ridge * np.eye(len(pooled))
            factor = np.linalg.cholesky(own)
            self.means.append(mean / self.scale)
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(2 * float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x / self.scale - self.means[k]) @ self.factors[k].T
        return -0.5 * ((z * z).sum(axis=1) + self.logs[k])

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = self.log_density(x, 1) - self.log_density(x, 0) + self.prior
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(found: DataFrame, labels: DataFrame, label_col: str = "quality", shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant | float:
    """Learns from all labelled rows outside the held-out fold; the share of label 1 where a class has fewer than two rows."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = taught.join(found, "doc_id")
    pairs = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
    moments = [F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m_{x}") for x in STATISTICS), *(F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c_{i}_{j}") for i, j in pairs)]
    by = {r["label"]: r for r in rows.groupBy("label").agg(*moments).collect()}
    sizes = [by[k]["n"] if k in by else 0 for k in (0, 1)]
    if min(sizes) < 2:
        return sizes[1] / sum(sizes) if sum(sizes) else 1.0
    means, covariances = [], []
    for k in (0, 1):
        means.append(np.array([by[k][f"m_{x}"] for x in STATISTICS]))
        c = np.zeros((len(STATISTICS), len(STATISTICS)))
        for i, j in pairs:
            c[i, j] = c[j, i] = by[k][f"c_{i}_{j}"]
        covariances.append(c)
    return Discriminant(sizes, means, covariances, shrink, ridge)


def _score(model: Discriminant | float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy() for k in STATISTICS]) if len(batch) else np.zeros((0, len(STATISTICS)))
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score)})

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score and predicted."""
    found = stored(statistics(docs, id_col, text_col), "statistics")
    scored = found.mapInArrow(_score(fit(found, labels)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    model = fit(stored(statistics(docs, id_col, text_col), "statistics"), labels)

    def marks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        offsets, data = string_buffers(column)
        for first, last in chunks(offsets):
            x = statistics_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            yield first, (np.full(len(x), model) if isinstance(model, float) else model.score(x)) >= threshold

    return rows_where(docs, text_col, marks)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
