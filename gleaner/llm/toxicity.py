"""Toxicity as ordered grades: cumulative-link regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_sample, cut, numbered_columns
from gleaner.llm.words import MARKS, Lookup, hash_texts

#: Words are runs of letters and digits; their first bytes count as well, so that inflected insults share a feature.
PREFIXES = (4, 5, 6, 7)
#: A feature counts as present, at least twice, at least three times, and by its share of the words if at least twice.
TIMES, SHARES = (1, 2, 3), (0.004, 0.008, 0.016, 0.03)
LEVELS = len(TIMES) + len(SHARES)
#: Labelled documents that the model is fitted on, the first by a hash.
FIT_ROWS = 8_000
#: Features enter that LEAST toxic documents have, or a tenth of them where they are few but two at least, and whose z-score against the others is SCREEN or more; the FEATURES
#: highest at most.
LEAST, SCREEN, FEATURES = 8, 6.0, 4096
RIDGE, STEPS = 1e-5, 400
#: A text is toxic from this expected severity on.
TOXIC_AT = 0.5

@dataclass
class Model:
    """P(grade > k) = sigmoid(score - threshold k), with one weight for each feature and level at all thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.places = Lookup(self.features)

    def score(self, hashes: np.ndarray) -> float:
        at, level = self.levels(hashes)
        return float(self.weights[at * LEVELS + level].sum())

    def levels(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of a text, with each level that they reach."""
        at, n = np.unique(self.places.find(hashes)[1], return_counts=True)
        share = n / max(1, len(hashes))
        reach = np.column_stack([n >= t for t in TIMES] + [(n >= 2) & (share >= s) for s in SHARES])
        row, level = np.nonzero(reach)
        return at[row], level

    def severity(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the most probable one (the lowest of ties)."""
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))
        edges = np.concatenate((np.ones((len(score), 1)), above, np.zeros((len(score), 1))), 1)
        return above.sum(1), (edges[:, :-1] - edges[:, 1:]).argmax(1)


def hashed(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    return hash_texts(texts, MARKS, PREFIXES)


def _screened(sample: DataFrame) -> np.ndarray:
    """Hashes of the features that enter: documents are counted within tasks, summed and ranked by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = np.array(batch.column(1)) > 0
            distinct = [np.unique(h) for _, h in hashed(batch.column(0).to_pylist())]
            keys, at = np.unique(np.concatenate([*distinct, np.zeros(0, np.uint64)]), return_inverse=True)
            toxic = np.repeat(grade, [len(d) for d in distinct])
            n = np.bincount(at, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, weights=toxic, minlength=len(keys)).astype(np.int64)), pa.array(n)], names=["h", "toxic", "n"])

    total = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") > 0).alias("t")).first()
    n, t = total["n"], total["t"]
    if not t or t == n:
        return np.zeros(0, np.uint64)
    counted = sample.mapInArrow(task, "h long, toxic long, n long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(F.col("toxic") >= max(2, min(LEAST, t // 10)))
    p = F.col("n") / n
    z = (F.col("toxic") / t - (F.col("n") - F.col("toxic")) / (n - t)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / t + 1 / (n - t)))
    top = counted.withColumn("z", z).where(F.col("z") >= SCREEN).orderBy(F.desc("z"), "h").limit(FEATURES).toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def fit(labelled: DataFrame, n_grades: int, rows: int = FIT_ROWS) -> Model:
    """A model of at most ``rows`` rows (text, grade), by Adam on the ridge-penalised likelihood.

    Texts stay with the tasks; the driver gets the screened features of the bounded sample. Thresholds stay in order, as
    they are a first one plus positive steps. Without rows of two grades, every text has the grade of the rows, or 0.
    """
    sample = cut(bounded_sample(labelled.select("text", F.col("grade").cast("long").alias("grade")).where("grade is not null"), rows).repartition(8))
    blank = Model(_screened(sample), np.zeros(0), np.zeros(0))
    shared = sample.sparkSession.sparkContext.broadcast(blank)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, h in hashed(batch.column(0).to_pylist()):
                at, level = shared.value.levels(h)
                found.append(at * LEVELS + level)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], names=["at", "grade"])

    got = sample.mapInArrow(task, "at array<long>, grade long").toPandas()
    grade = np.clip(got["grade"].to_numpy(np.int64), 0, n_grades - 1)
    size = len(blank.features) * LEVELS
    if len(set(grade.tolist())) < 2:
        only = int(grade[0]) if len(grade) else 0
        return Model(blank.features, np.zeros(size), np.where(np.arange(n_grades - 1) < only, -20.0, 20.0))
    at = np.concatenate([np.asarray(x, np.int64) for x in got["at"]])
    row = np.repeat(np.arange(len(got)), [len(x) for x in got["at"]])
    return Model(blank.features, *_ascend(at, row, grade, size, n_grades))


def _thresholds(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x[:1], x[0] + np.cumsum(np.exp(x[1:]))))


def _ascend(at: np.ndarray, row: np.ndarray, grade: np.ndarray, size: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(grade)
    above = np.array([(grade > k).mean() for k in range(n_grades - 1)])
    first = np.log((1 - above + 1e-3) / (above + 1e-3))
    x = np.concatenate((np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    every = np.arange(n)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))
    for step in range(1, STEPS + 1):
        w, cuts = x[:size], _thresholds(x[size:])
        score = np.bincount(row, w[at], n) if len(at) else np.zeros(n)
        s = sigmoid(score[:, None] - cuts[None, :])
        edges = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), 1)
        p = np.maximum(edges[every, grade] - edges[every, grade + 1], 1e-9)
        slope = np.zeros((n, n_grades + 1))
        slope[:, 1:-1] = s * (1 - s)
        to_score = (slope[every, grade] - slope[every, grade + 1]) / p
        to_cut = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            to_cut[k] = (slope[grade == k, k + 1] / p[grade == k]).sum() - (slope[grade == k + 1, k + 1] / p[grade == k + 1]).sum()
        tail = np.cumsum(to_cut[::-1])[::-1]
        gradient = np.concatenate((np.bincount(at, to_score[row], size) / n - RIDGE * w, tail[:1] / n, tail[1:] * np.exp(x[size + 1 :]) / n))
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        x = x + 0.2 * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return x[:size], _thresholds(x[size:])


def grade_texts(docs: DataFrame, model: Model, text_col: str = "text", toxic_at: float = TOXIC_AT) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (most probable) and ``toxic``; columns of these names are replaced.

    The whole text counts, however long. Null and empty texts have no feature, hence the severity that the thresholds give to
    score 0. Of equally probable grades the lowest counts; repeated rows get equal grades; an empty table gives an empty one.
    """
    fresh = ["severity", "grade", "toxic"]
    keep = [c for c in docs.columns if c.lower() not in fresh]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, at = numbered_columns(docs, keep, text_col)
    kinds = [f.dataType.simpleString() for f in plain.schema.fields[: len(keep)]] + ["double", "long", "boolean"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, h in hashed(batch.column(at).to_pylist()):
                score[i] = shared.value.score(h)
            severity, grade = shared.value.severity(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(severity), pa.array(grade.astype(np.int64)), pa.array(severity >= toxic_at)], names=[f"c{i}" for i in range(len(keep) + 3)])

    out = plain.mapInArrow(task, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*keep, *fresh)


def graded_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``text, grade`` of at most ``rows`` labelled documents, those of the lowest hashes of the id; of repeated labels, the
    highest grade counts. The ids are picked first and shared with all tasks, so no text is shuffled."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("grade"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "grade")


#: Grades of the table ``labels``, whose ``toxic`` is 0 or 1.
GRADES = 2


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of ``docs`` by a model of its labelled rows. Nulls, empty and very long texts and
    extra columns are as in ``grade_texts``; without labels every text has grade 0."""
    model = fit(graded_labels(docs, labels), GRADES)
    return grade_texts(docs.select("doc_id", "text"), model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic")
