"""Nearest-centroid classification: training, prediction, evaluation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.vectors import dot, doubles, norm
from gleaner.operators.ranking import group_rank

TEMPERATURE = 20.0


def centroids(df: DataFrame, label: str | list[str], vector: str) -> DataFrame:
    """The normalised mean vector of each class; null vectors count in none.

    Sums are taken by (class, position), so they combine before the shuffle and no task holds a class.
    """
    by = [label] if isinstance(label, str) else label
    places = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(doubles(vector)).alias("i", "x"))
    means = places.groupBy(*by, "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(*by, F.transform("v", lambda s: s["x"]).alias("v"))
    sized = rows.withColumn("size", norm(F.col("v")))
    return sized.select(*by, F.when(F.col("size") > 0, F.transform("v", lambda x: x / F.col("size"))).otherwise(F.col("v")).alias("centroid"))


def predict(df: DataFrame, model: DataFrame, label: str, vector: str, positive, negative, on: list[str] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``df`` with both similarities, the label of the nearer centroid (ties: ``negative``) and its softmax confidence.

    ``model`` has one centroid for each of two classes (and each value of ``on``), so the join is small.
    """
    on = on or []
    c = model.where(F.col(label).isin(positive, negative))
    wide = c.groupBy(*on).agg(F.max(F.when(F.col(label) == positive, F.struct("centroid")))["centroid"].alias("c_pos"), F.max(F.when(F.col(label) == negative, F.struct("centroid")))["centroid"].alias("c_neg"))
    joined = df.join(F.broadcast(wide), on) if on else df.crossJoin(F.broadcast(wide))  # one row, or one for each fold
    v = doubles(vector)
    scored = joined.withColumns({"sim_positive": dot(v, F.col("c_pos")), "sim_negative": dot(v, F.col("c_neg"))}).drop("c_pos", "c_neg")
    gap = F.col("sim_positive") - F.col("sim_negative")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(gap * -temperature))
    nearer = gap > 0
    return scored.withColumn("predicted", F.when(nearer, F.lit(positive)).otherwise(F.lit(negative))).withColumn("confidence", F.when(nearer, p).otherwise(1 - p))


def save_model(model: DataFrame, folder: str) -> None:
    """Writes centroids, to be read by ``load_model``; an earlier model in the folder is replaced."""
    model.write.mode("overwrite").parquet(folder)


def load_model(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids that ``save_model`` wrote; FileNotFoundError if there are none."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        raise FileNotFoundError(f"no model in {folder}") from e


def binary_metrics(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp and accuracy, precision, recall, F1 (0 where a denominator is) by ``by``."""
    n = {"tn": ~truth & ~predicted, "fp": ~truth & predicted, "fn": truth & ~predicted, "tp": truth & predicted}
    out = df.groupBy(*(by or [])).agg(*(F.count_if(c).alias(k) for k, c in n.items()))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def with_fold(df: DataFrame, label: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """``fold`` in turn over the rows of each class in a seeded random order, so folds differ by at most one row of a class.

    The order is that of a hash of seed and key, so it is the same on every run; keys should be unique.
    """
    shuffled = [F.asc(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))), F.asc(key)]
    ranked = group_rank(df, [label], shuffled, "fold")
    return ranked.withColumn("fold", ((F.col("fold") - 1) % folds).cast("int"))


def hashed_fold(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """``fold`` by a seeded hash of the key: even on the whole, and without a sort of a class."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int"))


def cross_validate(df: DataFrame, label: str, vector: str, positive, negative, folds: int) -> DataFrame:
    """Metrics of each fold, classified by the centroids of the other folds' rows. ``df`` has a column ``fold``.

    A row trains every fold but its own, so the centroids of all folds come from one pass of sums.
    """
    if folds < 2:
        return df.sparkSession.createDataFrame([], "fold int, tn long, fp long, fn long, tp long, accuracy double, precision double, recall double, f1 double")
    own = df.where(F.col(label).isin(positive, negative)).select("fold", label, vector)
    train = own.withColumn("test_fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))))
    model = centroids(train.select(F.col("test_fold").alias("fold"), label, vector), ["fold", label], vector)
    scored = predict(own, model, label, vector, positive, negative, on=["fold"])
    return binary_metrics(scored, F.col(label) == positive, F.col("predicted") == positive, ["fold"])


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean ratios and total counts over folds."""
    return metrics.agg(*(F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")), *(F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")))
