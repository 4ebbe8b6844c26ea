"""Ranks over whole tables and within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import folded
from gleaner.operators.graph import cut, written

#: Rows of a group that a window ranks in one task; larger groups are ranked in ranges.
HOT = 1_000_000


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based rank in a total order.

    The rows are range partitioned and written once; each partition then counts its own rows and adds the sizes of those
    before it, so no task sees more than its range. ``order`` should end with a unique column.
    """
    ranged = df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id())
    sorted_ = cut(ranged)
    sizes = sorted_.groupBy("part__").agg(F.count(F.lit(1)).alias("size__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("part__", F.coalesce(F.sum("size__").over(before), F.lit(0)).alias("offset__"))
    inner = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    return sorted_.join(F.broadcast(offsets), "part__").withColumn(name, inner + F.col("offset__")).drop("part__", "offset__")


def group_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", hot: int = HOT) -> DataFrame:
    """``df`` with its 1-based rank within its group, which may be of any size. ``order`` should end with a unique column.

    Groups of up to ``hot`` rows are ranked by a window, which shuffles the rows once and writes nothing. Larger ones, found by a
    count of the group columns alone, are ranked in ranges, so that no task gets more than a range of them.
    """
    window = Window.partitionBy(*(F.col(f"`{g}`") for g in group)).orderBy(*order)
    names = [f"key{i}__" for i in range(len(group))]
    keys = [F.col(f"`{g}`").alias(k) for g, k in zip(group, names, strict=True)]
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__")).where(F.col("n__") > hot).select(*names)
    if large.isEmpty():
        return df.withColumn(name, F.row_number().over(window))
    large = written(large, "large")
    same = F.lit(True)
    for g, k in zip(group, names, strict=True):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(k))
    small = df.join(large, same, "left_anti").withColumn(name, F.row_number().over(window))
    return small.unionByName(_ranked_in_ranges(df.join(large, same, "left_semi"), group, order, name))


def _ranked_in_ranges(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows are range partitioned by group and order and written once. A partition ranks its own rows; only its first group can
    have begun in partitions before it, and how far comes in a table of at most a row for each partition."""
    ranged = written(df.repartitionByRange(*(F.col(f"`{g}`").asc() for g in group), *order).withColumn("part__", F.spark_partition_id()), "ranged")
    keys = [F.col(f"`{g}`").alias(f"key{i}__") for i, g in enumerate(group)]
    names = [f"key{i}__" for i in range(len(group))]
    sizes = ranged.groupBy(F.col("part__").alias("at__"), *keys).agg(F.count(F.lit(1)).alias("size__"))
    before = F.sum("size__").over(Window.partitionBy(*names).orderBy("at__").rowsBetween(Window.unboundedPreceding, -1))
    begun = sizes.withColumn("before__", before).where("before__ > 0").select("at__", *names, "before__")
    same = F.col("part__") == F.col("at__")
    for g, k in zip(group, names, strict=True):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(k))
    inner = F.row_number().over(Window.partitionBy("part__", *(F.col(f"`{g}`") for g in group)).orderBy(*order))
    ranked = ranged.withColumn("inner__", inner).join(F.broadcast(begun), same, "left")  # a row for each partition at most
    return ranked.withColumn(name, F.col("inner__") + F.coalesce("before__", F.lit(0))).drop("part__", "at__", "before__", "inner__", *names)


def best_of_group(df: DataFrame, group: str, width: str, height: str, size: str, name: str) -> DataFrame:
    """``df`` with ``rank`` and ``kept``: in each group the largest area, then the most bytes, then the first name stays."""
    order = [F.desc(F.col(width).cast("long") * F.col(height)), F.desc(size), F.asc(name)]
    return group_rank(df, [group], order).withColumn("kept", F.col("rank") == 1)


def redundancy_totals(ranked: DataFrame, group: str, size: str) -> DataFrame:
    """One row: groups of more than one member, redundant members, and their bytes."""
    per = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("kept"), F.col(size)).otherwise(0)).alias("bytes"))
    out = per.where("n > 1").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_redundant"), F.sum("bytes").alias("redundant_bytes"))
    return out.select("n_groups", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_redundant", "redundant_bytes")))


def mode_of_group(df: DataFrame, group: str, width: str, height: str, path: str) -> DataFrame:
    """The most frequent (width, height) of each group, of ties the larger area, width, height; with its first path."""
    known = df.where(F.col(width).isNotNull() & F.col(height).isNotNull())
    counts = known.groupBy(group, width, height).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(folded(F.col(path).cast("string")).alias("key"), F.col(path).alias("path"))).alias("first"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), F.desc(F.col(width).cast("long") * F.col(height)), F.desc(width), F.desc(height))
    return counts.withColumn("k", F.row_number().over(order)).where("k = 1").select(group, width, height, "n", F.col("first.path").alias("path"))


def top_fraction(df: DataFrame, order: list[Column], fraction: float) -> DataFrame:
    """The first ``ceil(fraction * rows)`` rows, with their rank."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    ranked = cut(global_rank(df, order))
    total = ranked.count()
    return ranked.where(F.col("rank") <= F.ceil(F.lit(fraction) * F.lit(total)))


def rank_in_cluster(df: DataFrame, cluster: str, vector: str, key: str) -> DataFrame:
    """Members by falling similarity to their cluster's normalised mean: ``similarity`` and ``rank``."""
    from gleaner.functions.vectors import dot, doubles
    from gleaner.operators.classify import centroids

    means = centroids(df, cluster, vector)
    scored = df.join(means, cluster).withColumn("similarity", dot(doubles(vector), F.col("centroid"))).drop("centroid")
    return group_rank(scored, [cluster], [F.desc(F.round("similarity", 9)), F.asc(key)])


def cluster_names(ranked: DataFrame, cluster: str, name: str, style: str) -> DataFrame:
    """File names by cluster and rank: ``prefix`` (number in front), ``number`` (number alone) or ``original``."""
    number, folder = F.format_string("%04d", F.col("rank").cast("int")), F.format_string("%02d", F.col(cluster).cast("int"))
    ext = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    names = {"prefix": F.concat(number, F.lit("_"), F.col(name)), "number": F.concat(number, ext), "original": F.col(name)}
    if style not in names:
        raise ValueError(f"style must be one of {sorted(names)}")
    return ranked.withColumn("folder", folder).withColumn("target", names[style])
