"""What is there already, by name or by part of a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_existing(df: DataFrame, name: str, existing: DataFrame, existing_name: str) -> DataFrame:
    """Rows whose name is not among the existing ones; null names are new."""
    return df.join(existing.select(F.col(existing_name).alias(name)).distinct(), name, "left_anti")


def not_contained(df: DataFrame, part: str, existing: DataFrame, existing_name: str, longest: int = 64) -> DataFrame:
    """Rows whose ``part`` no existing name contains; an id that is only part of another one is found too. Null parts are new.

    Parts of at most ``longest`` characters meet the pieces of that length of the names in an equi-join; only lengths
    that occur are cut out, so a name gives a row for each length and place. Longer parts meet the names that hold their
    first ``longest`` characters in such a join, and those names are looked through.
    """
    parts = df.where(F.col(part).isNotNull()).select(F.col(part).alias("part__")).distinct()
    cut_to = F.least(F.length("part__"), F.lit(longest))
    lengths = [r[0] for r in parts.select(cut_to.alias("n")).distinct().collect()]  # at most ``longest`` + 1
    names = existing.where(F.col(existing_name).isNotNull()).select(F.col(existing_name).alias("name__")).distinct()
    n = F.col("n__")

    def pieces(wanted: list[int]) -> DataFrame:
        cut_out = names.withColumn("n__", F.explode(F.array(*map(F.lit, sorted(wanted or [0]))).cast("array<int>"))).where(F.length("name__") >= n)
        return cut_out.select("name__", F.explode(F.transform(F.sequence(F.lit(1), F.length("name__") - n + 1), lambda i: F.substring("name__", i, n))).alias("piece__"))

    short = parts.where(F.length("part__") <= longest).join(pieces(lengths).select(F.col("piece__").alias("part__")).distinct(), "part__", "left_semi")
    long = parts.where(F.length("part__") > longest).withColumn("piece__", F.substring("part__", 1, longest))
    held = pieces([longest]).where(F.length("name__") > longest)
    long = long.join(held, (long.piece__ == held.piece__) & F.contains(F.col("name__"), F.col("part__")), "left_semi").select("part__")
    return df.join(short.unionByName(long).withColumnRenamed("part__", part), part, "left_anti")


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, *order)]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return df.groupBy(key).agg(first).select(key, *(F.col("first")[c].alias(c) for c in (*order, *rest)))
