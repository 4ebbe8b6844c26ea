"""Complete-linkage clustering under a distance threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import norm
from gleaner.operators.graph import connected_components, cut, drop_written, written
from gleaner.operators.similarity import cosine_pairs


def complete_merges(pairs: DataFrame) -> DataFrame:
    """``a, b`` for each merge of complete linkage over ``pairs`` (``a < b``, ``distance``), in which pairs that are missing are too far
    apart to be in one cluster; clusters stand under their smallest member.

    In each round all clusters that are each other's nearest merge at once. Complete linkage allows that: no merge
    brings a third cluster nearer, so what is mutually nearest stays so whatever merges elsewhere. Of equal distances the pair of
    the smallest members counts as nearer. Then the table of distances is contracted: between two clusters it has the largest, and
    only if all distances between their parts were there. The nearest of all pairs always merges, so rounds end when
    no distance is left. A round is two groupings and joins over the sparse table; nothing but whether merges are left
    comes to the driver.
    """
    far = written(pairs.select("a", "b", "distance"), "far")
    found = None
    while not far.isEmpty():
        ends = far.select("a", "b", "distance", F.explode(F.array("a", "b")).alias("x"))
        nearest = ends.groupBy("x").agg(F.min(F.struct("distance", "a", "b")).alias("pair"))
        merges = written(nearest.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair.a", "pair.b"), "merges")
        found = merges if found is None else found.unionByName(merges)
        into = merges.select(F.col("b").alias("x"), F.col("a").alias("top")).unionByName(merges.select(F.col("a").alias("x"), F.col("a").alias("top")))
        left, right = into.select(F.col("x").alias("a"), F.col("top").alias("p")), into.select(F.col("x").alias("b"), F.col("top").alias("q"))
        named = far.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("p", "a").alias("x"), F.coalesce("q", "b").alias("y"), "distance", (F.when(F.col("p").isNull(), 1).otherwise(2) * F.when(F.col("q").isNull(), 1).otherwise(2)).alias("parts"))
        between = named.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("distance").alias("distance"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
        old, far = far, written(between.where("n = parts").select("a", "b", "distance"), "far")
        drop_written(old)
    drop_written(far)
    return pairs.select("a", "b").limit(0) if found is None else found


def first_of_equal(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The smallest key of each distinct vector, with the vector; null, zero and infinite ones, which are in no pair, go."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull() & (norm(v) > 0) & (norm(v) < float("inf")))
    return rows.groupBy(v.alias(vector)).agg(F.min(key).alias(key)).select(key, vector)


def equal_links(df: DataFrame, firsts: DataFrame, key: str, vector: str) -> DataFrame:
    """``a, b`` for each row but the first of its vector: the first one's key and its own."""
    rows = df.select(F.col(key).alias("b"), F.col(vector).cast("array<double>").alias("v"))
    return rows.join(firsts.select(F.col(key).alias("a"), F.col(vector).alias("v")), "v").where("a < b").select("a", "b")


def cosine_components(df: DataFrame, key: str, vector: str, above: float) -> DataFrame:
    """``node, component`` of the graph of ``cosine_pairs`` with ``above`` below 1; equal vectors hang on the first of them
    by key, so copies cost a link each and not a pair with each other."""
    firsts = cut(first_of_equal(df, key, vector))
    links = cosine_pairs(firsts, key, vector, above).select("a", "b").unionByName(equal_links(df, firsts, key, vector))
    return connected_components(links, "a", "b")


def cluster_complete_linkage(df: DataFrame, key: str, vector: str, threshold: float = 0.60) -> DataFrame:
    """``key, cluster`` where a cluster is named by its smallest key; null and zero vectors are clusters of their own.

    Equal vectors are one cluster at any threshold above 0, so only the first of them by key is clustered and the rest take
    its cluster. Members of a cluster are all within the threshold of each other, so the pairs below it are all that is
    needed; they are merged in rounds over the whole table (see ``complete_merges``), and no task gets a whole component.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    if threshold <= 0:
        return rows.select(F.col("key").alias(key), F.col("key").alias("cluster"))
    firsts = cut(first_of_equal(rows, "key", "v"))
    pairs = cosine_pairs(firsts, "key", "v", 1 - threshold).select("a", "b", (1 - F.col("similarity")).alias("distance"))
    tops = connected_components(complete_merges(pairs), "a", "b")
    found = firsts.join(tops.withColumnRenamed("node", "key"), "key", "left").select("v", F.coalesce("component", "key").alias("cluster"))
    return rows.join(found, "v", "left").select(F.col("key").alias(key), F.coalesce("cluster", "key").alias("cluster"))
