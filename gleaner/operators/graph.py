"""Connected components of an edge table, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task may link, some 230 MB of Python objects; more are contracted by rounds of joins until so few are left,
#: with the same result.
FEW_EDGES = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    _ready(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of our own below the shared checkpoint folder."""
    return f"{_ready(spark)}/gleaner-{name}-{uuid.uuid4().hex}"


def _ready(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the cluster names in ``spark.checkpoint.dir``, else the session's.

    A folder of our own is made only on a local master. Elsewhere executors would write to disks that others cannot read.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Like ``cut``, but as a Parquet table: columns are read one by one, and the planner knows its size."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_written(df: DataFrame) -> None:
    """Remove the folder of a ``written`` table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("gleaner-"):
            path.getFileSystem(conf).delete(path, True)


def tops(pairs: list[tuple]) -> dict:
    """Each item of ``pairs`` with the smallest one that it is linked with."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(up.setdefault(a, a)), find(up.setdefault(b, b))
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """``(node, component)`` for each node of an undirected edge table; a component is named by its smallest node.

    Nodes are put in the order of their hashes. Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks one step further, and
    contracts the graph: edges are renamed to what their ends hang on, and those within a node go. A node that hooks
    vanishes from the next round, so in this random order even long chains shrink by a constant factor each time. Once at
    most ``few`` edges are left, one task links them. Null ends and self loops link nothing.

    Nothing but the number of edges left comes to the driver. Renaming joins tables that have an exchange on either side,
    which lets the adaptive planner split a hub's edges. The tables of a round are removed after the next one.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    one = one.select(*(F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n")).alias(c) for c in ("a", "b")))
    left = written(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "round")
    n_left = left.count()
    if n_left <= few:
        return _lowest(_linked(left))
    found = written(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node")), "round")
    for _ in range(max_rounds):
        if n_left <= few:
            last = _linked(left).withColumnRenamed("node", "component")
            whole = written(found.join(last, "component", "left").select("node", F.coalesce("top", "component").alias("top")), "round")
            drop_written(found)
            return _lowest(whole)
        sides = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(sides.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up")), "round")
        further = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hung = written(hooks.join(further, "up").select("node", "top"), "round")
        a, b = hung.select(F.col("node").alias("a"), F.col("top").alias("x")), hung.select(F.col("node").alias("b"), F.col("top").alias("y"))
        renamed = left.join(a, "a").join(b, "b").where("x <> y")
        old = [left, found, hooks, hung]
        found = written(found.join(hung.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component")), "round")
        left = written(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "round")
        n_left = left.count()
        for table in old:
            drop_written(table)
    raise RuntimeError(f"edges are left after {max_rounds} rounds")


def _linked(few: DataFrame) -> DataFrame:
    """``node, top`` of a table of few edges, by one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda x: (x["h"], _sortable(x["n"]))
        whole: dict[tuple, dict] = {}
        pairs = []
        for batch in batches:
            for row in batch.to_pylist():
                a, b = name(row["a"]), name(row["b"])
                whole[a], whole[b] = row["a"], row["b"]
                pairs.append((a, b))
        for linked in [tops(pairs)] if pairs else []:
            kind = batch.schema.field("a").type
            yield pa.RecordBatch.from_arrays([pa.array([whole[x] for x in side], kind) for side in (linked.keys(), linked.values())], names=["node", "top"])

    kind = few.schema["a"].dataType.simpleString()
    return few.coalesce(1).mapInArrow(task, f"node {kind}, top {kind}")


def _sortable(x):
    return tuple(_sortable(v) for v in x.values()) if isinstance(x, dict) else (x is not None, x)


def _lowest(linked: DataFrame) -> DataFrame:
    lowest = linked.groupBy("top").agg(F.min("node.n").alias("lowest"))
    return linked.join(lowest, "top").select(F.col("node.n").alias("node"), F.col("lowest").alias("component"))
