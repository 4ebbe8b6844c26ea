"""First-seen-wins over a stream of landed files."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gleaner.operators.membership import first_seen

#: Polls without anything new, and polls in all, after which a stream is stopped; seconds between polls.
EMPTY_POLLS, POLLS, WAIT = 6, 1000, 1.5
#: Runs of keys that are merged into one of the next level, and parts of a run by a hash of the key.
EVERY, BUCKETS = 16, 64


def landed(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files in ``folder``, oldest first."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def keep_first(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key that the stream brings; with several rows of a key in one batch, any of them.

    The state holds every key for good, as there is no expiry; ``start_first_seen`` has a defined winner and its state
    in a table instead.
    """
    return stream.dropDuplicates(keys)


def start_first_seen(stream: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str, trigger: dict | None = None, act: Callable[[DataFrame], DataFrame] | None = None, every: int = EVERY) -> StreamingQuery:
    """Appends to the parquet folder ``table`` the first row by ``order`` of each key that is not there yet.

    Each batch is reduced to its own first rows and joined against the keys of earlier batches. A batch writes a folder
    of its own number and replaces it if it is run again, so a restart neither loses nor repeats a row.

    Keys are kept in levels: ``every`` batches make a run of keys, ``every`` such runs one of the next level, and so on; what has
    been merged is removed. A key is thus written again once for each level, however many keys there are, which is
    a logarithm of the number of batches. Runs are bucketed by a hash of the key, and a batch reads the buckets
    that its own keys fall into. Only runs of batches before the current one are merged, so it can be run again.

    ``act`` does something with the new rows, such as fetching a file under a name that the key reserves, and returns those
    rows where it succeeded. Only they are recorded: a key whose action failed is free again, and its next row is tried.
    """

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, *order)]
        first = batch.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first")).select(*keys, *(F.col("first")[c].alias(c) for c in (*order, *rest)))
        spark = batch.sparkSession
        _merge_keys(spark, table, keys, number, every)
        first = first.withColumn("bucket__", _bucket(keys)).persist()
        try:
            touched = [r["bucket__"] for r in first.select("bucket__").distinct().collect()]  # BUCKETS at most
            known = _known_keys(spark, table, keys, number, touched)
            new = first.drop("bucket__")
            if known is not None:
                new = new.join(known, keys, "left_anti")
            (act(new) if act else new).write.mode("overwrite").parquet(f"{table}/batch={number}")
        finally:
            first.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _known_keys(spark: SparkSession, table: str, keys: list[str], number: int, buckets: list[int] | None = None) -> DataFrame | None:
    """The keys of all batches before ``number``, of some buckets if they are given."""
    runs = key_runs(spark, table, number)
    covered = max((high for _, high in runs), default=-1)
    parts = [spark.read.parquet(f"{table}/keys={low}-{high}") for low, high in runs]
    if buckets is not None:
        parts = [p.where(F.col("bucket__").isin(buckets)) for p in parts]
    paths = [f"{table}/batch={k}" for k in _batches(spark, table) if covered < k < number]
    parts = [p.select(*keys) for p in parts] + ([spark.read.parquet(*paths).select(*keys)] if paths else [])
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def key_runs(spark: SparkSession, table: str, number: int) -> list[tuple[int, int]]:
    """First and last batch of the runs of keys before batch ``number``, without those that a larger one holds."""
    found = sorted(((int(low), int(high)) for low, high in (n.split("-") for n in _complete(spark, table, "keys")) if int(high) < number), key=lambda r: (r[0], -r[1]))
    return [r for k, r in enumerate(found) if not any(r[1] <= o[1] for o in found[:k])]


def _merge_keys(spark: SparkSession, table: str, keys: list[str], number: int, every: int) -> None:
    """Before batch ``number``: the last ``every`` batches or runs become one, if so many are there."""
    span = 1
    while number and number % (span * every) == 0:
        span *= every
    low, high = number - span, number - 1
    if span == 1 or (low, high) in key_runs(spark, table, number):
        return
    inside = [r for r in key_runs(spark, table, number) if r[0] >= low]
    covered = max((h for _, h in inside), default=low - 1)
    parts = [spark.read.parquet(f"{table}/keys={a}-{b}").select(*keys) for a, b in inside]
    paths = [f"{table}/batch={k}" for k in _batches(spark, table) if covered < k <= high]
    if paths:
        parts.append(spark.read.parquet(*paths).select(*keys))
    if not parts:
        return
    merged = functools.reduce(DataFrame.unionByName, parts).withColumn("bucket__", _bucket(keys))
    merged.repartition("bucket__").write.mode("overwrite").partitionBy("bucket__").parquet(f"{table}/keys={low}-{high}")
    fs, path = _files(spark, table)
    for a, b in inside:
        fs.delete(path(f"keys={a}-{b}"), True)


def _files(spark: SparkSession, table: str):
    """The file system that holds the table, and paths in it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(table).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: make(f"{table}/{name}")


def _complete(spark: SparkSession, table: str, kind: str) -> list[str]:
    """What follows ``kind=`` in the names of the folders that are complete."""
    fs, path = _files(spark, table)
    if not fs.exists(path("")):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path(""))]
    return [n.split("=", 1)[1] for n in names if n.startswith(f"{kind}=") and fs.exists(path(f"{n}/_SUCCESS"))]


def _batches(spark: SparkSession, table: str) -> list[int]:
    return sorted(map(int, _complete(spark, table, "batch")))


def stop_when_quiet(query: StreamingQuery, empty_polls: int = EMPTY_POLLS, polls: int = POLLS, wait: float = WAIT) -> int:
    """Polls a running stream and stops it after so many polls in a row without new rows, or polls in all; returns the polls made."""
    quiet, last = 0, -1
    for made in range(1, polls + 1):
        progress = query.lastProgress
        if progress is not None and progress["batchId"] != last and progress["numInputRows"] > 0:
            quiet, last = 0, progress["batchId"]
        else:
            quiet += 1
        if quiet >= empty_polls or not query.isActive:
            break
        time.sleep(wait)
    query.stop()
    return made


def first_seen_stream(spark: SparkSession, folder: str, schema: StructType, keys: list[str], order: list[str], table: str, checkpoint: str) -> DataFrame:
    """What ``start_first_seen`` leaves after all files that are there."""
    query = start_first_seen(landed(spark, folder, schema), keys, order, table, checkpoint)
    query.awaitTermination()
    known = [f"{table}/batch={k}" for k in _batches(spark, table)]
    return spark.read.parquet(*known)


__all__ = ["first_seen", "first_seen_stream", "keep_first", "landed", "start_first_seen", "stop_when_quiet"]
