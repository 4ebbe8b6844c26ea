"""Shared helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.graph import cut, written

__all__ = ["bounded_sample", "cut", "load", "lower_ascii", "numbered_columns", "text_or_empty", "with_row_key", "written"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    """A row for each of at most ``n`` distinct values of ``text``, those of the lowest hashes; the same on every run.

    Only hashes are ranked; the texts are then picked by a filter, so no task gathers the candidates' texts.
    """
    hashed = rows.where("text is not null").withColumn("hash__", F.xxhash64("text"))
    lowest = hashed.select("hash__").distinct().orderBy("hash__").limit(n).agg(F.max("hash__")).first()[0]
    rest = [c for c in rows.columns if c != "text"]
    if lowest is None:
        return rows.limit(0)
    picked = hashed.where(F.col("hash__") <= lowest).groupBy("hash__").agg(F.min(F.struct("text", *rest)).alias("row"))
    return picked.select(*(F.col("row")[c].alias(c) for c in rows.columns))


def numbered_columns(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns to keep as c0, c1 and so on, whatever their names, and the place of the text, which is sent to tasks once."""
    columns = keep if text_col in keep else [*keep, text_col]
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))), columns.index(text_col)


def with_row_key(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_key``, which tells every row from all others and is the same each time they are read.

    It is the place of a row in its Parquet file; rows that do not come straight from files are written first.
    """
    if not rows.inputFiles() or "_metadata" not in _hidden(rows):
        rows = written(rows, "keyed")
    return rows.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("row_key"))


def _hidden(rows: DataFrame) -> list[str]:
    try:
        return rows.select("_metadata.row_index").columns and ["_metadata"]
    except AnalysisException:
        return []
