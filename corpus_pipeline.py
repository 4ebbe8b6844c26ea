"""A corpus made ready for training: five operators, one after another, over the whole of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import cut, load, with_row_key
from gleaner.llm.decontamination import find_leaks
from gleaner.llm.language_id import identify
from gleaner.llm.line_dedup import dedup_lines
from gleaner.llm.near_dup import near_duplicates
from gleaner.llm.packing import Limits, pack_documents
from gleaner.llm.queries import vocabulary
from gleaner.operators.graph import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letter (so null and empty texts), or far from the language that fits best.

    Repeated rows and null ids are judged by their own texts. A language whose label is null teaches nothing. Without any
    label no language is known, and every document goes. An empty table gives an empty one; columns beyond those of
    ``documents`` are left out, whatever their names.
    """
    return identify(docs.select(*COLUMNS)).where("not rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents have go from all but the first; every document stays, with an empty text if all its lines go.

    Null texts become empty. A null id counts as one document after all others; rows of one id count as one document and
    keep their own lines. An empty table gives an empty one; columns beyond those of ``documents`` are left out.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row of the smallest id stays; of equal ids one row, and of null ids one if all are null.

    Each row is judged by itself: rows of one id with different texts go or stay on their own. Documents without a word
    (null and empty texts) are near nothing and stay. An empty table gives an empty one; columns beyond those of
    ``documents`` are left out.
    """
    keyed = with_row_key(docs.select(*COLUMNS))
    named = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key").alias("id"), "text")
    gone = near_duplicates(named, "id", words=5, threshold=0.8).where("not kept").select("id.row_key")
    return keyed.join(cut(gone), "row_key", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, and no other rows, whatever their ids.

    Null and empty texts hold nothing and stay; repeated rows go or stay together, as their texts are equal. An empty table
    or benchmark takes nothing away; columns beyond those of ``documents`` are left out.
    """
    keyed = with_row_key(docs.select(*COLUMNS))
    gone = cut(find_leaks(keyed, load(spark, sf_dir, "benchmark"), "row_key").select(F.col("id").alias("row_key")).distinct())
    return keyed.join(gone, "row_key", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents with their ids.

    Null and empty texts are the end token alone; repeated rows and null ids are packed like others. An empty table gives an
    empty one; columns beyond the id and the text are left out.
    """
    return pack_documents(docs, vocabulary(), Limits()).withColumnRenamed("id", "doc_id").withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near", near),
    ("benchmark", benchmark),
    ("packed", packed),
]

#: Language models, signatures and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder as Parquet before the next reads them."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            folder = shared_folder(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.schema(docs.schema).parquet(folder)
    return docs
