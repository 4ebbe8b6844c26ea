"""Tables as CSV, JSON and text files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import folded
from gleaner.operators.graph import drop_written, written
from gleaner.operators.ranking import global_rank


# The first line of a file of predictions.
PREDICTION_HEADER = "filepath,predicted_label,confidence,similarity_illust,similarity_photo"


def prediction_lines(scored: DataFrame, path: str, label: str, confidence: str, positive: str, negative: str) -> DataFrame:
    """A header line, and a CSV line for each row: the path always in quotes, numbers with four decimals."""
    quoted = F.concat(F.lit('"'), F.col(path), F.lit('"'))
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    return _headed(PREDICTION_HEADER, scored.select(F.concat_ws(",", quoted, F.col(label).cast("string"), number(confidence), number(positive), number(negative)).alias("value")))


def _headed(header: str, lines: DataFrame) -> DataFrame:
    return lines.sparkSession.range(1, numPartitions=1).select(F.lit(header).alias("value")).unionByName(lines)


def _field(column: Column, alone: bool) -> Column:
    """A value as RFC 4180 has it: in quotes, with its own quotes doubled, where it holds a quote, a comma or a line break; a null is
    empty. An empty value that is ``alone`` in its line is quoted too, since an empty line is no row."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    odd = text.rlike('[",\r\n]')
    return F.when((odd | (text == "")) if alone else odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, bom: bool = True) -> DataFrame:
    """A header line, with a byte order mark in front, and a line for each row, quoted where needed. Written as text, the parts
    in order of their names make one file."""
    line = lambda fields: F.concat_ws(",", *(_field(f, len(df.columns) == 1) for f in fields))
    header = df.sparkSession.range(1, numPartitions=1).select(F.concat(F.lit("\ufeff" if bom else ""), line([F.lit(c) for c in df.columns])).alias("value"))
    return header.unionByName(df.select(line([F.col(f"`{c}`") for c in df.columns]).alias("value")))


def write_csv(df: DataFrame, folder: str) -> None:
    """A folder of CSV parts with headers; nulls are empty, quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(folder)


def write_text(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").text(folder)


def resolution_lines(modes: DataFrame, width: str, height: str, path: str) -> DataFrame:
    """``WxH``, tab, path; the largest area first, then width, height and path."""
    order = [F.desc(F.col(width).cast("long") * F.col(height)), F.desc(width), F.desc(height), F.asc(folded(F.col(path))), F.asc(path)]
    return modes.orderBy(*order).select(F.format_string("%dx%d\t%s", F.col(width), F.col(height), F.col(path)).alias("value"))


def pair_lines(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    return pairs.select(F.format_string("%s <-> %s (%d)", F.col(a).cast("string"), F.col(b).cast("string"), F.col(distance)).alias("value"))


def numbered_pair_lines(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """Pair lines with their number in front, the nearest pairs first."""
    ranked = global_rank(pairs.select(a, b, distance), [F.asc(distance), F.asc(a), F.asc(b)], "ordinal")
    return ranked.select(F.format_string("%d. %s <-> %s (%d)", F.col("ordinal"), F.col(a).cast("string"), F.col(b).cast("string"), F.col(distance)).alias("value"))


# The texts of the report on similar images.
NOTHING_FOUND = "類似画像は見つかりませんでした。"
FOUND = "%d 件の類似画像ペアが見つかりました。"
PAIR, MEMBER = "ペア %d: ハミング距離 %d  |  フォルダ間: %s", "  [%s] %s"
BETWEEN, BETWEEN_COUNT = "類似画像が見つかったフォルダ間:", "  %s: %d 件"
FOLDERS, FOLDER_NAMES = "類似画像がある親フォルダ名:", "  %s: %s"
WIDTH = 60


def similar_report(pairs: DataFrame, order: list[Column], root: str) -> DataFrame:
    """``line, value``: the whole report on ``pairs`` (``folder_a, name_a, folder_b, name_b, distance``) in the order of its lines.

    How many pairs there are; each pair with its number by ``order``, which should be total, and its files; how many pairs each two
    folders share; and the folders. Without pairs, the one line that says so. The folders are one line, as the report has it;
    all others are rows of their own, however many. Pairs are sorted once; where a line stands follows from its pair's number, and what
    comes after the pairs is made from the counts of two folders each.
    """
    spark = pairs.sparkSession
    between = F.array_join(F.array_sort(F.array("folder_a", "folder_b")), " <-> ")
    kept = written(pairs.select("folder_a", "name_a", "folder_b", "name_b", "distance", F.struct(*order).alias("order")), "pairs")
    n = kept.count()
    text = lambda *values: F.posexplode(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values))).alias("part", "value")
    numbered = lambda df, before: df.select((F.lit(before).cast("long") + F.col("part") + 1).alias("line"), "value")
    alone = lambda before, *values: numbered(spark.range(1, numPartitions=1).select(text(*values)), before)
    if not n:
        return alone(0, NOTHING_FOUND)
    head = ("=" * WIDTH, FOUND % n, "=" * WIDTH, "")
    member = lambda side: F.format_string(MEMBER, f"folder_{side}", f"name_{side}")
    ranked = global_rank(kept, [F.asc("order")], "k").select("k", text(F.format_string(PAIR, F.col("k"), F.col("distance"), between), member("a"), member("b"), ""))
    counts = written(kept.groupBy("folder_a", "folder_b").agg(F.count(F.lit(1)).alias("n")), "counts")
    shared = global_rank(counts.groupBy(between.alias("between")).agg(F.sum("n").alias("n")), [F.asc("between")], "k")
    after = len(head) * (n + 1)  # a pair has as many lines as the head
    drop_written(kept)
    folders = counts.select(F.explode(F.array("folder_a", "folder_b")).alias("folder")).agg(F.array_join(F.array_sort(F.collect_set("folder")), ", ").alias("names"))
    lines = [
        alone(0, *head),
        ranked.select((F.col("k") * len(head) + F.col("part") + 1).alias("line"), "value"),
        alone(after, "-" * WIDTH, BETWEEN),
        shared.select((F.lit(after + 2).cast("long") + F.col("k")).alias("line"), F.format_string(BETWEEN_COUNT, "between", "n").alias("value")),
        numbered(folders.select(text("", "-" * WIDTH, FOLDERS, F.format_string(FOLDER_NAMES, F.lit(root), F.col("names")))), after + 2 + shared.count()),
    ]
    return functools.reduce(DataFrame.unionByName, lines)


def count_lines(counts: DataFrame, name: str, n: str) -> DataFrame:
    return counts.select(F.format_string("%s: %d", F.col(name), F.col(n)).alias("value"))


def date_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")
