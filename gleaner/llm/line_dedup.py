"""Lines that many documents share, removed from all but one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, lower_ascii, text_or_empty

#: Blanks that are stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``docs`` with the columns ``n_lines``, ``n_dropped`` and ``kept_text``.

    Texts are exploded into lines; a normalised line of at least ``min_chars`` code points found in at least ``min_docs``
    distinct documents loses all its lines except those in the smallest id that holds it. Kept lines are put together by
    position.

    The keys are hashed to 128 bits and their documents are counted in two steps, both combined before the shuffle.
    Only keys over the threshold meet the lines again, in a join of two exchanges, which the adaptive planner splits at
    a hot key. What comes back to a document is the list of its dropped positions, so its text is shuffled once.

    Null and empty texts are one empty line. A null id counts as one document that is larger than all others. Rows with
    the same id count as one document, and each keeps or loses its own lines. Extra columns stay, whatever their names;
    only the three new columns replace columns of the same name.
    """
    same = F.xxhash64(text_or_empty(text_col))  # tells rows of one id apart
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), same.alias("same"), F.split(text_or_empty(text_col), "\n").alias("lines"))
    lines = docs.select(F.col(id_col).alias("id"), same.alias("same"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("pos", "line"))
    keyed = lines.select("id", "same", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select("id", "same", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"))
    common = cut(
        hashed.groupBy("h", "g", "id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h", "g")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id"))
        .where(F.col("n_docs") >= min_docs)
        .select("h", "g", "first_id")
    )
    drops = (
        hashed.join(common, ["h", "g"])
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy(F.col("id").alias("gone_id"), F.col("same").alias("gone_same"))
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    kept = rows.join(drops, rows.id.eqNullSafe(drops.gone_id) & (rows.same == drops.gone_same), "left")
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.size("lines"))).alias("b"))
    text = F.concat_ws("\n", F.flatten(F.transform("gaps", lambda g: F.slice(F.col("lines"), g["a"] + 2, g["b"] - g["a"] - 1))))
    out = kept.select("row", "lines", gaps.alias("gaps"), F.size(gone).alias("n_gone")).select("row", F.size("lines").alias("n_all"), "n_gone", text.alias("text_left"))
    fresh = ["n_lines", "n_dropped", "kept_text"]
    keep = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in fresh]
    return out.select(*keep, F.col("n_all").cast("long").alias("n_lines"), F.col("n_gone").cast("long").alias("n_dropped"), F.col("text_left").alias("kept_text"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for each row of ``docs``; nulls, ties and repeated rows as in ``dedup_lines``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
