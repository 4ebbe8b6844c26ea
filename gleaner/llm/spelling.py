"""Spelling variants: words at distance one, found in tries that are broadcast one block at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import trie
from gleaner.llm.common import lower_ascii, text_or_empty, written
from gleaner.operators.blocks import dealt_evenly
from gleaner.operators.graph import drop_written

LETTERS = r"[A-Za-zÀ-ÿ]"
#: A shard ends with this many words or characters, whichever comes first; a longer word is a shard of its own.
SHARD_WORDS, SHARD_CHARS = 100_000, 2_000_000
#: Bytes of shards that are broadcast at once; a larger shard goes alone.
BLOCK_BYTES = 48_000_000
SHARD = "text string, start binary, depth binary, skip binary, n binary, bytes long"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_n: int = 2, slip: int = 31) -> DataFrame:
    """``word, n`` of the lower-cased letter runs of whole texts, those of ``least_chars`` and ``least_n`` at least.

    Runs are maximal; only A-Z are lower-cased. Where ``slip`` divides the crc32 of ``id:run``, the character that the crc32
    points at is taken out first. Runs too short to become a word are passed over by the pattern. Null and empty texts have no words, a null
    id counts as an empty one, and repeated rows count each. Occurrences are summed in the tasks before they are shuffled.
    """
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(lower_ascii(text_or_empty(F.col(f"`{text_col}`"))), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Compact tries of ``word, n``, each of a range of words in code-point order."""

    def packed(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        made = trie.build([w for w, _ in rows], [n for _, n in rows])
        arrays = [np.array(x, kind).tobytes() for x, kind in ((made.start, np.uint32), (made.depth, np.uint32), (made.skip, np.uint32), (made.n, np.int64))]
        return pa.RecordBatch.from_pydict({"text": [made.text], **dict(zip(("start", "depth", "skip", "n"), ([a] for a in arrays), strict=True)), "bytes": [len(made.text) + sum(map(len, arrays))]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        chars = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows and (len(rows) >= shard_words or chars + len(row[0]) > shard_chars):
                    yield packed(rows)
                    rows, chars = [], 0
                rows.append(row)
                chars += len(row[0])
        if rows:
            yield packed(rows)

    return words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(task, SHARD)


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``word, n_near, best`` for those of ``words`` (``word, n``, distinct) that have a word at distance one: how many, and the
    one of largest ``n`` as ``(m, word)`` with ``m`` its ``-n``, of ties the first in code-point order.

    The words become trie shards of bounded size, written to the shared folder. Shards are broadcast in blocks of at most
    ``block_bytes``; each word's automaton meets every shard of a block, most of which it leaves at the root. Being near is
    mutual, so a word looks only for those with a character less, or a larger one in a place, and a pair counts for both. What a batch of words
    finds is reduced in the task, and a last grouping reduces over batches and blocks.
    """
    spark = words.sparkSession
    shards = written(trie_shards(words, shard_words, shard_chars), "shards")
    named = shards.withColumn("name", F.concat_ws("/", "_metadata.file_name", "_metadata.row_index"))
    blocks: list[list] = []
    room = 0
    for name, size in sorted((r["name"], r["bytes"]) for r in named.select("name", "bytes").collect()):  # a row for each shard
        if not blocks or size > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(name)
        room -= size
    dealt = dealt_evenly(words.select("word", "n"))
    found = []
    for block in blocks:
        rows = named.where(F.col("name").isin(block)).drop("name", "bytes").collect()
        shared = spark.sparkContext.broadcast([tuple(map(bytes, (r["text"].encode(), r["start"], r["depth"], r["skip"], r["n"]))) for r in rows])
        found.append(written(dealt.mapInArrow(_visit(shared), "word string, n_near long, m long, best string"), "near"))
        shared.destroy()
    drop_written(shards)
    if not found:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<m:bigint,word:string>").alias("best"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", F.col("best").alias("word"))).alias("best"))


def _visit(shared):
    """Words against every shard of a broadcast block: ``word, n_near, m, best`` of either word of the pairs that a batch finds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [trie.Trie(text.decode(), *(memoryview(x).cast("I") for x in (start, depth, skip)), memoryview(n).cast("q"), {}) for text, start, depth, skip, n in shared.value]
        for batch in batches:
            own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            found: dict[str, list] = {}

            def add(word: str, best: tuple[int, str], found: dict[str, list] = found) -> None:
                if word not in found:
                    found[word] = [1, best]
                    return
                found[word][0] += 1
                found[word][1] = min(found[word][1], best)

            for shard in shards:
                for word, n in own:
                    for k in trie.neighbours(shard, word, half=True):
                        other = trie.word_at(shard, k)
                        add(word, (-shard.n[k], other))
                        add(other, (-n, word))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([b[0] for _, b in found.values()], pa.int64()), pa.array([b[1] for _, b in found.values()], pa.string())], names=["word", "n_near", "m", "best"])

    return task


def follow_forms(forms: DataFrame, ratio: int) -> DataFrame:
    """``word, root`` for each row of ``word, form, n``: forms followed to the last.

    A form is at least ``ratio`` times as frequent as its word, so no chain is longer than the logarithm of the largest
    count, and each round of joins doubles how far the links reach.
    """
    most = forms.agg(F.max("form_n")).first()[0] or 1
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(max(1, math.ceil(math.log(most, ratio))).bit_length()):
        further, old = links.select(F.col("word").alias("root"), F.col("root").alias("next")), links
        links = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        if k:
            drop_written(old)
    return links


def spelling_variants(words: DataFrame, ratio: int = 10, **limits: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word, n``, distinct and not empty).

    ``form`` is the word at distance one that is most frequent, if it is at least ``ratio`` times as frequent as the word. ``root`` is
    the last of a chain of forms, the word itself if it has none. Ties go to the first in code-point order. Null words are
    left out; an empty table gives an empty one. ``limits`` are those of ``near_words``.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms may go in circles")
    words = written(words.where("word is not null and word <> ''").select("word", F.col("n").cast("long").alias("n")), "words")
    formed = -F.col("best.m") >= F.col("n") * ratio
    near = near_words(words, **limits)
    forms = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "forms")
    drop_written(near)
    drop_written(words)
    return forms.join(follow_forms(forms, ratio), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_digest(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``documents``."""
    return spelling_variants(count_words(docs))
