"""Phrase counts and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import phrases
from gleaner.operators.ranking import global_rank


def explode_phrases(df: DataFrame, key: str, prompt: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.posexplode(phrases(F.col(prompt))).alias("position", "phrase"))


def phrase_frequency(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """``phrase, n, first_key, first_position``: repeats within one prompt count."""
    first = F.min(F.struct("key", "position"))
    out = explode_phrases(df, key, prompt).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return out.select("phrase", "n", F.col("first.key").alias("first_key"), F.col("first.position").alias("first_position"))


def phrase_rank(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """``phrase, n, rank``: most frequent first, of ties the one seen first."""
    ranked = global_rank(phrase_frequency(df, key, prompt), [F.desc("n"), F.asc("first_key"), F.asc("first_position"), F.asc("phrase")])
    return ranked.select("phrase", "n", "rank")


def phrase_report(df: DataFrame, key: str, prompt: str, top: int = 1000) -> DataFrame:
    """One JSON row: the ``top`` phrases with their counts, and how many prompts and phrases there were.

    Phrases by prompt are a table of their own (``explode_phrases``); a report of all of them would be one row of any size.
    """
    counts = phrase_frequency(df, key, prompt)
    best = counts.orderBy(F.desc("n"), "first_key", "first_position", "phrase").limit(top)
    listed = best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "first_key", "first_position", "phrase", "n"))), lambda s: F.struct(s["phrase"].alias("phrase"), s["n"].alias("n"))).alias("phrases"))
    sizes = counts.agg(F.count(F.lit(1)).alias("n_phrases"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_occurrences"))
    prompts = df.agg(F.count(prompt).alias("n_prompts"))
    return listed.join(F.broadcast(sizes)).join(F.broadcast(prompts)).select(F.to_json(F.struct("n_prompts", "n_phrases", "n_occurrences", "phrases")).alias("value"))
