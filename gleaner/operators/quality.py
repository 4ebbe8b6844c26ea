"""Quality rules that flag items, and the best of what is clean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_fraction


@dataclass(frozen=True)
class Rules:
    """Thresholds; comparisons are strict, on values before rounding. ``aesthetic`` None turns that rule off."""

    blur: float = 100.0
    asymmetry: float = 0.18
    confidence: float = 0.55
    tip_distance: float = 0.01
    aesthetic: float | None = None


def reasons(tests: list[tuple[Column, str]]) -> Column:
    """The messages of the tests that hold, in order; a test that is null does not hold."""
    return F.filter(F.array(*(F.when(t, F.lit(m)) for t, m in tests)), lambda m: m.isNotNull())


def flag_quality(df: DataFrame, rules: Rules = Rules(), blur: str = "blur", asymmetry: str = "asymmetry", confidence: str = "confidence", tips: str = "tip_min", aesthetic: str = "aesthetic") -> DataFrame:
    """``df`` with ``issues`` (array), ``n_issues``, ``issue_text`` and rounded scores; missing measures break no rule.

    ``tips`` is an array of the least fingertip distance of each hand; every hand that is too close counts.
    """
    tests = [(F.col(blur) < rules.blur, "blurry"), (F.col(asymmetry) > rules.asymmetry, "asymmetric face")]
    crowded = F.transform(F.filter(F.coalesce(F.col(tips).cast("array<double>"), F.array().cast("array<double>")), lambda d: d < rules.tip_distance), lambda _: F.lit("fingers too close"))
    late = [(F.col(confidence) < rules.confidence, "uncertain hand")]
    if rules.aesthetic is not None:
        late.append((F.col(aesthetic) < rules.aesthetic, "low aesthetic score"))
    out = df.withColumn("issues", F.concat(reasons(tests), crowded, reasons(late)))
    return out.withColumns({"n_issues": F.size("issues"), "issue_text": F.array_join("issues", "; "), "blur_rounded": F.round(blur, 1), "aesthetic_rounded": F.round(aesthetic, 3)})


def report_order(key: str) -> list[Column]:
    """Most issues first, then the lower rounded aesthetic score, a missing one as 0."""
    return [F.desc("n_issues"), F.asc(F.coalesce("aesthetic_rounded", F.lit(0.0))), F.asc(key)]


def best_clean(flagged: DataFrame, key: str, fraction: float = 0.2) -> DataFrame:
    """The top fraction of rows without issues by rounded aesthetic score (missing last), then rounded blur score."""
    order = [F.desc_nulls_last("aesthetic_rounded"), F.desc("blur_rounded"), F.asc(key)]
    return top_fraction(flagged.where("n_issues = 0"), order, fraction)


def low_mean(df: DataFrame, group: str, value: str, threshold: float) -> DataFrame:
    """Groups whose mean is at most ``threshold``; a group without values counts as low."""
    return df.groupBy(group).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n")).where((F.col("mean_value") <= threshold) | F.col("mean_value").isNull())


def empty_run_stop(df: DataFrame, ts: str, bucket_seconds: int, run: int) -> DataFrame:
    """One row: the start of the first bucket of time that ends a run of ``run`` empty ones, or null.

    Gaps are looked for within days, then between days on one row for each day, so no window spans the table.
    """
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / bucket_seconds).cast("long")
    rows = df.where(F.col(ts).isNotNull()).select(bucket.alias("bucket")).distinct().withColumn("day", F.floor(F.col("bucket") * bucket_seconds / 86400))
    from pyspark.sql import Window

    within = rows.withColumn("next", F.lead("bucket").over(Window.partitionBy("day").orderBy("bucket"))).select("bucket", "next")
    days = rows.groupBy("day").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    between = days.select(F.col("high").alias("bucket"), F.lead("low").over(Window.orderBy("day")).alias("next"))  # a row for each day
    gaps = within.unionByName(between).where(F.col("next") - F.col("bucket") > run)
    return gaps.agg(F.timestamp_seconds((F.min("bucket") + run) * bucket_seconds).cast("timestamp_ntz").alias("stopped_at"))
