"""What can be told of a video from its raw numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(frames: Column, fps: Column) -> Column:
    """Seconds; null unless both numbers are positive."""
    return F.when((frames > 0) & (fps > 0), frames / fps)


def bitrate(size: Column, seconds: Column) -> Column:
    """Kilobits a second; null without a positive duration."""
    return F.when(seconds > 0, size * 8.0 / 1000.0 / seconds)


def clock(seconds: Column) -> Column:
    """``H:MM:SS`` of the whole seconds, days in front if there are any."""
    s = F.floor(seconds).cast("long")
    day = F.floor(s / 86400).cast("long")
    rest = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    days = F.format_string("%d day%s, ", day, F.when(day == 1, F.lit("")).otherwise(F.lit("s")))
    return F.when(s.isNotNull(), F.concat(F.when(day > 0, days).otherwise(F.lit("")), rest))


def resolution(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.format_string("%dx%d", width, height))


def pixels(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width.cast("long") * height)


def media_info(width: Column, height: Column, fps: Column, frames: Column, size: Column) -> list[Column]:
    """Resolution, pixels, duration, clock time and rounded bitrate (half to even), null where unknown; all null without a
    positive width and height, as such a file was not read."""
    read = (width > 0) & (height > 0)
    seconds = duration(frames, fps)
    known = {
        "resolution": resolution(width, height), "pixels": pixels(width, height), "duration": seconds,
        "clock": clock(seconds), "bitrate_kbps": F.bround(bitrate(size, seconds), 0).cast("long"),
    }
    return [F.when(read, c).alias(k) for k, c in known.items()]
