"""What is to be done with files: a table first, carried out only on demand."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.functions.images import oriented, to_rgb
from gleaner.functions.jpeg import jpeg
from gleaner.functions.text import base_name, with_extension
from gleaner.operators.graph import written
from gleaner.operators.ranking import group_rank
from gleaner.sinks.images import write_file
from gleaner.sources.files import convert_action

POLICIES = ("suffix", "overwrite", "error")
#: Actions that leave files as they are.
IDLE = ("error", "keep", "dryrun")


def plan(files: DataFrame, target_dir: str | Column, action: str | Column, name: Column | None = None) -> DataFrame:
    """``src, dst, action`` for files with a column ``path``."""
    folder = F.lit(target_dir.rstrip("/")) if isinstance(target_dir, str) else target_dir
    return files.select(F.col("path").alias("src"), F.concat(folder, F.lit("/"), name if name is not None else base_name(F.col("path"))).alias("dst"), (F.lit(action) if isinstance(action, str) else action).alias("action"))


def without_collisions(planned: DataFrame, existing: DataFrame | None = None, policy: str = "suffix") -> DataFrame:
    """``planned`` with free targets.

    ``suffix``: the first keeps its name, the others get ``_1``, ``_2`` and so on before the extension, past all names
    that exist (a column ``dst``) or are planned. ``overwrite``: the last by source stays. ``error``: rows whose target
    is taken get the action ``error``.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    taken = (existing.select("dst") if existing is not None else planned.select("dst").limit(0)).distinct().withColumn("taken", F.lit(True))
    if policy == "overwrite":
        last = planned.groupBy("dst").agg(F.max(F.struct("src", "action")).alias("last"))
        return last.select("last.src", "dst", "last.action")
    seen = group_rank(planned, ["dst"], [F.asc("src"), F.asc("action")], "k").join(taken, "dst", "left")
    if policy == "error":
        return seen.withColumn("action", F.when((F.col("k") > 1) | F.col("taken"), "error").otherwise(F.col("action"))).select("src", "dst", "action")
    seen = written(seen, "seen")
    keep = (F.col("k") == 1) & F.col("taken").isNull()
    late = seen.where(~keep).select("src", "dst", "action", F.when(F.col("taken"), F.col("k")).otherwise(F.col("k") - 1).cast("long").alias("at"))
    names = planned.select("dst").unionByName(taken.select("dst")).distinct()
    number = F.regexp_extract("dst", r"_([1-9][0-9]{0,17})(?:\.[^./]+)?$", 1)
    used = names.where(number != "").select(F.concat(F.regexp_replace("dst", r"_[0-9]+(\.[^./]+)?$", ""), F.regexp_extract("dst", r"_[0-9]+(\.[^./]+)?$", 1)).alias("dst"), number.cast("long").alias("used"))
    used = used.join(late.select("dst").distinct(), "dst", "left_semi")
    # before the i-th used number u there are u - i free ones; the j-th late file comes after all used ones with fewer than j
    gaps = group_rank(used, ["dst"], [F.asc("used")], "i").select(F.lit(None).cast("string").alias("src"), "dst", F.lit(None).cast("string").alias("action"), (F.col("used") - F.col("i")).alias("at"), F.lit(1).alias("kind"))
    lined = group_rank(late.withColumn("kind", F.lit(0)).unionByName(gaps), ["dst"], [F.asc("at"), F.asc("kind"), F.asc("src")], "number")
    stem, ext = F.regexp_replace("dst", r"\.[^./]+$", ""), F.regexp_extract("dst", r"(\.[^./]+)$", 1)
    moved = lined.where("kind = 0").select("src", F.concat(stem, F.lit("_"), F.col("number").cast("string"), ext).alias("dst"), "action")
    return seen.where(keep).select("src", "dst", "action").unionByName(moved)


def duplicate_plan(ranked: DataFrame, target_dir: str, action: str = "dryrun") -> DataFrame:
    """Moves or deletes the redundant members of ranked groups; ``dryrun`` only reports them."""
    if action not in ("dryrun", "move", "delete"):
        raise ValueError("action must be dryrun, move or delete")
    return without_collisions(plan(ranked.where("not kept"), target_dir, action))


def convert_plan(files: DataFrame) -> DataFrame:
    """PNG files are converted and .jpeg files renamed to .jpg; a taken target is an error of that file alone."""
    path = F.col("path")
    todo = files.select(path.alias("src"), with_extension(path, ".jpg").alias("dst"), convert_action(path).alias("action")).where("action <> 'keep'")
    return without_collisions(todo, files.select(path.alias("dst")), "error")


def carry_out(planned: DataFrame, images: DataFrame | None = None, orientations: DataFrame | None = None, quality: int = 85) -> DataFrame:
    """Does what ``planned`` (``src, dst, action``) says with local or mounted files, a row each; returns ``src, dst, action, error``.

    ``move``, ``rename``, ``copy`` and ``delete`` are done in the tasks. ``convert`` takes the decoded image of ``src`` from ``images``
    (``scan_images``), turns it by ``orientations`` (``path, orientation``, as ``header_sizes`` finds it), lays it over white,
    writes it as JPEG and then removes the source; a target that exists, or an image that cannot be read, is an error of that
    row and its source stays. ``error``, ``keep`` and ``dryrun`` do nothing, any other action is an error.

    The plan is written down first. A file that is gone because an earlier attempt of the task moved it is no error, so a lost
    task can run again.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [_do(*row.values()) for row in batch.select(["src", "dst", "action"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], names=["src", "dst", "action", "error"])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time
                r = batch.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict({"src": [r["src"]], "dst": [r["dst"]], "action": ["convert"], "error": pa.array([_convert(**r, quality=quality)], pa.string())})

    schema = "src string, dst string, action string, error string"
    todo = written(planned.select("src", "dst", "action"), "todo")  # a plan made from a scan cannot be made again once files are gone
    if images is None:
        return todo.mapInArrow(task, schema)
    local = F.regexp_replace("path", "^file:/+", "/")
    decoded = images.select(local.alias("src"), "width", "height", "channels", "data")
    turned = orientations.select(local.alias("src"), "orientation") if orientations is not None else decoded.select("src", F.lit(1).alias("orientation")).limit(0)
    rows = todo.where("action = 'convert'").drop("action").join(decoded, "src", "left").join(turned, "src", "left").select("src", "dst", "width", "height", "channels", "data", "orientation")
    return todo.where("action is null or action <> 'convert'").mapInArrow(task, schema).unionByName(rows.mapInArrow(convert, schema))


def carried_out(planned: DataFrame, images: DataFrame | None = None, orientations: DataFrame | None = None, quality: int = 85) -> tuple[DataFrame, dict[str, int]]:
    """What ``carry_out`` returns, done and written, and how many rows were ``processed``, ``skipped`` and ``failed``, counted while
    they were done."""
    seen, skipped = Observation("outcome"), F.col("action").isin(*IDLE)
    done = carry_out(planned, images, orientations, quality).observe(seen, F.count_if(~skipped & F.col("error").isNull()).alias("processed"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & F.col("error").isNotNull()).alias("failed"))
    return written(done, "done"), seen.get


def outcome_counts(done: DataFrame) -> DataFrame:
    """``action, processed, skipped, failed`` of what ``carry_out`` returned: rows of a plan that do nothing were skipped."""
    skipped = F.col("action").isin(*IDLE)
    return done.groupBy("action").agg(F.count_if(~skipped & F.col("error").isNull()).alias("processed"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & F.col("error").isNotNull()).alias("failed"))


def _do(src: str, dst: str, action: str) -> str | None:
    try:
        if action in ("move", "copy", "rename"):
            if not os.path.exists(src) and os.path.exists(dst) and action != "copy":
                return None
            os.makedirs(os.path.dirname(dst), exist_ok=True)
            (shutil.copy2 if action == "copy" else shutil.move)(src, dst)
        elif action == "delete":
            if os.path.exists(src):
                os.remove(src)
        elif action == "convert":
            return "images are needed to convert"
        elif action not in IDLE:
            return f"unknown action {action}"
    except OSError as e:
        return str(e)
    return None


def _convert(src: str, dst: str, width: int | None, height: int | None, channels: int | None, data: bytes | None, orientation: int | None, quality: int) -> str | None:
    try:
        if not os.path.exists(src) and os.path.exists(dst):
            return None
        if os.path.exists(dst):
            return f"{dst} exists"
        if data is None:
            return "not a readable image"
        content = jpeg(oriented(to_rgb(data, height, width, channels), orientation or 1), quality)
        if error := write_file(dst, content):
            return error
        os.remove(src)
    except (OSError, ValueError) as e:
        return str(e)
    return None
