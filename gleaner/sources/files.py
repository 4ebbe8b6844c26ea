"""File scans: names and sizes first, contents only where asked for."""

from __future__ import annotations

import functools
import itertools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.headers import head, header_size, orientation
from gleaner.functions.text import base_name, extension, first_segment, local_path, parent
from gleaner.operators.blocks import dealt_evenly
from gleaner.operators.graph import shared_folder, written

#: Files that Spark's reader of images is given at once.
READ_AT_ONCE = 10_000

# The suffixes that each scan takes.
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
IMAGES_TIFF = (*IMAGES, ".tif", ".tiff")
IMAGES_WIDE = (".avif", ".bmp", ".gif", ".heic", ".heif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
VIDEOS = (".3gp", ".avi", ".flv", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".ogg", ".ogv", ".webm", ".wmv")


def scan_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = IMAGES, recursive: bool = True, content: bool = False, ordered: bool = False) -> DataFrame:
    """``path, filename, ext, length, modified`` (and ``content``) of the files below ``path``, or of that file.

    The suffix is compared in lower case. Without ``content`` the reader only lists; it never opens a file. ``ordered``
    sorts by path.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    columns = ["path", base_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("ext"), "length", F.col("modificationTime").alias("modified")]
    out = found.select(*columns, *(["content"] if content else []))
    out = out.where(F.col("ext").isin(*suffixes)) if suffixes else out
    return out.orderBy("path") if ordered else out


def header_sizes(files: DataFrame) -> DataFrame:
    """``path, width, height, orientation`` of scanned files, from their headers; null where a file is no image of a known kind,
    or cut off before its size. Nothing is decoded.

    Files without ``content`` lie in a local or mounted folder; a task opens them and reads a few bytes and the EXIF block of
    each. With ``content``, from wherever Spark has read it, that is looked at instead.
    """
    whole = "content" in files.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [x.as_py() for x in batch.column(1)] if whole else [_head(x.as_py()) for x in batch.column(0)]
            sizes = [header_size(c) or (None, None) for c in heads]
            turned = [orientation(c) if s[0] is not None else None for c, s in zip(heads, sizes, strict=True)]
            columns = [pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(turned, pa.int32())], names=["path", "width", "height", "orientation"])

    return files.select("path", *(["content"] if whole else [])).mapInArrow(task, "path string, width int, height int, orientation int")


def _head(path: str) -> bytes | None:
    try:
        with open(local_path(path), "rb", buffering=0) as f:
            return head(f)
    except OSError:
        return None


def with_folder(files: DataFrame, root: str) -> DataFrame:
    """``parent_dir``: the folder right below ``root``; files in the root itself go."""
    return files.withColumn("parent_dir", first_segment(F.regexp_replace("path", "^file:/+", "/"), root)).where("parent_dir is not null")


def with_parent(files: DataFrame) -> DataFrame:
    """``parent_dir``: the folder that holds the file."""
    return files.withColumn("parent_dir", parent(F.col("path")))


def outside(files: DataFrame, folder: str) -> DataFrame:
    """Files that do not lie below ``folder``; a folder whose name only begins alike stays."""
    return files.where(~F.startswith(F.regexp_replace("path", "^file:/+", "/"), F.lit(folder.rstrip("/") + "/")))


def scan_images(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """Decoded images: ``path, width, height, channels, data`` (BGR order), null where a file is no readable image. Files that
    go between listing and reading are passed over."""
    image = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).option("dropInvalid", "false").option("ignoreMissingFiles", "true").load(path)
    good = F.col("image.height") > 0
    return image.select(F.col("image.origin").alias("path"), *(F.when(good, F.col(f"image.{c}")).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))))


def listed_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = IMAGES) -> DataFrame:
    """``path, filename, ext`` of the files below a local or mounted folder, however many. Tasks list folders, level by level, and write
    what they find; the driver lists none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            with os.scandir(folder) as entries:
                while some := list(itertools.islice(entries, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([e.path for e in some], pa.string()), pa.array([e.is_dir(follow_symlinks=False) for e in some], pa.bool_())], names=["path", "folder"])

    level, levels = spark.createDataFrame([(local_path(root),)], "path string"), []
    while not levels or not level.isEmpty():
        found = written(dealt_evenly(level).mapInArrow(task, "path string, folder boolean"), "listed")
        levels.append(found.where("not folder").select("path", base_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("ext")))
        level = found.where("folder").select("path")
    out = functools.reduce(DataFrame.unionByName, levels)
    return out.where(F.col("ext").isin(*suffixes)) if suffixes else out


def decoded_images(files: DataFrame, most: int = READ_AT_ONCE) -> DataFrame:
    """``scan_images`` of the local or mounted files in ``path``, however many, as a written table with their own paths.

    Spark's reader keeps what it knows of each file in the driver, so files are linked to from folders of ``most`` at most, each made by one
    attempt of a task, and the folders are read one after another, as many at once as have ``most`` files together.
    """
    spark = files.sparkSession
    root = local_path(shared_folder(spark, "links"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, folder = 0, ""
        for batch in batches:
            links = []
            for path in batch.column(0).to_pylist():
                if n % most == 0:
                    folder = f"{root}/{uuid.uuid4().hex}"
                    os.makedirs(folder)
                links.append(f"{folder}/{n}{os.path.splitext(path)[1]}")
                os.symlink(path, links[-1])
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(links, pa.string()), batch.column(0), pa.array([os.path.dirname(x) for x in links], pa.string())], names=["link", "path", "folder"])

    linked = written(dealt_evenly(files.select("path")).mapInArrow(task, "link string, path string, folder string"), "linked")
    out, held, n = f"{shared_folder(spark, 'decoded')}", [], 0
    columns = "path string, width int, height int, channels int, data binary"
    spark.createDataFrame([], columns).write.parquet(out)

    def read() -> None:
        few = linked.where(F.col("folder").isin(*held)).select("link", "path")
        images = scan_images(spark, held).coalesce(spark.sparkContext.defaultParallelism).withColumn("link", F.regexp_replace("path", "^file:/+", "/")).drop("path")
        few.join(images, "link", "left").select("path", "width", "height", "channels", "data").write.mode("append").parquet(out)

    for row in linked.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).orderBy("folder").toLocalIterator():
        if held and n + row["n"] > most:
            read()
            held, n = [], 0
        held, n = [*held, row["folder"]], n + row["n"]
    if held:
        read()
    return spark.read.schema(columns).parquet(out)


def decodable(images: DataFrame) -> DataFrame:
    """Whatever its suffix, what could be decoded."""
    return images.where("data is not null")


def convert_action(path: Column) -> Column:
    """``convert`` for PNG, ``rename`` for .jpeg, else ``keep``."""
    ext = extension(path)
    return F.when(ext == ".png", "convert").when(ext == ".jpeg", "rename").otherwise("keep")
