"""Rasters as image files, on a local or mounted folder."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.functions.jpeg import jpeg
from gleaner.functions.text import local_path

# PNG's colour types for gray, RGB and RGBA.
COLOUR_TYPES = {1: 0, 3: 2, 4: 6}


def png(width: int, height: int, channels: int, data: bytes) -> bytes:
    """A PNG file of 8-bit samples, row by row, in the order gray, RGB or RGBA."""
    if len(data) != width * height * channels:
        raise ValueError(f"{len(data)} samples are no {width} x {height} x {channels}")
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    size = width * channels
    lines = b"".join(b"\0" + data[k * size : (k + 1) * size] for k in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPES[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_files(files: DataFrame) -> DataFrame:
    """Writes ``content`` to ``path``, a file for each row; returns ``path, error``.

    A file appears whole under its name or not at all, and a task that is run again writes the same file again.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [write_file(local_path(p), c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["path", "error"])

    return files.select("path", "content").mapInArrow(task, "path string, error string")


def write_file(path: str, content: bytes) -> str | None:
    try:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, path)
    except OSError as e:
        return str(e)
    return None


def encoded(rasters: DataFrame, by_name: bool = False, quality: int = 85) -> DataFrame:
    """``path, content``: rasters (path, width, height, channels, data in the order gray, RGB or RGBA) as PNG files.

    With ``by_name``, as JPEG files where the path ends in .jpg or .jpeg; those have no alpha, and gray is as three equal colours.
    """

    def one(path: str, width: int, height: int, channels: int, data: bytes) -> bytes:
        if by_name and path.lower().endswith((".jpg", ".jpeg")):
            x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            return jpeg(np.repeat(x, 3, 2) if channels == 1 else x[..., :3], quality)
        return png(width, height, channels, data)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([one(**row.to_pylist()[0])], pa.binary())], names=["path", "content"])

    return rasters.select("path", "width", "height", "channels", "data").mapInArrow(task, "path string, content binary")
