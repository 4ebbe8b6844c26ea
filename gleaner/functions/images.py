"""Kernels over decoded images, in Arrow batches: hashes, thumbnails, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.resample import luma, resize

# The weights of red, green and blue in luminance.
LUMINANCE = np.array([0.299, 0.587, 0.114])


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height by width by 3 of an image in BGR, BGRA or gray order; alpha lies over white."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, 2)
    rgb = x[..., 2::-1]
    if channels == 4:
        a = x[..., 3:].astype(float) / 255
        rgb = np.rint(rgb * a + 255 * (1 - a)).astype(np.uint8)
    return rgb


def oriented(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The image as EXIF's orientation (1 to 8) says that it is to be seen."""
    if orientation in (5, 6, 7, 8):
        rgb = rgb.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        rgb = rgb[:, ::-1]
    if orientation in (3, 4, 7, 8):
        rgb = rgb[::-1]
    return rgb


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb.astype(float) @ LUMINANCE + 0.5)


def dhash(rgb: np.ndarray, size: int) -> list[int]:
    """Difference hash of a Lanczos thumbnail: words of 64 bits, signed, row by row, highest bit first."""
    small = resize(luma(rgb), size, size + 1, "lanczos")
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    bits = np.pad(bits, (0, -len(bits) % 64))
    return np.packbits(bits.reshape(-1, 64), axis=1).view(">i8").ravel().tolist()


def histogram(rgb: np.ndarray) -> list[float]:
    """256 bins for each channel, by the number of pixels."""
    return (np.concatenate([np.bincount(rgb[..., c].ravel(), minlength=256) for c in range(3)]) / rgb[..., 0].size).tolist()


def thumbnail(rgb: np.ndarray, size: int = 128) -> list[int]:
    """Luminance of a bicubic thumbnail."""
    return resize(luma(rgb), size, size, "bicubic").astype(int).ravel().tolist()


def mean_saturation(rgb: np.ndarray) -> float:
    x = rgb.astype(int)
    high, low = x.max(2), x.min(2)
    return float(np.where(high > 0, (high - low) * 255 // np.maximum(high, 1), 0).mean()) if x.size else 0.0


def content_share(rgb: np.ndarray, size: int = 64, tolerance: int = 32) -> float:
    """Share of a nearest-neighbour thumbnail that is not near its most frequent colour."""
    rows = ((np.arange(size) + 0.5) * rgb.shape[0] / size).astype(int)
    cols = ((np.arange(size) + 0.5) * rgb.shape[1] / size).astype(int)
    small = rgb[rows][:, cols].reshape(-1, 3).astype(int)
    colours, n = np.unique(small, axis=0, return_counts=True)
    near = (np.abs(small - colours[n.argmax()]) <= tolerance).all(1)
    return float(1 - near.mean())


def blur_score(rgb: np.ndarray) -> float:
    """Variance of the Laplacian, the border mirrored without its edge."""
    x = np.pad(gray(rgb), 1, mode="reflect") if min(rgb.shape[:2]) > 1 else np.pad(gray(rgb), 1, mode="edge")
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def content_box(rgb: np.ndarray, tolerance: int = 10, padding: int = 0) -> list[int] | None:
    """Box of what differs from the most frequent corner in any channel; None if nothing does."""
    if not 0 <= tolerance <= 255 or padding < 0:
        raise ValueError("tolerance must lie between 0 and 255, padding must not be negative")
    corners = [tuple(rgb[r, c].tolist()) for r, c in ((0, 0), (0, -1), (-1, 0), (-1, -1))]
    back = max(corners, key=lambda c: (corners.count(c), -corners.index(c)))
    rows, cols = np.nonzero((np.abs(rgb.astype(int) - back) > tolerance).any(2))
    if not len(rows):
        return None
    h, w = rgb.shape[:2]
    return [max(0, int(cols.min()) - padding), max(0, int(rows.min()) - padding), min(w, int(cols.max()) + 1 + padding), min(h, int(rows.max()) + 1 + padding)]


KERNELS: dict[str, tuple[str, Callable[[np.ndarray], object]]] = {
    "dhash256": ("array<long>", lambda x: dhash(x, 16)),
    "dhash64": ("long", lambda x: dhash(x, 8)[0]),
    "histogram": ("array<double>", histogram),
    "thumbnail": ("array<int>", thumbnail),
    "saturation": ("double", mean_saturation),
    "content": ("double", content_share),
    "blur": ("double", blur_score),
    "box": ("array<int>", content_box),
}


def with_features(images: DataFrame, kernels: list[str], orientations: DataFrame | None = None) -> DataFrame:
    """``path, width, height`` and the named kernels of ``scan_images`` rows; null for images that cannot be read.

    An image is decoded once for all of its kernels, and no more than one at a time is held as an array. With
    ``orientations`` (``path, orientation``, as ``header_sizes`` finds it) images are turned first, and so are their sizes.
    """
    kinds = [KERNELS[k][0] for k in kernels]

    def one(r: dict) -> dict:
        rgb = oriented(to_rgb(r["data"], r["height"], r["width"], r["channels"]), r["orientation"] or 1) if r["data"] else None
        size = {"width": r["width"], "height": r["height"]} if rgb is None else {"width": rgb.shape[1], "height": rgb.shape[0]}
        return {"path": r["path"]} | size | {k: None if rgb is None else KERNELS[k][1](rgb) for k in kernels}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(batch.slice(k, 1).to_pylist()[0]) for k in range(batch.num_rows)], schema)

    arrow = {"array<long>": pa.list_(pa.int64()), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "double": pa.float64()}
    schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), *((k, arrow[t]) for k, t in zip(kernels, kinds, strict=True))])
    turned = images.withColumn("orientation", F.lit(1)) if orientations is None else images.join(orientations.select("path", "orientation"), "path", "left")
    return turned.select("path", "width", "height", "channels", "data", "orientation").mapInArrow(task, ", ".join(["path string, width int, height int", *(f"{k} {t}" for k, t in zip(kernels, kinds, strict=True))]))


def apply_layers(df: DataFrame, key: str, vector: str, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``key, score``: a linear stack of layers (weights, bias) over each vector, one product of matrices for a batch.

    The layers are shared with all tasks; they are a model of fixed size. Null vectors have a null score.
    """
    shared = df.sparkSession.sparkContext.broadcast(layers)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            there = [i for i, v in enumerate(vectors) if v is not None]
            score: list[float | None] = [None] * len(vectors)
            if there:
                x = np.array([vectors[i] for i in there], float)
                for w, b in shared.value:
                    x = x @ w.T + b
                for i, s in zip(there, x[:, 0], strict=True):
                    score[i] = float(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["key", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInArrow(task, f"key {kind}, score double").withColumnRenamed("key", key)
