"""Vectors, matrices and bit strings held in arrays and longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Bits that differ between two hashes of several words, such as four longs of 256 bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def gradient_hash(v: Column, first: int = 0, count: int = 63) -> Column:
    """One bit for each rise between neighbours, the first neighbours' bit highest: the row form of a difference hash."""
    rise = lambda i: F.when(F.get(v, i + 1) > F.get(v, i), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.aggregate(F.sequence(F.lit(first), F.lit(first + count - 1)), F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(rise(i)))


def grid_hash(v: Column, size: int) -> Column:
    """Difference hash of a grid of ``size`` rows of ``size + 1`` values: words of 64 bits, row by row, highest bit first."""
    bit = lambda k: (lambda at: F.when(F.get(v, at + 1) > F.get(v, at), F.lit(1)).otherwise(F.lit(0)).cast("long"))(F.floor(k / size).cast("int") * (size + 1) + (k % size).cast("int"))
    word = lambda w: F.aggregate(F.sequence(w * 64, F.least(w * 64 + 63, F.lit(size * size - 1))), F.lit(0).cast("long"), lambda h, k: F.shiftleft(h, 1).bitwiseOR(bit(k)))
    return F.transform(F.sequence(F.lit(0), F.lit((size * size - 1) // 64)), word)


def intersection(a: Column, b: Column, channels: int = 1) -> Column:
    """Histogram intersection of two normalised histograms; 0 where one is missing."""
    return F.coalesce(total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / channels, F.lit(0.0))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference; 255 where one is missing."""
    return F.coalesce(total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a), F.lit(255.0))


def share_over(a: Column, b: Column, least: float) -> Column:
    """Share of places that differ by ``least`` or more; 1 where one is missing."""
    return F.coalesce(F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d >= least)) / F.size(a), F.lit(1.0))


def laplacian_variance(v: Column, width: int, height: int) -> Column:
    """Population variance of the five-point stencil over the inner cells of a matrix stored row by row."""
    at = lambda i: F.get(v, i)
    inner = F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: (i % width).between(1, width - 2) & (i / width >= 1) & (i < width * (height - 1)))
    stencil = F.transform(inner, lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i))
    mean = lambda x: total(x) / F.size(x)
    return F.element_at(F.transform(F.array(stencil), lambda s: mean(F.transform(s, lambda x: x * x)) - mean(s) * mean(s)), 1)


def modal_share(v: Column, scale: float, tolerance: int) -> Column:
    """Share of values whose bucket lies within ``tolerance`` of the most frequent bucket (of ties the smallest)."""
    if tolerance < 0 or scale <= 0:
        raise ValueError("tolerance must not be negative, scale must be above 0")
    buckets = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    count = lambda b, x: F.size(F.filter(b, lambda y: y == x))
    top = lambda b: F.array_max(F.transform(F.array_distinct(b), lambda x: F.struct(count(b, x).alias("n"), (-x).alias("x"))))["x"] * -1
    return F.element_at(F.transform(F.array(buckets), lambda b: F.element_at(F.transform(F.array(top(b)), lambda m: F.size(F.filter(b, lambda y: F.abs(y - m) <= tolerance)) / F.size(b)), 1)), 1)


def trim_box(v: Column, width: int, height: int, tolerance: float, padding: int = 0) -> Column:
    """``left, top, right, bottom`` (end exclusive) of the cells that differ from the background by more than ``tolerance``.

    The background is the most frequent corner, of ties the first in the order top left, top right, bottom left, bottom
    right. The box grows by ``padding`` and stays within the matrix; it is null where nothing differs.
    """
    if tolerance < 0 or padding < 0 or width < 1 or height < 1:
        raise ValueError("tolerance and padding must not be negative, sides must be 1 at least")
    corners = F.array(*(F.get(v, F.lit(i)) for i in (0, width - 1, width * (height - 1), width * height - 1)))
    often = lambda c: F.element_at(F.filter(c, lambda x: F.size(F.filter(c, lambda y: y == x)) == F.array_max(F.transform(c, lambda z: F.size(F.filter(c, lambda y: y == z))))), 1)
    cells = F.sequence(F.lit(0), F.lit(width * height - 1))
    differ = lambda b: F.filter(cells, lambda i: F.abs(F.get(v, i) - b) > tolerance)
    found = F.element_at(F.transform(F.transform(F.array(corners), often), differ), 1)
    box = lambda f: F.struct(
        F.greatest(F.lit(0), F.array_min(F.transform(f, lambda i: i % width)) - padding).alias("left"),
        F.greatest(F.lit(0), F.array_min(F.transform(f, lambda i: F.floor(i / width).cast("int"))) - padding).alias("top"),
        F.least(F.lit(width), F.array_max(F.transform(f, lambda i: i % width)) + 1 + padding).alias("right"),
        F.least(F.lit(height), F.array_max(F.transform(f, lambda i: F.floor(i / width).cast("int"))) + 1 + padding).alias("bottom"),
    )
    return F.element_at(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, box(f))), 1)


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """A detector's box widened by a share of its own size and clamped; whole numbers are cut towards zero."""
    if margin < 0:
        raise ValueError("margin must not be negative")
    dx, dy = (x2 - x1) * margin, (y2 - y1) * margin
    whole = lambda c: c.cast("int")
    return F.struct(
        F.greatest(F.lit(0), whole(x1 - dx)).alias("left"), F.greatest(F.lit(0), whole(y1 - dy)).alias("top"),
        F.least(whole(width), whole(x2 + dx)).alias("right"), F.least(whole(height), whole(y2 + dy)).alias("bottom"),
    )


def largest_box(boxes: Column) -> Column:
    """Of boxes (x1, y1, x2, y2), the first one of the largest area above 0; null if there is none."""
    areas = F.transform(boxes, lambda b, i: F.struct(((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).alias("area"), (-i).alias("i"), b.alias("box")))
    return F.array_max(F.filter(areas, lambda a: a["area"] > 0))["box"]


def asymmetry(left: Column, right: Column, centre: Column, width: Column) -> Column:
    """Mean over pairs of |distance left - distance right| to the centre line, by face width; null where the width is 0."""
    pairs = F.zip_with(left, right, lambda a, b: F.abs(F.abs(centre - a) - F.abs(b - centre)))
    return F.when(width > 0, total(pairs) / F.size(pairs) / width)


def worst_asymmetry(faces: Column) -> Column:
    """The largest asymmetry of several faces (left, right, centre, width); null without a face that has a width."""
    return F.array_max(F.transform(faces, lambda f: asymmetry(f["left"], f["right"], f["centre"], f["width"])))


def least_distance(xs: Column, ys: Column) -> Column:
    """Smallest distance between two of the points."""
    index = F.sequence(F.lit(0), F.size(xs) - 1)
    apart = lambda i, j: F.sqrt(F.pow(F.get(xs, i) - F.get(xs, j), F.lit(2.0)) + F.pow(F.get(ys, i) - F.get(ys, j), F.lit(2.0)))
    return F.array_min(F.flatten(F.transform(index, lambda i: F.transform(F.filter(index, lambda j: j > i), lambda j: apart(i, j)))))


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation of a pixel as a byte; 0 for black."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high > 0, F.floor((high - low) * 255 / high)).otherwise(F.lit(0)).cast("int")
