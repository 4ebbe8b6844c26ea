"""Joins of all near pairs of a metric space, in pieces of work of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Items whose distances to all others are known; the driver holds two numbers for each pair of them.
PIVOTS = 64
#: Bytes of a block, of which a task holds two, and items of a tile, which is compared at once.
BLOCK_BYTES, TILE = 8_000_000, 512
#: Where there would be more blocks than so many, they have up to so many bytes, so that rows are sent fewer times.
MANY, MOST_BYTES = 16, 20_000_000


class Space(NamedTuple):
    """Items as the rows of a matrix, the distances of a metric (rows by columns), and which pairs are near, as ``i, j, value``
    and how many pairs were compared to the end.

    ``near`` finds all pairs at most ``width`` apart; where distances are rounded, ``width`` is a little wider than that.
    """

    items: Callable[[pa.ChunkedArray | pa.Array], np.ndarray]
    distances: Callable[[np.ndarray, np.ndarray], np.ndarray]
    near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, int]]
    width: float


def dealt_evenly(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out in turn, for rows that are a piece of work each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _nearest(far: np.ndarray) -> np.ndarray:
    return far.argmin(1)


def _zones(cells: dict[int, tuple[int, np.ndarray, np.ndarray]], pivots: np.ndarray, size: int) -> list[tuple[list[int], int, np.ndarray, np.ndarray]]:
    """Cells joined to zones of at least ``size`` items, each next to the last along a walk over near pivots: cells, items, least
    and largest distance to every pivot."""
    left, walk = set(cells), []
    at = min(left, default=None)
    while left:
        walk.append(at)
        left.discard(at)
        at = min(left, key=lambda c: (pivots[at][c], c), default=None)
    zones: list[tuple[list[int], int, np.ndarray, np.ndarray]] = []
    for c in walk:
        n, low, high = cells[c]
        if zones and zones[-1][1] + n <= size:
            own, m, a, b = zones.pop()
            zones.append(([*own, c], m + n, np.minimum(a, low), np.maximum(b, high)))
        else:
            zones.append(([c], n, low, high))
    return zones


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> float:
    """How far two sets of items are from each other at least: the widest gap between their distances to one pivot."""
    return float(np.maximum(low - other_high, other_low - high).max(initial=0.0))


def _tiles(far: np.ndarray) -> list[np.ndarray]:
    """Items in tiles of near ones: by their nearest pivot, then by the distance to it."""
    nearest = _nearest(far)
    order = np.lexsort((far[np.arange(len(far)), nearest], nearest))
    return [order[k : k + TILE] for k in range(0, len(order), TILE)]


def _sample(rows: DataFrame) -> pa.Array:
    """The distinct items of the ``PIVOTS`` lowest hashes; a task keeps no more than so many."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            both = batch if kept is None else pa.concat_batches([kept, batch])
            _, first = np.unique(both.column("h").to_numpy(), return_index=True)
            kept = both.take(pa.array(first[:PIVOTS]))
        if kept is not None:
            yield kept

    kind = rows.schema["item"].dataType
    few = rows.select("item", F.xxhash64("item").alias("h")).mapInArrow(lowest, f"item {kind.simpleString()}, h long")
    return pa.array([r["item"] for r in few.groupBy("h").agg(F.min("item").alias("item")).orderBy("h").limit(PIVOTS).collect()], to_arrow_type(kind))


#: Which of the pairs of rows ``i, j`` are kept, by their place, and values of those that are.
Test = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]


def near_in_block(space: Space, x: np.ndarray, y: np.ndarray | None, pivots: np.ndarray, test: Test | None = None) -> tuple[list[np.ndarray], int]:
    """``i, j, value`` of the near items of ``x`` and ``y`` (None: of ``x``, each pair once) that pass a test, with its values, and how many
    pairs were compared to the end. What fails the test goes tile by tile."""
    sides = []
    for z in (x,) if y is None else (x, y):
        far = space.distances(z, pivots)
        sides.append([(t, far[t].min(0), far[t].max(0)) for t in _tiles(far)])
    none = np.zeros(0, int)
    found, compared = [(none, none, np.zeros(0), *(test(none, none)[1] if test else []))], 0
    for k, (s, low, high) in enumerate(sides[0]):
        for t, other_low, other_high in sides[-1][k if y is None else 0 :]:
            if _apart(low, high, other_low, other_high) > space.width:
                continue
            i, j, value, full = space.near(x[s], (x if y is None else y)[t])
            compared += full // 2 if y is None and s is t else full
            if y is None and s is t:
                upper = i < j
                i, j, value = i[upper], j[upper], value[upper]
            i, j = s[i], t[j]
            kept, values = test(i, j) if test else (slice(None), [])
            found.append((i[kept], j[kept], value[kept], *values))
    return [np.concatenate(z) for z in zip(*found, strict=True)], compared


def near_pairs(rows: DataFrame, space: Space, count: bool = False, tested: Callable[[pa.Table, pa.Table], Test] | None = None, values: str = "") -> DataFrame:
    """``a, b, value`` for each near pair of ``rows`` (``key``, ``item``; keys distinct, nothing null), ``a < b``.

    With ``count``, ``compared`` for each pair of blocks instead: how many pairs of items were compared to the end. ``tested`` makes a test
    of two blocks from what else ``rows`` have, and a pair that passes it has its ``values`` (a schema of doubles) too.

    Up to ``PIVOTS`` items are pivots. By the triangle inequality two items are at least as far apart as their distances to any pivot
    differ. Items fall into the cell of their nearest pivot, cells of few items are joined to zones, and a zone of many is
    split by a hash, so that a block has about ``BLOCK_BYTES`` (of many rows, up to ``MOST_BYTES``). Zones that some pivot tells apart are not paired; of what
    meets, tiles of near items are told apart likewise before they are compared, and most pairs of a tile by a part of the two
    items, if the width is small. A row is sent to each block pair that it
    is part of, and each pair is a group of its own.

    The driver holds the pivots and what pivots and cells have to do with each other. A small width spares most pairs; a
    wide one in a space without clusters compares all, which is quadratic work.
    """
    spark = rows.sparkSession
    kind = rows.schema["key"].dataType
    key, arrow = kind.simpleString(), to_arrow_type(kind)
    schema = "compared long" if count else f"a {key}, b {key}, value double{', ' * bool(values)}{values}"
    more = [c for c in rows.columns if c not in ("key", "item")]
    given = _sample(rows)
    if not len(given):
        return spark.createDataFrame([], schema)
    pivots = space.items(given)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = space.distances(space.items(batch.column("item")), pivots)
                cell = _nearest(far)
                held = np.unique(cell)
                low, high = (np.stack([f(far[cell == c], axis=0) for c in held]).astype(float) for f in (np.min, np.max))
                n = np.bincount(cell, minlength=len(pivots))[held]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, len(pivots)).astype(np.int32)), pa.array(np.tile(np.arange(len(pivots), dtype=np.int32), len(held))), pa.array(np.repeat(n, len(pivots))), pa.array(low.ravel()), pa.array(high.ravel())], names=["cell", "pivot", "n", "low", "high"])

    known = rows.select("key", "item").mapInArrow(placed, "cell int, pivot int, n long, low double, high double").groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    table = np.array(sorted(map(tuple, known.collect())), float).reshape(-1, len(pivots), 5)  # a row for each pair of pivots at most
    cells = {int(c[0, 0]): (int(c[0, 2]), c[:, 3], c[:, 4]) for c in table}
    size, most = (max(TILE, b // max(1, pivots[0].nbytes)) for b in (BLOCK_BYTES, MOST_BYTES))
    size = max(size, min(most, sum(n for n, _, _ in cells.values()) // MANY))
    zones = _zones(cells, space.distances(pivots, pivots), size)
    blocks = [-(-n // size) for _, n, _, _ in zones]
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    meets = [[w for w in range(len(zones)) if _apart(*zones[z][2:], *zones[w][2:]) <= space.width] for z in range(len(zones))]
    zone_of = np.zeros(len(pivots), np.int64)
    for z, (own, *_) in enumerate(zones):
        zone_of[own] = z

    def zoned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest(space.distances(space.items(batch.column("item")), pivots))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), pa.array(zone_of[cell])], names=["key", "item", "zone"])

    def zoned_with_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in zoned([batch]):
                yield pa.RecordBatch.from_arrays([*out.columns, *(batch.column(c) for c in more)], names=["key", "item", "zone", *more])

    at = lambda x: F.element_at(F.array(*map(F.lit, x)).cast("array<long>"), (F.col("zone") + 1).cast("int"))
    own = (at(first[:-1]) + F.pmod(F.xxhash64("key", F.lit(1)), at(blocks))).alias("own")
    partners = F.element_at(F.array(*(F.array(*map(F.lit, w)) for w in meets)).cast("array<array<long>>"), (F.col("zone") + 1).cast("int"))
    item = rows.schema["item"].dataType.simpleString()
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    zoned_rows = rows.select("key", "item", *more).mapInArrow(zoned_with_more, f"key {key}, item {item}, zone long{kinds}").select("key", "item", *more, own, F.explode(partners).alias("zone"))
    sent = zoned_rows.select("key", "item", *more, "own", F.explode(F.sequence(at(first[:-1]), at(first[1:]) - 1)).alias("other"))
    paired = sent.select("key", "item", *more, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))

    def compare(pair: pa.Table) -> pa.Table:
        left = np.asarray(pair.column("left"))
        same = pair.column("i")[0].as_py() == pair.column("j")[0].as_py()
        keys, items = np.asarray(pair.column("key")), space.items(pair.column("item"))
        sides = [pair] * 2 if same else [pair.filter(pair.column("left")), pair.filter(pc.invert(pair.column("left")))]
        test = tested(*sides) if tested and not count else None
        if same:
            k1 = k2 = keys
            (i, j, *found), compared = near_in_block(space, items, None, pivots, test)
        else:
            k1, k2 = keys[left], keys[~left]
            (i, j, *found), compared = near_in_block(space, items[left], items[~left], pivots, test)
        if count:
            return pa.table({"compared": pa.array([compared], pa.int64())})
        p, q = k1[i], k2[j]
        less = p < q
        names = ["value", *(v.split()[0] for v in values.split(",") if v)]
        return pa.table({"a": pa.array(np.where(less, p, q), arrow), "b": pa.array(np.where(less, q, p), arrow), **{n: pa.array(v.astype(float), pa.float64()) for n, v in zip(names, found, strict=True)}})

    return paired.groupBy("i", "j").applyInArrow(compare, schema)
