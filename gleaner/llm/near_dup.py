"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union of links."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written
from gleaner.llm.words import hash_texts, mix, shingles
from gleaner.operators.graph import connected_components, drop_written

#: Chance that the bands miss a link of exactly the threshold.
MISS = 1e-8
ROWS = 4
#: Sets in a block, and shingles of all of them together, on average; blocks are verified in pairs.
TILE, SHINGLES = 256, 1 << 18
#: Bits of the map that tells which rows' sets may be wanted; 8 MB, whatever the input.
MAP_BITS = 1 << 26
_BLOCK = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def n_bands(threshold: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)) if threshold < 1 else 1


def super_minhash(ids: np.ndarray, size: int) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes, as ``rank << 32 | fraction``.

    Element i gives slot pi_i(j) the value j + u_ij, where pi_i is a random permutation made by a Fisher-Yates shuffle
    that goes on only while a rank can still lower some slot. All elements of a block take step j at once, which gives
    the same minima as one element after another.
    """
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for at in range(0, len(ids), _BLOCK):
        block = ids[at : at + _BLOCK]
        every = np.arange(len(block))
        order: np.ndarray | None = None
        for j in range(size):
            if (out.max() >> half) < j:
                break
            r = mix(block + np.array([j + 1], np.uint64) * _GOLDEN)
            k = (j + (((r & low) * np.uint64(size - j)) >> half)).astype(np.int64)
            if j == 0:
                slot, first = k, k
            else:
                if order is None:
                    order = np.tile(np.arange(size, dtype=np.uint16 if size < 1 << 16 else np.uint32), (len(block), 1))
                    order[every, first] = 0
                slot = order[every, k].astype(np.int64)
                order[every, k] = order[:, j]
            np.minimum.at(out, slot, (np.uint64(j) << half) | (r >> half))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    key = mix(np.arange(bands, dtype=np.uint64) + _GOLDEN)
    for k in range(rows):
        key = mix(key ^ (parts[:, k] * _GOLDEN + np.uint64(k)))
    return key.view(np.int64)


def _signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``id, h, n, digest, keys``: a hash of the row, set size, 128-bit digest of the set and band keys of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys = [], [], []
            for _, w in hash_texts(batch.column(2).to_pylist()):
                s = shingles(w, words)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(band_keys(super_minhash(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(keys)], names=["id", "h", "n", "digest", "keys"])

    return docs.mapInArrow(task, f"id {docs.dtypes[0][1]}, h long, n long, digest binary, keys array<long>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x.view(np.int64) for x in parts]) if parts else np.zeros(0, np.int64)))


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes ``h``, of which the driver gets ``MAP_BITS`` at most."""
    bit = F.pmod("h", F.lit(MAP_BITS))
    parts = hashes.select(F.floor(bit / 32768).alias("part"), (bit % 32768).alias("bit")).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toPandas()
    out = np.zeros((MAP_BITS // 32768, 4096), np.uint8)
    for part, bits in zip(parts["part"], parts["bits"], strict=True):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``digest, ids``: the sets of the rows of ``docs`` whose hash ``h`` is in ``wanted`` (digest, h), each once.

    A map of bits passes over most other rows before their texts are hashed, and no text is shuffled. What passes by
    chance goes in the join. A task gives a row's set once, so that repeated rows cost nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(wanted))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, np.zeros(0, np.int64)
        for batch in batches:
            h = batch.column(1).to_numpy()
            at = h % MAP_BITS
            some = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            some = some[np.sort(np.unique(h[some], return_index=True)[1])]
            some = some[~np.isin(h[some], seen)]
            seen = np.concatenate((seen, h[some]))
            texts = batch.column(2).take(pa.array(some))
            for low in range(0, len(some), 256):
                got = [shingles(w, words) for _, w in hash_texts(texts[low : low + 256].to_pylist())]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in got]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), _lists(got)], names=["digest", "ids"])

    found = docs.mapInArrow(task, "digest binary, ids array<long>")
    return found.join(wanted.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("ids").alias("ids"))


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: Fraction) -> list[tuple[int, int]]:
    """Pairs of a left and a right set (right None: of two left sets) whose intersection is at least ``threshold`` of their union."""
    sets = left + (right or [])
    n = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    often = np.bincount(place, minlength=len(values)) > 1
    place, owner = place[often[place]], owner[often[place]]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(left), len(right) if right else len(left)), np.float64)
    for low in range(0, len(values), 4096):
        a, b = np.searchsorted(place, (low, low + 4096))
        if a == b:
            continue
        columns, at = np.unique(place[a:b], return_inverse=True)
        grid = np.zeros((len(sets), len(columns)), np.float32)
        grid[owner[a:b], at] = 1
        common += grid[: len(left)] @ (grid[len(left) :] if right else grid).T
    union = n[: len(left), None] + (n[len(left) :] if right else n)[None, :] - common
    found = threshold.denominator * common >= threshold.numerator * union
    if right is None:
        found = np.triu(found, 1)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(found), strict=True)]


def _forest(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """As few of the pairs as link the same items."""
    top = list(range(size))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            top[x] = y
            out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, rows: int = ROWS) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts whose sets of word shingles have a Jaccard similarity of at least ``threshold``, taken as the decimal number that it
    prints as, are linked; a component is named by its smallest id and keeps that row.

    1. Rows with equal sets form a class, found by a digest of the set; only classes go on, so copies cost nothing.
    2. Each class spreads its SuperMinHash signature over bands; the number of bands makes the chance to miss a link at
       the threshold at most ``MISS``. In a bucket, all classes are paired with the smallest (a star, never all pairs),
       and each pair is verified on its full sets. A leader's set goes once to each block of its members.
    3. A bucket of three or more classes which the verified links leave in several components may hide links between
       members that are both unlike the smallest. Such buckets are joined into groups, and each group is verified block
       by block. Members that the first links have already united are not compared with each
       other. Pairs of blocks are dealt out evenly, and each returns a forest of its links, so its output is linear in
       its sides.
    4. Components of all links; class members take the component of their class.

    Null texts, and texts without words, have an empty set and link with nothing. Texts of fewer than ``words`` words have
    one shingle. Rows that repeat an id are classes of their own texts and share a component only if linked; of equal rows
    all that have the smallest id count as kept, so a caller that wants one of them gives ids that differ. A null id
    takes part, but is never the smallest unless all are null. An empty table gives an empty one. Columns other than the
    two are not read, whatever their names.
    """
    share = Fraction(str(threshold))
    if not 0 < share <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    bands = n_bands(threshold, rows)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    narrow = narrow.select("id", F.xxhash64("id", "text").alias("h"), "text")
    signed = written(_signatures(narrow, words, bands, rows), "signed")
    classes = written(signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    banded = classes.select("digest", F.explode("keys").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.min("digest").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    stars = written(banded.join(buckets, "key").where("digest <> leader").select("leader", "digest").distinct(), "stars")
    wanted = classes.join(stars.select("leader").unionByName(stars.select(F.col("digest").alias("leader"))).distinct().withColumnRenamed("leader", "digest"), "digest", "left_semi")
    sets = written(_sets(narrow, written(wanted.select("digest", "h"), "wanted"), words), "sets")
    sized = classes.select("digest", "n")
    links = written(_starred(written(stars.join(sized, "digest"), "sized"), sets, share), "links")
    united = written(connected_components(links, "leader", "digest"), "united")

    mixed = banded.join(buckets.where("size > 2"), "key").select("key", "leader", "digest").join(united.withColumnRenamed("node", "digest"), "digest", "left")
    mixed = mixed.withColumn("part", F.coalesce("component", "digest"))
    open_keys = mixed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    rest = written(mixed.join(open_keys, "key").select("leader", "digest", "part").distinct(), "rest")
    more = written(_tiled(rest.join(sized, "digest"), sets, share), "more")
    parts = written(connected_components(links.unionByName(more), "leader", "digest"), "parts")

    reps = classes.select("digest", "rep")
    member = parts.join(reps, parts.node == reps.digest).select("digest", "component", "rep")
    lowest = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(reps.join(member.join(lowest, "component").select("digest", "component_id"), "digest", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id")), "named")
    for table in (buckets, stars, sets, links, united, rest, more, parts, classes):
        drop_written(table)
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _chunks(n: str, shingles_: str) -> Column:
    """How many blocks so many sets with so many shingles make."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / TILE), F.ceil(F.col(shingles_) / SHINGLES)).cast("long")


def _linked(rows: DataFrame, by: list[str], threshold: Fraction) -> DataFrame:
    """``leader, digest``: a forest of the links between the two sides (0 and 1) of each group of ``rows`` (side, digest, part, ids),
    or within side 0 where that is all. A group is two blocks at most, so a task holds little more than that."""

    def task(table: pa.Table) -> pa.Table:
        side, digest, parts = np.array(table.column("side")), table.column("digest").to_pylist(), table.column("part").to_pylist()
        sets = [np.asarray(x.values).view(np.uint64) for x in table.column("ids")]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs = tile_links([sets[k] for k in left], [sets[k] for k in right] if len(right) else None, threshold) if len(left) else []
        to = right if len(right) else left
        pairs = [(int(left[a]), int(to[b])) for a, b in pairs]
        pairs = _forest([(a, b) for a, b in pairs if parts[a] != parts[b]], len(digest))
        return pa.table({"leader": pa.array([digest[a] for a, _ in pairs], pa.binary()), "digest": pa.array([digest[b] for _, b in pairs], pa.binary())})

    return rows.groupBy(*by).applyInArrow(task, "leader binary, digest binary")


def _starred(stars: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The links of ``stars`` (leader, digest, n) between a leader and its members."""
    large = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).select("leader", _chunks("k", "s").alias("chunks")).where("chunks > 1")
    dealt = stars.join(written(large, "large"), "leader", "left").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.coalesce("chunks", F.lit(1))))
    members = dealt.select("leader", "chunk", F.lit(1).alias("side"), "digest")
    leaders = members.select("leader", "chunk").distinct().select("leader", "chunk", F.lit(0).alias("side"), F.col("leader").alias("digest"))
    rows = members.unionByName(leaders).withColumn("part", F.col("digest")).join(sets, "digest")
    return _linked(rows, ["leader", "chunk"], threshold)


def _tiled(rest: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links within the groups that ``rest`` (leader, digest, part, n) forms, between members of different parts.

    A group's largest part has blocks of its own, numbered after the others; two of those need no look. Pairs of blocks
    are dealt out by ranges of their rows, so tasks get about as many each.
    """
    groups = connected_components(rest.where("leader <> digest").select("leader", "digest"), "leader", "digest").select(F.col("node").alias("digest"), F.col("component").alias("gid"))
    members = written(rest.select("digest", "part", "n").distinct().join(groups, "digest"), "members")
    by_part = members.groupBy("gid", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    sizes = by_part.groupBy("gid").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.max(F.struct("k", "part", "s")).alias("main"))
    sizes = sizes.select("gid", F.col("main.part").alias("main"), F.col("main.k").alias("k_main"), F.col("main.s").alias("s_main"), (F.col("k") - F.col("main.k")).alias("k_rest"), (F.col("s") - F.col("main.s")).alias("s_rest"))
    sizes = written(sizes.select("gid", "main", _chunks("k_main", "s_main").alias("c_main"), _chunks("k_rest", "s_rest").alias("c_rest")), "sizes")
    seed = F.xxhash64("digest")
    chunk = F.when(F.col("part") == F.col("main"), F.col("c_rest") + F.pmod(seed, "c_main")).otherwise(F.pmod(seed, "c_rest"))
    placed = members.join(sizes, "gid").select("gid", "digest", "part", "c_main", "c_rest", chunk.alias("chunk"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("c_rest") + F.col("c_main") - 1), lambda j: (j < F.col("c_rest")) | (F.col("chunk") < F.col("c_rest")))
    tiles = placed.select("gid", "digest", "part", "chunk", F.explode(others).alias("other"))
    tiles = tiles.select("gid", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "digest", "part")
    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _linked(tiles.join(sets, "digest").repartitionByRange(n, "gid", "i", "j"), ["gid", "i", "j"], threshold)


def near_dup_digest(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` of three words at 0.85, with the id as ``doc_id``; nulls, ties and repeated rows as there."""
    out = near_duplicates(docs, words=3, threshold=0.85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
