"""Merkle manifests: trees of eight over the documents of each group, hashed by DuckDB in aligned blocks."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import lower_ascii, written
from gleaner.operators.graph import drop_written

#: Nodes that become one, and levels of a block: 4096 leaves.
FAN, HEIGHT = 8, 4
#: Characters of a digest.
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: list[Column]) -> Column:
    """sha256, as lower-case hex, of each value's number of UTF-8 bytes, a colon and the value; of ``-`` for a null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place in their group from 0, and ``n``, the group's size.

    The rows are range partitioned by group and order, sorted and written. A row's place in its file then tells its place in
    the group but for what other files and groups hold before it: a table of a row for each file, and for each group in it.
    """
    keys = [group, *order]
    sorted_ = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), "ordered")
    placed = sorted_.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file__"), F.col("_metadata.row_index").alias("row__"))
    sizes = placed.groupBy("file__", group).agg(F.count(F.lit(1)).alias("size"), F.min("row__").alias("first"))
    inside = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(inside.orderBy("file__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("file__", group, (before - F.col("first")).alias("shift__"), F.sum("size").over(inside).alias("n"))
    return placed.join(shifts, ["file__", group]).withColumn("at", F.col("row__") + F.col("shift__")).drop("file__", "row__", "shift__")


@functools.cache
def _engine():
    """The task's DuckDB, which keeps nothing on disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _levels(n: int) -> int:
    """Levels above ``n`` nodes until one remains, as far as a block goes."""
    up = 0
    while n > 1 and up < HEIGHT:
        n, up = -(-n // FAN), up + 1
    return up


def _runs(levels: int) -> str:
    """Level queries over ``block``: ``run0, run1, ..`` have the joined hashes below each node, ``level1, level2, ..`` the nodes."""
    ctes = ["level0 AS (SELECT place AS p, leaf AS hash FROM block)"]
    for k in range(levels):
        ctes.append(f"run{k} AS (SELECT p // {FAN} AS up, string_agg(hash, '' ORDER BY p) AS run FROM level{k} GROUP BY up)")
        ctes.append(f"level{k + 1} AS (SELECT up AS p, sha256(run) AS hash FROM run{k})")
    return ", ".join(ctes)


def _block_root(block: pa.Table) -> pa.Table:
    con, levels = _engine(), _levels(block.column("n")[0].as_py())
    con.register("block", block)
    root = con.execute(f"WITH {_runs(levels)} SELECT hash FROM level{levels}").fetchall()
    con.unregister("block")
    first = block.slice(0, 1)
    return pa.table({"named": first.column("named"), "bucket": first.column("bucket"), "n": first.column("n"), "hash": [h for (h,) in root]})


def _fold(block: pa.Table, outer: pa.Table, proofs: bool, names: list[str]) -> pa.Table:
    """Each leaf's siblings up to the root, and the root that its changed hash leads to."""
    con, levels = _engine(), _levels(block.column("n")[0].as_py() if block.num_rows else 1)
    top = outer.to_pylist()[0]
    con.register("block", block)
    ctes = [_runs(levels), "fold0 AS (SELECT * EXCLUDE (changed), changed AS folded, '' AS proof FROM block)"]
    for k in range(levels):
        at = f"(place // {FAN**k} % {FAN} * {HEX})"
        left, right = f"left(run, {at})", f"substring(run, {at} + {HEX + 1})"
        ctes.append(f"fold{k + 1} AS (SELECT f.* REPLACE (sha256({left} || folded || {right}) AS folded, proof || {left} || {right} AS proof) FROM fold{k} f JOIN run{k} ON up = place // {FAN ** (k + 1)})")
    k, given = levels, []
    for side in top["sides"]:
        given += [side["left"], side["right"]]
        ctes.append(f"fold{k + 1} AS (SELECT * REPLACE (sha256(${len(given) - 1}::VARCHAR || folded || ${len(given)}::VARCHAR) AS folded, proof || ${len(given) - 1}::VARCHAR || ${len(given)}::VARCHAR AS proof) FROM fold{k})")
        k += 1
    given += [top["subroot"], top["root"]]
    last = f"SELECT id, leaf, ${len(given) - 1}::VARCHAR AS subroot, ${len(given)}::VARCHAR AS root, sha256(proof) AS proof_sha256, folded AS folded_root{', proof' if proofs else ''} FROM fold{k}"
    found = con.sql(f"WITH {', '.join(ctes)} {last}", params=given).to_arrow_table()
    con.unregister("block")
    return found.select(names)


def _outer(nodes: DataFrame) -> DataFrame:
    """``named, bucket, sides, top`` for ``named, bucket, n, hash``: siblings on either side, level by level, up to the group's one node.

    Levels are grouped by Spark from below and their proofs joined from above; a level has an eighth of the rows of the one below.
    """
    level = written(nodes.select("named", F.col("bucket").alias("at"), "n", "hash"), "level")
    runs, old, most = [], [], level.agg(F.max("n")).first()[0] or 0
    while most > 1:
        many = level.where("n > 1").groupBy("named", F.expr(f"at div {FAN}").alias("at"))
        joined = many.agg(F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("below"))
        run = written(joined.withColumn("hash", F.sha2(F.array_join("below.hash", "").cast("binary"), 256)), "run")
        runs.append(run)
        old += [run, level]
        level = written(level.where("n = 1").unionByName(run.drop("below")), "level")
        most = -(-most // FAN)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    done = level.select("named", "at", empty.alias("sides"), F.col("hash").alias("top"))
    for run in reversed(runs):
        hashes = lambda a, n: F.array_join(F.slice("below.hash", a, n), "")
        side = F.struct(hashes(F.lit(1), F.col("k")).alias("left"), hashes(F.col("k") + 2, F.lit(FAN)).alias("right"))
        below = run.join(done, ["named", "at"]).select("named", "below", "sides", "top", F.posexplode("below").alias("k", "node"))
        small = done.join(run.select("named", "at"), ["named", "at"], "left_anti")  # groups that had one node already
        old.append(done)
        done = written(below.select("named", F.col("node.at").alias("at"), F.concat(F.array(side), "sides").alias("sides"), "top").unionByName(small), "proof")
    for table in old:
        drop_written(table)
    return done.withColumnRenamed("at", "bucket")


def fold_proofs(rows: DataFrame, proofs: bool = True) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root`` for ``named`` (the group, never null), ``id, leaf, changed``.

    Leaves stand in each group by id, nulls first, then by hash. Every ``FAN`` consecutive nodes, and the rest, become the
    sha256 of their hashes, until one remains; the groups' last nodes, in the order of their names, likewise. ``proof_sha256`` is that
    of the siblings on the way to the root, from below and from left to right, ``folded_root`` the root that comes of
    ``changed`` with these siblings; ``proofs`` adds the siblings as ``proof``. An empty table gives an empty one.

    A group is cut into blocks of ``FAN ** HEIGHT`` leaves, which are whole subtrees; tasks get them as Arrow and run the level
    queries in DuckDB. Spark combines the blocks' roots and joins the proofs above a block to it, so a task never sees more
    than one block, however large a group is, and what a leaf carries through shuffles is its hashes.
    """
    size = FAN**HEIGHT
    placed = in_order(rows.select("named", "id", "leaf", "changed"), "named", ["id", "leaf", "changed"])
    blocks = placed.select("named", F.expr(f"at div {size}").alias("bucket"), (F.col("at") % size).alias("place"), "n", "id", "leaf", "changed")
    nodes = blocks.select("named", "bucket", "place", "n", "leaf").groupBy("named", "bucket").applyInArrow(_block_root, "named string, bucket long, n long, hash string")
    inner = _outer(nodes.withColumn("n", F.expr(f"(n + {size - 1}) div {size}")))
    subroots = in_order(inner.where("bucket = 0").select(F.lit("").alias("all"), F.col("named").alias("name"), F.col("top").alias("hash")), "all", ["name"])
    above = _outer(subroots.select("name", F.lit("").alias("named"), F.col("at").alias("bucket"), "n", "hash"))
    named = subroots.select(F.col("name").alias("named"), F.col("at").alias("k")).join(above.select(F.col("bucket").alias("k"), F.col("sides").alias("more"), F.col("top").alias("root")), "k")
    outer = written(inner.join(named, "named").select("named", "bucket", F.concat("sides", "more").alias("sides"), F.col("top").alias("subroot"), "root"), "outer")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof string" * proofs
    names = [c for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof") if proofs or c != "proof"]
    return blocks.groupBy("named", "bucket").cogroup(outer.groupBy("named", "bucket")).applyInArrow(lambda block, top: _fold(block, top, proofs, names), schema)


def dataset_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None, proofs: bool = True) -> DataFrame:
    """The manifest of ``docs``: for each row ``leaf, subroot, root, proof_sha256, folded_root, verified`` and its id.

    ``columns`` make a leaf; ``changed`` has expressions for columns that are checked in place of the original ones: where they
    change a value, ``folded_root`` differs from ``root`` and ``verified`` is false. Null values have a mark of their own, and null
    groups are one group before all others; repeated rows and ids are leaves of their own. For proofs see ``fold_proofs``.
    """
    of = lambda c: F.col(f"`{c}`")
    leaf = leaf_hash([of(c) for c in columns])
    differs = leaf_hash([(changed or {}).get(c, of(c)) for c in columns]) if changed else leaf
    named = F.coalesce(F.concat(F.lit("+"), of(group_col).cast("string")), F.lit(""))
    leaves = written(docs.select(named.alias("named"), of(id_col).alias("id"), leaf.alias("leaf"), differs.alias("changed")), "leaves")
    found = fold_proofs(leaves, proofs).withColumn("verified", F.col("folded_root") == F.col("root"))
    drop_written(leaves)
    return found.withColumnRenamed("id", id_col)


def merkle_digest(docs: DataFrame) -> DataFrame:
    """``documents`` with the text's A-Z lower-cased where 3 divides the id's crc32: what the proofs say of each row."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(touched, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return dataset_manifest(docs, changed={"text": text}, proofs=False)
