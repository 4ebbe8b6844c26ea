"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.ranges import range_of
from gleaner.llm.common import text_or_empty

#: Words of a paragraph at most; a longer line is cut after so many, counted from its start.
WORDS = 16
#: Bits of a slot in each of the three subtables: of the stored fingerprint, and of the retries.
BITS = (3, 5, 7)
#: Digests that a part of a larger sketch holds at most on average.
LOAD = 8
ROUNDS = 16
#: Bits of a digest that choose its part start here; those below choose its slots.
COARSE, FINE = 24, 44
_NO_KEYS = "cast(array() as array<bigint>)"


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\S+(?:[^\S\n]+\S+){{0,{WORDS - 1}}}"), F.lit(0))


def digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of a text's paragraphs."""
    return F.array_sort(F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p))))


def _with(cell: str, keys: str, sign: int, t: int, bits: int) -> str:
    """``cell`` with those of an array of digests whose slot in subtable t is i, counted as ``sign``."""
    hit = f"filter({keys}, d -> (shiftrightunsigned(d, {t * bits}) & {(1 << bits) - 1}) = i)"
    return f"aggregate({hit}, {cell}, (s, d) -> named_struct('n', s.n + {sign}, 'k', s.k ^ d, 'c', s.c ^ (xxhash64(d) & 4294967295)))"


def _cells(plus: str, minus: str | None, bits: int) -> str:
    """The sketch of an array of digests, less that of another: each of ``3 << bits`` cells sums counts and combines keys and checks by xor."""
    zero = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
    cell = lambda t: _with(zero, plus, 1, t, bits) if minus is None else _with(_with(zero, plus, 1, t, bits), minus, -1, t, bits)
    return f"concat({', '.join(f'transform(sequence(0, {(1 << bits) - 1}), i -> {cell(t)})' for t in range(3))})"


def _peeled(cells: str, bits: int) -> str:
    """The digests that peeling recovers from a difference of sketches, ``a`` with count 1 and ``b`` with -1, or null if some cell stays full.

    A round takes the digests of all pure cells out of their three cells; there are rounds as long as they find some.
    """
    pure = lambda n: f"array_distinct(transform(filter(z.cells, x -> x.n = {n} and x.c = (xxhash64(x.k) & 4294967295)), x -> x.k))"
    less = ", ".join(f"transform(slice(z.cells, {(t << bits) + 1}, {1 << bits}), (x, i) -> {_with(_with('x', 'p.a', -1, t, bits), 'p.b', 1, t, bits)})" for t in range(3))
    taken = f"if(size(p.a) + size(p.b) = 0, named_struct('cells', z.cells, 'a', z.a, 'b', z.b, 'go', false), named_struct('cells', concat({less}), 'a', concat(z.a, p.a), 'b', concat(z.b, p.b), 'go', true))"
    step = f"(z, r) -> if(z.go, element_at(transform(array(named_struct('a', {pure(1)}, 'b', {pure(-1)})), p -> {taken}), 1), z)"
    start = f"named_struct('cells', {cells}, 'a', {_NO_KEYS}, 'b', {_NO_KEYS}, 'go', true)"
    end = "z -> if(forall(z.cells, x -> x.n = 0 and x.k = 0L and x.c = 0L), named_struct('a', z.a, 'b', z.b, 'peeled', true), null)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, {step}, {end})"


def sketch(column: str) -> Column:
    """The sketch of a column of digests, as an array of cells."""
    return F.expr(_cells(column, None, BITS[0]))


def difference(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """What two columns of digests differ by, recovered from sketches: ``a`` and ``b``, the digests of one side alone, and
    ``peeled``, whether peeling alone recovered all of them.

    The two stored sketches are subtracted and peeled; where the sizes alone differ by more than a sketch has cells, that
    is left out. If it fails, larger sketches are made: the digests are dealt by other bits into so many parts that one
    holds ``LOAD`` at most on average, coarsely and then finely, and the parts' sketches are subtracted and peeled; a part that fails is made
    larger again. What is still full then (two digests that share all slots) is told from the sets, with ``peeled`` false.
    """
    pick = lambda keys, bit, i: f"filter({keys}, d -> pmod(shiftrightunsigned(d, {bit}), m) = {i})"
    one = "named_struct('a', array_except(q.a, q.b), 'b', array_except(q.b, q.a), 'peeled', false)"
    for bits in reversed(BITS):
        one = f"element_at(transform(array({_peeled(_cells('q.a', 'q.b', bits), bits)}), t -> if(t is null, {one}, t)), 1)"
    coarse = f"transform(sequence(0, m - 1), i -> named_struct('a', {pick(a, COARSE, 'i')}, 'b', {pick(b, COARSE, 'i')}))"
    fine = f"flatten(transform({coarse}, g -> transform(sequence(0, m - 1), j -> named_struct('a', {pick('g.a', FINE, 'j')}, 'b', {pick('g.b', FINE, 'j')}))))"
    parts = f"transform({fine}, q -> if(size(q.a) + size(q.b) = 0, named_struct('a', {_NO_KEYS}, 'b', {_NO_KEYS}, 'peeled', true), {one}))"
    root = f"cast(ceil(sqrt((size({a}) + size({b})) / {LOAD})) as int)"
    whole = f"element_at(transform(array({root}), m -> element_at(transform(array({parts}), r -> named_struct('a', flatten(transform(r, x -> x.a)), 'b', flatten(transform(r, x -> x.b)), 'peeled', forall(r, x -> x.peeled))), 1)), 1)"
    apart = f"zip_with({sketch_a}, {sketch_b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"
    small = f"if(abs(size({a}) - size({b})) > {3 << BITS[0]}, null, {_peeled(apart, BITS[0])})"
    return F.expr(f"element_at(transform(array({small}), s -> if(s is null, {whole}, s)), 1)")


def likeness(a: str, b: str, apart: str) -> Column:
    """The share of two texts' paragraphs that both have: 1 for equal sets (also two empty ones), 0 where none is shared."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise((total - F.size(f"{apart}.a") - F.size(f"{apart}.b")) / total)


def fingerprint(column: str, cells: str) -> Column:
    """The stored sketch as text: the number of digests, then count, key and check of each cell in hex."""
    return F.expr(f"concat(size({column}), ':', array_join(transform({cells}, x -> concat(hex(x.n), '.', hex(x.k), '.', hex(x.c))), ','))")


def with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, text, marks, cells`` (digests and their sketch), and ``next_`` with each. Every row gets the next one by descending id; the first follows the last.

    Ids are cut into as many ranges as the session has shuffle partitions, at quantiles, and a partition is a range. The first row of a range is
    also sent to the range above, so one shuffle of the rows is enough and no window spans more than a range. The driver
    gets a row for each range. Equal ids go by a hash of their text and stay in one range; null ids come last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty("text").alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    part = range_of(F.col("id").cast("long"), bounds, "long")
    tops = sorted(ids.groupBy(part.alias("part")).agg(F.max("id").alias("top")).collect(), reverse=True)  # a row for each range
    sends = [(lower["top"], upper["part"]) for upper, lower in zip(tops, tops[1:], strict=False)] + ([(tops[0]["top"], tops[-1]["part"])] if tops else [])
    targets: dict[int | None, list[int]] = {}
    for top, to in sends:
        targets.setdefault(top, []).append(to)
    sent = F.broadcast(spark.createDataFrame(list(targets.items()), "top long, to array<int>"))  # a row for each range
    none = F.array().cast("array<struct<part:int,copy:boolean>>")
    copies = F.coalesce(F.transform("to", lambda p: F.struct(p.alias("part"), F.lit(True).alias("copy"))), none)
    placed = rows.withColumn("own", part).join(sent, F.col("id").cast("long").eqNullSafe(F.col("top")), "left")
    dealt = placed.select("id", "text", F.explode(F.concat(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("copy"))), copies)).alias("place"))
    dealt = dealt.select("id", "text", "place.part", "place.copy").repartitionByRange(n, "part")
    marked = dealt.withColumn("marks", digests(F.col("text"))).withColumn("cells", sketch("marks"))
    down = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("id"), F.xxhash64("text"))
    after = marked.withColumns({f"next_{c}": F.lead(c).over(down) for c in ("text", "marks", "cells")})
    return after.where("not copy").drop("part", "copy")


def compare_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for ``docs`` (doc_id, text), then
    ``removed`` and ``added``, the recovered digests of paragraphs that only the text, and only its edited text, has (hex,
    sorted, comma-joined), and ``peeled``, whether peeling alone recovered them and those of the next text.

    A null text is empty; an empty text has no paragraphs, and is like another empty one. Very long texts are compared whole.
    Repeated rows follow each other and are alike. A single row follows itself; an empty table gives an empty one. Other
    columns are not read, whatever their names.
    """
    rows = with_next(docs.select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = rows.select("id", n.cast("long").alias("n_chars"), "marks", "cells", "next_marks", "next_cells", edited.alias("edited"))
    made = made.withColumn("edited_marks", digests(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    made = made.withColumn("edited_cells", sketch("edited_marks"))
    made = made.withColumn("apart", difference("marks", "edited_marks", "cells", "edited_cells"))
    made = made.withColumn("further", difference("marks", "next_marks", "cells", "next_cells"))
    side = lambda keys: F.array_join(F.transform(F.array_sort(keys), F.hex), ",")
    return made.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint("marks", "cells").alias("fingerprint"), fingerprint("edited_marks", "edited_cells").alias("edited_fingerprint"),
        likeness("marks", "edited_marks", "apart").alias("near_edited"), likeness("marks", "next_marks", "further").alias("near_next"),
        side("apart.a").alias("removed"), side("apart.b").alias("added"), (F.col("apart.peeled") & F.col("further.peeled")).alias("peeled"),
    )
