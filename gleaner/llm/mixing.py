"""Sources mixed to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import text_or_empty, with_row_key, written
from gleaner.operators.graph import drop_written
from gleaner.operators.ranking import global_rank

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that are queued as one; a longer text is several in a row.
PACKET = 256
#: Parts of a source, by the first three hex digits of the shuffle key.
BINS = 4096


def size_in_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> tuple[DataFrame, float]:
    """``sizes`` (of ``source`` and ``source_size``) with ``target``, and the sum of all targets.

    Sources in code-point order, null last, have the weights in turn and share ``share`` times all words by them. No target
    is above ``repeats`` times its source's size; what is above is shared again by weight until none is. Each sharing is
    one aggregate over the sources, of which three numbers come to the driver.
    """
    if not 0 <= share <= repeats or min(weights) <= 0:
        raise ValueError("share must lie between 0 and repeats, and weights above 0")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(global_rank(sizes, [F.asc_nulls_last("source")]).select("source", "source_size", weight.alias("weight")), "sources")
    most = F.col("source_size") * repeats
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = (most < F.col("weight") * F.lit(level)) & F.lit(n_full >= 0)
        n, given, open_weight = ranked.agg(F.coalesce(F.sum(full.cast("long")), F.lit(0)), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == n_full or not open_weight:
            break
        level, n_full = (budget - (given or 0)) / open_weight, n
    return ranked.select("source", "source_size", F.least(most.cast("double"), F.col("weight") * F.lit(level)).alias("target")), budget


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """What the mix takes of each row: ``row_key, id, size, source_size, target, start, reached, taken``.

    The documents of a source queue in the order of a hash of id and text, up to ``repeats`` times over. They are cut into packets
    of at most ``PACKET`` words; a packet's virtual finish time is the number of the source's words up to its end divided by the
    source's target. All packets are range partitioned by finish time, and the mix ends where the words of all ranges
    before reach the budget; of the last packet only what is left of the budget is taken. So a source gets its target up
    to about a packet, and no text is taken more than ``repeats`` times.

    A source may hold any share of the rows: places in its queue are summed within ``BINS`` parts of it. Nothing but three
    numbers, and one for each range of packets, comes to the driver. ``start`` is the row's place in its source's queue,
    ``reached`` how many words of that queue are taken, which makes ``taken`` a sum over the row's passes.

    Null and empty texts, and those of white space, have size 0 and nothing is taken. A null id counts as an empty one in the
    hash, a null source is a source of its own. Rows of equal id and text are interchangeable and lie in one part. An empty
    table gives an empty one. The same rows give the same plan, whatever their partitions.
    """
    keyed = with_row_key(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source")))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # never null, so that it joins and partitions plainly
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), text_or_empty("text")).cast("binary"))
    sized = written(keyed.select("row_key", "id", named.alias("named"), size_in_words(F.col("text")).alias("size"), key.alias("key")).withColumn("bin", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")), "sized")
    bins = written(sized.groupBy("named", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    source = F.when(F.col("named") != "", F.substring("named", 2, 2**31 - 1))
    targets, budget = source_targets(bins.groupBy("named").agg(F.sum("bin_size").alias("source_size")).select(source.alias("source"), "source_size"), weights, share, repeats)
    targets = targets.select(named.alias("named"), "source_size", "target")
    before = F.sum("bin_size").over(Window.partitionBy("named").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    begun = bins.select("named", "bin", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("size").over(Window.partitionBy("named", "bin").orderBy("key", "row_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")

    def placed(of_source: DataFrame) -> DataFrame:
        return sized.withColumn("within", within).join(begun.join(of_source, "named"), ["named", "bin"]).withColumn("start", F.col("before") + F.col("within"))

    ranged = written(_packets(placed(targets), repeats), "packets")
    reached = written(_truncated(ranged, int(budget)), "reached")
    drop_written(ranged)
    found = placed(targets.join(reached, "named", "left").withColumn("reached", F.coalesce("reached", F.lit(0))))
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("reached") - F.col("start") - F.col("source_size") * k)) for k in range(repeats)]
    return found.select("row_key", "id", "size", "source_size", "target", "start", "reached", sum(passes[1:], passes[0]).cast("long").alias("taken"))


def _packets(placed: DataFrame, repeats: int) -> DataFrame:
    """Packets of all passes, range partitioned by finish time; of equal times the source and the place in its queue decide."""
    queued = placed.where("size > 0 and target > 0").select("named", "size", "source_size", "target", "start", F.explode(F.expr(f"sequence(0, {repeats - 1})")).alias("pass"))
    cut = queued.select("*", F.explode(F.expr(f"sequence(0L, (size - 1) div {PACKET})")).alias("k"))
    end = F.least(F.col("size"), (F.col("k") + 1) * PACKET)
    ended = cut.select("named", (F.col("start") + F.col("pass") * F.col("source_size") + end).alias("end"), (end - F.col("k") * PACKET).alias("words"), "target")
    timed = ended.select((F.col("end") / F.col("target")).alias("finish"), "named", "end", "words")
    return timed.repartitionByRange("finish", "named", "end").withColumn("part", F.spark_partition_id())


def _truncated(ranged: DataFrame, budget: int) -> DataFrame:
    """``named, reached``: how far each source's queue is taken once ``budget`` words are, in order of finish times."""
    last, left = -1, budget
    for part, words in sorted((r["part"], r["words"]) for r in ranged.groupBy("part").agg(F.sum("words").alias("words")).collect()):
        last = part
        if words >= left:
            break
        left -= words
    order = Window.orderBy("finish", "named", "end").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.where(F.col("part") == last).withColumn("run", F.sum("words").over(order))  # the rows of one range
    over = F.greatest(F.lit(0), F.col("run") - left)
    rim = run.where(F.col("run") - F.col("words") < left).select("named", (F.col("end") - over).alias("reached"))
    return ranged.where(F.col("part") < last).select("named", F.col("end").alias("reached")).unionByName(rim).groupBy("named").agg(F.max("reached").alias("reached"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix itself: the columns of ``docs`` for each time that a document is taken, with ``finish``, its virtual finish time there.

    The text ends with the last word taken. Sorting by ``finish`` gives the order of the queues. Columns named ``finish``
    and ``row_key`` are left out. For odd rows see ``mix_plan``.
    """
    rows = with_row_key(docs.drop("row_key"))
    plan = mix_plan(rows.drop("row_key"), id_col, text_col, source_col, weights, share, repeats).select("row_key", "size", "source_size", "target", "start", "reached")
    passes = plan.select("*", F.explode(F.expr(f"sequence(0, {repeats - 1})")).alias("pass")).withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
    taken = passes.withColumn("words", F.least(F.col("size"), F.col("reached") - F.col("from"))).where("words > 0")
    took = taken.select("row_key", F.when(F.col("words") < F.col("size"), F.col("words").cast("int")).alias("words__"), ((F.col("from") + F.col("words")) / F.col("target")).alias("finish__"))
    cut = F.array_join(F.slice(F.regexp_extract_all(f"`{text_col}`", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words__")), "")
    text = F.when(F.col("words__").isNull(), F.col(f"`{text_col}`")).otherwise(cut)
    both = rows.drop("finish").join(took, "row_key")
    return both.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns if c not in ("finish", "row_key")), F.col("finish__").alias("finish"))


def mixing_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``reached``."""
    return mix_plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "reached")
