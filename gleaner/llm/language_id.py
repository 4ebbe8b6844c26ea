"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, numbered_columns, written
from gleaner.operators.graph import drop_written
from gleaner.operators.ranking import global_rank

ORDER = 4
#: n-grams rarer than this share of their language's symbols are left to the lower order: none, so the model grows with
#: the distinct n-grams of the corpus.
MIN_SHARE = 0.0
#: Texts fall into FOLDS by a hash. All of them calibrate, each by a model of the other folds; the model that is used has learned
#: all.
FOLDS = 2
ALL = "all"
#: A text is rejected where its cross-entropy has gone a calibrated part of the way from that of own texts to that of foreign
#: ones, and is more than NOISE standard deviations from the former. The part lies LEAN of the way from where OWN of the own
#: texts have got to, to where FOREIGN of the texts whose language is taken away have not; REJECT_AT if the two do not lie so.
REJECT_AT, NOISE, LEAN, OWN, FOREIGN = 0.5, 6.0, 0.75, 0.999, 0.05
UNKNOWN = "und"
#: Characters and rows that a task looks at together.
_CHUNK, _ROWS = 1 << 18, 512
_SPACE = 0x20
_SYMBOLS: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """16-bit symbol of each code point below U+10000: the lower-case letter, or a blank for what is no letter."""
    if not _SYMBOLS:
        table = np.full(1 << 16, _SPACE, np.uint16)
        for c in range(1 << 16):
            if (x := chr(c)).isalpha():
                table[c] = min(ord(x.lower()[0]), 0xFFFF)
        _SYMBOLS.append(table)
    return _SYMBOLS[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all texts and how many each text has (none without a letter).

    A text is padded with blanks in front; runs of what is no letter become one blank.
    """
    pad = "\n" * (ORDER - 1)
    parts = [f"{pad}{t or ''}\n" for t in texts]
    size = np.array([len(p) for p in parts])
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = _symbols()[np.minimum(code, 0xFFFF)].copy()
    for at in np.flatnonzero(code > 0xFFFF):
        symbol[at] = 0xE000 + code[at] % 0x1900 if chr(code[at]).isalpha() else _SPACE
    text = np.repeat(np.arange(len(parts)), size)
    start = np.cumsum(size) - size
    letter = symbol != _SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for k in range(ORDER - 1):
        keep[start + k] = True
    symbol, text = symbol[keep].astype(np.uint64), text[keep]
    n = max(0, len(symbol) - ORDER + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(ORDER):
        gram = (gram << np.uint64(16)) | symbol[k : k + n]
    same = text[:n] == text[ORDER - 1 :] if n else np.zeros(0, bool)
    has = np.add.reduceat(letter, start) > 0 if len(parts) else np.zeros(0, bool)
    same &= has[text[:n]]
    return gram[same], np.bincount(text[:n][same], minlength=len(parts))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            yield batch.slice(low, _ROWS)


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK:
            yield slice(low, i + 1)
            low, size = i + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


def _fold(text: str = "text") -> Column:
    return F.pmod(F.xxhash64(F.lit(11), text), F.lit(FOLDS)).cast("int")


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """``lang, fold, gram, n`` over all rows of ``labelled`` (text, lang); counted within tasks before the shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(lang: tuple[str, int]) -> int:
            keys = np.concatenate([k for k, _ in held[lang]])
            n = np.concatenate([c for _, c in held[lang]])
            keys, at = np.unique(keys, return_inverse=True)
            held[lang] = [(keys, np.bincount(at, weights=n).astype(np.int64))]
            return len(keys)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                merge(lang)
                keys, n = held[lang][0]
                yield pa.RecordBatch.from_arrays([pa.array([lang[0]] * len(keys), pa.string()), pa.array([lang[1]] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "fold", "gram", "n"])
            held.clear()

        for batch in _slices(batches):
            texts, langs = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for part in _chunks(texts):
                grams, size = ngrams(texts[part])
                names = sorted(set(langs[part]))
                owner = np.array([names.index(x) for x in langs[part]])
                for k, lang in enumerate(names):
                    keys, n = np.unique(grams[np.repeat(owner == k, size)], return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    if len(held[lang]) >= 16:
                        merge(lang)
            if sum(len(k) for x in held.values() for k, _ in x) > 2_000_000:
                yield from flush()
        yield from flush()

    rows = labelled.where("text is not null and lang is not null").select("text", "lang", _fold().alias("fold"))
    return rows.mapInArrow(task, "lang string, fold int, gram long, n long").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Kneser-Ney terms in sorted arrays: for each language and order the n-grams with their discounted share, and the
    contexts with the weight of the lower order."""

    langs: list[str]
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contexts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    n_symbols: int = 1
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    temperature: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    noise: np.ndarray = field(default_factory=lambda: np.zeros(0))
    foreign: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reject_at: float = REJECT_AT

    def probability(self, lang: int, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last symbol of each n-gram after the others, lower orders interpolated."""
        if order == 0:
            return np.full(len(keys), 1 / self.n_symbols)
        share = _look_up(*self.grams[lang, order], keys, 0.0)
        weight = _look_up(*self.contexts[lang, order], keys >> np.uint64(16), 1.0)
        lower = keys & np.uint64((1 << (16 * (order - 1))) - 1)
        return share + weight * self.probability(lang, lower, order - 1)

    def table(self, keys: np.ndarray) -> np.ndarray:
        return np.log(np.stack([self.probability(k, keys) for k in range(len(self.langs))], 1)).astype(np.float32)

    def freeze(self) -> Model:
        """All n-grams that some language has, sorted, with a column of log-probabilities for each language."""
        self.known = np.unique(np.concatenate([self.grams[k, ORDER][0] for k in range(len(self.langs))] or [np.zeros(0, np.uint64)]))
        self.logs = self.table(self.known) if self.langs else self.logs
        return self

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy in nats a symbol (text by language), mean squared log-probability, and n-grams of each text."""
        grams, size = ngrams(texts)
        total, square = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs)))
        some = size > 0
        if len(grams) and self.langs:
            at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            missed = np.flatnonzero(self.known[at] != grams)
            logs = self.logs[at]
            if len(missed):
                rare, where = np.unique(grams[missed], return_inverse=True)
                logs[missed] = self.table(rare)[where]
            start = (np.cumsum(size) - size)[some]
            total[some] = np.add.reduceat(logs, start, axis=0, dtype=np.float64)
            square[some] = np.add.reduceat(logs * logs, start, axis=0, dtype=np.float64)
        n = np.maximum(size, 1)[:, None]
        return -total / n, square / n, size

    def way(self, h: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far texts of cross-entropy ``h`` are on the way from own texts (0) to foreign ones (1)."""
        return (h - self.mean[best]) / np.maximum(self.foreign[best] - self.mean[best], 1e-9)

    def limit(self, best: np.ndarray, size: np.ndarray, reject_at: float) -> np.ndarray:
        """The highest cross-entropy that a text of that many n-grams may have."""
        own, way = self.mean[best], np.maximum(0, self.foreign[best] - self.mean[best])
        return own + np.maximum(reject_at * way, NOISE * np.sqrt(self.spread[best] + self.noise[best] / np.maximum(size, 1)))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _mask(order: int) -> Column:
    return F.lit((1 << (16 * order)) - 1).cast("long")


def fit(labelled: DataFrame, min_share: float = MIN_SHARE) -> Model:
    """A model of all rows of ``labelled`` (text, lang), calibrated by models of a part of them on the rest.

    Counts and continuation counts are aggregated by Spark. The driver receives every distinct n-gram and context of each
    order, in Arrow columns, and the tasks share them; both grow with the corpus: 16 bytes for each n-gram and context of a
    language, and for each n-gram that any language has 8 bytes and 4 more a language. With ``min_share``, rarer ones are
    left out and what they had goes to the lower order of their context, so probabilities add up all the same.

    Rows without a text, a label or a letter teach nothing; repeated rows count as often as they come. Without any rows
    there are no languages.
    """
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    models = _learn(count_ngrams(labelled), min_share)
    model = models.pop(ALL, Model([]))
    return calibrate(model, models, labelled) if model.langs else model


def _learn(counts: DataFrame, min_share: float) -> dict[str, Model]:
    """Models of ``counts`` (``lang, fold, gram, n``), not calibrated, all learned together: ``ALL`` of all folds, and one for each fold
    that has learned the others."""
    parts = F.array(F.lit(ALL), *(F.when(F.col("fold") != k, F.lit(str(k))) for k in range(FOLDS)))
    named = counts.select("gram", "n", "lang", F.explode(F.array_compact(parts)).alias("part")).select(F.concat("part", F.lit(":"), "lang").alias("lang"), "gram", "n")
    level = cut(named.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("f", F.col("n")))
    total = level.groupBy("lang").agg(F.sum("f").alias("all"))
    model = Model([])
    for order in range(ORDER, 0, -1):
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
        discount = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).join(total, "lang")
        rate = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        discount = discount.select("lang", "all", F.least(F.greatest(rate, F.lit(0.05)), F.lit(0.95)).alias("d"))
        grams = level.withColumn("context", context).join(F.broadcast(discount), "lang")  # one row a language
        often = F.col("f") >= F.col("all") * min_share
        rest = F.when(often, F.least("n", "d")).otherwise(F.col("n"))  # what a gram leaves to the lower order
        around = grams.groupBy("lang", "context").agg(F.sum("n").alias("sum"), F.sum(rest).alias("rest"), F.sum("f").alias("cf"), F.first("all").alias("all"))
        kept_contexts = around.where(F.col("cf") >= F.col("all") * min_share).select("lang", "context", (F.col("rest") / F.col("sum")).alias("weight"))
        kept = grams.where(often).join(around.select("lang", "context", "sum"), ["lang", "context"])
        kept = kept.select("lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("sum")).alias("share"))
        for name, table, key in (("grams", kept, "gram"), ("contexts", kept_contexts, "context")):
            found = table.toArrow()
            if not model.langs:
                model.langs = sorted(found["lang"].unique().to_pylist())
            for k, lang in enumerate(model.langs):
                own = found.filter(pc.equal(found["lang"], lang))
                keys = own[key].to_numpy().astype(np.int64).view(np.uint64)
                by = np.argsort(keys)
                getattr(model, name)[k, order] = keys[by], own.column(2).to_numpy().astype(float)[by]
        if order > 1:
            level = cut(level.groupBy("lang", F.col("gram").bitwiseAND(_mask(order - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")))
        else:
            symbols = level.select(F.substring_index("lang", ":", 1).alias("part"), "gram").distinct().groupBy("part").count().collect()  # a row a part
    models = {r["part"]: Model([], n_symbols=1 + r["count"]) for r in symbols}
    for k, name in enumerate(model.langs):
        part, lang = name.split(":", 1)
        own = models[part]
        for order in range(1, ORDER + 1):
            own.grams[len(own.langs), order], own.contexts[len(own.langs), order] = model.grams[k, order], model.contexts[k, order]
        own.langs.append(lang)
    return {part: m.freeze() for part, m in models.items()}


def calibrate(model: Model, parts: dict[str, Model], labelled: DataFrame) -> Model:
    """Temperature of the score by likelihood, each language's usual cross-entropy, and where to reject, from all labelled texts.

    Each text is looked at by the model of the folds that it is not in, at any number of texts; equal texts of one label count once. A text whose
    language that model has not learned tells nothing of its own, and a language that it has not learned is farther than all others. Means and
    quantiles are Spark's, and exact: the driver receives a row for each language and four ranked values.
    """
    judged = reduce(DataFrame.unionByName, (_judged(labelled, int(k), part, model) for k, part in sorted(parts.items())))
    rows = written(judged.dropDuplicates(["one", "two", "own"]), "judged")
    n = len(model.langs)
    mine, low = F.col("entropy")[F.col("own")], F.array_min("entropy")
    warm = 2.0 ** np.arange(0, 9)

    def loss_at(t: float) -> Column:
        return F.log(F.aggregate("entropy", F.lit(0.0), lambda a, x: a + F.exp(t * (low - x)))) + t * (mine - low)

    told = rows.groupBy("own").agg(
        F.count(F.lit(1)).alias("n"), F.avg(mine).alias("mean"), F.var_pop(mine).alias("spread"), F.avg(F.col("square") - mine * mine).alias("noise"),
        F.array(*(F.sum(F.col("entropy")[k]) for k in range(n))).alias("sums"), F.array(*(F.sum(loss_at(t)) for t in warm.tolist())).alias("losses"),
    ).collect()  # a row a language
    size, mean, spread, noise = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    sums, loss = np.zeros((n, n)), np.zeros(len(warm))
    for r in sorted(told, key=lambda r: r.own):
        size[r.own], mean[r.own], spread[r.own], noise[r.own], sums[r.own] = r["n"], r["mean"], r.spread, r.noise, r.sums
        loss += r.losses
    every = int(size.sum())
    model.temperature = float(warm[loss.argmin()])
    usual = size @ mean / every if every else 0.0
    model.mean = np.where(size > 1, mean, usual)
    model.spread = np.where(size > 1, spread, size @ (spread + (mean - usual) ** 2) / every if every else 1.0)
    model.noise = np.where(size > 1, noise, size @ noise / every if every else 1.0)
    other = every - size  # texts of other languages
    model.foreign = np.where(other > 0, (sums.sum(0) - sums.diagonal()) / np.maximum(other, 1), np.log(model.n_symbols))
    if n > 1 and every:
        others = F.transform("entropy", lambda x, k: F.when(k == F.col("own"), F.lit(float("inf"))).otherwise(x))  # each text as if its own language were not known
        ways = F.array(*(F.struct(F.lit(k).alias("kind"), _way(model, h).alias("way")) for k, h in enumerate((F.col("entropy"), others))))
        near, far = _quantiles(rows.select("one", "two", "own", F.inline(ways)), every, [OWN, FOREIGN])
        model.reject_at = near + LEAN * (far - near) if far > near else REJECT_AT
    drop_written(rows)
    return model


def _judged(labelled: DataFrame, fold: int, part: Model, model: Model) -> DataFrame:
    """``one, two, own, square, entropy`` of each text of ``fold`` with a letter, in a language of ``part``, by ``part``: two hashes of the
    text, the place of its language in ``model``, mean squared log-probability in it, and cross-entropy in each language of ``model``."""
    shared = labelled.sparkSession.sparkContext.broadcast(part)
    n, farthest, at = len(model.langs), float(np.log(model.n_symbols)), [model.langs.index(x) for x in part.langs]
    place = dict(zip(part.langs, at, strict=True))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts, langs = batch.column(2).to_pylist(), np.array([place.get(x, -1) for x in batch.column(3).to_pylist()], np.int32)
            for some in _chunks(texts):
                found, squares, size = shared.value.entropies(texts[some])
                h, square, own = np.full((len(size), n), farthest), np.zeros((len(size), n)), langs[some]
                h[:, at], square[:, at] = found, squares
                kept = np.flatnonzero((size > 0) & (own >= 0))
                own = own[kept]
                lists = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32) * n, h[kept].ravel())
                keys = [batch.column(k).slice(some.start, some.stop - some.start).take(pa.array(kept)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(own), pa.array(square[kept, own]), lists], names=["one", "two", "own", "square", "entropy"])

    keyed = labelled.where(_fold() == fold).select(F.xxhash64("text").alias("one"), F.xxhash64(F.lit(12), "text").alias("two"), "text", "lang")
    return keyed.mapInArrow(task, "one long, two long, own int, square double, entropy array<double>")


def _way(model: Model, h: Column) -> Column:
    """``Model.way`` of the lowest of the cross-entropies ``h``."""
    lowest = F.array_min(h)
    best = F.array_position(h, lowest).cast("int")
    mean, way = F.array(*map(F.lit, model.mean.tolist())), F.array(*map(F.lit, np.maximum(model.foreign - model.mean, 1e-9).tolist()))
    return (lowest - F.element_at(mean, best)) / F.element_at(way, best)


def _quantiles(ways: DataFrame, n: int, parts: list[float]) -> list[float]:
    """The quantile ``parts[kind]`` of ``way`` of the ``n`` rows of each ``kind`` of ``ways``, between the two ranks about it as in numpy."""
    at = [k * n + q * (n - 1) for k, q in enumerate(parts)]
    ranks = sorted({int(f(x)) + 1 for x in at for f in (np.floor, np.ceil)})
    ranked = global_rank(ways, [F.col("kind"), F.col("way"), F.col("one"), F.col("two"), F.col("own")])
    found = {r["rank"]: r.way for r in ranked.where(F.col("rank").isin(ranks)).select("rank", "way").collect()}  # four rows at most
    low, high = ([found[int(f(x)) + 1] for x in at] for f in (np.floor, np.ceil))
    return [float(a + (b - a) * (x - np.floor(x))) for a, b, x in zip(low, high, at, strict=True)]


def predict(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``entropy``, ``rejected``; columns of these names are replaced.

    The language of the lowest length-normalised cross-entropy, over the whole text. ``score`` is its posterior at the
    calibrated temperature. Null texts and texts without a letter are ``und`` with score 0, and rejected; so is a text
    whose cross-entropy is ``reject_at`` of the way from that of its language's own texts to that of foreign ones (by default
    the calibrated part). Ties go to the first language by name. Repeated rows get equal results. With no labelled text at
    all, every row is ``und``; an empty table gives an empty one.
    """
    fresh = ["lang_pred", "score", "entropy", "rejected"]
    keep = [c for c in docs.columns if c.lower() not in fresh]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "lang_pred string, score double, entropy double, rejected boolean"

    def judge(texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
        m: Model = shared.value
        if not m.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [True] * len(texts)
        h, _, size = m.entropies(texts)
        best = h.argmin(1)
        z = np.exp(-m.temperature * (h - h.min(1, keepdims=True)))
        score = np.where(size > 0, 1 / z.sum(1), 0.0)
        lowest = h.min(1)
        out = (size == 0) | (lowest > m.limit(best, size, m.reject_at if reject_at is None else reject_at))
        return [m.langs[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)], score.tolist(), np.where(size > 0, lowest, 0.0).tolist(), out.tolist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(at).to_pylist()
            found: tuple[list, ...] = ([], [], [], [])
            for part in _chunks(texts):
                for a, b in zip(found, judge(texts[part]), strict=True):
                    a += b
            columns = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64()), pa.array(found[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[f"c{i}" for i in range(len(keep) + 4)])

    plain, at = numbered_columns(docs, keep, text_col)
    kinds = [f.dataType.simpleString() for f in plain.schema.fields[: len(keep)]] + [x.split()[1] for x in schema.split(", ")]
    out = plain.mapInArrow(task, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*keep, *fresh)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` by a model of those rows of ``docs`` that are labelled and not held out; a null id is not held out."""
    return predict(docs, fit(docs.where(~F.coalesce(held_out(), F.lit(False))).select("text", "lang")))


def language_id_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of ``docs`` by a model of the rows that are not held out.

    Null texts and those without a letter are ``und`` and rejected; a null id is not held out. Repeated rows, and other
    columns, are as in ``predict``.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(~F.coalesce(held_out(), F.lit(False))).select("text", "lang"))
    out = predict(rows.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
