"""Benchmark passages in documents: latent semantic retrieval, then checks on the words themselves."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.llm.common import bounded_sample, cut
from gleaner.llm.words import Lookup, hash_texts

#: Words of a passage, and words from one passage of a document to the next, half as many.
PASSAGE, STRIDE = 32, 16
RANK = 128
#: Documents whose passages, with those of the benchmark, the latent space is fitted on: the first by a hash of their text.
FIT_ROWS = 2000
#: Benchmark items in a block, on average, and blocks that one pass over the documents looks for; more take more passes.
BLOCK, BLOCKS = 5000, 8
CANDIDATE = 0.5
#: How much more a benchmark passage weighs in the fit than a document's, so that the latent space keeps what is rare in
#: documents but tells benchmark passages apart.
EMPHASIS = 10.0
#: Shares of an item's words that a document must have in order: enough by itself, or with the answer.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
#: Terms in more than this share of the documents carry no weight, unless an item would be left with fewer than FEW.
COMMON, FEW = 0.05, 4
#: Words that a task searches at once.
CHUNK = 50_000
HITS = "id {id}, item_id {item}, similarity double, overlap double, answer_overlap double, word_start long, word_end long"


@dataclass
class Index:
    """Latent vectors of a block of benchmark passages, and of the terms that carry weight."""

    items: list
    words: list[np.ndarray]
    terms: Lookup
    vectors: np.ndarray
    owner: np.ndarray
    passages: np.ndarray
    #: Terms that a passage of a document needs, at most half of those that any passage of an item has.
    least: int

    def __post_init__(self) -> None:
        self.own_terms = [frozenset(self.terms.find(w)[1].tolist()) for w in self.words]
        #: An accepted item misses at most a share of its words, hence as many of its terms.
        self.needs = [max(1, len(t) - int((1 - PARAPHRASE) * len(w))) for t, w in zip(self.own_terms, self.words, strict=True)]
        pairs = sorted((t, i) for i, own in enumerate(self.own_terms) for t in own)
        #: Items that have each term, in a row; those of term t start at ``first[t]``.
        self.holders = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms.keys) + 1))

    def reach(self, item: int) -> int:
        """Words on either side of a passage that are searched for an item."""
        return len(self.words[item]) + PASSAGE // 2

    def seeds(self, hit: np.ndarray, term: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and word of each place from which on the words in reach have as many of the item's terms, counted
        with repetitions, as the item needs. No item that is accepted from there is left out, whatever its cosine."""
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(np.arange(len(hit)), n)
        item = self.holders[self.first[term][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        group = text[at] * len(self.items) + item
        by = np.argsort(group, kind="stable")
        at, item, group = at[by], item[by], group[by]
        end = np.arange(len(at)) + np.array(self.needs, np.int64)[item] - 1
        last = np.minimum(end, max(0, len(at) - 1))
        span = np.array([self.reach(i) + PASSAGE for i in range(len(self.items))], np.int64)[item]
        ok = (end < len(at)) & (group[last] == group) & (hit[at[last]] - hit[at] < span)
        return text[at[ok]], item[ok], hit[at[ok]]


def item_starts(n: int) -> list[int]:
    """Passages that cover ``n`` words; the last one ends with them."""
    return sorted({*range(0, max(1, n - PASSAGE + 1), PASSAGE), max(0, n - PASSAGE)})


def answer(words: np.ndarray) -> np.ndarray:
    """An item's last third, which holds its answer."""
    return words[-max(1, len(words) // 3) :]


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last index of ``b`` that lie in ``a``'s words, bit by bit."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state, first, last = full, -1, -1
    for j, x in enumerate(b.tolist()):
        if match := where.get(x, 0):
            hit = state & match
            if hit:
                first, last = (j if first < 0 else first), j
            state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count(), first, last


def _term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that have each term, over all documents; summed within tasks, then by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(terms))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, seen = shared.value, 0, np.zeros(len(shared.value.keys), np.int64)
        for batch in batches:
            rows, at, size = [], [], 0
            for i, w in hash_texts(batch.column(0).to_pylist()):
                n += 1
                hit = own.find(w)[1]
                rows.append(np.full(len(hit), i, np.int64))
                at.append(hit)
                size += len(hit)
                if size > 100_000:
                    _count(seen, rows, at)
                    size = 0
            _count(seen, rows, at)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["term", "n"])

    found = docs.select("text").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms) + 1, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _count(seen: np.ndarray, rows: list[np.ndarray], at: list[np.ndarray]) -> None:
    if at:
        pairs = np.unique(np.concatenate(rows) * len(seen) + np.concatenate(at))
        seen += np.bincount(pairs % len(seen), minlength=len(seen))
    rows.clear()
    at.clear()


def _weights(terms: np.ndarray, words: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    n = max(1, counts[-1])
    idf = np.log((1 + n) / (1 + counts[:-1])) + 0.1
    light = counts[:-1] > COMMON * n
    for w in words:
        k = np.unique(np.searchsorted(terms, w))
        if (~light[k]).sum() < min(FEW, len(k)):
            light[k] = False
    idf[light] = 0
    return idf


def _passage_rows(words: np.ndarray, terms: np.ndarray, idf: np.ndarray, starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for s in starts:
        w = words[s : s + PASSAGE]
        k = np.minimum(np.searchsorted(terms, w), max(0, len(terms) - 1))
        k, tf = np.unique(k[terms[k] == w], return_counts=True)
        value = idf[k] * (1 + np.log(tf))
        if (norm := np.sqrt((value**2).sum())) > 0:
            yield k, value / norm


def _gram_times(sample: DataFrame, terms: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A' A basis`` for the weighted TF-IDF passages A of ``sample`` (text, weight): partial sums by task, added up by Spark for each term."""
    shared = sample.sparkSession.sparkContext.broadcast((terms, idf, basis))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight, q = shared.value
        out = np.zeros_like(q)
        for batch in batches:
            weights = np.array(batch.column(1))
            for i, w in hash_texts(batch.column(0).to_pylist()):
                for k, v in _passage_rows(w, own, weight, item_starts(len(w))):
                    out[k] += v[:, None] * (v @ q[k]) * weights[i]
        some = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.astype("<f4").tobytes() for x in out[some]], pa.binary())], names=["term", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<f4") for x in table.column("part").to_pylist()], axis=0, dtype=np.float64)
        return pa.table({"term": table.column("term")[:1], "part": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    rows = sample.mapInArrow(task, "term long, part binary").groupBy("term").applyInArrow(add, "term long, part binary").toPandas()
    out = np.zeros_like(basis)
    for t, x in zip(rows["term"], rows["part"], strict=True):
        out[t] = np.frombuffer(x, "<f4")
    return out


def _latent(sample: DataFrame, texts: list[str], terms: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages, by a randomised range finder with two power iterations."""
    rank = min(rank, len(terms))
    own = sample.sparkSession.createDataFrame([(t, EMPHASIS**2) for t in texts], "text string, weight double")
    both = cut(own.unionByName(sample).repartition(16))
    q = np.random.default_rng(7).standard_normal((len(terms), rank))
    for _ in range(2):
        q, _ = np.linalg.qr(_gram_times(both, terms, idf, q))
    values, turn = np.linalg.eigh(q.T @ _gram_times(both, terms, idf, q))
    return (q @ turn[:, np.argsort(-values)]).astype(np.float32)


def build(docs: DataFrame, items: DataFrame, rank: int = RANK) -> Iterator[Index]:
    """Indexes of the benchmark ``items`` (item_id, text), a block each, dealt by hash; items without a word are in none.

    The documents are read twice for all blocks together: for how many have each of the benchmark's words, whose hashes
    come to the driver and to the tasks (8 bytes a word), and for the sample. The driver holds one block at a time.
    """
    rows = items.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    all_terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x in _distinct_words(rows))]))
    if not len(all_terms):
        return
    counts = _term_counts(docs, all_terms)
    sample = cut(bounded_sample(docs.select("text"), FIT_ROWS).select("text", F.lit(1.0).alias("weight")))
    for block in range(blocks):
        found = dealt.where(F.col("block") == block).orderBy("item_id", "text").toPandas()
        words = dict(hash_texts(found["text"].tolist()))
        kept = [i for i in sorted(words) if len(words[i])]
        if not kept:
            continue
        own = [words[i] for i in kept]
        terms = np.unique(np.concatenate(own))
        idf = _weights(terms, own, np.append(counts[np.searchsorted(all_terms, terms)], counts[-1]))
        vectors = _latent(sample, [found["text"][i] for i in kept], terms, idf, rank)
        passages, owner, sizes = [], [], []
        for i, w in enumerate(own):
            for k, v in _passage_rows(w, terms, idf, item_starts(len(w))):
                passages.append(v @ vectors[k])
                owner.append(i)
                sizes.append(int((idf[k] > 0).sum()))
        matrix = np.array(passages, np.float32).reshape(len(owner), vectors.shape[1])
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        live = idf > 0
        weighted = vectors[live] * idf[live, None].astype(np.float32)
        yield Index([found["item_id"][i] for i in kept], own, Lookup(terms[live]), weighted, np.array(owner, np.int64), matrix, min(3, max(1, min(sizes, default=2) // 2)))


def _distinct_words(rows: DataFrame) -> Iterator[np.ndarray]:
    """Hashes of the words of all items; each once in a task, and once for all by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [w for _, w in hash_texts(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *held])).view(np.int64))], names=["term"])

    found = rows.select("text").mapInArrow(task, "term long").distinct().toArrow()
    yield found["term"].to_numpy().astype(np.int64).view(np.uint64)


def search(index: Index, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """``(text, item, similarity, overlap, answer overlap, first word, word after the last)`` for each item found in a text."""
    sizes = np.array([len(w) for w in texts], np.int64)
    if not sizes.sum() or not len(index.passages) or not len(index.terms.keys):
        return
    base = np.cumsum(sizes) - sizes
    words = np.concatenate(texts)
    hit, term = index.terms.find(words)
    blocks = np.maximum(1, -(-sizes // STRIDE))
    text = np.repeat(np.arange(len(texts)), blocks)
    start = base[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    low = np.searchsorted(hit, start)
    count = np.diff(np.append(low, len(hit)))
    sums = np.zeros((len(text) + 1, index.vectors.shape[1]), np.float32)
    full = np.flatnonzero(count)
    if not len(full):
        return
    sums[full] = np.add.reduceat(index.vectors[term], low[full], axis=0)
    follows = np.append(text[1:] == text[:-1], False)  # a passage is a block and the next of the same text
    some = np.flatnonzero(count + np.append(count[1:], 0) * follows >= index.least)
    found: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for at in range(0, len(some), 2048):
        part = some[at : at + 2048]
        x = sums[part] + sums[part + 1] * follows[part, None]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        near = x @ index.passages.T
        for i, j in zip(*np.nonzero(near >= CANDIDATE), strict=True):
            found.setdefault((int(text[part[i]]), int(index.owner[j])), []).append((float(near[i, j]), int(start[part[i]] - base[text[part[i]]])))
    for t, i, at in zip(*(x.tolist() for x in index.seeds(hit, term, np.repeat(np.arange(len(texts)), sizes)[hit])), strict=True):
        found.setdefault((t, i), []).append((-1.0, (at - int(base[t])) // STRIDE * STRIDE))
    spots, at_spot = hit.tolist(), term.tolist()
    for (t, i), places in found.items():
        item, own = index.words[i], texts[t]
        best: tuple[float, float, int, int] | None = None
        reach = index.reach(i)
        until = -1
        for at in sorted({s for _, s in places}):
            if at < until:
                continue
            low, high = max(0, at - reach), min(len(own), at + PASSAGE + reach)
            a, b = bisect.bisect_left(spots, base[t] + low), bisect.bisect_left(spots, base[t] + high)
            if len(index.own_terms[i].intersection(at_spot[a:b])) < index.needs[i]:
                continue
            until = at + STRIDE * 2
            length, first, last = lcs(item, own[low:high])
            tail = answer(item)
            got = (length / len(item), lcs(tail, own[low:high])[0] / len(tail), low + first, low + last + 1)
            best = got if best is None or got > best else best
        if best is not None and (best[0] >= COPY or best[0] >= PARAPHRASE and best[1] >= ANSWER):
            if (similarity := max(s for s, _ in places)) < 0:  # found by its terms only
                k = np.searchsorted(text, t) + np.array(sorted({s for _, s in places})) // STRIDE
                x = sums[k] + sums[k + 1] * follows[k, None]
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                similarity = float((x @ index.passages[index.owner == i].T).max())
            yield t, i, similarity, best[0], best[1], best[2], best[3]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> DataFrame:
    """A row for each document and benchmark item that the document holds, word for word or paraphrased.

    Every passage of every text is compared with every passage of the benchmark in the latent space; where the cosine is
    at least ``CANDIDATE``, or the words nearby have as many of the item's terms as an accepted item must have, the longest
    common subsequence of words decides: ``COPY`` of the item's words in order, or
    ``PARAPHRASE`` of them along with its answer (its last third). Documents are only scanned; what the tasks of a pass
    share is ``BLOCKS`` blocks of about ``BLOCK`` items, and only more items take more passes.

    Term counts come from all documents; the latent space of a block is fitted on its passages and those of ``FIT_ROWS``
    documents. Null and empty texts hold nothing; a very long text is searched whole. Items without words, or without an
    id, are in no document; ids may be of any type. Repeated rows give repeated results; of places with equal overlap the
    last one counts, and a document has a row for each of its items. Empty tables give an empty one. Columns other than
    the two are not read, whatever their names.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = HITS.format(id=narrow.schema["id"].dataType.simpleString(), item=items.schema["item_id"].dataType.simpleString())
    kind = to_arrow_type(items.schema["item_id"].dataType)
    spark, out, shared = docs.sparkSession, None, []

    def scan(shared: list) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, held, size = batch.column(0), [], 0
                for _, w in hash_texts(batch.column(1).to_pylist()):
                    held.append(w)
                    size += len(w)
                    if size >= CHUNK:
                        for index in shared:
                            yield from _emit(index.value, held, ids, kind)
                        ids, held, size = ids.slice(len(held)), [], 0
                for index in shared:
                    yield from _emit(index.value, held, ids, kind)

        part = narrow.mapInArrow(task, schema)
        return part if out is None else out.unionByName(part)

    for index in build(narrow, items, rank):
        shared.append(spark.sparkContext.broadcast(index))
        if len(shared) == BLOCKS:
            out, shared = scan(shared), []
    if shared:
        out = scan(shared)
    return spark.createDataFrame([], schema) if out is None else out


def _emit(index: Index, texts: list[np.ndarray], ids: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = sorted((t, i, *rest) for t, i, *rest in search(index, texts))
    if rows:
        columns = list(zip(*rows, strict=True))
        names = ["item_id", "similarity", "overlap", "answer_overlap", "word_start", "word_end"]
        item = pa.array([index.items[i] for i in columns[1]], kind)
        rest = [pa.array(c, k) for c, k in zip(columns[2:], [pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()], strict=True)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), item, *rest], names=["id", *names])


def leaks_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, overlap, answer_overlap`` of the leaks, the best place of each item in each document; repeated rows
    and documents of one id count once. Nulls, empty texts and tables are as in ``find_leaks``."""
    out = find_leaks(docs, items).select(F.col("id").alias("doc_id"), "item_id", F.round("overlap", 6).alias("overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))
    return out.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.max("answer_overlap").alias("answer_overlap"))
