"""Examples packed into token sequences under several limits at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tokens import encoder

#: Examples, and tokens of all of them, that one round of packing chooses from; the latter bounds the memory of a task.
POOL, POOL_TOKENS = 4096, 1 << 23
SCHEMA = "id {id}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments (pieces of examples) and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Example:
    """A part of an example, from ``start`` on; ``loss`` marks its tokens that bear loss (None: all)."""

    key: object
    ids: np.ndarray
    start: int
    total: int
    loss: np.ndarray | None = None

    def bearing(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, at: int) -> tuple[Example, Example]:
        a, b = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Example(self.key, self.ids[:at], self.start, self.total, a), Example(self.key, self.ids[at:], self.start + at, self.total, b)

    def most(self, tokens: int, loss_tokens: int) -> int:
        """How many of its first tokens go into the room that is left."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return min(n, loss_tokens)
        return int(np.searchsorted(np.cumsum(self.loss[:n]), loss_tokens, side="right"))


class Packer:
    """Vector bin packing by the dot-product heuristic, one open sequence at a time.

    Of the examples that fit whole, the one whose demand vector has the largest dot product with the room left goes in
    next. Where none fits and cutting is allowed, the largest example is cut to fill what is left. Examples of equal
    demand are taken in the order of arrival, so a task that is run again gives the same sequences.
    """

    def __init__(self, limits: Limits, cuttable: bool = True) -> None:
        self.limits, self.cuttable = limits, cuttable
        self.kinds: dict[tuple[int, int], list[Example]] = {}
        self.waiting = self.tokens = 0
        self.open: list[Example] = []

    def add(self, example: Example) -> None:
        demand = (len(example.ids), example.bearing())
        if demand[1] > self.limits.loss_tokens and not self.cuttable or demand[0] > self.limits.tokens and not self.cuttable:
            raise ValueError(f"example {example.key} does not fit into a sequence")
        self.kinds.setdefault(demand, []).append(example)
        self.waiting += 1
        self.tokens += demand[0]

    def sequences(self, least: int, tokens: int | None = None) -> Iterator[list[Example]]:
        """Sequences, until at most ``least`` examples, of at most so many ``tokens``, wait; what is in the open sequence stays for later."""
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        demand = np.array(sorted(self.kinds), float).reshape(-1, 2)
        demand = np.column_stack((demand[:, 0], np.ones(len(demand)), demand[:, 1]))
        left = np.array([len(self.kinds[int(t), int(x)]) for t, _, x in demand])
        for k in self.kinds.values():
            k.reverse()
        mean = (demand * left[:, None]).sum(0) / max(1, left.sum()) / cap
        weighted = demand / cap * mean / cap
        alive = left > 0
        room = self._room(cap)
        tail: Example | None = None
        while tail is not None or self.waiting > least or tokens is not None and self.tokens > tokens:
            piece, k = tail, -1
            if piece is None:
                fits = alive & (demand <= room).all(1)
                k = int(np.argmax(np.where(fits, weighted @ room, -1.0))) if fits.any() else int(np.flatnonzero(alive)[-1])
                piece = self.kinds[int(demand[k, 0]), int(demand[k, 2])][-1]
            whole = room[1] >= 1 and len(piece.ids) <= room[0] and piece.bearing() <= room[2]
            n = len(piece.ids) if whole else piece.most(int(room[0]), int(room[2])) if self.cuttable and room[1] >= 1 else 0
            if not whole and n == 0:
                yield self._close()
                room = cap.copy()
                continue
            if tail is None:
                self.kinds[int(demand[k, 0]), int(demand[k, 2])].pop()
                self.waiting -= 1
                self.tokens -= len(piece.ids)
                left[k] -= 1
                alive[k] = left[k] > 0
            tail = None
            if n < len(piece.ids):
                piece, tail = piece.cut(n)
            self.open.append(piece)
            room = room - [len(piece.ids), 1, piece.bearing()]
            if room[0] <= 0:
                yield self._close()
                room = cap.copy()
        for k in self.kinds.values():
            k.reverse()
        self.kinds = {k: v for k, v in self.kinds.items() if v}

    def last(self) -> Iterator[list[Example]]:
        """What stays open at the end; cut into sequences of powers of two where cutting is allowed, which need no padding."""
        queue = self._close()
        if not self.cuttable:
            yield from [queue] if queue else []
            return
        total = sum(len(x.ids) for x in queue)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            while size:
                piece = queue.pop(0)
                if len(piece.ids) > size:
                    piece, tail = piece.cut(size)
                    queue.insert(0, tail)
                self.open.append(piece)
                size -= len(piece.ids)
            yield self._close()

    def _room(self, cap: np.ndarray) -> np.ndarray:
        return cap - [sum(len(x.ids) for x in self.open), len(self.open), sum(x.bearing() for x in self.open)]

    def _close(self) -> list[Example]:
        out, self.open = self.open, []
        return out


def pack(examples: DataFrame, encode: Callable[[pa.RecordBatch], Iterator[Example]], limits: Limits, cuttable: bool = True, pool: int = POOL, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Pieces of ``examples`` with the sequence and the offset that each got; ``encode`` makes examples of a batch of rows.
    The first column of ``examples`` is the key, of any type.

    Every task packs the rows of its own partition, ``pool`` examples or ``pool_tokens`` tokens at a time, so nothing is
    shuffled and a lost task is run again alone; only one example longer than ``pool_tokens`` takes more. One open sequence goes over from round to round; only the last one of a task may be short.
    ``sequence_id`` holds the partition in its upper bits.
    """

    kind = examples.schema.fields[0].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cuttable)
        key: pa.DataType | None = None
        number = TaskContext.get().partitionId() << 40
        out: list[tuple[int, int, Example]] = []

        def emit(sequence: list[Example]) -> None:
            nonlocal number
            offset = 0
            for x in sequence:
                out.append((number, offset, x))
                offset += len(x.ids)
            number += bool(sequence)

        for batch in batches:
            key = batch.schema.field(0).type
            for example in encode(batch):
                packer.add(example)
                if packer.waiting >= pool or packer.tokens >= pool_tokens:
                    for sequence in packer.sequences(pool // 8, pool_tokens // 2):
                        emit(sequence)
                    if out:
                        yield _batch(out, key)
                        out.clear()
        for sequence in (*packer.sequences(0), *packer.last()):
            emit(sequence)
        if out:
            yield _batch(out, key)

    return examples.mapInArrow(task, SCHEMA.format(id=kind))


def _batch(rows: list[tuple[int, int, Example]], key: pa.DataType | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x.key for _, _, x in rows], key),
            pa.array([x.start for _, _, x in rows], pa.int64()),
            pa.array([len(x.ids) for _, _, x in rows], pa.int64()),
            pa.array([x.ids.astype("<u4").tobytes() for _, _, x in rows], pa.binary()),
            pa.array([x.total for _, _, x in rows], pa.int64()),
            pa.array([x.bearing() for _, _, x in rows], pa.int64()),
            pa.array([s for s, _, _ in rows], pa.int64()),
            pa.array([o for _, o, _ in rows], pa.int64()),
        ],
        names=["id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"],
    )


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` packed whole: each text's ids, then ``end_id``; every token bears loss.

    Null and empty texts are the end token alone; a very long text is cut over many sequences. Rows are packed as they come:
    repeated rows and null ids too, and rows of equal length in the order of arrival. Ids may be of any type. An empty
    table gives an empty one. Columns other than the id and the text are not read, whatever their names.
    """

    def encode(batch: pa.RecordBatch) -> Iterator[Example]:
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.concatenate((enc.encode(text), end))
            yield Example(key, ids, 0, len(ids))

    return pack(docs.select(F.col(id_col), F.col(text_col)), encode, limits)


def packing_digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids; rows as those of ``packed``, one by one."""
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
