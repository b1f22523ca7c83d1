"""Bounded-space online packing of documents into training sequences.

Each task keeps a fixed number of open windows. A document's last part goes to the open window with
the least room that still takes it; when none does, the fullest window is filled up with its front
and emitted, and the rest is placed again. What is open at the end of a task is merged with what a
few neighbouring tasks left over; the very last ids are cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.llm import text as X
from crowdgauge.llm import tokens
from crowdgauge.runtime import pin

#: Tasks whose left-over windows are merged together.
MERGED = 4
_FIELDS = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


class Packer:
    """Open windows of at most ``capacity`` ids; ``closed`` takes the pieces of full ones."""

    def __init__(self, capacity: int, windows: int, base: int):
        self.capacity, self.next_id = capacity, base
        self.fill = np.zeros(windows, np.int64)
        self.open: list[list] = [[] for _ in range(windows)]
        self.closed: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _into(self, w: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.open[w].append((doc, start, ids, total))
        self.fill[w] += len(ids)
        if self.fill[w] == self.capacity:
            self._close(self.open[w])
            self.open[w], self.fill[w] = [], 0

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        """Place ``ids``, which stand at ``start`` in a document of ``total`` ids."""
        while len(ids):
            if len(ids) >= self.capacity:
                self._close([(doc, start, ids[: self.capacity], total)])
                start, ids = start + self.capacity, ids[self.capacity :]
                continue
            room = self.capacity - self.fill
            fits = np.where(room >= len(ids), room, self.capacity + 1)
            best = int(fits.argmin())
            if room[best] >= len(ids):
                self._into(best, doc, start, ids, total)
                return
            fullest = int(room.argmin())
            n = int(room[fullest])
            self._into(fullest, doc, start, ids[:n], total)
            start, ids = start + n, ids[n:]

    def left(self) -> list[list]:
        """Pieces of the windows that are still open, the fullest first."""
        order = np.argsort(-self.fill, kind="stable")
        return [self.open[w] for w in order if self.open[w]]

    def finish(self) -> None:
        """Join what is open; the last ids go into sequences whose lengths are powers of two."""
        rest = self.left()
        self.open, self.fill = [[]], np.zeros(1, np.int64)
        for piece in (p for window in rest for p in window):
            self.add(*piece)
        pieces, self.open[0] = self.open[0], []
        size = int(sum(len(p[2]) for p in pieces))
        while size:
            n = 1 << (size.bit_length() - 1)
            taken, need = [], n
            while need:
                doc, start, ids, total = pieces.pop(0)
                if len(ids) > need:
                    pieces.insert(0, (doc, start + need, ids[need:], total))
                    ids = ids[:need]
                taken.append((doc, start, ids, total))
                need -= len(ids)
            self._close(taken)
            size -= n

    def rows(self, more: dict | None = None) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*self.closed, strict=True) if self.closed else [()] * 6
        self.closed = []
        return _rows(doc, start, ids, total, sequence, offset)


def _rows(doc, start, ids, total, sequence, offset) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
            pa.array(total, pa.int64()),
            pa.array(sequence, pa.int64()),
            pa.array(offset, pa.int64()),
        ],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def _with(batch: pa.RecordBatch, task: int, open_: bool) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([task] * n, pa.int32()), pa.array([open_] * n, pa.bool_())],
        names=[*batch.schema.names, "task", "open"],
    )


def _place(capacity: int, windows: int, end_id: int, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(capacity, windows, task << 32)
        end = np.array([end_id], np.uint32)
        added = tokens.added_tokens() if ranks is None else None
        for batch in X.small(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc, found in zip(ids, tokens.encode(batch.column("text"), ranks, added), strict=True):
                packer.add(doc, 0, np.concatenate([found, end]), len(found) + 1)
                if len(packer.closed) >= 4096:
                    yield _with(packer.rows(), task, False)
        yield _with(packer.rows(), task, False)
        for pieces in packer.left():
            packer._close(pieces)
        yield _with(packer.rows(), task, True)

    return run


def _merge(capacity: int, windows: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        # their own ids lie beyond those of the first of the tasks
        packer = Packer(capacity, windows, (int(table.column("task")[0].as_py()) << 32) + (1 << 31))
        for row in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
        packer.finish()
        return pa.Table.from_batches([packer.rows()])

    return run


def pack(
    docs: DataFrame, capacity: int = 2048, windows: int = 32, end_id: int = 1, ranks: str | None = None
) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    Every document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. ``ids`` are
    unsigned 32-bit little-endian. Each id lies in exactly one piece; the pieces of a sequence lie
    without gaps from offset 0. Sequences hold ``capacity`` ids, but for the last of each merge,
    whose lengths are powers of two, so no sequence needs padding. Rows that repeat a doc_id are
    packed each; a null doc_id is kept as null. Other columns are ignored. ``ranks`` is the path of
    a rank file; without it the public vocabulary is used, with the added tokens of its tokenizer file.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = pin(
        slim.mapInArrow(_place(capacity, windows, end_id, ranks), f"{_FIELDS}, task int, open boolean"),
        codec="zstd",
    )
    merged = (
        placed.filter("open")
        .withColumn("merge", F.floor(F.col("task") / MERGED))
        .groupBy("merge")
        .applyInArrow(_merge(capacity, windows), _FIELDS)
    )
    return placed.filter("NOT open").drop("task", "open").unionByName(merged)
