"""Ranked lexical search over bags: documents that the items cannot tell apart are scored once.

A document counts for the items only by its terms that some item holds, their frequencies, and the
length norm ``m``. Documents that agree in all of these form a class. Classes are found by the hash of
frequencies and ``m``, which range-partitions the documents, and are verified by comparing what was
hashed. A class is scored once against all items; its members follow by ascending doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge.llm import text as X
from crowdgauge.runtime import pin, unpin

#: (item, term) pairs of the items that one pass over the documents serves; they travel by broadcast.
ITEM_TERMS = 1_000_000
#: Cells (class, item) of a score matrix, and (class, item) products held at a time.
CELLS, PRODUCTS = 1 << 20, 1 << 22

#: Bytes of terms. ASCII letters and digits, and every byte of other characters.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, term) of each row's distinct terms."""
    for batch in X.small(batches):
        for low, high, raw, starts in X.chunks(batch.column("text")):
            b, e, first = X.spans(_TERM[raw], starts)
            data = _LOWER[raw].tobytes()
            for row in range(high - low):
                found = sorted({data[i:j].decode() for i, j in zip(b[first[row] : first[row + 1]], e[first[row] :])})
                item = batch.column("item_id").slice(low + row, 1)
                yield pa.RecordBatch.from_arrays(
                    [item.take(pa.array([0] * len(found), pa.int32())), pa.array(found, pa.string())],
                    names=["item_id", "term"],
                )


def _bags(hashes: np.ndarray, sizes: np.ndarray):
    """n and the frequencies of known terms of every document: two arrays of 32-bit numbers in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.small(batches):
            for low, high, raw, starts in X.chunks(batch.column("text")):
                b, e, first = X.spans(_TERM[raw], starts)
                found = X.span_hashes(raw, b, e, X._FOLDED)
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                known = np.flatnonzero((hashes[at] == found) & (sizes[at] == e - b))
                row = np.searchsorted(first, known, side="right") - 1
                cell, tf = np.unique(row * len(hashes) + at[known], return_counts=True)
                row, term = np.divmod(cell, len(hashes))
                cuts = np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(np.diff(first), pa.int64()),
                        lists(term),
                        lists(tf),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


class Scorer:
    """The best members of classes for each of a block of items, kept as (score, doc_id) rows."""

    def __init__(self, weights: np.ndarray, term: np.ndarray, item: np.ndarray, items: int, k: int):
        order = np.argsort(term, kind="stable")
        self.item, self.items, self.k = item[order], items, k
        self.cuts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.weights = weights
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items

    def scores(self, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """[class, item] scores of classes given by the ``counts`` of their terms."""
        tf = tfs.astype(np.int64)
        value = self.weights[terms] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * np.repeat(m, counts)))
        row = np.repeat(np.arange(len(m)), counts)
        total = np.zeros(len(m) * self.items, np.int64)
        each = self.cuts[terms + 1] - self.cuts[terms]
        ends = np.cumsum(each)
        low = 0
        while low < len(terms):  # products of a part of the cells at a time
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - each[low] + PRODUCTS, side="right")))
            n = each[low:high]
            place = np.arange(n.sum()) + np.repeat(self.cuts[terms[low:high]] - (np.cumsum(n) - n), n)
            cell = np.repeat(row[low:high] * self.items, n) + self.item[place]
            np.add.at(total, cell, np.repeat(value[low:high], n))
            low = high
        return total.reshape(len(m), self.items)

    def add(self, scores: np.ndarray, members: list[np.ndarray]) -> None:
        """Classes' scores and their first members in ascending order."""
        first = np.array([x[0] for x in members])
        top = scores.max(axis=0, initial=0)
        for i in np.flatnonzero(top > 0):
            held, ids = self.best[i]
            least = max(1, int(held[-1])) if len(held) == self.k else 1
            if top[i] < least:
                continue
            some = np.flatnonzero(scores[:, i] >= least)
            # the k first classes by (score, first member) hold the k first members
            some = some[np.lexsort((first[some], -scores[some, i]))[: self.k]]
            ids = np.concatenate([ids, *(members[c] for c in some)])
            held = np.concatenate([held, *(np.full(len(members[c]), scores[c, i]) for c in some)])
            order = np.lexsort((ids, -held))[: self.k]
            self.best[i] = held[order], ids[order]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.best]
        join = lambda j: np.concatenate([b[j] for b in self.best]) if self.best else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(self.items), sizes), pa.int64()),
                pa.array(join(1), pa.int64()),
                pa.array(join(0), pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts) of a list array."""
    cuts = column.offsets.to_numpy()
    return column.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0]


def _classes(batch: pa.RecordBatch, starts: np.ndarray) -> np.ndarray:
    """Where a new class starts: the hash, m, the terms or their frequencies differ from the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in ("class", "m"):
        x = batch.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    size = np.diff(starts)
    new[1:] |= size[1:] != size[:-1]
    # the hash agrees and so do the sizes: compare what was hashed
    same = np.flatnonzero(~new)
    if len(same):
        n = size[same]
        ends = np.cumsum(n)
        inside = np.arange(ends[-1]) + np.repeat(starts[same] - (ends - n), n)
        differ = np.zeros(ends[-1] + 1, np.int64)
        for name in ("terms", "tfs"):
            x, _ = _flat(batch.column(name))
            differ[1:] += x[inside] != x[inside - np.repeat(n, n)]
        differ = np.cumsum(differ)
        new[same] = differ[ends] > differ[ends - n]
    return new


def _score(weights: np.ndarray, term: np.ndarray, item: np.ndarray, items: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # items are taken in blocks, so that a score matrix stays small
        width = min(items, 1_024)
        blocks = []
        for low in range(0, items, width):
            mine = (item >= low) & (item < low + width)
            blocks.append(Scorer(weights, term[mine], item[mine] - low, min(width, items - low), k))
        step = max(1, CELLS // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, starts = _flat(part.column("terms"))
                tfs, _ = _flat(part.column("tfs"))
                begin = np.flatnonzero(_classes(part, starts))
                ids = part.column("doc_id").to_numpy()
                # rows are sorted by class and doc_id: a class's first k rows are its smallest members
                ends = np.append(begin[1:], part.num_rows)
                members = [ids[b : min(b + k, e)] for b, e in zip(begin, ends)]
                counts = np.diff(starts)[begin]
                total = np.cumsum(counts)
                inside = np.arange(total[-1]) + np.repeat(starts[begin] - (total - counts), counts)
                m = part.column("m").to_numpy()[begin]
                for block in blocks:
                    block.add(block.scores(m, counts, terms[inside], tfs[inside]), members)
        for number, block in enumerate(blocks):
            found = block.rows()
            own = pc.add(found.column("item"), number * width)
            yield pa.RecordBatch.from_arrays([own, *found.columns[1:]], names=found.schema.names)

    return run


def rank(documents: DataFrame, items: DataFrame, k: int = 10, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``documents(doc_id, text)`` for each of
    ``items(item_id, text)``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A term's weight
    is floor(1000 ln((2N+2)/(2df+1))); a document's score sums w * (10^9 tf div (1000 tf + 8 m)) over
    the item's distinct terms, with m = 10 + 90 n N div L, in 64-bit integers. N counts the documents
    with a term, L all their terms, n one document's. Equal scores go by ascending doc_id. An item with fewer than k
    documents above 0 has fewer rows; one without terms, or with a null or empty text, has none.

    Null and empty texts are documents without terms and are never found. Rows that repeat a doc_id are documents of
    their own, each with its rank; rows without a doc_id take part in N, L and df but are not returned. Rows that repeat an item_id, a
    null one included, are one item with the terms of all. Other columns, of any name, are ignored. The
    documents are read once for each ``item_terms`` pairs of item and term, whose vocabulary travels by
    broadcast; a single item's terms must fit in one. Terms are told apart by 64-bit hashes and sizes.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    pairs = pin(asked.mapInArrow(_terms, f"item_id {kind}, term string").distinct())
    blocks = max(1, -(-pairs.count() // item_terms))
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    form = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    out = None
    for block in range(blocks):
        mine = pairs.filter(own == block).orderBy("item_id", "term").toArrow()
        if not mine.num_rows:
            continue
        found = _rank_block(spark, slim, mine, k, kind)
        out = found if out is None else out.unionByName(found)
    unpin(pairs)
    return spark.createDataFrame([], form) if out is None else out.select("item_id", "rank", "doc_id", "score")


def _rank_block(spark, slim: DataFrame, pairs: pa.Table, k: int, kind: str) -> DataFrame:
    """``rank`` for one block of items, given by their (item_id, term) pairs in order of item_id."""
    names = pairs.column("term").combine_chunks().dictionary_encode()
    raw, starts = X.buffers(names.dictionary)
    hashes = X.span_hashes(raw[: starts[-1]], starts[:-1], starts[1:], X._BYTES)
    order = np.argsort(hashes)
    hashes, sizes = hashes[order], np.diff(starts)[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term = place[names.indices.to_numpy()]
    ids = pairs.column("item_id").to_pylist()
    new = [i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))]
    item = np.cumsum(new) - 1

    bags = pin(slim.mapInArrow(_bags(hashes, sizes), "doc_id bigint, n bigint, terms array<int>, tfs array<int>"))
    n, total = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(hashes), np.int64)
    for r in bags.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    # documents with equal terms, frequencies and m lie side by side, a large class over many tasks
    classed = (
        bags.filter("doc_id IS NOT NULL AND size(terms) > 0")
        .withColumn("m", F.expr(f"10 + (90 * n * {n}L) div {max(total, 1)}L"))
        .withColumn("class", F.xxhash64("m", "terms", "tfs"))
        .drop("n")
        .repartitionByRange("class", "doc_id")
        .sortWithinPartitions("class", "m", "terms", "tfs", "doc_id")
    )
    scored = classed.mapInArrow(
        _score(weights, term, item, int(item[-1]) + 1, k), "item bigint, doc_id bigint, score bigint"
    )
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    labels = spark.createDataFrame(
        list(enumerate(x for x, first in zip(ids, new) if first)), f"item bigint, item_id {kind}"
    )
    return scored.withColumn("rank", turn).filter(F.col("rank") <= k).join(F.broadcast(labels), "item").drop("item")
