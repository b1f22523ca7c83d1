"""Embedding near-duplicates by an inverted multi-index.

The halves of the unit vectors have codebooks of their own; the product of the two is a grid of
cells. A vector lies in the cell of its nearest centres. Vectors of cosine c are sqrt(2 - 2c) apart,
and how far a cell is from a vector is bounded, half by half, by the border between the cell's centre
and the vector's own. The multi-sequence traversal takes cells by the growing sum of both bounds; it
ends where the sum passes the limit that the target recall asks for. That limit is taken from sampled
vectors, each compared with all rows. Vectors that meet in a cell are verified by their cosine in
double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.llm import vectors as V
from crowdgauge.llm.components import components
from crowdgauge.runtime import pin, unpin

#: Rows of a block when the vectors of a cell are compared.
BLOCK = 1_024
_SLACK = 1e-9


class Grid:
    """Two codebooks and the squared distance up to which cells are visited."""

    def __init__(self, units: np.ndarray, codes: int, threshold: float):
        self.width = units.shape[1]
        self.cut = self.width // 2
        self.books = [V.k_means(half, codes) for half in self._halves(units)]
        self.limit = self.most = max(0.0, 2.0 - 2.0 * threshold) + _SLACK

    def _halves(self, units: np.ndarray) -> list[np.ndarray]:
        units = V.fitted(units, self.width)
        return [units[:, : self.cut], units[:, self.cut :]]

    def home(self, units: np.ndarray) -> np.ndarray:
        first, second = (V.nearest(h, b)[0] for h, b in zip(self._halves(units), self.books, strict=True))
        return first * len(self.books[1]) + second

    def bounds(self, units: np.ndarray) -> list[np.ndarray]:
        """Per half: a lower bound of the squared distance of each row to each centre's region."""
        out = []
        for half, book in zip(self._halves(units), self.books, strict=True):
            d = V.squared(half, book)
            own = d.argmin(axis=1)
            apart = np.sqrt(V.squared(book, book))[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                border = (d - d.min(axis=1, keepdims=True)) / (2.0 * apart)
            border[np.arange(len(half)), own] = 0.0
            out.append(np.nan_to_num(border, nan=0.0, posinf=0.0) ** 2)
        return out

    def visits(self, units: np.ndarray) -> list[np.ndarray]:
        """The cells of each row, nearest first, up to the limit."""
        first, second = self.bounds(units)
        cells = []
        for a, b in zip(first, second, strict=True):
            rows, columns = np.flatnonzero(a <= self.limit), np.flatnonzero(b <= self.limit)
            total = np.round(a[rows][:, None] + b[columns][None, :], 10)
            i, j = np.nonzero(total <= self.limit)
            order = np.argsort(total[i, j], kind="stable")
            cells.append((rows[i] * len(self.books[1]) + columns[j])[order])
        return cells

    def sums(self, first: np.ndarray, second: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The bound of each (row, cell), rounded so that it is the same wherever it is computed."""
        n = len(self.books[1])
        return np.round(first[row, cell // n] + second[row, cell % n], 10)

    def calibrate(self, worst: np.ndarray, recall: float, whole: bool) -> None:
        """Set the limit up to which that share of linked vectors meet all their links.

        ``worst`` is the largest sum of each sampled vector's links. Unless the sample is ``whole``,
        it must hold so many linked vectors that one of them is beyond the share; with fewer the
        limit stays the one that holds every link.
        """
        if recall < 1.0 and len(worst) and (whole or len(worst) >= least_linked(recall)):
            self.limit = min(self.most, float(np.quantile(worst, recall, method="higher")) + _SLACK)


def least_linked(recall: float) -> int:
    return math.ceil(round(1.0 / (1.0 - recall), 6))


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are not zero, unit vectors), without overflow."""
    top = np.abs(matrix).max(axis=1, initial=0.0)
    some = np.flatnonzero(top > 0)
    scaled = matrix[some] / top[some][:, None]
    return some, scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _worst(threshold: float, shared):
    """The largest sum of each sampled vector's links to the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, sampled = shared.value
        bounds = {key: grid.bounds(units) for key, (_, _, units) in sampled.items()}
        found = {key: np.full(len(own), -1.0) for key, (own, _, _) in sampled.items()}
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            labels = np.array(batch.column("label").to_pylist(), object)
            for rows, matrix in V.by_length(batch.column("embedding")):
                some, units = _unit(matrix)
                rows, home = rows[some], grid.home(units)
                for label in set(labels[rows]):
                    key = (label, matrix.shape[1])
                    if key not in sampled:
                        continue
                    own, _, asked = sampled[key]
                    at = np.flatnonzero(labels[rows] == label)
                    for i in range(0, len(at), BLOCK):
                        near = at[i : i + BLOCK]
                        r, c = np.nonzero(asked @ units[near].T >= threshold)
                        other = own[r] != cls[rows[near[c]]]
                        r, c = r[other], c[other]
                        np.maximum.at(found[key], r, grid.sums(*bounds[key], r, home[near[c]]))
        place = np.concatenate([p[found[k] >= 0] for k, (_, p, _) in sampled.items()])
        most = np.concatenate([found[k][found[k] >= 0] for k in sampled])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(most, pa.float64())], names=["place", "worst"])

    return run


def _calibrated(classes: DataFrame, picked: pa.Table, grid: Grid, threshold: float, recall: float, whole: bool) -> Grid:
    """The grid with the limit that the links of the ``picked`` classes to all classes ask for."""
    labels = np.array(picked.column("label").to_pylist(), object)
    cls = picked.column("cls").to_numpy()
    sampled = {}
    for rows, matrix in V.by_length(picked.column("embedding").combine_chunks()):
        some, units = _unit(matrix)
        rows = rows[some]
        for label in sorted(set(labels[rows])):
            at = np.flatnonzero(labels[rows] == label)
            sampled[label, matrix.shape[1]] = (cls[rows[at]], rows[at], units[at])
    if sampled:
        shared = classes.sparkSession.sparkContext.broadcast((grid, sampled))
        found = classes.select("cls", "label", "embedding").mapInArrow(
            _worst(threshold, shared), "place bigint, worst double"
        )
        worst = found.groupBy("place").agg(F.max("worst").alias("worst")).toPandas()["worst"]
        grid.calibrate(worst.to_numpy(np.float64), recall, whole)
    return grid


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: Grid = shared.value
        for batch in batches:
            for rows, matrix in V.by_length(batch.column("embedding")):
                some, units = _unit(matrix)
                if not len(some):
                    continue
                at = pa.array(rows[some])
                cells = grid.visits(units)
                offsets = np.zeros(len(cells) + 1, np.int32)
                np.cumsum([len(c) for c in cells], out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("cls").take(at),
                        batch.column("label").take(at),
                        batch.column("copies").take(at),
                        pa.array([matrix.shape[1]] * len(some), pa.int32()),
                        pa.array([u.tobytes() for u in units], pa.binary()),
                        pa.array(grid.home(units), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cells), pa.int64())),
                    ],
                    names=["cls", "label", "copies", "width", "unit", "home", "visits"],
                )

    return run


def _compare(threshold: float, shared):
    """Links of a group's queries, and a forest that joins what the links join within the group.

    A link whose data vector does not visit the query's own cell is counted for both here.
    """

    def run(table: pa.Table) -> pa.Table:
        grid: Grid = shared.value
        query = table.column("query").to_numpy()
        cls = table.column("cls").to_numpy()
        copies, home = table.column("copies").to_numpy(), table.column("home").to_numpy()
        flat = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64)
        units = flat.reshape(len(query), -1)
        q, d = np.flatnonzero(query), np.flatnonzero(~query)
        links = units[q] @ units[d].T >= threshold
        links &= cls[q][:, None] != cls[d][None, :]
        r, c = np.nonzero(links)
        some_q, r = np.unique(r, return_inverse=True)
        some_d, c = np.unique(c, return_inverse=True)
        q, d, links = q[some_q], d[some_d], links[np.ix_(some_q, some_d)]
        count = links @ copies[d]
        back = np.zeros(len(d), np.int64)
        if len(d) and grid.limit < grid.most:
            alone = grid.sums(*grid.bounds(units[d]), c, home[q][r]) > grid.limit
            np.add.at(back, c[alone], copies[q][r[alone]])
        root_q, root_d = cls[q].copy(), cls[d].copy()
        top = np.iinfo(np.int64).max
        while len(q):
            new_q = np.minimum(root_q, np.where(links, root_d[None, :], top).min(axis=1))
            new_d = np.minimum(root_d, np.where(links, new_q[:, None], top).min(axis=0))
            if (new_q == root_q).all() and (new_d == root_d).all():
                break
            root_q, root_d = new_q, new_d
        return pa.table(
            {
                "a": np.concatenate([cls[q], cls[d]]),
                "b": np.concatenate([root_q, root_d]),
                "n": np.concatenate([count, back]).astype(np.int64),
            }
        )

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    codes: int = 16,
    sample: int = 8_192,
    recall: float = 0.999,
    asked: int = 16_384,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine
    is at least ``threshold``. Null and zero vectors and those with a null or non-finite component
    link with nothing. ``component_id`` is the smallest vec_id that links reach; ``kept`` says that it
    is the vector's own. The codebooks are fitted on ``sample`` vectors at most, chosen by the hash of
    their id; every vector is indexed. The traversal goes as far as that share ``recall`` of linked vectors
    needs to meet all their links, judged on ``asked`` vectors, each compared with all of its label; with
    1, or fewer than 1 / (1 - recall) linked ones among them where there are more vectors than ``asked``,
    it visits every cell that can hold a link. A link counts for both ends, whichever of them meets the other. Equal vectors are
    compared once and counted as often as they occur; the vectors of a cell are compared in blocks.
    Rows that repeat a vec_id are vectors of their own. Other columns are ignored.
    """
    slim = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumns(
        {
            "h1": F.xxhash64("label", "embedding"),
            "h2": F.xxhash64(F.reverse("embedding"), F.size("embedding"), "label"),
        }
    )
    usable = slim.filter("label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL")
    classes = pin(
        usable.groupBy("h1", "h2").agg(
            F.min("vec_id").alias("cls"),
            F.count("*").alias("copies"),
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        )
    )
    slimmed = classes.orderBy(F.xxhash64("cls"), "cls").limit(max(sample, asked)).select("cls", "label", "embedding")
    picked = slimmed.toArrow()
    fitting = picked.column("embedding").slice(0, sample).combine_chunks()
    parts = [_unit(m)[1] for _, m in V.by_length(fitting)] if picked.num_rows else []
    width = max((p.shape[1] for p in parts if len(p)), default=2)
    units = np.concatenate([V.fitted(p, width) for p in parts]) if parts else np.zeros((0, width))
    if not len(units):
        units = np.zeros((1, width))
    grid = Grid(units, codes, threshold)
    if recall < 1.0 and picked.num_rows:
        whole = picked.num_rows < max(sample, asked) <= asked
        grid = _calibrated(classes, picked.slice(0, asked), grid, threshold, recall, whole)
    shared = vectors.sparkSession.sparkContext.broadcast(grid)
    placed = pin(
        classes.select("cls", "label", "copies", "embedding").mapInArrow(
            _place(shared),
            "cls bigint, label string, copies bigint, width int, unit binary, home bigint, visits array<bigint>",
        )
    )
    cell = ["label", "width", "cell"]
    data = placed.withColumn("cell", F.col("home"))
    queries = placed.withColumn("cell", F.explode("visits"))
    held = data.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("d_blocks"))
    asked = queries.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("q_blocks"))
    blocks = pin(held.join(asked, cell))
    block = lambda n: F.pmod(F.xxhash64("cls"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    columns = [*cell, "d", "q", "cls", "copies", "home", "unit", "query"]
    rows = (
        data.join(blocks, cell)
        .withColumns({"d": block("d_blocks"), "query": F.lit(False)})
        .withColumn("q", every("q_blocks"))
        .select(*columns)
        .unionByName(
            queries.join(blocks, cell)
            .withColumns({"q": block("q_blocks"), "query": F.lit(True)})
            .withColumn("d", every("d_blocks"))
            .select(*columns)
        )
    )
    found = pin(rows.groupBy(*cell, "d", "q").applyInArrow(_compare(threshold, shared), "a bigint, b bigint, n bigint"))
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    labels = components(found.select("a", "b"))
    valid = placed.select("cls", "copies")
    summary = pin(
        valid.join(counts, "cls", "left")
        .join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        .join(classes.select("cls", "h1", "h2"), "cls")
        .select(
            "h1",
            "h2",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "cls").alias("component_id"),
        )
    )
    unpin(found, placed, blocks, labels, classes)
    usable_row = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    keys = [F.when(usable_row, F.col(h)).alias(h) for h in ("h1", "h2")]
    return (
        slim.select("vec_id", *keys)
        .join(summary, ["h1", "h2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
