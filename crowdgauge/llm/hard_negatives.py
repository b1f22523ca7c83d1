"""Hard negatives from blocks of candidates whose zone maps bound every score.

Candidates are ordered by label and Hilbert curve and written to Parquet as blocks of neighbours. Each
block has a zone map: the least and the greatest value of every component. For an anchor a, the interval
product of a with the zone map bounds the score of every row of the block, from below and from above.
A block is read for an anchor's positives if it has the label and its upper bound reaches a score that
five other rows surely have; it is read for a window of negatives if another label's scores can
lie in the window and reach one that ten rows of the window surely have. What surely exists is measured
on a bounded sample of rows. Anchors are taken in chunks of neighbours on the same curve, which read
mostly the same blocks; within a chunk and a group of blocks every row is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge.llm import vectors as V
from crowdgauge.runtime import pin, unpin

#: Rows of a block, anchors of a chunk, blocks that are scored together, zone maps and chunks that are judged together.
BLOCK, CHUNK, TOGETHER, ZONES, TEAM = 256, 512, 64, 4_096, 64
#: Candidates held for a chunk before only the best of each window are kept.
POOL = 1 << 20
_PLACED = "id bigint, asks boolean, label bigint, width int, place binary, vector binary"
_BLOCKS = (
    "block bigint, width int, label bigint, n_rows int, ids binary, labels binary, kind string, vectors binary, "
    "low binary, high binary"
)
_WINDOWS = (
    "number bigint, width int, n_rows int, ids binary, labels binary, kind string, vectors binary, "
    "anchor binary, positive binary, positive_score binary, low_score binary, high_score binary, reach binary"
)
_WANTED = "number bigint, block bigint, windows bigint"
_FOUND = (
    "number bigint, window bigint, score bigint, id bigint, "
    "anchor_id bigint, positive_id bigint, positive_score bigint"
)


def curve(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve, as sortable bytes, of rows of cell numbers below 2**bits.

    From the highest bit down, each axis with the bit set reflects the first axis, any other swaps
    with it below that bit; a Gray code over the axes then orders the cells of one level.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(n):
            up = (x[i] >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(up, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= ((x[n - 1] >> level) & 1) * ((1 << level) - 1)
    x ^= flip
    planes = [(x[i] >> level) & 1 for level in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def _edges(sample: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vectors the inner borders of the cells of every axis, equally filled in the sample."""
    out = {}
    for width, rows in sample.items():
        bits = max(2, min(8, 64 // max(width, 1)))
        out[width] = np.quantile(rows, np.arange(1, 1 << bits) / (1 << bits), axis=0) if width else np.zeros((3, 0))
    return out


def _place(edges: dict[int, np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in V.by_length(batch.column("embedding")):
                whole, width = np.floor(matrix * scale), matrix.shape[1]
                if width in edges and width and len(rows):
                    inner = edges[width]
                    cells = np.stack(
                        [np.searchsorted(inner[:, i], whole[:, i], side="right") for i in range(width)], axis=1
                    )
                    places = curve(cells, int(np.log2(len(inner) + 1)))
                else:
                    places = np.zeros((len(rows), 1), np.uint8)  # a length that the sample does not know
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(at) for c in ("id", "asks", "label")),
                        pa.array([width] * len(rows), pa.int32()),
                        pa.array([p.tobytes() for p in places], pa.binary()),
                        pa.array([x.tobytes() for x in whole], pa.binary()),
                    ],
                    names=["id", "asks", "label", "width", "place", "vector"],
                )

    return run


def _block(number: int, width: int, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> list:
    top = np.abs(matrix).max(initial=0.0)
    kind = next((k for k, limit in (("<i2", 2.0**15), ("<i4", 2.0**31)) if top < limit), "<f8")
    low, high = (f(axis=0) if len(matrix) else np.zeros(width) for f in (matrix.min, matrix.max))
    return [
        number, width, int(labels[0]), len(ids), ids.tobytes(), labels.tobytes(), kind,
        matrix.astype(kind).tobytes(), low.tobytes(), high.tobytes(),
    ]


def _gather(size: int, by_label: bool):
    """Sorted rows in blocks of at most ``size`` of one length, and of one label if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        held: list = []  # (ids, labels, matrix) of the block that is open
        key, rows = None, 0
        ready: list[list] = []

        def close() -> None:
            nonlocal held, rows, count
            if held:
                parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                ready.append(_block(base + count, parts[2].shape[1], *parts))
                count += 1
            held, rows = [], 0

        def flush() -> pa.RecordBatch:
            form = _arrow(_BLOCKS)
            columns = list(zip(*ready)) or [()] * len(form)
            ready.clear()
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, form, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in form])

        for batch in batches:
            widths, labels = batch.column("width").to_numpy(), batch.column("label").to_numpy()
            ids, vectors = batch.column("id").to_numpy(), batch.column("vector").to_pylist()
            change = np.flatnonzero((np.diff(widths) != 0) | ((np.diff(labels) != 0) & by_label)) + 1
            for a, b in zip([0, *change], [*change, len(ids)], strict=True):
                if a == b:
                    continue
                own = (widths[a], labels[a] if by_label else 0)
                if own != key:
                    close()
                    key = own
                while a < b:
                    n = min(size - rows, b - a)
                    matrix = np.frombuffer(b"".join(vectors[a : a + n])).reshape(n, widths[a])
                    held.append((ids[a : a + n], labels[a : a + n], matrix))
                    a, rows = a + n, rows + n
                    if rows == size:
                        close()
            if len(ready) >= 32:
                yield flush()
        close()
        yield flush()

    return run


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], row["kind"]).reshape(row["n_rows"], row["width"]).astype(np.float64)


def _ints(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers."""
    if np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _own(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[i, j]: the ids a[i] and b[j] are equal."""
    return a[:, None] == b[None, :]


class _Asked:
    """The windows of a chunk: pairs of an anchor and a range of scores, with what each surely reaches."""

    def __init__(self, chunk: dict, positives: bool, k: int):
        self.ids, self.labels, self.matrix = _ints(chunk, "ids"), _ints(chunk, "labels"), _matrix(chunk)
        self.positives, self.k = positives, k
        if positives:
            n = len(self.ids)
            self.anchor = np.arange(n)
            self.low, self.high = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
        else:
            self.anchor, self.low, self.high = (_ints(chunk, c) for c in ("anchor", "low_score", "high_score"))
        self.reach = self.low.copy()
        self.pool: list = []
        self.held = 0

    def take(self, label: int | None, labels: np.ndarray | None, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Score rows, all of one ``label`` or of ``labels`` each, and keep what can be among the first."""
        score = _products(self.matrix, matrix)
        allowed = ~_own(self.ids, ids)
        same = self.labels[:, None] == (label if labels is None else labels[None, :])
        allowed &= same if self.positives else ~same
        s = score[self.anchor]
        window, at = np.nonzero(allowed[self.anchor] & (s >= self.reach[:, None]) & (s <= self.high[:, None]))
        if len(window):
            self.pool.append((window, s[window, at], ids[at]))
            self.held += len(window)
        if self.held > POOL:
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep each window's first k: (window, score, id); what they reach is sure from now on."""
        if self.pool:
            window, score, ids = (np.concatenate(x) for x in zip(*self.pool))
        else:
            window, score, ids = (np.zeros(0, np.int64) for _ in range(3))
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        turn = np.arange(len(window)) - np.searchsorted(window, window)
        last = turn == self.k - 1
        self.reach[window[last]] = np.maximum(self.reach[window[last]], score[last])
        keep = turn < self.k
        best = window[keep], score[keep], ids[keep]
        self.pool, self.held = [best], int(keep.sum())
        return best

    def wants(self, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[window, block]: the block's scores, bounded by its zone map, can matter."""
        up, down = np.maximum(self.matrix, 0.0), np.minimum(self.matrix, 0.0)
        most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
        slack = 1e-9 * (1.0 + np.abs(self.matrix) @ np.maximum(np.abs(low), np.abs(high)).T)
        same = self.labels[:, None] == label[None, :]
        fine = (same if self.positives else ~same)[self.anchor]
        fine &= (most + slack)[self.anchor] >= self.reach[:, None].astype(np.float64)
        return fine & ((least - slack)[self.anchor] <= self.high[:, None].astype(np.float64))


def _add_reach(asked: _Asked, row: dict, sample: dict[int, tuple]) -> bytes:
    """What each window surely reaches among the sampled rows."""
    ids, labels, matrix = sample.get(row["width"], (np.zeros(0, np.int64), None, None))
    for i in range(0, len(ids), 1_024):
        asked.take(None, labels[i : i + 1_024], ids[i : i + 1_024], matrix[i : i + 1_024])
    asked.trim()
    return asked.reach.tobytes()


def _chunks(size: int, sample: dict[int, tuple], k: int):
    """Sorted anchors in chunks, with what their positives surely reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gather(size, False)(batches):
            reach = [_add_reach(_Asked(row, True, k), row, sample) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(reach, pa.binary())], names=[*batch.schema.names, "reach"]
            )

    return run


def _windows(least: int, most: int, sample: dict[int, tuple], k: int):
    """Chunks with a window of negatives for each anchor and positive."""

    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not chunks.num_rows:
            return pa.table({c: pa.array([], t) for c, t in _arrow(_WINDOWS)})
        found = found.sort_by([("window", "ascending"), ("score", "descending"), ("id", "ascending")])
        row = chunks.to_pylist()[0]
        anchor, score = (found.column(c).to_numpy().astype(np.int64) for c in ("window", "score"))
        row["anchor"], row["positive_score"] = anchor.tobytes(), score.tobytes()
        row["positive"] = found.column("id").to_numpy().astype(np.int64).tobytes()
        row["low_score"] = (-((-least * score) // 100)).tobytes()
        row["high_score"] = ((most * score) // 100).tobytes()
        row["reach"] = _add_reach(_Asked(row, False, k), row, sample)
        return pa.table({c: pa.array([row[c]], t) for c, t in _arrow(_WINDOWS)})

    return run


def _asked(chunk: dict, positives: bool, k: int) -> _Asked:
    asked = _Asked(chunk, positives, k)
    asked.reach = np.maximum(asked.reach, _ints(chunk, "reach"))
    return asked


def _choose(positives: bool, k: int):
    """(chunk, block, windows): the blocks that chunks must read, and for how many of their windows."""

    def run(chunks: pa.Table, zones: pa.Table) -> pa.Table:
        out = []
        label, blocks = zones.column("label").to_numpy(), zones.column("block").to_numpy()
        edge = lambda c: np.frombuffer(b"".join(zones.column(c).to_pylist())).reshape(len(label), -1)
        low, high = edge("low"), edge("high")
        for batch in chunks.to_batches(max_chunksize=1):
            chunk = batch.to_pylist()[0]
            wanted = _asked(chunk, positives, k).wants(label, low, high).sum(axis=0)
            some = np.flatnonzero(wanted)
            out.append((np.full(len(some), chunk["number"]), blocks[some], wanted[some]))
        return _table(_WANTED, out)

    return run


def _solve(positives: bool, k: int):
    """The first k of each window of a chunk among a group of blocks."""

    def run(chunks: pa.Table, blocks: pa.Table) -> pa.Table:
        if not chunks.num_rows or not blocks.num_rows:
            return _table(_FOUND, [])
        chunk = chunks.to_pylist()[0]
        asked = _asked(chunk, positives, k)
        for batch in blocks.to_batches(max_chunksize=1):
            row = batch.to_pylist()[0]
            asked.take(row["label"], None, _ints(row, "ids"), _matrix(row))
        window, score, ids = asked.trim()
        own = [np.full(len(window), chunk["number"]), window, score, ids, asked.ids[asked.anchor[window]]]
        other = (
            [np.zeros(len(window), np.int64)] * 2
            if positives
            else [_ints(chunk, c)[window] for c in ("positive", "positive_score")]
        )
        return _table(_FOUND, [own + other])

    return run


def _arrow(form: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return [(part.split()[0], kinds[part.split()[1]]) for part in form.split(", ")]


def _table(form: str, parts: list) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(form.split(", "))
    return pa.table({c: pa.array(x, t) for (c, t), x in zip(_arrow(form), columns, strict=True)})


def _search(chunks: DataFrame, blocks: DataFrame, positives: bool, k: int) -> DataFrame:
    """``_FOUND`` rows: the first k rows of every window of ``chunks``, after reading the blocks they need."""
    number = lambda c, size: max(1, -(-c.count() // size))
    teams, shards, parts = number(chunks, TEAM), number(blocks, ZONES), number(blocks, TOGETHER)
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # zone maps alone decide; blocks are read afterwards
    zones = blocks.select("block", "width", "label", "low", "high").withColumn("shard", hashed("block", shards))
    cell = ["width", "team", "shard"]
    wanted = pin(
        chunks.withColumns({"team": hashed("number", teams), "shard": every(shards)})
        .groupBy(*cell)
        .cogroup(zones.withColumn("team", every(teams)).groupBy(*cell))
        .applyInArrow(_choose(positives, k), _WANTED)
    )
    parted = wanted.withColumn("part", hashed("block", parts)).select("number", "block", "part")
    read = parted.join(blocks.select("block", "width", "label", "n_rows", "ids", "kind", "vectors"), "block")
    pairs = parted.select(F.col("number").alias("chunk"), F.col("part").alias("group")).distinct()
    asking = pairs.join(chunks, F.col("chunk") == F.col("number"))
    found = (
        asking.groupBy("chunk", "group")
        .cogroup(read.groupBy("number", "part"))
        .applyInArrow(_solve(positives, k), _FOUND)
    )
    turn = F.row_number().over(Window.partitionBy("number", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", turn).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
    sample: int = 4_096,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of
    ``vectors(vec_id, embedding, label)``.

    Components become floor(scale * x); a score is the integer inner product with the anchor. Anchors are
    the rows that fulfil ``is_anchor``. An anchor's positives are its first ``positives`` other rows of the
    same label, all if there are fewer; for each of them the first ``negatives`` rows of other labels with least * p <= 100 * score <= most * p are returned,
    p being the positive's score. Higher scores come first, ties by smaller vec_id. Windows without
    rows, such as those of a negative p, return nothing.

    Rows without vec_id or label take no part, nor do null vectors and those with a null or
    non-finite component. Vectors of different lengths are not compared. Rows that repeat a vec_id
    are candidates of their own, but never for an anchor of that id; anchors that are alike ask once. Labels are integers. An
    empty table gives an empty one; other columns, of any name, are ignored. Scores must stay below 2**63.

    ``sample`` rows at most are collected, chosen by the hash of their id; they set the cells of the curve and the
    scores that are surely reached, and change which blocks are read, never the result. The zone maps
    are judged as a grid of teams of anchors and shards of blocks, and blocks are read ``TOGETHER`` at
    a time for one chunk of anchors, so no task holds more however large a label is.
    """
    slim = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    picked = slim.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "label", "embedding").toArrow()
    known = {}
    if picked.num_rows:
        ids, labels = (picked.column(c).to_numpy() for c in ("id", "label"))
        for rows, matrix in V.by_length(picked.column("embedding").combine_chunks()):
            if len(rows):
                known[matrix.shape[1]] = ids[rows], labels[rows], np.floor(matrix * scale)
    edges = _edges({width: matrix for width, (_, _, matrix) in known.items()})
    placed = pin(slim.mapInArrow(_place(edges, scale), _PLACED))
    order = ["width", "label", "place", "id"]
    blocks = pin(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_gather(block, True), _BLOCKS)
    )
    order = ["width", "place", "id", "label"]
    chunks = pin(
        placed.filter("asks")
        .distinct()
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_chunks(CHUNK, known, positives), f"{_BLOCKS}, reach binary")
        .withColumnRenamed("block", "number")
    )
    best = _search(chunks, blocks, True, positives)
    windows = pin(
        chunks.groupBy("number")
        .cogroup(best.select("number", "window", "score", "id").groupBy("number"))
        .applyInArrow(_windows(least, most, known, negatives), _WINDOWS)
    )
    unpin(placed)
    return _search(windows, blocks, False, negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
