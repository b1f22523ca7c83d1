"""Near-duplicate documents by word n-gram Jaccard similarity, with parity sketches.

A document's distinct shingle hashes are dealt to blocks by their high bits, and each block holds the
XOR of its hashes. A shingle that only one of two documents has changes one block, so the number of
blocks that differ never exceeds the symmetric difference. Jaccard similarity bounds the symmetric
difference by the sizes; with more blocks than that bound, two similar documents agree in a whole
block (pigeonhole). Documents are therefore joined on (size band, block, parity). Pairs that meet are
filtered by the Hamming distance of a second parity sketch of one bit per shingle, which also
lower-bounds the symmetric difference, and verified on the exact sets.

Blocks of few shingles collide by chance. Every band has ``spare`` more blocks than the bound asks
for, and a document leaves out its smallest blocks as long as there are no more of those than spare
ones. Whether a block is small depends on its content alone, so two similar documents still share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.llm import text as X
from crowdgauge.llm.components import components
from crowdgauge.llm.runs import shared_rows
from crowdgauge.runtime import pin, unpin

_U = np.uint64
#: Rows of a block when members of a group are compared with each other.
#: Further centres that a bucket's members are compared with before they are compared with each other.
ROUNDS = 1
BLOCK = 1024
#: Ids that are broadcast to pick documents; above it they are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass
class Bands:
    """Size bands: sizes from ``lows[k]`` on, with the bound and the blocks of band ``k``.

    A pair belongs to the band of its larger document. The smaller one is put there as well, so a
    document is in its own band and in those above whose smallest partner sizes reach down to it.
    """

    percent: int
    ratio: float = 1.4
    spare: float = 0.15
    lows: list[int] = field(default_factory=lambda: [1])

    def low(self, k: int) -> int:
        while len(self.lows) <= k:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * self.ratio)))
        return self.lows[k]

    def of(self, size: int) -> list[int]:
        k = 0
        while self.low(k + 1) <= size:
            k += 1
        found = [k]
        while 100 * size >= self.percent * self.low(found[-1] + 1):
            found.append(found[-1] + 1)
        return found

    def bound(self, k: int) -> int:
        """The largest symmetric difference of a similar pair in the band."""
        return (100 - self.percent) * 2 * (self.low(k + 1) - 1) // (100 + self.percent)

    def spares(self, k: int) -> int:
        return int(np.ceil(self.spare * (self.bound(k) + 1)))

    def blocks(self, k: int) -> int:
        return self.bound(k) + 1 + self.spares(k)


def block_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of one document: one for each block that it takes part with."""
    keys = []
    for k in bands.of(len(found)) if len(found) else ():
        if bands.bound(k) == 0:
            continue  # only equal sets are similar there
        n = bands.blocks(k)
        step = (1 << 64) // n
        cuts = np.searchsorted(found, np.arange(n, dtype=_U) * _U(step))
        counts = np.diff(cuts, append=len(found))
        smallest = np.sort(counts)
        spare = bands.spares(k)
        # the count below which all blocks are left out, no more of them than spare ones
        floor = smallest[spare] if spare < n else smallest[-1] + 1
        kept = np.flatnonzero(counts >= floor)
        if not len(kept):
            continue
        parity = np.zeros(n, _U)
        filled = np.flatnonzero(counts)
        parity[filled] = np.bitwise_xor.reduceat(found, cuts[filled])
        keys.append(X.mix(parity[kept] + X.mix(kept.astype(_U) + _U(k + 1) * _U(0x100000001))))
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def bit_sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 2**j places, at least twice as many places as shingles."""
    places = 64
    while places < 2 * len(found):
        places *= 2
    at = (found >> _U(7)) & _U(places - 1)
    flips = np.bincount(at.astype(np.int64), minlength=places) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(_U)


def _signatures(k: int, fold: bool, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.small(batches):
            sizes, sums, xors, keys, sketches = [], [], [], [], []
            for found in X.shingle_sets(batch.column("text"), k, fold):
                sizes.append(len(found))
                sums.append(found.sum(dtype=_U))
                xors.append(np.bitwise_xor.reduce(found * _U(0x9E3779B97F4A7C15)) if len(found) else _U(0))
                keys.append(X.signed(block_keys(found, bands)))
                sketches.append(X.signed(bit_sketch(found)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(X.signed(np.array(sums, _U)), pa.int64()),
                    pa.array(X.signed(np.array(xors, _U)), pa.int64()),
                    X.list_array(sketches, pa.int64()),
                    X.list_array(keys, pa.int64()),
                ],
                names=["doc_id", "n_shingles", "set_sum", "set_xor", "sketch", "keys"],
            )

    return run


_SIGNATURES = (
    "doc_id bigint, n_shingles bigint, set_sum bigint, set_xor bigint, "
    "sketch array<bigint>, keys array<bigint>"
)


def shingle_arrays(docs: DataFrame, k: int, fold: bool) -> DataFrame:
    """(doc_id, shingles): the distinct shingle hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.small(batches):
            sets = [X.signed(s) for s in X.shingle_sets(batch.column("text"), k, fold)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), X.list_array(sets, pa.int64())], names=["doc_id", "shingles"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def pick(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Documents whose id is among ``ids`` (pinned and distinct).

    The ids are counted: up to ``BROADCAST_IDS`` they are broadcast, so that texts stay where they
    are; beyond it the two sides are joined by shuffle.
    """
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, column, "left_semi")


def _hamming() -> F.Column:
    """Distance of the sketches x and y; the longer one is folded onto the shorter."""

    def folded(c: str, other: str) -> F.Column:
        half = F.size(other)
        return F.when(
            F.size(c) > half,
            F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q)),
        ).otherwise(F.col(c))

    flips = F.zip_with(
        folded("x", "y"), folded("y", "x"), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("bigint")
    )
    return F.aggregate(flips, F.lit(0).cast("bigint"), lambda s, v: s + v)


def _plausible(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    end = lambda n, s, k: signs.select(
        F.col("cls").alias(n), F.col("sketch").alias(s), F.col("n_shingles").alias(k)
    )
    bound = (100 - percent) * (F.col("na") + F.col("nb"))
    return (
        pairs.join(end("a", "x", "na"), "a")
        .join(end("b", "y", "nb"), "b")
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .filter(_hamming() * (100 + percent) <= bound)
        .select("a", "b")
    )


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _compare(percent: int):
    """Plausible pairs of different labels between a group's queries and its data rows."""

    def run(table: pa.Table) -> pa.Table:
        cls, label, size = (table.column(c).to_numpy() for c in ("cls", "label", "n_shingles"))
        query = table.column("query").to_numpy()
        lists = table.column("sketch").combine_chunks()
        width = np.diff(lists.offsets.to_numpy())
        bits = lists.values.to_numpy().view(_U)
        at = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        left, right = [], []
        for w in np.unique(width):
            for v in np.unique(width):
                short = min(w, v)
                if max(w, v) > 2 * short:
                    continue  # sizes too far apart
                qs, ds = np.flatnonzero(query & (width == w)), np.flatnonzero(~query & (width == v))
                if not len(qs) or not len(ds):
                    continue
                data = _fold(bits[at[ds][:, None] + np.arange(v)], short)
                for i in range(0, len(qs), 256):
                    q = qs[i : i + 256]
                    part = _fold(bits[at[q][:, None] + np.arange(w)], short)
                    apart = np.zeros((len(q), len(ds)), np.int64)
                    for j in range(short):
                        apart += np.bitwise_count(part[:, j, None] ^ data[None, :, j])
                    x, y = size[q][:, None], size[ds][None, :]
                    near = apart * (100 + percent) <= (100 - percent) * (x + y)
                    near &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
                    near &= label[q][:, None] != label[ds][None, :]
                    r, c = np.nonzero(near)
                    left.append(cls[q[r]])
                    right.append(cls[ds[c]])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cls, center): members apart from their bucket's centre, with the smallest of them as the next one.

    A bucket whose open members are in one component with each other has nothing more to ask of them.
    """
    label = labels.select(F.col("node").alias("cls"), F.col("component").alias("label"))
    main = labels.select(F.col("node").alias("center"), F.col("component").alias("main"))
    marked = (
        buckets.join(label, "cls", "left")
        .join(main, "center", "left")
        .filter(F.coalesce("label", "cls") != F.coalesce("main", "center"))
        .withColumn("label", F.coalesce("label", "cls"))
    )
    following = pin(
        marked.groupBy("key")
        .agg(F.min("cls").alias("center"), F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low < high")
        .select("key", "center")
    )
    return marked.select("key", "cls").join(following, "key")


def _within_groups(buckets: DataFrame, labels: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b) that meet in a bucket and have different labels, pinned.

    Buckets of one label are settled. The members of all other buckets are gathered by the bucket's
    centre, once for each centre and member, and only members apart from the centre's label are
    compared with the rest: in blocks of ``BLOCK`` by ``BLOCK`` rows, on sketches alone, so a task
    holds two blocks and emits only pairs that the exact sets must decide. A group is sent once for
    each block of such members, so a large group with few of them moves about once.
    """
    label = labels.select(F.col("node").alias("cls"), F.col("component").alias("label"))
    main = labels.select(F.col("node").alias("center"), F.col("component").alias("main"))
    marked = (
        buckets.join(label, "cls", "left")
        .join(main, "center", "left")
        .withColumn("label", F.coalesce("label", "cls"))
        .withColumn("main", F.coalesce("main", "center"))
    )
    unsettled = marked.filter("label <> main").select("key").distinct()
    members = pin(
        marked.join(unsettled, "key", "left_semi")
        .select("center", "cls", "label", "main")
        .distinct()
    )
    apart = F.col("label") != F.col("main")
    count = members.groupBy("center").agg(
        F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"),
        F.ceil(F.count_if(apart) / F.lit(BLOCK)).alias("asks"),
    )
    blocked = (
        members.join(count, "center")
        .join(signs.select("cls", "n_shingles", "sketch"), "cls")
        .withColumn("d", F.pmod(F.xxhash64("cls"), "blocks"))
        .withColumn("q", F.pmod(F.xxhash64("cls"), "asks"))
    )

    def every(blocks: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))

    columns = ["center", "d", "q", "cls", "label", "n_shingles", "sketch", "query"]
    data = blocked.withColumn("q", every("asks")).withColumn("query", F.lit(False))
    queries = blocked.filter(apart).withColumn("d", every("blocks")).withColumn("query", F.lit(True))
    rows = data.select(*columns).unionByName(queries.select(*columns))
    found = pin(rows.groupBy("center", "d", "q").applyInArrow(_compare(percent), "a bigint, b bigint").distinct())
    unpin(members)
    return found


def _linked(pairs: DataFrame, docs: DataFrame, k: int, fold: bool, percent: int) -> DataFrame:
    """Pinned pairs (a, b) whose exact sets are similar."""
    ids = pin(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = pin(shingle_arrays(pick(docs, ids), k, fold))
    end = lambda n, s: sets.select(F.col("doc_id").alias(n), F.col("shingles").alias(s))
    both = F.size(F.array_intersect("x", "y"))
    links = pin(
        pairs.join(end("b", "y"), "b")
        .join(end("a", "x"), "a")
        .filter(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
        .distinct()
    )
    unpin(ids, sets)
    return links


def jaccard_components(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    fold: bool = True,
    ratio: float = 1.4,
    spare: float = 0.15,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of ``docs(doc_id, text)``.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their distinct shingles of
    ``words`` words; a shorter text is one shingle. ``component_id`` is the smallest doc_id that links
    reach. No link is lost: documents with equal sets are one class; every member of a bucket is first
    compared with the bucket's smallest, its centre; those that it does not link to are compared with the
    smallest of themselves, ``ROUNDS`` times over; then members that are not in one component with the
    first centre are compared with the whole bucket, but for members of their own component.

    Null and empty texts have the empty set, size 0 and link with nothing. A null doc_id keeps its
    row, with a null component. Rows that repeat a doc_id are one document with several texts. Other
    columns are ignored. Class ids and shingles are compared by 64-bit hashes (sets by two sums and
    their size).
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = Bands(percent, ratio, spare)
    signs = pin(docs.mapInArrow(_signatures(words, fold, bands), _SIGNATURES), codec="zstd")

    same = ["set_sum", "set_xor", "n_shingles"]
    small = signs.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", *same)
    # written first: a join with a table of its own can split a hot key, one with an aggregate cannot
    classes = pin(small.groupBy(*same).agg(F.min("doc_id").alias("cls")))
    member = pin(small.join(classes, same).select("doc_id", "cls").distinct())

    rows = signs.filter("doc_id IS NOT NULL").select("doc_id", F.explode("keys").alias("key"))
    met = pin(shared_rows(rows, "key", "doc_id"))
    sketches = pin(
        signs.join(member.filter("doc_id = cls").select("doc_id"), "doc_id", "left_semi").select(
            F.col("doc_id").alias("cls"), "n_shingles", "sketch"
        )
    )
    sizes = pin(signs.select("doc_id", "n_shingles"))
    unpin(signs, classes)

    places = pin(met.join(member, "doc_id").select("key", "cls").distinct())
    shared = places.groupBy("key").agg(F.min("cls").alias("center"), F.max("cls").alias("top"))
    shared = pin(shared.filter("center < top").drop("top"))
    buckets = pin(places.join(shared, "key"))
    unpin(met, shared, places)

    centers = buckets.filter("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b"))
    likely = _plausible(centers.distinct(), sketches, percent)
    # one centre a member is enough to begin with; the rest is compared in its group
    likely = pin(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = _linked(likely, docs, words, fold, percent)
    labels = components(links)
    asked, open_ = likely, buckets
    for _ in range(ROUNDS):
        open_ = pin(_still_open(open_, labels))
        if open_.isEmpty():
            break
        centers = open_.filter("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b"))
        near = _plausible(centers.distinct(), sketches, percent).join(asked, ["a", "b"], "left_anti")
        near = pin(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        links = links.unionByName(_linked(near, docs, words, fold, percent))
        labels, asked = components(links), asked.unionByName(near)
    rest = pin(_within_groups(buckets, labels, sketches, percent).join(asked, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = _linked(rest, docs, words, fold, percent)
        labels = components(links.unionByName(more))
    unpin(buckets, likely, rest, sketches)

    found = labels.select(F.col("node").alias("cls"), "component")
    named = member.join(found, "cls", "left").withColumn("cls", F.coalesce("component", "cls"))
    lowest = named.groupBy("doc_id").agg(F.min("cls").alias("cls"))
    return sizes.join(lowest, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("cls", "doc_id").alias("component_id")
    )
