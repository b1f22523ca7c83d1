"""Substring deduplication: repeated word windows found by FM-indexes of shards.

A window of ``k`` words always holds the same anchor, the least hash among its short word n-grams, so
equal windows have equal anchors at equal places. The windows of an anchor that several documents
share are a segment; all segments of an anchor go to one shard. A shard indexes its distinct segments and
streams them through backward search, which gives, for every window, the smallest document that
holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.llm import text as X
from crowdgauge.llm.fm_index import FMIndex, matching_minima
from crowdgauge.llm.ngram_join import BROADCAST_IDS, pick
from crowdgauge.llm.runs import shared_rows
from crowdgauge.runtime import pin, unpin

_U = np.uint64
#: Words of the n-grams among which an anchor is the least.
GRAM = 10
#: Words that one index holds at most, unless a single anchor's block has more.
SHARD_WORDS = 150_000
#: Distinct segments of one anchor that are indexed together; more are compared block by block.
BLOCK = 2_048


def _sliding(values: np.ndarray, width: int, pick_) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbouring values."""
    span, out = 1, values
    while span * 2 <= width:
        out = pick_(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick_(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least of some ``width`` neighbouring grams; ties count all."""
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, _U)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)


def own_windows(grams: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the ``width``-gram windows whose least gram each place of ``at`` holds.

    Those windows follow one another: a smaller gram on either side ends them.
    """
    least = _sliding(grams, width, np.minimum)
    first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i in range(0, len(at), 16_384):
        p = at[i : i + 16_384].astype(np.int64)
        window = p[:, None] + np.arange(1 - width, 1)
        inside = (window >= 0) & (window < len(least))
        own = inside & (least[np.where(inside, window, 0)] == grams[p][:, None])
        first[i : i + len(p)] = p + 1 - width + own.argmax(axis=1)
        last[i : i + len(p)] = first[i : i + len(p)] + own.sum(axis=1) - 1
    return first, last


def _grams(column: pa.Array, k: int):
    """(row, word hashes, n-gram hashes) of every text with a whole window."""
    for low, _, raw, starts in X.chunks(column):
        hashes, _, _, words = X.word_hashes(raw, starts)
        grams = X.window_hashes(hashes, GRAM)
        for i in np.flatnonzero(np.diff(words) >= k):
            a, b = words[i], words[i + 1]
            yield int(low + i), hashes[a:b], grams[a : b - GRAM + 1]


def _anchor_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.small(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys, docs, places = [], [], []
            for row, _, grams in _grams(batch.column("text"), k):
                at = anchors(grams, k - GRAM + 1)
                keys.append(grams[at])
                places.append(at)
                docs.append(np.full(len(at), ids[row]))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(X.signed(np.concatenate(keys)), pa.int64()),
                        pa.array(np.concatenate(docs), pa.int64()),
                        pa.array(np.concatenate(places), pa.int32()),
                    ],
                    names=["key", "doc_id", "place"],
                )

    return run


def _segment_rows(k: int):
    """The words of each shared anchor's own windows, from the first to the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.small(batches):
            lists = batch.column("anchors")
            docs = batch.column("doc_id")
            keys, own, begins, names, words = [], [], [], [], []
            for row, hashes, grams in _grams(batch.column("text"), k):
                held = lists[row].values
                at, key = held.field("place").to_numpy(), held.field("key").to_numpy()
                fits = at < len(grams)  # the same id may name several texts
                at, key = at[fits], key[fits]
                same = X.signed(grams[at]) == key
                first, last = own_windows(grams, at[same], k - GRAM + 1)
                short = hashes.astype(np.uint32)
                doc = docs[row].as_py()
                for begin, end, g in zip(first, last + k, key[same], strict=True):
                    if end < begin + k:
                        continue  # an equal gram of another text of the same id, least in no window here
                    part = hashes[begin:end]
                    keys.append(int(g))
                    own.append(doc)
                    begins.append(int(begin))
                    names.append(np.bitwise_xor.reduce(X.mix(part + np.arange(len(part), dtype=_U) * _U(0x9E3779B97F4A7C15))))
                    words.append(short[begin:end].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(X.signed(np.array(names, _U)), pa.int64()),
                    pa.array(own, pa.int64()),
                    pa.array(begins, pa.int32()),
                    pa.array(words, pa.binary()),
                ],
                names=["key", "segment", "doc_id", "begin", "words"],
            )

    return run


def _search(k: int):
    """Streams sorted segments; indexes whole anchor blocks until a shard is full."""

    def solve(shard: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(shard).combine_chunks()
        data = table.column("words").combine_chunks()
        parts = [np.frombuffer(w.as_buffer(), np.uint32) for w in data]
        size = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        texts = np.zeros(int((size + 1).sum()), np.int64)
        inner = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        _, dense = np.unique(np.concatenate(parts), return_inverse=True)
        texts[inner] = dense + 1
        docs = table.column("first_doc").to_numpy()
        of_place = np.repeat(docs, size + 1)
        index = FMIndex(texts)
        least, _ = matching_minima(index, texts, first, size, of_place[index.suffixes], k)
        hit = least < of_place
        # a segment has fewer windows than a window has words, so its hit windows cover one interval
        at = np.flatnonzero(least < of_place)
        of_hit = np.searchsorted(first, at, side="right") - 1
        edge = np.append(True, of_hit[1:] != of_hit[:-1]) if len(at) else np.zeros(0, bool)
        begin, end = at[edge], at[np.append(edge[1:], True) if len(at) else edge] + k
        segment = of_hit[edge]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(table.column("key").to_numpy()[segment], pa.int64()),
                pa.array(table.column("segment").to_numpy()[segment], pa.int64()),
                pa.array(docs[segment], pa.int64()),
                pa.array(begin - first[segment], pa.int32()),
                pa.array(end - first[segment], pa.int32()),
            ],
            names=["key", "segment", "doc_id", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, open_, words, held = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "low_block", "high_block")], axis=1)
            sizes = np.diff(np.frombuffer(batch.column("words").buffers()[1], np.int32)[batch.column("words").offset :][: batch.num_rows + 1]) // 4
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                if held is not None and tuple(keys[a]) != held:
                    full, open_ = full + open_, []
                    if words >= SHARD_WORDS:
                        yield solve(full)
                        full, words = [], 0
                held = tuple(keys[a])
                open_.append(batch.slice(a, b - a))
                words += int(sizes[a:b].sum())
        if full or open_:
            yield solve(full + open_)

    return run


def _covered(hits, n: int) -> np.ndarray:
    """Which of n words the intervals cover."""
    edges = np.zeros(n + 1, np.int64)
    if hits is not None:
        begin = np.minimum(hits.field("begin").to_numpy(), n)
        end = np.minimum(hits.field("end").to_numpy(), n)
        np.add.at(edges, begin, 1)
        np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.small(batches):
        hits, texts, counts, gone = batch.column("hits"), [], [], []
        marked = ~np.asarray(hits.is_null())
        for low, _, raw, starts in X.chunks(batch.column("text")):
            begin, end, words = X.spans(X._SOLID[raw], starts)
            for i in range(len(words) - 1):
                a, b = words[i], words[i + 1]
                own = raw[starts[i] : starts[i + 1]].tobytes()
                if marked[low + i]:
                    cover = _covered(hits[int(low + i)].values, b - a)
                    at = np.arange(a, b)[~cover]
                    kept = [raw[x:y].tobytes() for x, y in zip(begin[at], end[at], strict=True)]
                    texts.append(b" ".join(kept).decode())
                    gone.append(int(cover.sum()))
                else:
                    texts.append(b" ".join(own.split()).decode())
                    gone.append(0)
                counts.append(b - a)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
            names=["doc_id", "text", "n_words", "n_removed"],
        )


def repeated_in(firsts: DataFrame, k: int) -> DataFrame:
    """(key, segment, doc_id, low, high): the interval of each segment of ``firsts(key, segment,
    first_doc, words)`` that windows of the same key in smaller documents cover, if any do."""
    sizes = pin(firsts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    dealt = (
        firsts.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("segment"), blocks))
        .withColumn("other", other)
        .select(
            "key",
            F.least("block", "other").alias("low_block"),
            F.greatest("block", "other").alias("high_block"),
            "segment",
            "first_doc",
            "words",
        )
    )
    group = ["key", "low_block", "high_block"]
    return (
        dealt.repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(_search(k), "key bigint, segment bigint, doc_id bigint, low int, high int")
    )


def repeated_spans(docs: DataFrame, k: int = 50) -> DataFrame:
    """(doc_id, begin, end): word intervals of ``docs(doc_id, text)`` that equal windows of ``k`` words
    in documents of smaller ids cover. Intervals of a document may overlap."""
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = docs.mapInArrow(_anchor_rows(k), "key bigint, doc_id bigint, place int")
    met = pin(shared_rows(rows, "key", "doc_id", "place"))
    among = met.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # written first: a join with a table of its own can split a hot key, one with an aggregate cannot
    several = pin(among.filter("low < high").select("key"))
    held = met.join(several, "key", "left_semi")
    placed = pin(held.groupBy("doc_id").agg(F.collect_list(F.struct("place", "key")).alias("anchors")))
    unpin(met, several)
    ids = pin(placed.select("doc_id"))
    texts = pick(docs, ids).join(placed, "doc_id")
    segments = pin(
        texts.mapInArrow(
            _segment_rows(k), "key bigint, segment bigint, doc_id bigint, begin int, words binary"
        ),
        codec="zstd",
    )
    # equal segments of many documents are one, named by the smallest of them
    firsts = pin(
        segments.groupBy("key", "segment").agg(F.min("doc_id").alias("first_doc"), F.first("words").alias("words")),
        codec="zstd",
    )
    unpin(placed, ids)
    found = repeated_in(firsts, k)
    slim = segments.select("key", "segment", "doc_id", "begin", (F.octet_length("words") / 4).cast("int").alias("size"))
    copies = slim.join(firsts.select("key", "segment", "first_doc"), ["key", "segment"])
    # a later document that has the whole segment repeats all its windows
    later = copies.filter("doc_id > first_doc").select("doc_id", "begin", (F.col("begin") + F.col("size")).alias("end"))
    # the first one repeats what the index found in smaller documents
    own = slim.join(found, ["key", "segment", "doc_id"]).select(
        "doc_id", (F.col("begin") + F.col("low")).alias("begin"), (F.col("begin") + F.col("high")).alias("end")
    )
    return later.unionByName(own)


def dedup_substrings(docs: DataFrame, k: int = 50) -> DataFrame:
    """(doc_id, text, n_words, n_removed): the words of every document that no repeated window covers,
    joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if a window of ``k`` words that
    covers it occurs in a document with a smaller doc_id too; windows are judged on the input. Texts of
    fewer than ``k`` words stay; null texts have no words and the empty text. Rows without a doc_id are
    neither judged nor a reason to remove. Rows that repeat a doc_id lose the same places. Other
    columns are ignored. Words are compared by 32 bits of their hash each, whole segments by 64.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, k)
    hits = pin(spans.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("hits")))
    schema = "doc_id bigint, text string, n_words bigint, n_removed bigint"
    none = F.lit(None).cast(hits.schema["hits"].dataType)
    if hits.count() > BROADCAST_IDS:
        return docs.join(hits, "doc_id", "left").mapInArrow(_keep, schema)
    # few documents are hit: only their texts are moved, the others are read where they lie
    ids = F.broadcast(hits.select("doc_id"))
    hit = docs.join(ids, "doc_id", "left_semi").join(hits, "doc_id")
    clean = docs.join(ids, "doc_id", "left_anti").withColumn("hits", none)
    return hit.mapInArrow(_keep, schema).unionByName(clean.mapInArrow(_keep, schema))
