"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are a window. A window that occurred before, in an
earlier document or further up in the same one, is repeated; the lines that repeated windows cover
are removed. A single line that many documents share stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdgauge.llm import text as X
from crowdgauge.llm.runs import shared_rows
from crowdgauge.runtime import pin

_NEWLINE = 10


def _lines(raw: np.ndarray, starts: np.ndarray):
    """(begin, end, first line of each document) of lines that hold more than white space."""
    begin, end, _ = X.spans(raw != _NEWLINE, starts)
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(X._SOLID[raw], out=filled[1:])
    some = filled[end] > filled[begin]
    begin, end = begin[some], end[some]
    return begin, end, np.searchsorted(begin, starts)


def _windows(raw: np.ndarray, starts: np.ndarray, width: int):
    """(hash of the window from each line on, first line of each document, begin, end of lines)."""
    begin, end, first = _lines(raw, starts)
    return X.window_hashes(X.span_hashes(raw, begin, end, X._BYTES), width), first, begin, end


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.small(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for low, high, raw, starts in X.chunks(batch.column("text")):
                keys, first, begin, _ = _windows(raw, starts, width)
                if not len(keys):
                    continue
                doc = np.repeat(np.arange(high - low), np.diff(first))
                line = np.arange(len(begin)) - first[doc]
                whole = doc[: len(keys)] == doc[width - 1 :]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(X.signed(keys[whole]), pa.int64()),
                        pa.array(ids[low:high][doc[: len(keys)][whole]], pa.int64()),
                        pa.array(line[: len(keys)][whole], pa.int32()),
                    ],
                    names=["key", "doc_id", "line"],
                )

    return run


def _rebuild(width: int, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.small(batches):
            column = batch.column(text)
            repeats = batch.column("_repeats")
            out, counts, gone_counts = [], [], []
            marked = ~np.asarray(repeats.is_null())
            for low, high, raw, starts in X.chunks(column):
                keys, first, begin, end = _windows(raw, starts, width)
                counts.append(np.diff(first))
                removed = np.zeros(high - low, np.int64)
                for i in np.flatnonzero(marked[low:high]):
                    lines = repeats[int(low + i)].as_py()
                    at = np.array([r["line"] for r in lines], np.int64) + first[i]
                    key = np.array([r["key"] for r in lines], np.int64).view(np.uint64)
                    # the same id may name several texts: only windows that are really there count
                    fits = at + width <= first[i + 1]
                    at = at[fits][keys[at[fits]] == key[fits]]
                    covered = np.unique((at[:, None] + np.arange(width)).ravel())
                    removed[i] = len(covered)
                    if len(covered):
                        out.append((low + i, _without(raw, starts[i], starts[i + 1], begin[covered], end[covered])))
                gone_counts.append(removed)
            values = column
            if out:
                texts = column.to_pylist()
                for i, kept in out:
                    texts[i] = kept
                values = pa.array(texts, column.type)
            arrays = [values if c == text else batch.column(c) for c in columns]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            gone = np.concatenate(gone_counts) if gone_counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                names=[*columns, "_lines", "_removed"],
            )

    return run


def _without(raw: np.ndarray, low: int, high: int, begin: np.ndarray, end: np.ndarray) -> str:
    """The text without the given lines; each goes with one line break."""
    keep = np.ones(high - low, bool)
    for b, e in zip(begin - low, end - low, strict=True):
        keep[b : e + 1] = False  # the break after it, if there is one
    kept = raw[low:high][keep].tobytes().decode()
    ends_bare = high == low or raw[high - 1] != _NEWLINE
    last_gone = len(end) and end[-1] == high
    return kept[:-1] if ends_bare and last_gone and kept.endswith("\n") else kept


def dedup_lines(docs: DataFrame, width: int = 3, counts: bool = False) -> DataFrame:
    """``docs`` without the lines that repeated windows of ``width`` lines cover.

    Lines are what line breaks separate; lines of white space alone are kept and not counted.
    Windows are ordered by doc_id, then by place; all but the first of equal windows are repeated,
    and a line goes if any repeated window holds it. Windows are judged on the input. Documents of
    fewer than ``width`` lines, null and empty texts stay as they are, and so do rows without a
    doc_id. Rows equal in doc_id and text are one document and are treated alike. All columns are
    kept; with ``counts`` the result is (doc_id, text, n_lines, n_removed). Windows are compared by
    64-bit hashes.
    """
    slim = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )
    rows = slim.mapInArrow(_window_rows(width), "key bigint, doc_id bigint, line int")
    met = pin(shared_rows(rows, "key", "doc_id", "line"))
    first = met.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    later = met.join(first, "key").filter(F.struct("doc_id", "line") > F.col("first"))
    repeats = later.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.struct("line", "key")).alias("_repeats")
    )
    if counts:
        docs = docs.select("doc_id", "text")
    joined = docs.join(repeats, docs["doc_id"] == repeats["_id"], "left").drop("_id")
    columns = docs.columns
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("_lines", T.LongType()), T.StructField("_removed", T.LongType())]
    )
    done = joined.mapInArrow(_rebuild(width, "text", columns), schema)
    if counts:
        return done.withColumnsRenamed({"_lines": "n_lines", "_removed": "n_removed"})
    return done.drop("_lines", "_removed")
