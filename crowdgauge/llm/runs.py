"""Rows that share a key, found by one range-partitioned sort that splits hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def shared_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows whose ``key`` another row has too, with at most two others per partition.

    The rows are range-partitioned by key and ``order``, so a key that holds a third of all rows is
    spread over many tasks. Each task streams its sorted rows and keeps those whose neighbour has
    the same key, and its first and last row, whose neighbours other tasks may hold. Callers make
    the result exact by an aggregate over the few rows that are left. Keys must not be null.
    """
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    place = rows.columns.index(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, same_before = None, True  # the row not yet decided, and whether it must stay
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                table = pa.Table.from_batches([held, batch]).combine_chunks()
                batch = table.to_batches()[0]
            keys = batch.column(place).to_numpy(zero_copy_only=False)
            equal = keys[1:] == keys[:-1]
            keep = np.zeros(len(keys), bool)
            keep[0] = same_before
            keep[1:] |= equal
            keep[:-1] |= equal
            last = len(keys) - 1
            same_before = bool(keep[last])
            if last:
                yield batch.slice(0, last).filter(pa.array(keep[:last]))
            held = batch.slice(last, 1)
        if held is not None:
            yield held

    return ordered.mapInArrow(scan, rows.schema)
