"""Exact top-k by inner product as a Voronoi join.

Queries and data are grouped by their nearest pivot. With q = p + u and y = r + v for pivots p and r,
q.y = p.r + u.r + p.v + u.v, so the distances to the pivots bound every product. From each data group
the least distances are summarised; the k-th best lower bound among them is a score that every query of
a group surely reaches. Data whose upper bound stays below it are not sent to that group. Each group
is solved where its data meet, and the best of all blocks are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge.llm import vectors as V
from crowdgauge.runtime import pin

#: Rows of a block of queries and of data.
QUERIES, DATA = 512, 4_096
_FORM = "id bigint, asks boolean, width int, pivot int, apart double, vector binary"


def _assign(pivots: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in V.by_length(batch.column("embedding")):
                whole = np.floor(matrix * scale)
                near, d = V.nearest(V.fitted(whole, pivots.shape[1]), pivots)
                extra = whole[:, pivots.shape[1] :]
                apart = np.sqrt(d + (extra * extra).sum(axis=1))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at),
                        batch.column("asks").take(at),
                        pa.array([matrix.shape[1]] * len(rows), pa.int32()),
                        pa.array(near, pa.int32()),
                        pa.array(apart, pa.float64()),
                        pa.array([x.tobytes() for x in whole], pa.binary()),
                    ],
                    names=["id", "asks", "width", "pivot", "apart", "vector"],
                )

    return run


def _cuts(pivots: np.ndarray, radius: dict, nearest: dict, k: int) -> np.ndarray:
    """[query group, data group]: the least distance to its pivot that a datum must have to be sent."""
    n = len(pivots)
    dot, norm = pivots @ pivots.T, np.sqrt((pivots * pivots).sum(axis=1))
    cuts = np.full((n, n), np.inf)
    for i, rho in radius.items():
        reach = norm[i] + rho
        sure = np.sort(
            np.concatenate(
                [dot[i, j] - rho * norm[j] - reach * np.array(t) for j, t in nearest.items()] or [np.zeros(0)]
            )
        )[::-1]
        # the query itself may be among them
        floor = sure[k] if len(sure) > k else -np.inf
        slack = 1e-6 * (1.0 + abs(floor)) if np.isfinite(floor) else 0.0
        for j in nearest:
            need = floor - slack - dot[i, j] - rho * norm[j]
            cuts[i, j] = need / reach if reach > 0 else (-np.inf if need <= 0 else np.inf)
    return cuts


def _solve(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy()
        ids = table.column("id").to_numpy()
        flat = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64)
        matrix = flat.reshape(len(ids), -1)
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        d = d[np.argsort(ids[d], kind="stable")]
        top = [np.abs(matrix[x]).max(initial=0.0) for x in (q, d)]
        out = ([], [], [])
        for i in range(0, len(q), 128):
            part = q[i : i + 128]
            if top[0] * top[1] * max(1, matrix.shape[1]) < 2.0**53:
                score = (matrix[part] @ matrix[d].T).astype(np.int64)
            else:
                score = matrix[part].astype(np.int64) @ matrix[d].T.astype(np.int64)
            own = ids[part][:, None] == ids[d][None, :]
            for row, (mine, s) in enumerate(zip(own, score, strict=True)):
                others = np.flatnonzero(~mine)
                if len(others) > k:
                    least = np.partition(s[others], len(others) - k)[len(others) - k]
                    above = others[s[others] > least]
                    level = others[s[others] == least][: k - len(above)]  # smaller ids first
                    others = np.concatenate([above, level])
                out[0].append(np.full(len(others), ids[part[row]]))
                out[1].append(ids[d[others]])
                out[2].append(s[others])
        names = ("query_id", "vec_id", "score")
        return pa.table({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in zip(names, out, strict=True)})

    return run


def top_k(
    vectors: DataFrame, is_query, k: int = 20, scale: int = 64, pivots: int = 16, sample: int = 2_048
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of each query of ``vectors(vec_id, embedding)``.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller
    vec_id. ``is_query`` is a condition on the rows. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows without a vec_id; vectors of different lengths are
    not compared. Rows that repeat a vec_id are data of their own, but never a result for their own id,
    and ask once each distinct row. Scores are exact up to 2**63. Pivots are chosen from ``sample``
    rows at most, by the hash of their id; their summaries, k + 1 numbers for each pivot, are the only
    thing that is collected. Other columns are ignored.
    """
    slim = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    picked = slim.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
    parts = [m for _, m in V.by_length(picked.column(0).combine_chunks())] if picked.num_rows else []
    width = max((p.shape[1] for p in parts if len(p)), default=1)
    points = [np.floor(V.fitted(p, width) * scale) for p in parts if len(p)]
    centers = V.k_means(np.concatenate(points), pivots) if points else np.zeros((1, width))
    placed = pin(slim.mapInArrow(_assign(centers, scale), _FORM))

    turn = F.row_number().over(Window.partitionBy("pivot", "width").orderBy("apart", "id"))
    near = placed.withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    summaries: dict[int, tuple[dict, dict]] = {}
    for r in placed.filter("asks").groupBy("width", "pivot").agg(F.max("apart").alias("apart")).collect():
        summaries.setdefault(r["width"], ({}, {}))[0][r["pivot"]] = r["apart"]
    for r in near.select("width", "pivot", "apart").collect():
        if r["width"] in summaries:
            summaries[r["width"]][1].setdefault(r["pivot"], []).append(r["apart"])
    # (width, query group, data group, least distance): as many rows as pairs of pivots
    cuts = [
        (w, i, j, float(c))
        for w, (radius, nearest) in summaries.items()
        for (i, j), c in np.ndenumerate(_cuts(centers, radius, nearest, k))
        if c < np.inf
    ]
    spark = vectors.sparkSession
    wanted = spark.createDataFrame(cuts, "width int, group int, pivot int, cut double")
    sent = pin(
        placed.join(F.broadcast(wanted), ["width", "pivot"])
        .filter(F.col("apart") >= F.col("cut"))
        .select("width", "group", "id", "vector")
    )
    queries = placed.filter("asks").select("width", F.col("pivot").alias("group"), "id", "vector")
    group = ["width", "group"]
    n = lambda df, size, name: df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(size)).alias(name))
    blocks = pin(n(sent, DATA, "d_blocks").join(n(queries, QUERIES, "q_blocks"), group))
    block = lambda c: F.pmod(F.xxhash64("id"), c)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    columns = [*group, "d", "q", "id", "vector", "query"]
    rows = (
        sent.join(F.broadcast(blocks), group)
        .withColumns({"d": block("d_blocks"), "query": F.lit(False)})
        .withColumn("q", every("q_blocks"))
        .select(*columns)
        .unionByName(
            queries.join(F.broadcast(blocks), group)
            .withColumns({"q": block("q_blocks"), "query": F.lit(True)})
            .withColumn("d", every("d_blocks"))
            .select(*columns)
        )
    )
    solved = rows.groupBy(*group, "d", "q").applyInArrow(_solve(k), "query_id bigint, vec_id bigint, score bigint")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
