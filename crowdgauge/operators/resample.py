"""Bootstrap replicates without a row per row and replicate.

A fit is summed to its cells first. Equal comparisons of a cell, or the people of a fit, are the units
that are drawn: ``multinomial`` says for each unit and replicate how often. Units travel once for every
``REPS_PER_TASK`` replicates and come back as sums per cell, one array entry a replicate. Draws are
pure hashes of (seed, fit, replicate, place in the tree), so neither the number of partitions nor
the order of execution can change them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import graph, multinomial
from crowdgauge.operators.scan import OrderedGroups
from crowdgauge.runtime import pin, shuffle_partitions, unpin

#: Replicates of one task, and (unit, cell) rows that it takes.
REPS_PER_TASK, ROWS_PER_TASK = 128, 1 << 17


def poisson_steps() -> list[float]:
    """P(N <= k) of a Poisson(1) number, up to the k where doubles reach their end."""
    steps, step, total = [], math.exp(-1.0), 0.0
    while total + step > total and total < 1.0:
        total += step
        steps.append(total)
        step /= len(steps)
    return steps


def poisson(rows: DataFrame, fit: Sequence[str], n_rep: int, seed: int, unit: str = "response_id") -> DataFrame:
    """Rows with ``rep`` and ``times``, an independent Poisson(1) number for each unit: no positions,
    no join, and no fixed number of draws."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))).alias("rep")
    spread = rows.select("*", reps)
    # through a generated column, so that the hash is computed once and not once a step
    drawn = spread.select("*", F.explode(F.array(C.hash_draw(seed, *fit, "rep", unit))).alias("_draw"))
    first, *others = poisson_steps()
    times = sum(((F.col("_draw") >= t).cast("int") for t in others), F.lit(1))
    return drawn.filter(F.col("_draw") >= first).withColumn("times", times).drop("_draw")


def cells(rows: DataFrame, fit: Sequence[str], stat: Sequence[str]) -> DataFrame:
    """(fit, stat, weight, n, cell): the sums of every cell, numbered in the order of ``stat``."""
    summed = rows.groupBy(*fit, *stat).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    return pin(OrderedGroups(summed, fit, stat).with_position("cell").result)


def _units(rows: DataFrame, fit: list[str], stat: list[str], found: DataFrame, cluster: str | None) -> DataFrame:
    """(fit, unit, size, cell, rows, weight), pinned: what one draw of a unit adds to a cell."""
    number = found.select(*fit, *stat, "cell")
    if cluster is None:
        # written first: it is read to measure, to order and to number
        equal = pin(rows.groupBy(*fit, *stat, F.col("weight")).agg(F.count("*").alias("size")))
        ordered = OrderedGroups(equal, fit, [*stat, "weight"]).with_position("unit").result
        said, written = ordered.withColumn("rows", F.lit(1).cast("bigint")), [equal]
    else:
        sums = pin(rows.groupBy(*fit, cluster, *stat).agg(F.sum("weight").alias("weight"), F.count("*").alias("rows")))
        drawn = pin(sums.select(*fit, cluster).distinct())
        people = OrderedGroups(drawn, fit, [cluster]).with_position("unit").result
        said, written = sums.join(people, [*fit, cluster]).withColumn("size", F.lit(1).cast("bigint")), [sums, drawn]
    placed = pin(said.join(number, [*fit, *stat]).select(*fit, "unit", "size", "cell", "rows", "weight"))
    unpin(*written)
    return placed


def _drawn(head: pd.DataFrame, units: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, first replicate, weight sums, row sums) of one bundle of units and one run of replicates."""
    h = head.iloc[0]
    units = units.sort_values(["unit", "cell"], kind="stable")
    unit = units["unit"].to_numpy()
    new = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    row_unit = np.cumsum(np.append(True, unit[1:] != unit[:-1])) - 1
    reps = np.arange(h["first"], h["last"])
    times = multinomial.times(
        (int(h["key_a"]), int(h["key_b"])), reps, int(h["units"]), int(h["draws"]),
        units["size"].to_numpy()[new], int(h["bundle"]), np.asarray(h["totals"], np.int64),
    )
    order = np.argsort(units["cell"].to_numpy(), kind="stable")
    cell = units["cell"].to_numpy()[order]
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    drawn = times[row_unit[order]]
    weight = np.add.reduceat(drawn * units["weight"].to_numpy()[order][:, None], begin, axis=0)
    rows = np.add.reduceat(drawn * units["rows"].to_numpy()[order][:, None], begin, axis=0)
    return cell[begin], reps, weight, rows


def replicate_blocks(
    rows: DataFrame,
    found: DataFrame,
    fit: Sequence[str],
    stat: Sequence[str],
    n_rep: int,
    seed: int,
    cluster: str | None = None,
    reps_per_task: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(fit, first, cell, weights, times): sums of the replicates ``first``, ``first + 1``, … per cell.

    As many draws as a fit has rows, with replacement; with ``cluster`` as many as it has people, and
    a row enters as often as its person. ``found`` are the fit's ``cells``. A cell whose units lie in
    several bundles has several rows, to be added up.
    """
    fit, stat = list(fit), list(stat)
    units = _units(rows, fit, stat, found, cluster)
    size = units.groupBy(*fit).agg(
        (F.max("unit") + 1).alias("units"),
        F.sum(F.when(F.lit(cluster is None), F.col("size")).otherwise(0)).alias("draws"),
        F.count("*").alias("_rows"),
    )
    if cluster is not None:
        size = size.withColumn("draws", F.col("units"))
    size = pin(size)
    # subtrees of equal width, so that one holds about ``rows_per_task`` rows of the densest fit
    per_unit = size.agg(F.max(F.col("_rows") / F.col("units"))).first()[0] or 1.0
    width = 1 << max(0, int(math.log2(max(1.0, rows_per_task / per_unit))))
    if reps_per_task is None:
        # units travel once for every run of replicates: few bundles are still several tasks, many go alone
        bundles = size.agg(F.sum(F.ceil(F.col("units") / F.lit(width)))).first()[0] or 1
        runs = max(1, min(4, math.ceil(shuffle_partitions(rows.sparkSession) / bundles)))
        reps_per_task = max(8, min(REPS_PER_TASK, math.ceil(n_rep / runs)))
    bundled = units.withColumn("bundle", F.floor(F.col("unit") / F.lit(width)).cast("bigint"))
    once = bundled.select(*fit, "bundle", "unit", "size").distinct() if cluster else bundled
    totals = (
        once.groupBy(*fit, "bundle")
        .agg(F.sum("size").alias("total"))
        .groupBy(*fit)
        .agg(F.array_sort(F.collect_list(F.struct("bundle", "total")))["total"].alias("totals"))
    )
    firsts = F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1), F.lit(reps_per_task))).alias("first")
    heads = (
        size.join(totals, fit)
        .select(*fit, "units", "draws", "totals", F.explode(F.sequence(F.lit(0), F.size("totals") - 1)).alias("bundle"))
        .select("*", firsts)
        .withColumns(
            {
                "bundle": F.col("bundle").cast("bigint"),
                "last": F.least(F.col("first") + reps_per_task, F.lit(n_rep)),
                "key_a": C.hash_bits(8, seed, *fit, F.lit("a")),
                "key_b": C.hash_bits(8, seed, *fit, F.lit("b")),
            }
        )
    )
    kinds = dict(rows.select(*fit).dtypes)

    def sums(key: tuple, head: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        cell, reps, weight, drawn = _drawn(head, part)
        out = pd.DataFrame({"first": reps[0], "cell": cell, "weights": list(weight), "times": list(drawn)})
        for name, value in zip(fit, key, strict=False):
            out[name] = value
        return out[[*fit, "first", "cell", "weights", "times"]]

    keys = [*fit, "bundle", "first"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in fit), "first int, cell bigint"])
    return (
        heads.groupBy(*keys)
        .cogroup(bundled.select("*", firsts).groupBy(*keys))
        .applyInPandas(sums, f"{schema}, weights array<double>, times array<bigint>")
    )


def long(blocks: DataFrame, found: DataFrame, fit: Sequence[str], stat: Sequence[str]) -> DataFrame:
    """(fit, rep, stat, weight, times): one row per cell that a replicate drew."""
    both = F.posexplode(F.arrays_zip("weights", "times")).alias("_at", "_s")
    return (
        blocks.select(*fit, "first", "cell", both)
        .filter("_s.times > 0")
        .groupBy(*fit, (F.col("first") + F.col("_at")).alias("rep"), "cell")
        .agg(F.sum("_s.weights").alias("weight"), F.sum("_s.times").alias("times"))
        .join(found.select(*fit, "cell", *stat), [*fit, "cell"])
        .select(*fit, "rep", *stat, "weight", "times")
    )


def resample(
    rows: DataFrame,
    fit: Sequence[str],
    stat: Sequence[str],
    n_rep: int,
    seed: int,
    cluster: str | None = None,
    **options,
) -> DataFrame:
    """(fit, rep, stat, weight, times): the sums of every cell in every replicate that drew it."""
    found = cells(rows, fit, stat)
    blocks = replicate_blocks(rows, found, fit, stat, n_rep, seed, cluster, **options)
    return long(blocks, found, fit, stat)


def candidates(n_rep: int) -> int:
    """Attempts worth making: a fit survives only while at most 5 % of its attempts are
    discarded, so the wanted replicates must come within n / 0.95 attempts."""
    return max(n_rep, math.floor(n_rep / (1.0 - S.MAX_DISCARDED) + 1e-9))


def first_admissible(
    verdict: DataFrame, labels: DataFrame, fit: Sequence[str], n_rep: int
) -> tuple[DataFrame, DataFrame]:
    """The first ``n_rep`` replicates whose ``preserved`` says that they keep the graph, and a report
    per fit: attempts, discarded, failed.

    Every fit has at most ``candidates(n_rep)`` rows here, so taking the first n of them is cheap.
    """
    fit = list(fit)
    good = verdict.filter("preserved").groupBy(*fit).agg(
        F.slice(F.array_sort(F.collect_list("rep")), 1, n_rep).alias("reps")
    )
    every = labels.select(*fit).distinct().join(good, fit, "left")
    got = F.coalesce(F.size("reps"), F.lit(0))
    failed = F.coalesce(got < n_rep, F.lit(True))
    report = every.select(
        *fit,
        F.when(failed, F.lit(candidates(n_rep)))
        .otherwise(F.array_max("reps") + 1)
        .cast("bigint")
        .alias("attempts"),
        F.when(failed, F.lit(candidates(n_rep)) - F.greatest(got, F.lit(0)))
        .otherwise(F.array_max("reps") + 1 - n_rep)
        .cast("bigint")
        .alias("discarded"),
        failed.alias("failed"),
    )
    kept = every.filter(~failed).select(*fit, F.explode("reps").alias("rep"))
    return kept, report


def replicate_stats(
    rows: DataFrame,
    labels: DataFrame,
    fit: Sequence[str],
    stat: Sequence[str],
    edges_of: Callable[[DataFrame, Sequence[str]], DataFrame],
    n_rep: int,
    seed: int,
    cluster: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sufficient statistics of every admissible replicate, and the report per fit.

    ``stat`` are the grouping columns of the statistic, ``edges_of`` turns it into graph edges.
    """
    fit, stat = list(fit), list(stat)
    summed = pin(resample(rows, fit, stat, candidates(n_rep), seed, cluster).drop("times"))
    rep_edges = edges_of(summed, [*fit, "rep"])
    nodes = rep_edges.select(*fit, "rep", F.explode(F.array("u", "v")).alias("node"))
    rep_labels = graph.components_of_many(rep_edges, nodes, [*fit, "rep"])
    kept, report = first_admissible(graph.preserved(rep_labels, labels, fit), labels, fit, n_rep)
    report = pin(report)
    return summed.join(kept, [*fit, "rep"], "left_semi"), report
