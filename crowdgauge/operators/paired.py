"""Paired-comparison strengths with a virtual opponent, for all fits and replicates in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import estimate, graph, resample, select
from crowdgauge.operators.scan import largest_group
from crowdgauge.runtime import pin

#: Edges of one component a task may hold; larger ones iterate as joins.
EDGES_PER_TASK = 500_000


# --------------------------------------------------------------- iteration as joins and sums
def _totals(win: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every item with the weight it won."""
    sides = F.array(
        F.struct(F.col("winner").alias("item_id"), F.col("weight").alias("won")),
        F.struct(F.col("loser").alias("item_id"), F.lit(0.0).alias("won")),
    )
    return (
        win.select(*group, F.explode(sides).alias("s"))
        .groupBy(*group, "s.item_id")
        .agg(F.sum("s.won").alias("won"))
    )


def bt_step(pi: DataFrame, win: DataFrame, group: Sequence[str], eps: float) -> DataFrame:
    """One simultaneous update of all strengths, renormalised to geometric mean 1 per group.

    pi: (group, item_id, won, pi). An edge gives ``w / (pi_winner + pi_loser)`` to both its ends.
    """
    own = pi.select(*group, "item_id", "pi")
    shared = (
        win.join(own.withColumnRenamed("item_id", "winner").withColumnRenamed("pi", "_pw"), [*group, "winner"])
        .join(own.withColumnRenamed("item_id", "loser").withColumnRenamed("pi", "_pl"), [*group, "loser"])
        .select(
            *group,
            (F.col("weight") / (F.col("_pw") + F.col("_pl"))).alias("_share"),
            F.explode(F.array("winner", "loser")).alias("item_id"),
        )
        .groupBy(*group, "item_id")
        .agg(F.sum("_share").alias("_share"))
    )
    raised = pi.join(shared, [*group, "item_id"]).withColumn(
        "_new",
        (F.col("won") + F.lit(eps))
        / (F.col("_share") + F.lit(2.0 * eps) / (F.col("pi") + F.lit(1.0))),
    )
    level = raised.groupBy(*group).agg(F.exp(F.avg(F.log("_new"))).alias("_level"))
    return raised.join(level, list(group)).select(
        *group,
        "item_id",
        "won",
        F.col("pi").alias("_before"),
        (F.col("_new") / F.col("_level")).alias("pi"),
    )


def bt_iterate(
    win: DataFrame,
    group: Sequence[str],
    eps: float = S.DEFAULTS["aggregation.bt_prior"],
    max_iter: int = S.DEFAULTS["aggregation.max_iter"],
    tol: float | None = S.DEFAULTS["aggregation.tol"],
) -> DataFrame:
    """(group, item_id, theta) by joins and partial sums only, each round pinned.

    With ``tol`` None exactly ``max_iter`` rounds run.
    """
    win = pin(win.select(*group, "winner", "loser", "weight"))
    pi = pin(_totals(win, group).withColumn("pi", F.lit(1.0)))
    for _ in range(max_iter):
        step = pin(bt_step(pi, win, group, eps))
        pi = step.drop("_before")
        if tol is not None:
            moved = step.agg(F.max(F.abs(F.log("pi") - F.log("_before")))).first()[0]
            if moved is None or moved < tol:
                break
    return pi.select(*group, "item_id", F.log("pi").alias("theta"))


# ------------------------------------------------------------------- small groups, one task each
def _settle(winner, loser, weight, eps: float, max_iter: int, tol: float) -> np.ndarray:
    """Log-strengths of one component, from its edge list."""
    size = int(max(winner.max(), loser.max())) + 1
    won = np.bincount(winner, weight, size) + eps
    pi = np.ones(size)
    for _ in range(max_iter):
        share = weight / (pi[winner] + pi[loser])
        met = np.bincount(winner, share, size) + np.bincount(loser, share, size)
        new = won / (met + 2.0 * eps / (pi + 1.0))
        new /= np.exp(np.log(new).mean())
        moved = np.abs(np.log(new / pi)).max()
        pi = new
        if moved < tol:
            break
    return np.log(pi)


def bt_grouped(
    win: DataFrame, group: Sequence[str], eps: float, max_iter: int, tol: float
) -> DataFrame:
    """The same fixed point, one task per (fit, replicate, component).

    A group holds the summed edges of one graph, at most the catalog squared, checked before.
    """
    keys = list(group)
    kinds = dict(win.select(*keys, "winner").dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"item_id {kinds['winner']}", "theta double"])

    def solve(key: tuple[Any, ...], edges: pd.DataFrame) -> pd.DataFrame:
        items, codes = np.unique(
            np.concatenate([edges["winner"], edges["loser"]]), return_inverse=True
        )
        half = len(edges)
        theta = _settle(
            codes[:half], codes[half:], edges["weight"].to_numpy(float), eps, max_iter, tol
        )
        out = pd.DataFrame({"item_id": items, "theta": theta})
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out[[*keys, "item_id", "theta"]]

    slim = win.select(*keys, "winner", "loser", "weight")
    return slim.groupBy(*keys).applyInPandas(solve, schema)


def bt_fit(
    win: DataFrame,
    group: Sequence[str],
    eps: float = S.DEFAULTS["aggregation.bt_prior"],
    max_iter: int = S.DEFAULTS["aggregation.max_iter"],
    tol: float = S.DEFAULTS["aggregation.tol"],
    edges_per_task: int = EDGES_PER_TASK,
) -> DataFrame:
    """Strengths per group: in one task per group while the largest group fits, as joins beyond."""
    if largest_group(win, group) <= edges_per_task:
        return bt_grouped(win, group, eps, max_iter, tol)
    return bt_iterate(win, group, eps, max_iter, tol)


def _reached(at: np.ndarray, low: np.ndarray, begin: np.ndarray, nodes: np.ndarray, size: int) -> np.ndarray:
    """Least label that each node hears, from values in the order of the nodes."""
    out = np.full((size, low.shape[1]), size, low.dtype)
    out[nodes] = np.minimum.reduceat(low[at], begin, axis=0)
    return out


def _order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places by code, where each code begins among them, the codes)."""
    at = np.argsort(codes, kind="stable")
    nodes, begin = np.unique(codes[at], return_index=True)
    return at, begin, nodes


def preserved(u: np.ndarray, v: np.ndarray, drawn: np.ndarray, parts: int) -> np.ndarray:
    """Replicates (columns of ``drawn``, one row an edge) whose edges leave no more than ``parts`` parts."""
    items, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    half, size = len(u), len(items)
    at, begin, nodes = _order(codes)
    own = np.broadcast_to(np.arange(size)[:, None], (size, drawn.shape[1])).copy()
    there = np.concatenate([drawn, drawn])
    while True:
        far = np.where(there, np.concatenate([own[codes[half:]], own[codes[:half]]]), size)
        new = np.minimum(own, _reached(at, far, begin, nodes, size))
        new = np.take_along_axis(new, new, axis=0)
        if np.array_equal(new, own):
            return (own == np.arange(size)[:, None]).sum(axis=0) == parts
        own = new


class _Graph:
    """The edges of one fit as codes, with what a node's sums over its edges need."""

    def __init__(self, winner: np.ndarray, loser: np.ndarray, label: np.ndarray):
        self.items, codes = np.unique(np.concatenate([winner, loser]), return_inverse=True)
        half, self.size = len(winner), len(self.items)
        self.winner, self.loser = codes[:half], codes[half:]
        self.at, self.begin, self.nodes = _order(codes)
        self.won_at, self.won_begin, self.won_nodes = _order(self.winner)
        parts = np.empty(self.size, label.dtype)
        parts[self.winner], parts[self.loser] = label, label
        self.labels, self.part = np.unique(parts, return_inverse=True)
        self.part_at, self.part_begin, _ = _order(self.part)
        self.part_size = np.bincount(self.part)[:, None].astype(float)

    def settle(self, weight: np.ndarray, start: np.ndarray | None, eps: float, max_iter: int, tol: float) -> np.ndarray:
        """Log-strengths [item, replicate]; every replicate stops when none of its parts moves."""
        won = np.zeros((self.size, weight.shape[1]))
        won[self.won_nodes] = np.add.reduceat(weight[self.won_at], self.won_begin, axis=0)
        won += eps
        pi = np.ones_like(won) if start is None else np.repeat(np.exp(start)[:, None], won.shape[1], axis=1)
        out, live = np.empty_like(pi), np.arange(won.shape[1])
        for _ in range(max_iter):
            share = weight / (pi[self.winner] + pi[self.loser])
            met = np.add.reduceat(np.concatenate([share, share])[self.at], self.begin, axis=0)
            new = won / (met + 2.0 * eps / (pi + 1.0))
            level = np.add.reduceat(np.log(new)[self.part_at], self.part_begin, axis=0) / self.part_size
            new /= np.exp(level)[self.part]
            open_ = np.abs(np.log(new / pi)).max(axis=0) >= tol
            pi = new
            if not open_.all():
                out[:, live[~open_]] = pi[:, ~open_]
                pi, won, weight, live = pi[:, open_], won[:, open_], weight[:, open_], live[open_]
                if not len(live):
                    break
        out[:, live] = pi
        return np.log(out)


def bt_blocks(
    blocks: DataFrame,
    found: DataFrame,
    labels: DataFrame,
    fit: Sequence[str],
    eps: float,
    max_iter: int,
    tol: float,
    start: DataFrame | None = None,
) -> DataFrame:
    """(fit, rep, preserved, item_id, theta, label) from ``resample.replicate_blocks``, arrays but for rep.

    A task solves a run of replicates of one fit side by side. ``start`` (fit, item_id, theta) are
    strengths to begin with, such as those of all rows; without it all items begin equal.
    """
    keys, warm = list(fit), start is not None
    kinds = dict(found.select(*keys, "winner").dtypes)
    ends = found.select(*keys, "cell", "winner", "loser").join(labels.withColumnRenamed("node", "winner"), [*keys, "winner"])
    for side in ("winner", "loser"):
        if start is None:
            ends = ends.withColumn(f"{side}_theta", F.lit(0.0))
        else:
            first = start.select(*keys, F.col("item_id").alias(side), F.col("theta").alias(f"{side}_theta"))
            ends = ends.join(first, [*keys, side])
    item = kinds["winner"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "rep int, preserved boolean"])

    def solve(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell", kind="stable")
        cell = part["cell"].to_numpy()
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        # bundles of units may share a cell
        weight = np.add.reduceat(np.stack(part["weights"].to_numpy()), begin, axis=0)
        drawn = np.add.reduceat(np.stack(part["times"].to_numpy()), begin, axis=0) > 0
        edges = part.iloc[begin]
        g = _Graph(*(edges[c].to_numpy() for c in ("winner", "loser", "label")))
        good = preserved(edges["winner"].to_numpy(), edges["loser"].to_numpy(), drawn, len(g.labels))
        theta0 = None
        if warm:
            theta0 = np.empty(g.size)
            theta0[g.winner], theta0[g.loser] = edges["winner_theta"], edges["loser_theta"]
        theta = np.zeros((g.size, len(good)))
        if good.any():
            theta[:, good] = g.settle(weight[:, good], theta0, eps, max_iter, tol)
        out = pd.DataFrame({"rep": key[-1] + np.arange(len(good)), "preserved": good})
        out["items"] = [g.items] * len(good)
        out["theta"] = list(theta.T)
        out["labels"] = [g.labels[g.part]] * len(good)
        for name, value in zip(keys, key, strict=False):
            out[name] = value
        return out[[*keys, "rep", "preserved", "items", "theta", "labels"]]

    return (
        blocks.join(ends, [*keys, "cell"])
        .groupBy(*keys, "first")
        .applyInPandas(solve, f"{schema}, items array<{item}>, theta array<double>, labels array<{item}>")
    )


def center(
    theta: DataFrame, members: DataFrame, group: Sequence[str], value: str = "theta"
) -> DataFrame:
    """Subtract the mean over the group's reference members, or over all without any.

    ``members`` lists (item_id) or (some group keys, item_id) of the reference items.
    """
    on = [c for c in members.columns if c in theta.columns]
    flagged = theta.join(members.select(*on, F.lit(True).alias("_ref")), on, "left")
    means = flagged.groupBy(*group).agg(
        F.coalesce(F.avg(F.when(F.col("_ref"), F.col(value))), F.avg(value)).alias("_mean")
    )
    return (
        theta.join(means, list(group)).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")
    )


# ------------------------------------------------------------------------------- a whole fit
def _edges_of(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stats.select(
        *keys,
        F.least("winner", "loser").alias("u"),
        F.greatest("winner", "loser").alias("v"),
    ).distinct()


def _labelled(win: DataFrame, labels: DataFrame, fit: Sequence[str]) -> DataFrame:
    return win.join(labels.withColumnRenamed("node", "winner"), [*fit, "winner"])


@dataclass
class Compared:
    """What several versions of one fit share, so that the log behind it is read once."""

    log: DataFrame
    rows: DataFrame
    win: DataFrame
    labels: DataFrame


def compared(w: DataFrame, fit: Sequence[str] = ("dimension_id",)) -> Compared:
    """The comparisons of every fit, their sums by cell and the parts of its graph, all pinned."""
    fit = list(fit)
    a_won = F.col("choice") == "a"
    w = pin(w.select(*fit, "respondent_id", "item_a", "item_b", "choice", "weight"))
    rows = estimate.decisive(w).select(
        *fit,
        "respondent_id",
        F.when(a_won, F.col("item_a")).otherwise(F.col("item_b")).alias("winner"),
        F.when(a_won, F.col("item_b")).otherwise(F.col("item_a")).alias("loser"),
        "weight",
    )
    win = resample.cells(rows, fit, ["winner", "loser"])
    edges = _edges_of(win, fit)
    nodes = edges.select(*fit, F.explode(F.array("u", "v")).alias("node"))
    return Compared(w, rows, win, pin(graph.components_of_many(edges, nodes, fit)))


def fit_dimensions(
    w: DataFrame,
    pool: DataFrame,
    fit: Sequence[str] = ("dimension_id",),
    n_rep: int = S.DEFAULTS["aggregation.bootstrap_samples"],
    seed: int = 0,
    eps: float = S.DEFAULTS["aggregation.bt_prior"],
    max_iter: int = S.DEFAULTS["aggregation.max_iter"],
    tol: float = S.DEFAULTS["aggregation.tol"],
    cluster: str | None = None,
    warm: bool = True,
    ready: Compared | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scores with intervals of every fit at once: (estimates, report).

    Replicates draw comparisons, or with ``cluster`` whole people; with ``warm`` they start from the
    strengths of all rows. ``ready`` is ``compared(w, fit)``, for several versions of one fit.

    Estimates: fit, item_id, value, low, high, n, support, unknown_rate, norm for every pool item.
    Report: fit, comparisons, components, attempts, discarded, failed.
    """
    fit = list(fit)
    ready = ready or compared(w, fit)
    w, rows, win, labels = ready.log, ready.rows, ready.win, ready.labels
    main = graph.largest(labels, fit).select(*fit, "main", "components")
    members = pool.select("item_id")

    raw = pin(bt_fit(_labelled(win, labels, fit), [*fit, "label"], eps, max_iter, tol))
    full = center(raw, members, [*fit, "label"])
    solver = {"eps": eps, "max_iter": max_iter, "tol": tol, "start": raw if warm else None}
    boot, report = _replicates(rows, win, labels, members, fit, n_rep, seed, cluster, solver)
    interval = estimate.percentile_interval(boot, [*fit, "item_id"])
    sizes = (
        win.select(*fit, "n", F.explode(F.array("winner", "loser")).alias("item_id"))
        .groupBy(*fit, "item_id")
        .agg(F.sum("n").alias("n"))
    )
    cells = select.with_catalog(pool.select("item_id"), w.select(*fit).distinct(), fit)
    usable = ~F.col("failed") & (F.col("label") == F.col("main"))
    level = F.when(usable, C.support("dimension", "n", "low", "high")).otherwise("insufficient")
    estimates = (
        cells.join(full.withColumnRenamed("theta", "value"), [*fit, "item_id"], "left")
        .join(interval, [*fit, "item_id"], "left")
        .join(sizes, [*fit, "item_id"], "left")
        .join(main, fit, "left")
        .join(report, fit, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("support", F.coalesce(level, F.lit("insufficient")))
        .select(*fit, "item_id", "value", "low", "high", "n", "support")
        .join(estimate.unknown_rate(w, fit), [*fit, "item_id"], "left")
    )
    comparisons = win.groupBy(*fit).agg(F.sum("n").alias("comparisons"))
    summary = comparisons.join(main.drop("main"), fit).join(report, fit)
    return estimate.min_max_norm(estimates, fit), summary


def _replicates(
    rows: DataFrame,
    win: DataFrame,
    labels: DataFrame,
    members: DataFrame,
    fit: list[str],
    n_rep: int,
    seed: int,
    cluster: str | None,
    solver: dict[str, Any],
) -> tuple[DataFrame, DataFrame]:
    """(centred scores of the admissible replicates as ``value``, report)."""
    tries, group = resample.candidates(n_rep), [*fit, "rep", "label"]
    if largest_group(win, fit) > EDGES_PER_TASK:
        stats, report = resample.replicate_stats(
            rows, labels, fit, ["winner", "loser"], _edges_of, n_rep, seed, cluster
        )
        theta = bt_iterate(_labelled(stats, labels, fit), group, solver["eps"], solver["max_iter"], solver["tol"])
    else:
        blocks = resample.replicate_blocks(rows, win, fit, ["winner", "loser"], tries, seed, cluster)
        solved = pin(bt_blocks(blocks, win, labels, fit, **solver))
        kept, report = resample.first_admissible(solved, labels, fit, n_rep)
        report = pin(report)
        each = F.explode(F.arrays_zip("items", "theta", "labels")).alias("_e")
        theta = (
            solved.join(kept, [*fit, "rep"], "left_semi")
            .select(*fit, "rep", each)
            .select(*fit, "rep", F.col("_e.labels").alias("label"), F.col("_e.items").alias("item_id"), "_e.theta")
        )
    return center(theta, members, group).withColumnRenamed("theta", "value"), report


def fit_segments(
    w: DataFrame, pool: DataFrame, sizes: DataFrame, **options
) -> tuple[DataFrame, DataFrame]:
    """Refits per (variable, segment, dimension): the same plan with more keys, only for the
    segments above their floors. ``w`` carries variable and segment."""
    fit = ["variable", "segment", "dimension_id"]
    calculable = sizes.filter("calculable").select(*fit)
    return fit_dimensions(w.join(calculable, fit, "left_semi"), pool, fit, **options)
