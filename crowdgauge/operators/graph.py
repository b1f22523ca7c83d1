"""Components of comparison graphs, for many graphs at once: the graph key is a column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge.functions import columns as C
from crowdgauge.operators.estimate import decisive
from crowdgauge.operators.scan import largest_group
from crowdgauge.runtime import pin



def both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    back = edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select(*keys, "u", "v").unionByName(back).distinct()


def components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, label): label is the smallest node of the component.

    Smallest-neighbour propagation with pointer jumping: the rounds grow with the logarithm of the
    longest path. Every round is pinned, and one count tells whether anything moved.
    """
    keys = list(keys)
    links = pin(both_ways(edges, keys))
    labels = nodes.select(*keys, "node").distinct().withColumn("label", F.col("node"))
    while True:
        heard = (
            links.join(labels.withColumnRenamed("node", "v"), [*keys, "v"])
            .groupBy(*keys, F.col("u").alias("node"))
            .agg(F.min("label").alias("_heard"))
        )
        moved = labels.join(heard, [*keys, "node"], "left").select(
            *keys, "node", "label", F.least("label", F.coalesce("_heard", "label")).alias("_to")
        )
        # jump to the label of the node one points at
        target = moved.select(*keys, F.col("node").alias("_to"), F.col("_to").alias("_then"))
        jumped = moved.join(target, [*keys, "_to"], "left").select(
            *keys,
            "node",
            F.col("label").alias("_old"),
            F.least("_to", F.coalesce("_then", "_to")).alias("label"),
        )
        jumped = pin(jumped)
        changed = jumped.filter(F.col("_old") != F.col("label")).limit(1).count()
        labels = jumped.drop("_old")
        if not changed:
            return labels


EDGES_PER_TASK = 500_000


def _smallest_reachable(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def components_of_many(
    edges: DataFrame, nodes: DataFrame, keys: Sequence[str], edges_per_task: int = EDGES_PER_TASK
) -> DataFrame:
    """``components`` for a great many small graphs, such as one per replicate.

    While the largest graph fits a task every graph is labelled in one grouped pass; otherwise the
    labels travel by joins. Nodes without an edge are their own component either way.
    """
    keys = list(keys)
    if largest_group(edges, keys) > edges_per_task:
        return components(edges, nodes, keys)
    kinds = dict(edges.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"node {kinds['u']}, label {kinds['u']}"])

    def label(key: tuple[Any, ...], links: pd.DataFrame) -> pd.DataFrame:
        ids, codes = np.unique(np.concatenate([links["u"], links["v"]]), return_inverse=True)
        half = len(links)
        found = _smallest_reachable(codes[:half], codes[half:], len(ids))
        out = pd.DataFrame({"node": ids, "label": ids[found]})
        for name, part in zip(keys, key, strict=True):
            out[name] = part
        return out[[*keys, "node", "label"]]

    joined = edges.select(*keys, "u", "v").groupBy(*keys).applyInPandas(label, schema)
    every = nodes.select(*keys, "node").distinct()
    return every.join(joined, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("label", "node").alias("label")
    )


def largest(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label of the component with most nodes per graph; a tie goes to the smallest label."""
    sizes = labels.groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    return sizes.groupBy(*keys).agg(
        F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("main"),
        F.max("_n").alias("largest"),
        F.count("*").alias("components"),
    )


def comparison_edges(w: DataFrame, key: str = "dimension_id") -> DataFrame:
    """Distinct pairs with a decisive answer per dimension."""
    return (
        decisive(w)
        .select(key, F.col("item_a").alias("u"), F.col("item_b").alias("v"))
        .distinct()
    )


def inside(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """Edges with both ends in the pool."""
    ids = pool.select("item_id")
    left = edges.join(ids.withColumnRenamed("item_id", "u"), "u", "left_semi")
    return left.join(ids.withColumnRenamed("item_id", "v"), "v", "left_semi")


def connectivity_report(labels: DataFrame, bridges: DataFrame, key: str = "dimension_id") -> DataFrame:
    """Components, largest one, pending bridges and whether the graph hangs together."""
    pending = bridges.groupBy(key).agg(F.count("*").alias("pending_bridges"))
    return (
        largest(labels, [key])
        .join(pending, key, "left")
        .select(
            key,
            "components",
            "largest",
            F.coalesce("pending_bridges", F.lit(0)).alias("pending_bridges"),
            (F.col("components") <= 1).alias("connected"),
        )
    )


def kept_bridges(
    labels: DataFrame, marked: DataFrame, key: str = "dimension_id"
) -> tuple[DataFrame, DataFrame]:
    """Marked bridges that still join components, taken in id order, and the labels they lead to.

    Taking edges in order while they join something gives the minimum spanning forest under that
    order, so every round lets each component keep its first outgoing bridge and merges.
    """
    kept = None
    current = labels
    bridges = pin(marked.select(key, "question_id", "u", "v"))
    while True:
        ends = current.select(key, F.col("node"), F.col("label"))
        crossing = (
            bridges.join(ends.withColumnRenamed("node", "u").withColumnRenamed("label", "lu"), [key, "u"])
            .join(ends.withColumnRenamed("node", "v").withColumnRenamed("label", "lv"), [key, "v"])
            .filter(F.col("lu") != F.col("lv"))
        )
        first = (
            crossing.select(key, "question_id", F.explode(F.array("lu", "lv")).alias("label"))
            .groupBy(key, "label")
            .agg(F.min("question_id").alias("question_id"))
            .select("question_id")
            .distinct()
        )
        chosen = pin(crossing.join(first, "question_id", "left_semi"))
        if chosen.limit(1).count() == 0:
            break
        picked = chosen.select(key, "question_id", "u", "v")
        kept = picked if kept is None else kept.unionByName(picked)
        roots = current.select(key, F.col("label").alias("node")).distinct()
        joins = chosen.select(key, F.col("lu").alias("u"), F.col("lv").alias("v"))
        merged = components(joins, roots, [key]).select(
            key, F.col("node").alias("label"), F.col("label").alias("_root")
        )
        current = pin(
            current.join(merged, [key, "label"]).select(key, "node", F.col("_root").alias("label"))
        )
    if kept is None:
        kept = bridges.limit(0)
    return kept, current


def bridge_round(
    labels: DataFrame, gold: DataFrame, seed: int, upward: bool, key: str = "dimension_id"
) -> DataFrame:
    """(key, label, item_a, item_b): for each component one allowed pair with an earlier one, if any is.

    Nodes are numbered by component, then by hash, so those of earlier components come first. A member
    with fewer gold partners among them than there are has an allowed partner among its first gold
    partners + 1 of them: only so many are looked at, which together is no more than gold pairs and
    components. ``upward`` orders components the other way round.
    """
    order = F.col("label").desc() if upward else F.col("label").asc()
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, C.hash_draw(seed, key, "node"), "node"))
    placed = pin(labels.select(key, "node", "label", place.alias("place")))
    earlier = placed.groupBy(key, "label").agg((F.min("place") - 1).alias("earlier"))
    nodes = placed.join(earlier, [key, "label"])
    pairs = gold.select(key, F.col("item_a").alias("x"), F.col("item_b").alias("y"))
    both = pairs.unionByName(pairs.select(key, F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    other = placed.select(key, F.col("node").alias("y"), F.col("place").alias("py"))
    own = nodes.select(key, F.col("node").alias("x"), "earlier")
    taken = (
        both.join(own, [key, "x"]).join(other, [key, "y"]).filter(F.col("py") <= F.col("earlier"))
    ).groupBy(key, F.col("x").alias("node")).agg(F.count("*").alias("taken"))
    free = (
        nodes.join(taken, [key, "node"], "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
        .filter(F.col("taken") < F.col("earlier"))
    )
    drawn = F.struct(C.hash_draw(seed, key, "node"), F.col("node"))
    members = free.groupBy(key, "label").agg(F.min_by(F.struct("node", "taken"), drawn).alias("m"))
    looked = members.select(
        key, "label", F.col("m.node").alias("x"), F.explode(F.sequence(F.lit(1), F.col("m.taken").cast("int") + 1)).alias("py")
    ).join(other, [key, "py"])
    allowed = looked.join(both, [key, "x", "y"], "left_anti")
    best = allowed.groupBy(key, "label").agg(F.min_by(F.struct("x", "y"), "py").alias("b"))
    low, high = C.canonical_pair("x", "y")
    return best.select(key, "label", "b.x", "b.y").select(key, "label", low.alias("item_a"), high.alias("item_b"))


def new_bridges(labels: DataFrame, gold: DataFrame, seed: int, key: str = "dimension_id") -> DataFrame:
    """Pairs that join all components that allowed pairs can join, none of them gold.

    Every round each component takes one pair with an earlier one, so no circle arises; then the
    components merge. Rounds look at earlier and later components by turns and end when neither finds
    a pair.
    """
    found, current, idle, turn = None, labels, 0, 0
    while idle < 2:
        step = pin(bridge_round(current, gold, seed + turn, turn % 2 == 1, key))
        turn += 1
        if step.isEmpty():
            idle += 1
            continue
        idle = 0
        found = step if found is None else found.unionByName(step)
        ends = current.select(key, "node", "label")
        joins = (
            step.select(key, "item_a", "item_b")
            .join(ends.select(key, F.col("node").alias("item_a"), F.col("label").alias("u")), [key, "item_a"])
            .join(ends.select(key, F.col("node").alias("item_b"), F.col("label").alias("v")), [key, "item_b"])
            .select(key, "u", "v")
        )
        roots = current.select(key, F.col("label").alias("node")).distinct()
        merged = components(joins, roots, [key]).select(
            key, F.col("node").alias("label"), F.col("label").alias("_root")
        )
        current = pin(
            current.join(merged, [key, "label"]).select(key, "node", F.col("_root").alias("label"))
        )
    return step.select(key, "item_a", "item_b") if found is None else found.select(key, "item_a", "item_b")


def bridge_plan(
    edges: DataFrame,
    nodes: DataFrame,
    marked: DataFrame,
    gold: DataFrame,
    seed: int,
    key: str = "dimension_id",
) -> DataFrame:
    """(key, action, item_a, item_b, question_id): bridges kept, cleared and newly marked."""
    labels = components(edges, nodes, [key])
    kept, joined = kept_bridges(labels, marked, key)
    none = F.lit(None).cast("bigint")
    cleared = marked.join(kept, "question_id", "left_anti")

    def old(df: DataFrame, action: str) -> DataFrame:
        return df.select(
            key,
            F.lit(action).alias("action"),
            F.col("u").alias("item_a"),
            F.col("v").alias("item_b"),
            F.col("question_id").cast("bigint").alias("question_id"),
        )

    new = new_bridges(joined, gold, seed, key).select(
        key, F.lit("mark").alias("action"), "item_a", "item_b", none.alias("question_id")
    )
    return old(kept, "keep").unionByName(old(cleared, "clear")).unionByName(new)


def preserved(rep_labels: DataFrame, labels: DataFrame, fit: Sequence[str]) -> DataFrame:
    """(fit, rep, preserved): replicates that keep every node touched and every component whole.

    ``rep_labels`` covers the nodes a replicate touches. A replicate draws a subset of the edges,
    so its partition refines the original one and counting is enough.
    """
    whole = labels.groupBy(*fit).agg(
        F.count("*").alias("_nodes"), F.count_distinct("label").alias("_components")
    )
    drawn = rep_labels.groupBy(*fit, "rep").agg(
        F.count("*").alias("_n"), F.count_distinct("label").alias("_c")
    )
    same = (F.col("_n") == F.col("_nodes")) & (F.col("_c") == F.col("_components"))
    return drawn.join(whole, list(fit)).select(*fit, "rep", same.alias("preserved"))
