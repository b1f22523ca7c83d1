"""Rankings as paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.functions import columns as C


def ranking_to_pairs(rankings: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """The canonical pairs of every submitted order, best first.

    A ranking lists a handful of items, so its pairs come from one array expression per row.
    Without an order ('not sure') every pair is ``unknown``. Pairs that are gold in the ranking's
    dimension are dropped unless they are its anchor pair.
    """
    order = F.coalesce("submitted_order", "items")
    pairs = F.flatten(
        F.transform(
            order,
            lambda x, i: F.transform(
                F.slice(order, i + 2, F.size(order)),
                lambda y, j: F.struct(
                    x.alias("up"),
                    y.alias("down"),
                    ((i == 0) & (i + j + 2 == F.size(order))).alias("is_extreme"),
                ),
            ),
        )
    )
    low, high = C.canonical_pair(F.col("p.up"), F.col("p.down"))
    said = F.when(F.col("submitted_order").isNull(), "unknown").otherwise(
        F.when(F.col("p.up") < F.col("p.down"), "a").otherwise("b")
    )
    out = rankings.withColumn("p", F.explode(pairs)).select(
        "ranking_id",
        "respondent_id",
        "patch_id",
        "dimension_id",
        low.alias("item_a"),
        high.alias("item_b"),
        said.alias("choice"),
        "p.is_extreme",
    )
    if gold is None:
        return out
    return out.join(gold, ["item_a", "item_b", "dimension_id"], "left_anti")


def extreme_pair(order) -> tuple:
    """First against last: the pair that is asked again as a retest."""
    return C.canonical_pair(F.element_at(order, 1), F.element_at(order, -1))
