"""Closed-form estimators: every one reduces the log to small sums before anything is ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C

DECISIVE = ("a", "b")


def decisive(w: DataFrame) -> DataFrame:
    return w.filter(F.col("choice").isin(*DECISIVE))


def win_edges(w: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight of every (winner, loser) per fit: the sufficient statistic of paired comparison."""
    a_won = F.col("choice") == "a"
    return (
        decisive(w)
        .groupBy(
            *keys,
            F.when(a_won, F.col("item_a")).otherwise(F.col("item_b")).alias("winner"),
            F.when(a_won, F.col("item_b")).otherwise(F.col("item_a")).alias("loser"),
        )
        .agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    )


def per_item(w: DataFrame, keys: Sequence[str], *columns: Column | str) -> DataFrame:
    """One row per (answer, item it touches)."""
    return w.select(*keys, *columns, F.explode(F.array("item_a", "item_b")).alias("item_id"))


def unknown_rate(w: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted share of 'unknown' among all answers that touch an item."""
    said = per_item(w, keys, "choice", "weight")
    return said.groupBy(*keys, "item_id").agg(
        (
            F.sum(F.when(F.col("choice") == "unknown", F.col("weight")).otherwise(F.lit(0.0)))
            / F.sum("weight")
        ).alias("unknown_rate")
    )


def sample_sizes(w: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw number of answers behind every item."""
    return per_item(w, keys).groupBy(*keys, "item_id").agg(F.count("*").alias("n"))


def pair_sizes(w: DataFrame, keys: Sequence[str]) -> DataFrame:
    low, high = C.canonical_pair("item_a", "item_b")
    return w.groupBy(*keys, low.alias("item_a"), high.alias("item_b")).agg(F.count("*").alias("n"))


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """First value whose cumulated weight reaches half; the average with the next value when it
    is exactly half. Weights are summed per value first, so a group orders its distinct values."""
    totals = df.groupBy(*by, F.col(value).cast("double").alias("v")).agg(
        F.sum(weight).alias("w"), F.count("*").alias("n")
    )
    part = Window.partitionBy(*by)
    ordered = part.orderBy("v")
    half = F.sum("w").over(part) / 2
    running = F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.lit(1e-12) * F.greatest(F.abs("cum"), F.abs("half"))
    boundary = F.abs(F.col("cum") - F.col("half")) <= near
    reached = (F.col("cum") >= F.col("half")) | boundary
    return (
        totals.withColumn("half", half)
        .withColumn("cum", running)
        .withColumn("next", F.lead("v").over(ordered))
        .groupBy(*by)
        .agg(
            F.min_by(
                F.when(boundary & F.col("next").isNotNull(), (F.col("v") + F.col("next")) / 2)
                .otherwise(F.col("v")),
                F.when(reached, F.col("v")),
            ).alias("median"),
            F.sum("n").alias("n"),
        )
    )


def peak_values(w: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted median minute per item, rounded half up, with its raw count."""
    by = [*keys, "item_a"]
    return weighted_median(w, by, "minute", "weight").select(
        *keys,
        F.col("item_a").alias("item_id"),
        C.half_up("median").cast("double").alias("value"),
        "n",
    )


def proportions(w: DataFrame, options: DataFrame, by: str = "item_a") -> DataFrame:
    """Weighted share of every option per item with a Wilson interval on the Kish size.

    An answer meets all options through the exploded one-row option list; sums are partial.
    """
    folded = options.agg(F.array_sort(F.collect_set("code")).alias("_codes"))
    totals = w.groupBy(by).agg(
        F.sum("weight").alias("total"), C.kish("weight").alias("n_eff"), F.count("*").alias("n")
    )
    marked = (
        w.select(by, "weight", F.explode("traits").alias("trait"))
        .groupBy(by, "trait")
        .agg(F.sum("weight").alias("marked"))
    )
    cells = totals.join(F.broadcast(folded), F.lit(True)).withColumn("trait", F.explode("_codes"))
    share = F.coalesce("marked", F.lit(0.0)) / F.col("total")
    low, high = C.wilson("value", "n_eff")
    return (
        cells.join(marked, [by, "trait"], "left")
        .withColumn("value", share)
        .select(
            F.col(by).alias("item_id"),
            "trait",
            "value",
            low.alias("low"),
            high.alias("high"),
            "n",
            "n_eff",
        )
        .withColumn("support", C.support("trait", "n", "low", "high"))
    )


def min_max_norm(est: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Value rescaled to its fit's range; null with fewer than two values or a constant."""
    bounds = est.groupBy(*fit).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("value").alias("_k")
    )
    spread = F.col("_hi") - F.col("_lo")
    norm = F.when((F.col("_k") >= 2) & (spread > 0), (F.col("value") - F.col("_lo")) / spread)
    return est.join(bounds, list(fit)).withColumn("norm", norm).drop("_lo", "_hi", "_k")


def power_curve(peaks: DataFrame, sigma: float = S.DEFAULTS["aggregation.power_sigma"]) -> DataFrame:
    return peaks.select(
        "*", *[C.power_at(m, "value", sigma).alias(f"power_at_{m}") for m in S.POWER_MINUTES]
    )


#: Which variants stand behind each published dataset.
DATASET_VARIANTS = {
    "champion_dimensions": ("pairwise_dimension",),
    "peak_timing": ("peak_timing",),
    "champion_lane_strength": ("lane_1v1",),
    "champion_traits": ("trait_multiselect",),
    "matchup_matrix": ("lane_1v1",),
    "duo_features": ("duo_synergy", "lane_2v2"),
}


def included(routed: DataFrame) -> DataFrame:
    """Responses and distinct respondents behind each dataset."""
    sets = F.array_compact(
        F.array(
            *[
                F.when(F.col("variant").isin(*variants), F.lit(name))
                for name, variants in DATASET_VARIANTS.items()
            ],
            F.lit("quality_report"),
        )
    )
    return (
        routed.select("respondent_id", F.explode(sets).alias("dataset"))
        .groupBy("dataset")
        .agg(
            F.count("*").alias("responses"), F.count_distinct("respondent_id").alias("respondents")
        )
    )


def percentile_interval(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """2.5 and 97.5 % linear quantiles over replicates."""
    q = F.percentile(F.col(value), F.array(F.lit(0.025), F.lit(0.975)))
    return (
        samples.groupBy(*by)
        .agg(q.alias("_q"), F.count(value).alias("replicates"))
        .select(
            *by, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "replicates"
        )
    )


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null below three rows or for a constant side.

    Ranks come from counts per distinct value, so a group with many equal values orders few rows,
    and the correlation itself is five partial sums over (x, y) cells.
    """
    cells = df.groupBy(*by, x, y).agg(F.count("*").alias("_n"))

    def ranks(column: str) -> DataFrame:
        counted = cells.groupBy(*by, column).agg(F.sum("_n").alias("_c"))
        before = Window.partitionBy(*by).orderBy(column) if by else Window.orderBy(column)
        running = F.sum("_c").over(before.rowsBetween(Window.unboundedPreceding, 0))
        return counted.select(
            *by, column, (running - (F.col("_c") - 1) / 2).cast("double").alias(f"_r_{column}")
        )

    ranked = cells.join(ranks(x), [*by, x]).join(ranks(y), [*by, y])
    n, rx, ry = F.col("_n").cast("double"), F.col(f"_r_{x}"), F.col(f"_r_{y}")
    grouped = ranked.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.count_distinct(x).alias("_kx"),
        F.count_distinct(y).alias("_ky"),
        F.sum(n * rx).alias("_sx"),
        F.sum(n * ry).alias("_sy"),
        F.sum(n * rx * rx).alias("_sxx"),
        F.sum(n * ry * ry).alias("_syy"),
        F.sum(n * rx * ry).alias("_sxy"),
    )
    size = F.col("n").cast("double")
    cov = size * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    var_x = size * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    var_y = size * F.col("_syy") - F.col("_sy") * F.col("_sy")
    defined = (F.col("n") >= 3) & (F.col("_kx") > 1) & (F.col("_ky") > 1)
    return grouped.select(*by, "n", F.when(defined, cov / F.sqrt(var_x * var_y)).alias("rho"))


def running_sum(df: DataFrame, by: Sequence[str], order: str, column: str, name: str) -> DataFrame:
    """Cumulated mass over the distinct ordered categories of a group."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(column).over(frame))
