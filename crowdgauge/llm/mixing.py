"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Every source has a target number of words and a schedule, its weight over the time of training. The
integral of the schedule up to a time is the share of the target that is due by then. A source's
documents stand in a hashed order; the words before a document are its demand, and the time at which
the integral reaches that demand is the document's position. Sorting by position gives the order of
training. A source whose target exceeds its size is passed through again.

The cumulative sum over a source, which may hold a third of all rows, is taken in two steps: over
4,096 hash buckets of a source, then within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge.runtime import pin

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Relative weight at evenly spaced times from begin to end, one schedule for each of ``WEIGHTS``:
#: heavy sources fade, light ones grow.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2
) -> DataFrame:
    """``sources(source, source_size)`` with place, weight and target.

    Weights repeat along the sources in code point order, null last. The targets share
    ``share`` of all sizes by weight; none exceeds ``cap`` times its source, and what it would get
    beyond goes to the others by weight until none exceeds it. That is one level: a target is its
    weight times the level, or its cap if that is less. Ordered by cap over weight, the sources at
    their cap come first, so the level is found by one cumulative sum. The windows hold one row for
    each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod("place", F.lit(len(weights))) + 1)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "place")
    rows = (
        sources.withColumn("place", place)
        .withColumn("weight", weight.cast("double"))
        .withColumn("most", (F.col("source_size") * cap).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("due", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn(
            "before",
            F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        )
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("due") - F.col("before")) / F.col("rest"))
    )
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))
    return rows.withColumn("found", F.min(fits).over(everything)["level"]).select(
        "source",
        "source_size",
        "place",
        "weight",
        F.least("most", F.coalesce(F.col("found") * F.col("weight"), F.col("most"))).alias("target"),
    )


def reached(share: Column, knots: Sequence[float]) -> Column:
    """The time in [0, 1] by which a schedule's integral, scaled to 1, has grown to ``share``."""
    m = len(knots) - 1
    areas = [(a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, found = sum(areas), 0.0, F.lit(1.0)
    pieces = []
    for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        need = share * F.lit(whole) - F.lit(before)
        # area of the trapezoid up to x: a x + (b - a) x^2 / 2
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2.0 * (b - a)) * need))
        x = F.when(need <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * need / (F.lit(a) + root))
        pieces.append((share * F.lit(whole) < F.lit(before + areas[i]), (F.lit(float(i)) + x) / F.lit(float(m))))
        before += areas[i]
    for test, value in reversed(pieces):
        found = F.when(test, value).otherwise(found)
    return found


def demand(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    key: str | None = None,
) -> DataFrame:
    """What the mix takes of every document: (doc_id, source, size, source_size, target, taken,
    passes: array of (words, position)).

    ``size`` is the number of words, 0 for null or empty texts, of which nothing is taken. A source
    gives its target, rounded down, in its hashed order: whole passes, then the front of the next
    one, whose last document may be taken in part. No document is taken more than ``cap`` times.
    ``passes`` has each time it is taken with its training position in [0, 1). The order depends on
    the ids alone, so reruns agree. A null source is a source of its own, last in order; rows without
    a doc_id come first in theirs. Equal rows are documents of their own. With ``key``, a column that
    tells rows apart, the result has it too, and rows without a doc_id are spread by it.
    """
    nameless = F.concat(F.lit("row "), F.col(key).cast("string")) if key else F.lit("")
    number = F.coalesce(F.col("doc_id").cast("string"), nameless)
    keys = [key] if key else []
    sized = pin(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size"),
            F.substring(F.md5(number), 1, 16).alias("hashed"),
            *keys,
        )
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = pin(targets(sources, weights, share, cap))
    keyed = sized.alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))
    ).select("d.*", "source_size", "place", "target").withColumn("bucket", F.substring("hashed", 1, 3))
    sums = keyed.groupBy("place", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("place", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    within = (
        Window.partitionBy("place", "bucket")
        .orderBy("hashed", "doc_id", "size", *keys)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["place", "bucket"])
        .withColumn("before", F.col("offset") + F.col("inside"))
    )
    due = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = due - F.col("full") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    kinds = len(schedules)

    def position(turn: Column) -> Column:
        done = (turn * F.col("source_size") + F.col("before")).cast("double") / F.col("target")
        found = reached(done, schedules[kinds - 1])
        for i in range(kinds - 2, -1, -1):
            found = F.when(F.pmod("place", F.lit(kinds)) == i, reached(done, schedules[i])).otherwise(found)
        return found

    def passed(turn: Column) -> Column:
        words = F.when(turn < F.col("full"), F.col("size")).otherwise(F.col("part"))
        return F.struct(words.alias("words"), position(turn).alias("position"))

    taken = placed.withColumn("full", full).withColumn("part", part)
    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), "full"), passed), lambda p: p["words"] > 0)
    return taken.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("full") * F.col("size") + F.col("part")).cast("bigint").alias("taken"),
        passes.alias("passes"),
        *keys,
    )


def schedule(plan: DataFrame, key: str | None = None) -> DataFrame:
    """One row for each time a document is taken, in the order of training; with ``key`` its column too."""
    turns = plan.withColumn("turn", F.explode("passes"))
    keys = [key] if key else []
    return turns.select("doc_id", "source", "turn.words", "turn.position", *keys).orderBy("position", "doc_id", *keys)
