"""Streaks, rates, positions and standings of respondents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators.scan import ROWS_PER_TASK, OrderedGroups

ORDER = ["created_at", "response_id"]


def _micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def answer_streak(
    heads: DataFrame,
    gap_minutes: int = S.DEFAULTS["gamification.streak_gap_minutes"],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Consecutive submissions no more than a gap apart: current and best run."""
    slim = heads.select("respondent_id", *ORDER)
    groups = OrderedGroups(slim, ["respondent_id"], ORDER, rows_per_task).with_lag("created_at", "_before")
    gap = _micros("created_at") - _micros("_before")
    starts = F.col("_before").isNull() | (gap > gap_minutes * 60_000_000)
    sessions = groups.with_running_sum(starts.cast("bigint"), "session").result
    return (
        sessions.groupBy("respondent_id", "session")
        .agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
        .groupBy("respondent_id")
        .agg(
            F.max_by("n", "session").alias("current_streak"),
            F.max("n").alias("best_streak"),
            F.max("last_seen").alias("last_seen"),
        )
    )


def day_streak(
    heads: DataFrame,
    tz: str = S.DEFAULTS["gamification.streak_timezone"],
    min_answers: int = S.DEFAULTS["gamification.day_streak_min_answers"],
) -> DataFrame:
    """Consecutive local days that reach the minimum. The current run stands on the last active
    day, or on the day before it while the last active day has not reached the minimum.

    Rows are counted per day first, so a respondent's window holds calendar days, not answers.
    """
    days = (
        heads.select("respondent_id", C.local_day("created_at", tz).alias("day"))
        .groupBy("respondent_id", "day")
        .agg(F.count("*").alias("n"))
    )
    last = days.groupBy("respondent_id").agg(
        F.max("day").alias("last_active_date"), F.max_by("n", "day").alias("answers_today")
    )
    ordered = Window.partitionBy("respondent_id").orderBy("day")
    island = F.date_sub(F.col("day"), F.row_number().over(ordered))
    runs = (
        days.filter(F.col("n") >= min_answers)
        .withColumn("island", island)
        .groupBy("respondent_id", "island")
        .agg(F.max("day").alias("end"), F.count("*").alias("length"))
    )
    reached = F.col("answers_today") >= min_answers
    stands = F.when(reached, F.col("end") == F.col("last_active_date")).otherwise(
        F.col("end") == F.date_sub("last_active_date", 1)
    )
    return (
        last.join(runs, "respondent_id", "left")
        .groupBy("respondent_id", "last_active_date", "answers_today")
        .agg(
            F.coalesce(F.max(F.when(stands, F.col("length"))), F.lit(0)).alias("current_day_streak"),
            F.coalesce(F.max("length"), F.lit(0)).alias("best_day_streak"),
        )
    )


def visible_streaks(
    answer: DataFrame,
    day: DataFrame,
    now: Column,
    tz: str = S.DEFAULTS["gamification.streak_timezone"],
    gap_minutes: int = S.DEFAULTS["gamification.streak_gap_minutes"],
    min_answers: int = S.DEFAULTS["gamification.day_streak_min_answers"],
) -> DataFrame:
    """Both streaks as they stand at ``now``; an expired one reads 0."""
    today = C.local_day(now, tz)
    fresh = _micros(now) - _micros("last_seen") <= gap_minutes * 60_000_000
    yesterday = F.col("last_active_date") == F.date_sub(today, 1)
    alive = (F.col("last_active_date") == today) | (
        yesterday & (F.col("answers_today") >= min_answers)
    )
    return answer.join(day, "respondent_id").select(
        "respondent_id",
        F.when(fresh, F.col("current_streak")).otherwise(0).alias("answer_streak"),
        F.when(alive, F.col("current_day_streak")).otherwise(0).alias("day_streak"),
    )


def positions(heads: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Zero-based index of every submission in its respondent's history."""
    return OrderedGroups(heads, ["respondent_id"], ORDER, rows_per_task).with_position("position").result


def rate_windows(
    heads: DataFrame, key: str, windows: dict[str, int], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Submissions of a key in the ``seconds`` up to and including each submission.

    Every submission also sends one marker per window to the moment the window opens. Submissions
    and markers share one running count; a window's total is the count at the submission less the
    count at its marker. No range frame holds more than a running sum, whatever the key.
    """
    own = F.array(
        F.struct(F.lit("").alias("kind"), _micros("created_at").alias("at"), F.lit(1).alias("first")),
        *[
            F.struct(
                F.lit(name).alias("kind"),
                (_micros("created_at") - seconds * 1_000_000).alias("at"),
                F.lit(2).alias("first"),
            )
            for name, seconds in windows.items()
        ],
    )
    # A marker sorts behind submissions of the same instant: a window excludes its opening instant.
    events = heads.select(key, "response_id", F.explode(own).alias("e")).select(
        key, "response_id", "e.*"
    )
    counted = (
        OrderedGroups(events, [key], ["at", "first", "response_id", "kind"], rows_per_task)
        .with_running_sum((F.col("kind") == "").cast("bigint"), "seen")
        .result
    )
    at = {n: F.max(F.when(F.col("kind") == n, F.col("seen"))) for n in ["", *windows]}
    return counted.groupBy(key, "response_id").agg(
        at[""].alias("position"), *[(at[""] - at[n]).alias(n) for n in windows]
    )


def over_limit(
    rates: DataFrame, heads: DataFrame, key: str, window: str, limit: int, seconds: int
) -> DataFrame:
    """Submissions above the limit and after how many seconds the next one is accepted: when the
    oldest of the window leaves it."""
    when = heads.select("response_id", _micros("created_at").alias("at"))
    placed = rates.join(when, "response_id")
    over = placed.filter(F.col(window) > limit).withColumn(
        "oldest", F.col("position") - F.col(window) + 1
    )
    oldest = placed.select(
        key, F.col("position").alias("oldest"), F.col("at").alias("oldest_at")
    )
    wait = ((F.col("oldest_at") + seconds * 1_000_000 - F.col("at")) / 1_000_000).cast("bigint")
    return over.join(oldest, [key, "oldest"]).select(
        "response_id", key, window, F.greatest(F.lit(1).cast("bigint"), wait).alias("retry_after")
    )


def recent_types(heads: DataFrame, k: int = S.VARIETY_RUN) -> DataFrame:
    """The last ``k`` types of every respondent, oldest first, and the type variety rules out.

    Keeping the first k rows of a descending window is pruned before the shuffle.
    """
    latest = Window.partitionBy("respondent_id").orderBy(*[F.desc(c) for c in ORDER])
    kept = (
        heads.select("respondent_id", "type", *ORDER)
        .withColumn("back", F.row_number().over(latest))
        .filter(F.col("back") <= k)
    )
    entry = F.struct((-F.col("back")).alias("o"), F.col("type").alias("t"))
    types = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"])
    return (
        kept.groupBy("respondent_id")
        .agg(types.alias("recent"))
        .withColumn(
            "ruled_out",
            F.when(
                (F.size("recent") == k) & (F.size(F.array_distinct("recent")) == 1),
                F.col("recent")[0],
            ),
        )
    )


def rank_percentile(respondents: DataFrame, count: str = "answers_count") -> DataFrame:
    """Share of unflagged respondents with strictly fewer answers.

    Standings come from the histogram of counts: N answers give at most about sqrt(2 N) distinct
    counts, which is all the one ordered window holds.
    """
    unflagged = respondents.filter(~F.col("is_flagged"))
    histogram = unflagged.groupBy(count).agg(F.count("*").alias("_n"))
    before = Window.orderBy(count).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = histogram.select(
        F.col(count).alias("_c"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.sum("_n").over(everyone)).alias(
            "percentile"
        ),
    )
    return unflagged.join(below, F.col(count) == F.col("_c")).select("respondent_id", "percentile")


def leaderboard(
    heads: DataFrame,
    respondents: DataFrame,
    window: str,
    now: Column,
    k: int = S.DEFAULTS["gamification.leaderboard_size"],
    min_trust: float = S.DEFAULTS["export.min_trust"],
) -> DataFrame:
    """Top ``k`` unflagged, trusted respondents by submissions in a day, a week or ever."""
    spans = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}
    recent = heads
    if window in spans:
        recent = heads.filter(F.col("created_at") > now - F.expr(spans[window]))
    eligible = respondents.filter(~F.col("is_flagged") & (F.col("trust_score") >= min_trust))
    top = (
        recent.groupBy("respondent_id")
        .agg(F.count("*").alias("answers"))
        .join(eligible.select("respondent_id"), "respondent_id", "left_semi")
        .orderBy(F.desc("answers"), "respondent_id")
        .limit(k)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("answers"), "respondent_id"))
    return top.withColumn("rank", rank)


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key: a partial aggregate keeps one row per key and map task."""
    rest = [c for c in df.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*by).agg(newest).select(*by, "_r.*")


def daily_volume(heads: DataFrame, tz: str, days: int, last_day: Column) -> DataFrame:
    """Submissions per local day and type over a window of days, empty days as zeros."""
    counted = (
        heads.withColumn("day", C.local_day("created_at", tz))
        .filter(F.col("day") > F.date_sub(last_day, days))
        .groupBy("day")
        .pivot("type", list(S.QUESTION_TYPES))
        .agg(F.count(F.lit(1)))
    )
    spark = heads.sparkSession
    calendar = spark.range(days).select(
        F.date_sub(last_day, F.col("id").cast("int")).alias("day")
    )
    return calendar.join(counted, "day", "left").na.fill(0)


def trust_histogram(respondents: DataFrame, bins: int = S.TRUST_BINS) -> DataFrame:
    """Respondents per trust bin; the last bin is closed."""
    slot = F.least(F.floor(F.col("trust_score").cast("double") * bins), F.lit(bins - 1))
    counted = respondents.groupBy(slot.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    every = respondents.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def last_by_json_key(
    log: DataFrame, payload: str, path: str, when: str, action: Column | None = None
) -> DataFrame:
    rows = log if action is None else log.filter(action)
    return (
        rows.withColumn("name", C.json_get(payload, path))
        .filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.max(when).alias("last"))
    )


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """One page of a listing, newest first."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def ordered(df: DataFrame, spec: Sequence[tuple[str, Sequence[str] | None]]) -> DataFrame:
    """Rows by declared keys; a key with a list follows that list instead of its text."""
    keys = []
    for column, values in spec:
        if values is None:
            keys.append(F.col(column))
        else:
            keys.append(C.lookup(column, {v: i for i, v in enumerate(values)}))
    return df.orderBy(*keys)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
