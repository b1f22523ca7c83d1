"""How well each respondent answers: gold, retests, speed, repetition, identities, trust."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators.scan import ROWS_PER_TASK, OrderedGroups

COUNTERS = (
    "gold_attempts",
    "gold_passed",
    "retest_pairs",
    "retest_consistent",
    "fast_answers",
    "straightline_runs",
)


# ----------------------------------------------------------------------------------- gold
def gold_outcome(choice: Column | str = "choice", expected: Column | str = "expected") -> Column:
    """Passed or not; null for 'unknown', which is no attempt."""
    said, wanted = (F.col(c) if isinstance(c, str) else c for c in (choice, expected))
    return F.when(said != "unknown", said == wanted)


def evaluate_gold(responses: DataFrame) -> DataFrame:
    """Answers to questions that are gold today, first answers only, with their outcome."""
    return responses.filter(F.col("is_gold") & F.col("is_retest_of").isNull()).withColumn(
        "passed", gold_outcome()
    )


def gold_counts(responses: DataFrame, by: Sequence[str] = ("respondent_id",)) -> DataFrame:
    return (
        evaluate_gold(responses)
        .filter(F.col("passed").isNotNull())
        .groupBy(*by)
        .agg(F.count("*").alias("gold_attempts"), F.count_if("passed").alias("gold_passed"))
    )


def retire_gold(
    responses: DataFrame,
    respondents: DataFrame,
    min_attempts: int = S.DEFAULTS["quality.honeypot_min_attempts"],
    min_rate: float = S.DEFAULTS["quality.honeypot_min_pass_rate"],
) -> DataFrame:
    """Gold questions that too many unflagged respondents fail."""
    unflagged = respondents.filter(~F.col("is_flagged")).select("respondent_id")
    fair = responses.join(unflagged, "respondent_id", "left_semi")
    return gold_counts(fair, ["question_id"]).filter(
        (F.col("gold_attempts") >= min_attempts)
        & (F.col("gold_passed") / F.col("gold_attempts") < min_rate)
    )


def affected_by(responses: DataFrame, retired: DataFrame) -> DataFrame:
    """Respondents who met a retired question."""
    return (
        responses.join(retired.select("question_id"), "question_id", "left_semi")
        .select("respondent_id")
        .distinct()
    )


# -------------------------------------------------------------------------------- retests
def _answer(df: DataFrame) -> Column:
    kinds = {"choice": "string", "minute": "int", "traits": "array<string>"}
    return F.struct(
        *[(F.col(n) if n in df.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]
    )


def retest_join(responses: DataFrame) -> DataFrame:
    """Every retest next to the answer it repeats, both as (choice, minute, traits)."""
    answer = _answer(responses)
    original = responses.select(F.col("response_id").alias("original_id"), answer.alias("first"))
    repeat = responses.filter(F.col("is_retest_of").isNotNull()).withColumn("repeat", answer)
    return repeat.join(original, F.col("is_retest_of") == F.col("original_id"))


def retest_pairs(responses: DataFrame) -> DataFrame:
    """Retests with ``consistent``: true, false, or null where the pair does not count."""
    verdict = C.consistent(F.col("type"), F.col("first"), F.col("repeat"))
    return retest_join(responses).withColumn("consistent", verdict)


def retest_counts(responses: DataFrame, by: Sequence[str] = ("respondent_id",)) -> DataFrame:
    return (
        retest_pairs(responses)
        .filter(F.col("consistent").isNotNull())
        .groupBy(*by)
        .agg(F.count("*").alias("retest_pairs"), F.count_if("consistent").alias("retest_consistent"))
    )


# --------------------------------------------------------------------- degenerate answers
def fast_answers(heads: DataFrame, limit_ms: int = S.DEFAULTS["quality.fast_answer_ms"]) -> DataFrame:
    return heads.groupBy("respondent_id").agg(
        F.count_if(F.col("response_time_ms") < limit_ms).alias("fast_answers"),
        F.count("*").alias("answers_count"),
    )


def equal_runs(heads: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Runs of equal choices per respondent and type, 'unknown' breaking them.

    Only the two types with fixed positions on screen count. (respondent_id, type, choice, length)
    """
    positioned = heads.filter(F.col("type").isin("lane_matchup", "duo_synergy")).select(
        "respondent_id", "type", "created_at", "response_id", "choice"
    )
    groups = OrderedGroups(
        positioned, ["respondent_id", "type"], ["created_at", "response_id"], rows_per_task
    )
    changed = ~F.coalesce(F.col("choice") == F.col("_before"), F.lit(False))
    runs = groups.with_lag("choice", "_before").with_running_sum(changed.cast("bigint"), "run").result
    return (
        runs.filter(F.col("choice").isNotNull() & (F.col("choice") != "unknown"))
        .groupBy("respondent_id", "type", "run")
        .agg(F.count("*").alias("length"))
    )


def straightline_runs(
    heads: DataFrame,
    run_length: int = S.DEFAULTS["quality.straightline_run"],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """How many runs of ``run_length`` or more; one long run counts once."""
    return (
        equal_runs(heads, rows_per_task)
        .filter(F.col("length") >= run_length)
        .groupBy("respondent_id")
        .agg(F.count("*").alias("straightline_runs"))
    )


def flag_duplicates(
    respondents: DataFrame,
    now: Column,
    limit: int = S.DEFAULTS["quality.fingerprint_max_identities"],
) -> DataFrame:
    """Identities to flag: every unflagged one of a fingerprint that created more than ``limit``
    identities in the last 24 hours."""
    crowded = (
        respondents.filter(F.col("first_seen") > now - F.expr("INTERVAL 24 HOURS"))
        .groupBy("fingerprint_hash")
        .agg(F.count("*").alias("created"))
        .filter(F.col("created") > limit)
    )
    return respondents.filter(~F.col("is_flagged")).join(crowded, "fingerprint_hash", "left_semi")


# ---------------------------------------------------------------------------------- trust
def recount(
    responses: DataFrame,
    heads: DataFrame,
    respondents: DataFrame,
    limit_ms: int = S.DEFAULTS["quality.fast_answer_ms"],
    run_length: int = S.DEFAULTS["quality.straightline_run"],
) -> DataFrame:
    """The six signals of every respondent and the volume, from the raw log."""
    return (
        respondents.select("respondent_id")
        .join(gold_counts(responses), "respondent_id", "left")
        .join(retest_counts(responses), "respondent_id", "left")
        .join(fast_answers(heads, limit_ms), "respondent_id", "left")
        .join(straightline_runs(heads, run_length), "respondent_id", "left")
        .na.fill(0, [*COUNTERS, "answers_count"])
    )


def with_trust(counters: DataFrame) -> DataFrame:
    return counters.withColumn("trust", C.trust(*COUNTERS, "answers_count"))


def rebuild_trust(counted: DataFrame, respondents: DataFrame) -> DataFrame:
    """Respondents whose recomputed trust differs from the stored one."""
    stored = respondents.select("respondent_id", F.col("trust_score").alias("stored"))
    return (
        with_trust(counted)
        .join(stored, "respondent_id")
        .filter(F.col("stored").cast("decimal(4,3)") != F.col("trust"))
        .select("respondent_id", "stored", "trust")
    )


def verify_trust(stored: DataFrame, counted: DataFrame) -> DataFrame:
    """Respondents whose stored trust or counters differ from the recount; nothing is written.

    The volume is taken from the stored row: its drift is no quality matter.
    """
    fresh = counted.select("respondent_id", *[F.col(c).alias(f"new_{c}") for c in COUNTERS])
    expected = C.trust(*[F.col(f"new_{c}") for c in COUNTERS], F.col("answers_count"))
    joined = stored.join(fresh, "respondent_id").withColumn("expected", expected)
    same = F.col("trust_score").cast("decimal(4,3)").eqNullSafe(F.col("expected"))
    for name in COUNTERS:
        same = same & F.col(name).eqNullSafe(F.col(f"new_{name}"))
    return joined.filter(~same)


# ---------------------------------------------------------------------------- gold report
def rank_segment(rank: Column | str = "declared_rank") -> Column:
    """Segment of a declared rank; 'undeclared' for null."""
    table = {rank_: name for name, ranks in S.RANK_SEGMENTS.items() for rank_ in ranks}
    return F.coalesce(C.lookup(rank, table), F.lit(S.UNDECLARED))


def gold_report(responses: DataFrame, people: DataFrame, min_attempts: int) -> DataFrame:
    """Per gold question: attempts and passes, by rank segment, and the suspicion cross.

    A question is suspicious when those who fail it are at least as consistent in their retests
    as those who pass it. Flagged respondents are out, the trust filter is not applied.
    """
    fair = people.filter(~F.col("is_flagged"))
    answers = (
        evaluate_gold(responses)
        .filter(F.col("passed").isNotNull())
        .join(fair.select("respondent_id", "declared_rank"), "respondent_id")
        .withColumn("segment", rank_segment())
    )
    consistency = retest_counts(responses)
    own = answers.join(consistency, "respondent_id", "left").na.fill(
        0, ["retest_pairs", "retest_consistent"]
    )
    ok = F.col("passed")
    segments = [*S.RANK_SEGMENTS, S.UNDECLARED]
    per_segment = []
    for name in segments:
        here = F.col("segment") == name
        per_segment += [
            F.count_if(here).alias(f"{name}_attempts"),
            F.count_if(here & ok).alias(f"{name}_passed"),
        ]

    def pooled(test: Column, column: str) -> Column:
        return F.sum(F.when(test, F.col(column)).otherwise(F.lit(0)))

    grouped = own.groupBy("question_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(ok).alias("passed"),
        *per_segment,
        pooled(~ok, "retest_consistent").alias("fail_consistent"),
        pooled(~ok, "retest_pairs").alias("fail_pairs"),
        pooled(ok, "retest_consistent").alias("pass_consistent"),
        pooled(ok, "retest_pairs").alias("pass_pairs"),
    )
    enough = (
        (F.col("attempts") >= min_attempts) & (F.col("fail_pairs") > 0) & (F.col("pass_pairs") > 0)
    )
    # a / b >= c / d in integers, so that equal shares compare equal
    worse = F.col("fail_consistent") * F.col("pass_pairs") >= F.col("pass_consistent") * F.col(
        "fail_pairs"
    )
    return grouped.withColumn("suspicious", enough & worse)
