"""Streams over the event table (S), each run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.operators import select
from crowdgauge.operators import question_stats as Q
from crowdgauge.plans.questions import _COUNTS
from crowdgauge.plans.people import _GOLD, _GC, _RC, _RETEST, _STREAK
from crowdgauge.plans.registry import query
from crowdgauge.runtime import ensure_checkpoint_dir
from crowdgauge.sources import binding as B
from crowdgauge.sources.tables import TABLES
from crowdgauge.streaming import streams as ST

TZ = S.DEFAULTS["gamification.streak_timezone"]


def _folder(b: B.Binding) -> str:
    return f"{ensure_checkpoint_dir(b.spark)}/stream-{uuid.uuid4().hex}"


class _StreamBinding(B.Binding):
    """The same views over a stream of the event files."""

    def raw(self, name: str):
        if name == "events":
            path = f"{self.directory.rstrip('/')}/events.parquet"
            return ST.read_stream(self.spark, path, TABLES["events"])
        return super().raw(name)


def _live(b: B.Binding) -> _StreamBinding:
    return _StreamBinding(b.spark, b.directory)


def _asked(b):
    """Questions of the event log: every third number is unknown to the catalog."""
    return (
        b.log.filter("question_id % 3 <> 0")
        .groupBy("question_id")
        .agg(F.min("type").alias("type"))
        .withColumn("patch_id", 2024 + F.col("question_id") % 2)
    )


@query(
    "s1_validated_ingest",
    "elog raw_answers",
    """
SELECT sink, count(*) AS n FROM (SELECT CASE WHEN question_id % 3 = 0 THEN 'refused' WHEN event IN ('view', 'click') AND NOT (type = 'peak_timing' AND response_time_ms % 50 > 40)
  THEN 'accepted' WHEN event = 'signup' AND type IN ('pairwise_dimension', 'lane_matchup', 'duo_synergy') THEN 'accepted' ELSE 'refused' END AS sink FROM elog) GROUP BY 1""",
)
def s1_validated_ingest(b):
    folder = _folder(b)
    handle = ST.ingest(
        _live(b).raw_answers, b.traits, _asked(b), f"{folder}/out", f"{folder}/checkpoint", availableNow=True
    )
    handle.awaitTermination()

    def size(name):
        rows = b.spark.read.parquet(f"{folder}/out/{name}")
        return rows.agg(F.lit(name).alias("sink"), F.count("*").alias("n"))

    return size("accepted").unionByName(size("refused"))


@query(
    "s2_deduplicated_stream",
    "retested",
    """
SELECT respondent_id, question_id, count(*) AS n FROM retested WHERE is_retest_of IS NULL OR response_id % 2 = 0
GROUP BY ALL""",
)
def s2_deduplicated_stream(b):
    """Every answer arrives twice; half the retests are not claimed and count as duplicates."""
    retests = b.retested.select(
        "response_id", F.when(F.col("response_id") % 2 == 0, F.col("is_retest_of")).alias("is_retest_of")
    )
    live = _live(b).log.select("response_id", "respondent_id", "question_id", "created_at")
    marked = live.join(retests, "response_id", "left")
    doubled = marked.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    kept = ST.drain(ST.dedupe(doubled), _folder(b))
    return kept.groupBy("respondent_id", "question_id").agg(F.count("*").alias("n"))


@query(
    "s3_running_counters",
    "retested",
    f"""
WITH {_GOLD}, {_GC}, {_RETEST}, {_RC}, n AS (SELECT respondent_id, count(*) AS answers_count FROM retested GROUP BY 1),
j AS (SELECT respondent_id, answers_count, coalesce(gold_attempts, 0) AS gold_attempts, coalesce(gold_passed, 0) AS gold_passed,
  coalesce(retest_pairs, 0) AS retest_pairs, coalesce(retest_consistent, 0) AS retest_consistent
  FROM n LEFT JOIN gc USING (respondent_id) LEFT JOIN rc USING (respondent_id))
SELECT *, CAST(round(CAST(CAST(0.6::DOUBLE * ((gold_passed + 1.0::DOUBLE) / (gold_attempts + 2.0::DOUBLE)) + 0.4::DOUBLE * ((retest_consistent + 1.0::DOUBLE) / (retest_pairs + 2.0::DOUBLE))
  AS VARCHAR) AS DECIMAL(30, 18)), 3) AS DOUBLE) AS trust FROM j""",
)
def s3_running_counters(b):
    retests = b.retested.select("response_id", "is_retest_of")
    live = _live(b).log.join(retests, "response_id", "left")
    state = ST.drain(ST.running_counters(live, b.log), _folder(b), "complete")
    return state.select(
        "respondent_id", "answers_count", "gold_attempts", "gold_passed", "retest_pairs", "retest_consistent",
        F.col("trust").cast("double").alias("trust"),
    )


@query(
    "s4_sliding_rate",
    "elog",
    """
WITH w AS (SELECT respondent_id % 7 AS grp, unnest(range(6)) AS i, epoch_us(created_at) AS us FROM elog)
SELECT grp, (us // 10000000 - i) * 10000000 AS window_us, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) > 1""",
)
def s4_sliding_rate(b):
    live = _live(b).log.withColumn("grp", F.col("respondent_id") % 7)
    state = ST.drain(ST.rate_stream(live, "grp", limit=1), _folder(b), "complete")
    return state.select("grp", F.unix_micros("window_start").alias("window_us"), "n")


@query(
    "s5_identity_bursts",
    "",
    """
WITH f AS (SELECT 'f' || (c_custkey % 40) AS fingerprint_hash, min(o_orderdate) AS first_seen FROM customer JOIN orders ON o_custkey = c_custkey
  GROUP BY c_custkey, 1), w AS (SELECT *, unnest(range(24)) AS i, epoch_us(first_seen) AS us FROM f)
SELECT fingerprint_hash, (us // 3600000000 - i) * 3600000000 AS window_us, count(*) AS created FROM w GROUP BY 1, 2 HAVING count(*) > 0""",
)
def s5_identity_bursts(b):
    """Customers as identities created at their first order, read as a table by the batch twin of
    the stream: the operator is the same on both."""
    first = b.orders.groupBy("respondent_id").agg(F.min("created_at").alias("first_seen"))
    people = first.join(b.respondents.select("respondent_id", "fingerprint_hash"), "respondent_id")
    bursts = ST.identity_bursts(people, limit=0)
    return bursts.select("fingerprint_hash", F.unix_micros("window_start").alias("window_us"), "created")


@query(
    "s6_rolling_leaderboard",
    "elog identities",
    """
WITH w AS (SELECT respondent_id, unnest(range(7)) AS i, epoch_us(created_at) // 86400000000 AS d FROM elog),
c AS (SELECT respondent_id, d - i + 7 AS day_end, count(*) AS answers FROM w GROUP BY 1, 2)
SELECT respondent_id, answers FROM c WHERE day_end = (SELECT max(day_end) FROM c)
  AND respondent_id IN (SELECT respondent_id FROM identities WHERE NOT is_flagged AND trust_score >= 0.3)
ORDER BY answers DESC, respondent_id LIMIT 50""",
)
def s6_rolling_leaderboard(b):
    folder = _folder(b)
    handle = ST.leaderboard_stream(
        _live(b).log, b.identities, "7 days", "1 day", f"{folder}/top", f"{folder}/checkpoint", availableNow=True
    )
    handle.awaitTermination()
    return b.spark.read.parquet(f"{folder}/top").select("respondent_id", "answers")


@query(
    "s7_daily_volume",
    "elog",
    f"""
SELECT CAST(CAST(timezone('{TZ}', timezone('UTC', created_at)) AS DATE) AS VARCHAR) AS day, type, count(*) AS n FROM elog GROUP BY 1, 2""",
)
def s7_daily_volume(b):
    state = ST.drain(ST.daily_volume_stream(_live(b).log, TZ), _folder(b), "complete")
    return state.withColumn("day", F.col("day").cast("string"))


@query(
    "s8_answer_sessions",
    "elog",
    f"""
WITH {_STREAK} SELECT respondent_id, n, CAST(epoch_us(last_seen) AS BIGINT) AS last_us FROM lens""",
)
def s8_answer_sessions(b):
    state = ST.drain(ST.answer_sessions(_live(b).log), _folder(b), "complete")
    return state.select("respondent_id", "n", F.unix_micros("last_seen").alias("last_us"))


@query(
    "s9_question_stats_refresh",
    "responses questions",
    f"""
WITH {_COUNTS}, e AS (SELECT question_id, CAST(sum(n) FILTER (type <> 'trait_multiselect' OR key = '_total') AS BIGINT) AS exposure FROM counts GROUP BY 1)
SELECT patch_id, count(*) AS questions, CAST(coalesce(sum(exposure), 0) AS BIGINT) AS exposure FROM questions LEFT JOIN e USING (question_id) GROUP BY 1""",
)
def s9_question_stats_refresh(b):
    """New events trigger a full recompute of the question statistics, patch by patch."""
    folder = _folder(b)
    joined = b.responses.join(b.respondents, "respondent_id")

    def recompute():
        return Q.question_stats(
            b.responses, b.questions, select.aggregable(joined, B.MIN_TRUST), b.pool, b.dimensions, b.traits
        )

    handle = ST.refresh_sink(
        _live(b).log, recompute, f"{folder}/stats", f"{folder}/checkpoint", availableNow=True
    )
    handle.awaitTermination()
    stats = b.spark.read.parquet(f"{folder}/stats")
    return stats.groupBy("patch_id").agg(
        F.count("*").alias("questions"), F.sum("exposure_count").alias("exposure")
    )


@query(
    "s10_late_answers",
    "elog",
    """
SELECT question_id % 2 + 2024 AS patch_id, count(*) AS n, round(sum((200 + 8 * (respondent_id % 101)) / 1000.0::DOUBLE
  * pow(0.5::DOUBLE, greatest(date_diff('day', CAST(created_at AS DATE), DATE '2024-01-15'), 0) / 21.0::DOUBLE)), 4) AS weight FROM elog GROUP BY 1""",
)
def s10_late_answers(b):
    """Half the events lie after the export day: they stay, keep their patch and weigh their trust."""
    trust = (F.lit(200) + F.lit(8) * (F.col("respondent_id") % 101)).cast("double") / F.lit(1000.0)
    live = _live(b).log.withColumn("trust_score", trust).withColumn(
        "patch_id", F.col("question_id") % 2 + 2024
    )
    kept = ST.drain(ST.late_policy(live, "2024-01-15", 21.0).select("patch_id", "weight"), _folder(b))
    return kept.groupBy("patch_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))
