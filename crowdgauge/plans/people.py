"""Annotator quality (D33-D43) and behaviour windows (F, H6, G11-G13, G15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import annotators as A
from crowdgauge.operators import behaviour as W
from crowdgauge.operators import select
from crowdgauge.plans.registry import query
from crowdgauge.sources import binding as B

P = C.plain
TZ = S.DEFAULTS["gamification.streak_timezone"]
RUN = 3

_GOLD = """
gold AS (SELECT *, CASE WHEN choice <> 'unknown' THEN choice = expected END AS passed FROM retested
  WHERE is_gold AND is_retest_of IS NULL)"""

_RETEST = """
pairs_r AS (SELECT r.response_id, r.respondent_id, r.type, CASE r.type
  WHEN 'pairwise_dimension' THEN CASE WHEN o.choice <> 'unknown' AND r.choice <> 'unknown' THEN o.choice = r.choice END
  WHEN 'lane_matchup' THEN split_part(o.choice, '_', 1) = split_part(r.choice, '_', 1)
  WHEN 'peak_timing' THEN abs(o.minute - r.minute) <= 5
  WHEN 'duo_synergy' THEN o.choice = r.choice
  ELSE CAST(len(list_intersect(o.traits, r.traits)) AS DOUBLE)
    / len(list_distinct(list_concat(o.traits, r.traits))) >= 0.6 END AS consistent
  FROM retested r JOIN retested o ON r.is_retest_of = o.response_id)"""


@query(
    "d33_gold_evaluation",
    "retested",
    f"WITH {_GOLD} SELECT response_id, respondent_id, question_id, passed FROM gold",
)
def d33_gold_evaluation(b):
    return A.evaluate_gold(b.retested).select("response_id", "respondent_id", "question_id", "passed")


_GC = "gc AS (SELECT respondent_id, count(passed) AS gold_attempts, count(*) FILTER (passed) AS gold_passed FROM gold GROUP BY 1 HAVING count(passed) > 0)"


@query("d34_gold_counts", "retested", f"WITH {_GOLD}, {_GC} SELECT * FROM gc")
def d34_gold_counts(b):
    return A.gold_counts(b.retested)


@query(
    "d35_retire_failing_gold",
    "retested identities",
    f"""
WITH {_GOLD}, r AS (SELECT question_id, count(passed) AS gold_attempts, count(*) FILTER (passed) AS gold_passed
  FROM gold JOIN identities USING (respondent_id) WHERE NOT is_flagged GROUP BY 1
  HAVING count(passed) >= 5 AND CAST(count(*) FILTER (passed) AS DOUBLE) / count(passed) < 0.85)
SELECT question_id, gold_attempts, gold_passed, (SELECT count(DISTINCT respondent_id) FROM retested
  WHERE question_id IN (SELECT question_id FROM r)) AS affected FROM r""",
)
def d35_retire_failing_gold(b):
    retired = A.retire_gold(b.retested, b.identities, min_attempts=5)
    affected = A.affected_by(b.retested, retired).agg(F.count("*").alias("affected"))
    return retired.join(F.broadcast(affected), F.lit(True))


@query(
    "d36_retest_consistency",
    "retested",
    f"WITH {_RETEST} SELECT response_id, type, consistent FROM pairs_r",
)
def d36_retest_consistency(b):
    return A.retest_pairs(b.retested).select("response_id", "type", "consistent")


_RC = """rc AS (SELECT respondent_id, count(*) AS retest_pairs, count(*) FILTER (consistent) AS retest_consistent
  FROM pairs_r WHERE consistent IS NOT NULL GROUP BY 1)"""


@query(
    "d37_retest_counts",
    "retested",
    f"""
WITH {_RETEST}, {_RC} SELECT 'respondent ' || respondent_id AS key, retest_pairs, retest_consistent FROM rc
UNION ALL SELECT 'type ' || type, count(*), count(*) FILTER (consistent) FROM pairs_r
  WHERE consistent IS NOT NULL GROUP BY type""",
)
def d37_retest_counts(b):
    def keyed(df, column, label):
        return df.select(
            F.concat(F.lit(label), column).alias("key"), "retest_pairs", "retest_consistent"
        )

    return keyed(A.retest_counts(b.retested), "respondent_id", "respondent ").unionByName(
        keyed(A.retest_counts(b.retested, ["type"]), "type", "type ")
    )


_FA = """fa AS (SELECT respondent_id, count(*) FILTER (response_time_ms < 800) AS fast_answers, count(*) AS answers_count
  FROM retested GROUP BY 1)"""


@query("d38_fast_answers", "retested", f"WITH {_FA} SELECT * FROM fa")
def d38_fast_answers(b):
    return A.fast_answers(b.retested)


_SL = f"""
seq AS (SELECT *, CASE WHEN choice = lag(choice) OVER w THEN 0 ELSE 1 END AS change FROM retested
  WHERE type IN ('lane_matchup', 'duo_synergy') WINDOW w AS (PARTITION BY respondent_id, type ORDER BY created_at, response_id)),
runs AS (SELECT *, sum(change) OVER (PARTITION BY respondent_id, type ORDER BY created_at, response_id
  ROWS UNBOUNDED PRECEDING) AS run FROM seq),
lens AS (SELECT respondent_id, type, run, count(*) AS length FROM runs WHERE choice <> 'unknown' GROUP BY 1, 2, 3),
sl AS (SELECT respondent_id, count(*) AS straightline_runs FROM lens WHERE length >= {RUN} GROUP BY 1)"""

_TRUST_SQL = """CAST(round(CAST(CAST(least(1, greatest(0,
  (0.6::DOUBLE * ((gold_passed + 1.0::DOUBLE) / (gold_attempts + 2.0::DOUBLE)) + 0.4::DOUBLE * ((retest_consistent + 1.0::DOUBLE) / (retest_pairs + 2.0::DOUBLE)))
  * (1.0::DOUBLE - 0.5::DOUBLE * least(1.0::DOUBLE, (fast_answers + 2 * straightline_runs) / greatest(20.0::DOUBLE, 0.15::DOUBLE * answers_count)))))
  AS VARCHAR) AS DECIMAL(30, 18)), 3) AS DOUBLE)"""

_RECOUNT = f"""
{_GOLD}, {_GC}, {_RETEST}, {_RC}, {_FA}, {_SL},
counted AS (SELECT i.respondent_id, coalesce(gold_attempts, 0) AS gold_attempts, coalesce(gold_passed, 0) AS gold_passed,
  coalesce(retest_pairs, 0) AS retest_pairs, coalesce(retest_consistent, 0) AS retest_consistent,
  coalesce(fast_answers, 0) AS fast_answers, coalesce(straightline_runs, 0) AS straightline_runs,
  coalesce(fa.answers_count, 0) AS answers_count, i.trust_score AS stored
  FROM identities i LEFT JOIN gc USING (respondent_id) LEFT JOIN rc USING (respondent_id)
  LEFT JOIN fa USING (respondent_id) LEFT JOIN sl USING (respondent_id)),
trusted AS (SELECT *, {_TRUST_SQL} AS trust FROM counted)"""


def _counted(b):
    return A.recount(b.retested, b.retested, b.identities, run_length=RUN)


@query(
    "d39_trust_score",
    "retested identities",
    f"""
WITH {_RECOUNT} SELECT respondent_id, gold_attempts, gold_passed, retest_pairs, retest_consistent,
  fast_answers, straightline_runs, answers_count, trust FROM trusted""",
)
def d39_trust_score(b):
    return A.with_trust(_counted(b)).withColumn("trust", F.col("trust").cast("double"))


@query(
    "d40_trust_rebuild",
    "retested identities",
    f"WITH {_RECOUNT} SELECT respondent_id, round(stored, 6) AS stored, trust FROM trusted WHERE stored <> trust",
)
def d40_trust_rebuild(b):
    return A.rebuild_trust(_counted(b), b.identities).select(
        "respondent_id", P("stored").alias("stored"), F.col("trust").cast("double").alias("trust")
    )


@query(
    "d41_trust_verification",
    "retested identities",
    f"WITH {_RECOUNT} SELECT respondent_id, trust AS expected, fast_answers FROM trusted WHERE respondent_id % 3 = 0",
)
def d41_trust_verification(b):
    """Every third stored row carries one fast answer too many; exactly those come back."""
    stored = (
        A.with_trust(_counted(b))
        .withColumn("trust_score", F.col("trust"))
        .withColumn(
            "fast_answers",
            F.col("fast_answers") + F.when(F.col("respondent_id") % 3 == 0, 1).otherwise(0),
        )
    )
    return A.verify_trust(stored, _counted(b)).select(
        "respondent_id",
        F.col("expected").cast("double").alias("expected"),
        F.col("new_fast_answers").alias("fast_answers"),
    )


@query(
    "d42_duplicate_identities",
    "identities",
    """
WITH n AS (SELECT min(created) AS t0 FROM (SELECT min(ts) AS created FROM events))
SELECT respondent_id, fingerprint_hash FROM identities WHERE NOT is_flagged AND fingerprint_hash IN (
  SELECT fingerprint_hash FROM identities, n WHERE first_seen > t0 - INTERVAL 1 HOUR GROUP BY 1 HAVING count(*) > 3)""",
)
def d42_duplicate_identities(b):
    start = b.raw("events").agg(F.min("ts").cast("timestamp").alias("t0"))
    people = b.identities.join(F.broadcast(start), F.lit(True))
    now = F.col("t0") + F.expr("INTERVAL 23 HOURS")
    return A.flag_duplicates(people, now, limit=3).select("respondent_id", "fingerprint_hash")


_SEGMENT = """CASE WHEN declared_rank IN ('iron', 'bronze', 'silver') THEN 'low'
  WHEN declared_rank IN ('gold', 'platinum', 'emerald') THEN 'mid'
  WHEN declared_rank IN ('diamond', 'master', 'grandmaster', 'challenger') THEN 'high'
  WHEN declared_rank = 'unranked' THEN 'unranked' ELSE 'undeclared' END"""


@query(
    "d43_gold_report",
    "retested identities",
    f"""
WITH {_GOLD}, {_RETEST}, {_RC},
a AS (SELECT g.*, {_SEGMENT} AS segment, coalesce(retest_pairs, 0) AS rp, coalesce(retest_consistent, 0) AS rs
  FROM gold g JOIN identities i USING (respondent_id) LEFT JOIN rc USING (respondent_id)
  WHERE passed IS NOT NULL AND NOT is_flagged)
SELECT question_id, count(*) AS attempts, count(*) FILTER (passed) AS passed,
  count(*) FILTER (segment = 'low') AS low_attempts, count(*) FILTER (segment = 'undeclared' AND passed) AS undeclared_passed,
  count(*) FILTER (segment = 'high') AS high_attempts,
  count(*) >= 5 AND sum(rp) FILTER (NOT passed) > 0 AND sum(rp) FILTER (passed) > 0
    AND sum(rs) FILTER (NOT passed) * sum(rp) FILTER (passed) >= sum(rs) FILTER (passed) * sum(rp) FILTER (NOT passed)
    IS TRUE AS suspicious
FROM a GROUP BY 1""".replace(
        """  count(*) >= 5 AND sum(rp)""", """  coalesce(count(*) >= 5 AND sum(rp)"""
    ).replace("    IS TRUE AS suspicious", "    , false) AS suspicious"),
)
def d43_gold_report(b):
    return A.gold_report(b.retested, b.identities, min_attempts=5).select(
        "question_id", "attempts", "passed", "low_attempts", "undeclared_passed", "high_attempts",
        "suspicious",
    )


# -------------------------------------------------------------------------------- windows
_STREAK = """
gap AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM elog WINDOW w AS (PARTITION BY respondent_id ORDER BY created_at, response_id)),
ses AS (SELECT *, sum(fresh) OVER (PARTITION BY respondent_id ORDER BY created_at, response_id ROWS UNBOUNDED PRECEDING) AS s FROM gap),
lens AS (SELECT respondent_id, s, count(*) AS n, max(created_at) AS last_seen FROM ses GROUP BY 1, 2),
streak AS (SELECT respondent_id, max_by(n, s) AS current_streak, max(n) AS best_streak, max(last_seen) AS last_seen FROM lens GROUP BY 1)"""

_DAYS = f"""
days AS (SELECT respondent_id, CAST(timezone('{TZ}', timezone('UTC', created_at)) AS DATE) AS day, count(*) AS n FROM elog GROUP BY 1, 2),
lastd AS (SELECT respondent_id, max(day) AS last_active_date, max_by(n, day) AS answers_today FROM days GROUP BY 1),
isl AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY respondent_id ORDER BY day) AS INTEGER) AS island FROM days WHERE n >= 3),
druns AS (SELECT respondent_id, island, max(day) AS stop, count(*) AS length FROM isl GROUP BY 1, 2),
dstreak AS (SELECT l.respondent_id, l.last_active_date, l.answers_today,
  coalesce(max(length) FILTER (stop = CASE WHEN answers_today >= 3 THEN last_active_date ELSE last_active_date - 1 END), 0) AS current_day_streak,
  coalesce(max(length), 0) AS best_day_streak
  FROM lastd l LEFT JOIN druns USING (respondent_id) GROUP BY 1, 2, 3)"""


@query(
    "f1_answer_streak",
    "elog",
    f"WITH {_STREAK} SELECT respondent_id, current_streak, best_streak FROM streak",
)
def f1_answer_streak(b):
    return W.answer_streak(b.log).select("respondent_id", "current_streak", "best_streak")


@query(
    "f2_day_streak",
    "elog",
    f"WITH {_DAYS} SELECT respondent_id, current_day_streak, best_day_streak, answers_today FROM dstreak",
)
def f2_day_streak(b):
    return W.day_streak(b.log, min_answers=3).select(
        "respondent_id", "current_day_streak", "best_day_streak", "answers_today"
    )


@query(
    "f3_visible_streaks",
    "elog",
    f"""
WITH {_STREAK}, {_DAYS} SELECT respondent_id,
  CASE WHEN TIMESTAMP '2024-01-30 23:59:00' - last_seen <= INTERVAL 30 MINUTE THEN current_streak ELSE 0 END AS answer_streak,
  CASE WHEN last_active_date = DATE '2024-01-30' OR (last_active_date = DATE '2024-01-29' AND answers_today >= 3)
    THEN current_day_streak ELSE 0 END AS day_streak
FROM streak JOIN dstreak USING (respondent_id)""",
)
def f3_visible_streaks(b):
    now = F.lit("2024-01-30 23:59:00").cast("timestamp")
    return W.visible_streaks(
        W.answer_streak(b.log), W.day_streak(b.log, min_answers=3), now, min_answers=3
    )


@query(
    "f4_straightline_runs",
    "retested",
    f"WITH {_SL} SELECT respondent_id, straightline_runs FROM sl",
)
def f4_straightline_runs(b):
    return A.straightline_runs(b.retested, run_length=RUN)


@query(
    "f5_history_positions",
    "elog",
    """
SELECT response_id, respondent_id, row_number() OVER (PARTITION BY respondent_id
  ORDER BY created_at, response_id) - 1 AS position FROM elog""",
)
def f5_history_positions(b):
    return W.positions(b.log.select("respondent_id", "created_at", "response_id"))[
        ["response_id", "respondent_id", "position"]
    ]


_RATE = """
rates AS (SELECT k.response_id, k.{key}, k.created_at, row_number() OVER (PARTITION BY k.{key} ORDER BY k.created_at, k.response_id) AS position,
  (SELECT count(*) FROM src o WHERE o.{key} = k.{key} AND o.created_at > k.created_at - INTERVAL 1 HOUR
     AND (o.created_at, o.response_id) <= (k.created_at, k.response_id)) AS in_hour,
  (SELECT count(*) FROM src o WHERE o.{key} = k.{key} AND o.created_at > k.created_at - INTERVAL 1 DAY
     AND (o.created_at, o.response_id) <= (k.created_at, k.response_id)) AS in_day
  FROM src k)"""


def _with_ip(b):
    return b.log.withColumn("ip_hash", F.concat(F.lit("ip"), F.col("respondent_id") % 7))


@query(
    "f6_rate_windows",
    "elog",
    "WITH src AS (SELECT * FROM elog), "
    + _RATE.format(key="respondent_id")
    + " SELECT response_id, respondent_id, position, in_hour, in_day FROM rates",
)
def f6_rate_windows(b):
    return W.rate_windows(b.log, "respondent_id", {"in_hour": 3600, "in_day": 86400})


@query(
    "f6_rate_over_limit_by_address",
    "elog",
    "WITH src AS (SELECT *, 'ip' || (respondent_id % 7) AS ip_hash FROM elog), "
    + _RATE.format(key="ip_hash")
    + """
SELECT r.response_id, r.ip_hash, r.in_hour, greatest(1, CAST(trunc(date_diff('microsecond', r.created_at,
  o.created_at + INTERVAL 1 HOUR) / 1000000.0) AS BIGINT)) AS retry_after
FROM rates r JOIN rates o ON o.ip_hash = r.ip_hash AND o.position = r.position - r.in_hour + 1
WHERE r.in_hour > 2""",
)
def f6_rate_over_limit_by_address(b):
    heads = _with_ip(b)
    rates = W.rate_windows(heads, "ip_hash", {"in_hour": 3600})
    return W.over_limit(rates, heads, "ip_hash", "in_hour", 2, 3600)


@query(
    "f7_recent_types",
    "elog",
    """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY respondent_id ORDER BY created_at DESC, response_id DESC) AS back FROM elog),
r AS (SELECT respondent_id, list(type ORDER BY back DESC) AS recent FROM k WHERE back <= 3 GROUP BY 1)
SELECT respondent_id, array_to_string(recent, '|') AS recent,
  CASE WHEN len(recent) = 3 AND len(list_distinct(recent)) = 1 THEN recent[1] END AS ruled_out FROM r""",
)
def f7_recent_types(b):
    return W.recent_types(b.log).withColumn("recent", F.concat_ws("|", "recent"))


@query(
    "f8_rank_percentile",
    "identities",
    """
SELECT respondent_id, round(CAST(rank() OVER (ORDER BY answers_count) - 1 AS DOUBLE) / count(*) OVER (), 6) AS percentile
FROM identities WHERE NOT is_flagged""",
)
def f8_rank_percentile(b):
    return W.rank_percentile(b.identities).select("respondent_id", P("percentile").alias("percentile"))


@query(
    "f9_leaderboard",
    "elog identities",
    """
SELECT respondent_id, answers, row_number() OVER (ORDER BY answers DESC, respondent_id) AS rank FROM (
  SELECT respondent_id, count(*) AS answers FROM elog WHERE created_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY
    AND respondent_id IN (SELECT respondent_id FROM identities WHERE NOT is_flagged AND trust_score >= 0.3) GROUP BY 1)
QUALIFY rank <= 50""",
)
def f9_leaderboard(b):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return W.leaderboard(b.log, b.identities, "week", now)


@query(
    "f10_latest_row_per_key",
    "elog",
    """
SELECT question_id, response_id, respondent_id, choice FROM elog
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, response_id DESC) = 1""",
)
def f10_latest_row_per_key(b):
    log = b.log.select("question_id", "created_at", "response_id", "respondent_id", "choice")
    return W.latest(log, ["question_id"], W.ORDER).select(
        "question_id", "response_id", "respondent_id", "choice"
    )


# ------------------------------------------------------------------------------ monitoring
@query(
    "g11_overview_totals",
    "responses respondents rankings",
    f"""
SELECT count(*) AS rows, count(*) FILTER (s.ranking_id IS NULL OR question_id = anchor_question_id) AS submissions,
  count(*) FILTER (is_retest_of IS NULL AND NOT is_gold AND NOT is_flagged AND trust_score >= 0.3) AS aggregable_rows,
  count(DISTINCT s.respondent_id) AS respondents, count(DISTINCT CASE WHEN is_flagged THEN s.respondent_id END) AS flagged_respondents
FROM responses s JOIN respondents r ON s.respondent_id = r.respondent_id LEFT JOIN rankings k USING (ranking_id)
WHERE s.patch_id = {B.CURRENT_PATCH}""",
)
def g11_overview_totals(b):
    current = b.responses.filter(F.col("patch_id") == B.CURRENT_PATCH)
    joined = current.join(b.respondents, "respondent_id")
    return select.overview_totals(joined, b.rankings, B.MIN_TRUST)


@query(
    "g12_daily_volume",
    "elog",
    f"""
WITH d AS (SELECT CAST(timezone('{TZ}', timezone('UTC', created_at)) AS DATE) AS day, type FROM elog),
cal AS (SELECT CAST(DATE '2024-01-30' - CAST(i AS INTEGER) AS DATE) AS day FROM range(30) t(i))
SELECT CAST(cal.day AS VARCHAR) AS day, {", ".join(f"count(type) FILTER (type = '{t}') AS {t}" for t in S.QUESTION_TYPES)}
FROM cal LEFT JOIN d USING (day) GROUP BY 1""",
)
def g12_daily_volume(b):
    volume = W.daily_volume(b.log, TZ, 30, F.lit("2024-01-30").cast("date"))
    return volume.withColumn("day", F.col("day").cast("string"))


@query(
    "g13_trust_histogram",
    "respondents",
    """
SELECT i AS bin, count(respondent_id) AS n FROM range(20) t(i) LEFT JOIN respondents
  ON least(CAST(floor(trust_score * 20) AS BIGINT), 19) = i GROUP BY 1""",
)
def g13_trust_histogram(b):
    return W.trust_histogram(b.respondents)


@query(
    "g15_latest_by_json_key",
    "",
    """
SELECT json_extract_string(props, '$.k') AS name, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us
FROM events WHERE event_type = 'signup' GROUP BY 1""",
)
def g15_latest_by_json_key(b):
    log = b.raw("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return W.last_by_json_key(log, "props", "$.k", "at", F.col("event_type") == "signup").select(
        "name", F.col("last").alias("last_us")
    )


@query(
    "h6_paged_listing",
    "elog",
    """
SELECT response_id, event, (SELECT count(*) FROM elog WHERE event = 'click') AS total FROM elog WHERE event = 'click'
ORDER BY created_at DESC, response_id DESC LIMIT 50 OFFSET 100""",
)
def h6_paged_listing(b):
    rows = b.log.filter("event = 'click'")
    total = rows.agg(F.count("*").alias("total"))
    listing = W.page(rows, [F.desc("created_at"), F.desc("response_id")], 50, 3)
    return listing.join(F.broadcast(total), F.lit(True)).select("response_id", "event", "total")
