"""Candidate ranking (H1-H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import behaviour, candidates, select
from crowdgauge.plans.draws import hash_sql
from crowdgauge.plans.registry import query
from crowdgauge.runtime import pin
from crowdgauge.sources import binding as B

P = C.plain
K = 20

_Q = f"""
q AS (SELECT question_id, type, item_a, item_b, item_c, item_d, patch_id, is_gold, count(*) AS exposure_count,
  CASE WHEN question_id % 11 <> 0 THEN CAST(question_id % 101 AS DOUBLE) / 100 END AS entropy,
  CASE WHEN question_id % 13 <> 0 THEN CAST(question_id % 7 AS DOUBLE) / 7 END AS coverage_deficit,
  type = 'pairwise_dimension' AND (item_a + item_b) % 7 = 0 AS bridge_priority FROM responses GROUP BY ALL),
hot AS (SELECT question_id, CASE WHEN type = 'lane_matchup' THEN CASE WHEN item_c IS NULL THEN 'lane_1v1' ELSE 'lane_2v2' END ELSE type END AS variant,
  0.35::DOUBLE * (1.0::DOUBLE / (1 + exposure_count)) + 0.25::DOUBLE * coalesce(entropy, 0) + 0.2::DOUBLE * coalesce(coverage_deficit, 0)
    + CASE WHEN bridge_priority THEN 1.0::DOUBLE ELSE 0 END AS priority FROM q
  WHERE NOT is_gold AND exposure_count >= 2 AND patch_id = {B.CURRENT_PATCH} AND item_a IN (SELECT item_id FROM pool)
    AND (item_b IS NULL OR item_b IN (SELECT item_id FROM pool)) AND (item_c IS NULL OR item_c IN (SELECT item_id FROM pool))
    AND (item_d IS NULL OR item_d IN (SELECT item_id FROM pool)))"""


def _questions(b):
    """Questions with their exposure and stand-in statistics that SQL can repeat."""
    k = F.col("question_id")
    keys = ["question_id", "type", "item_a", "item_b", "item_c", "item_d", "patch_id", "is_gold"]
    bridge = (F.col("type") == "pairwise_dimension") & ((F.col("item_a") + F.col("item_b")) % 7 == 0)
    return (
        b.responses.groupBy(*keys)
        .agg(F.count("*").alias("exposure_count"))
        .withColumn("entropy", F.when(k % 11 != 0, (k % 101).cast("double") / 100))
        .withColumn("coverage_deficit", F.when(k % 13 != 0, (k % 7).cast("double") / 7))
        .withColumn("bridge_priority", F.coalesce(bridge, F.lit(False)))
    )


@query(
    "h1_priority_topk",
    "responses pool",
    f"""
WITH {_Q}
SELECT variant, question_id, round(priority, 6) AS priority, row_number() OVER (PARTITION BY variant ORDER BY priority DESC, question_id) AS place
FROM hot QUALIFY place <= {K}""",
)
def h1_priority_topk(b):
    top = candidates.priority_topk(_questions(b), b.pool, cold=2, k=K, patch_id=B.CURRENT_PATCH)
    return top.select("variant", "question_id", P("priority").alias("priority"), "place")


def _people(b):
    """Respondents with their volume and the last types of their submissions."""
    heads = select.heads(b.responses, b.rankings)
    volume = heads.groupBy("respondent_id").agg(F.count("*").alias("answers_count"))
    return (
        b.respondents.select("respondent_id")
        .join(volume, "respondent_id", "left")
        .join(behaviour.recent_types(heads).select("respondent_id", "recent"), "respondent_id", "left")
        .withColumn("answers_count", F.coalesce("answers_count", F.lit(0)))
        .withColumn("recent", F.coalesce("recent", F.array().cast("array<string>")))
    )


SLOTS, EPSILON, SEED, COLD = 6, 0.5, 11, 5


def _number(*keys: str) -> str:
    return f"({hash_sql(13, SEED, *keys)} / 4503599627370496::DOUBLE)"


def _pick_variant(blocked: str) -> str:
    """The variant whose share of the open weights holds the draw, as a chain of cases."""
    open_ = [
        f"CASE WHEN l[{i}] > 0 AND coalesce({blocked} <> '{candidates.VARIANT_TYPE[v]}', true) THEN {S.VARIANT_WEIGHTS[v]}.0::DOUBLE ELSE 0 END"
        for i, v in enumerate(S.VARIANTS, 1)
    ]
    cases = [
        f"WHEN {w} > 0 AND draw * ({' + '.join(open_)}) < {' + '.join(open_[: i + 1])} THEN '{S.VARIANTS[i]}'"
        for i, w in enumerate(open_)
    ]
    return f"CASE {' '.join(cases)} END"


_TYPE_OF = " ".join(f"WHEN '{v}' THEN '{t}'" for v, t in candidates.VARIANT_TYPE.items())
_SAID = ", ".join(f"('{v}', {i})" for i, v in enumerate(S.VARIANTS, 1))
_TAKEN = ", ".join(f"l[{i}] - CASE WHEN chosen = '{v}' THEN 1 ELSE 0 END" for i, v in enumerate(S.VARIANTS, 1))
_NEXT = f"""
WITH RECURSIVE {_Q.replace("exposure_count >= 2", "true").replace("AS variant,", "AS variant, exposure_count, bridge_priority,")},
cand AS (SELECT question_id, variant, priority, CASE WHEN bridge_priority THEN 0 WHEN exposure_count >= {COLD} THEN 1 ELSE 2 END AS list FROM hot),
spot AS (SELECT question_id, list, variant, count(*) OVER (PARTITION BY list, variant) AS size, row_number() OVER (PARTITION BY list, variant
  ORDER BY CASE WHEN list = 2 THEN {_number("question_id", "'cold'")} ELSE -priority END, question_id) - 1 AS pos FROM cand),
heads AS (SELECT s.respondent_id, s.response_id, s.created_at, s.type FROM responses s LEFT JOIN rankings k USING (ranking_id)
  WHERE s.ranking_id IS NULL OR question_id = anchor_question_id),
last AS (SELECT *, row_number() OVER (PARTITION BY respondent_id ORDER BY created_at DESC, response_id DESC) AS back FROM heads),
people AS (SELECT respondent_id, count(h.response_id) AS answers_count, max(CASE WHEN back = 3 THEN type END) AS a, max(CASE WHEN back = 2 THEN type END) AS b,
  max(CASE WHEN back = 1 THEN type END) AS c FROM respondents LEFT JOIN last h USING (respondent_id) GROUP BY 1),
starts AS (SELECT respondent_id, variant, {_number("respondent_id", "variant", "'start'")} AS draw FROM respondents CROSS JOIN (SELECT DISTINCT variant FROM spot)),
unasked AS (SELECT s.respondent_id, p.list, p.variant, p.question_id, row_number() OVER (PARTITION BY s.respondent_id, p.list, p.variant
    ORDER BY (pos + size - CASE WHEN list = 2 THEN CAST(floor(draw * size) AS BIGINT) ELSE 0 END) % size) - 1 AS m
  FROM starts s JOIN spot p USING (variant) ANTI JOIN (SELECT DISTINCT respondent_id, question_id FROM responses) x
    ON x.respondent_id = s.respondent_id AND x.question_id = p.question_id),
lefts AS (SELECT respondent_id, list, variant, count(*) AS n FROM unasked GROUP BY ALL),
v(variant, i) AS (VALUES {_SAID}),
per AS (SELECT respondent_id, variant, i, coalesce(sum(n) FILTER (list = 0), 0) AS nb, coalesce(sum(n) FILTER (list = 1), 0) AS nh,
  coalesce(sum(n) FILTER (list = 2), 0) AS nc FROM (SELECT respondent_id, variant, i FROM respondents CROSS JOIN v) LEFT JOIN lefts USING (respondent_id, variant) GROUP BY ALL),
base AS (SELECT respondent_id, list(CAST(nb + nh + nc AS BIGINT) ORDER BY i) AS l FROM per GROUP BY 1),
st AS (SELECT respondent_id, -1 AS slot, CAST(NULL AS VARCHAR) AS chosen, a, b, c, answers_count, l FROM people JOIN base USING (respondent_id)
  UNION ALL SELECT respondent_id, slot, chosen, b, c, CASE chosen {_TYPE_OF} END, answers_count, [{_TAKEN}] FROM (
    SELECT *, CASE WHEN answers_count + slot < 3 AND l[1] > 0 THEN 'pairwise_dimension' WHEN a = b AND b = c THEN coalesce({_pick_variant("c")}, {_pick_variant("NULL")})
      ELSE {_pick_variant("NULL")} END AS chosen
    FROM (SELECT respondent_id, slot + 1 AS slot, a, b, c, answers_count, l, {_number("respondent_id", "slot + 1", "'variant'")} AS draw FROM st WHERE slot < {SLOTS - 1}))),
slots AS (SELECT respondent_id, slot, chosen AS variant, row_number() OVER (PARTITION BY respondent_id, chosen ORDER BY slot) - 1 AS j FROM st WHERE slot >= 0 AND chosen IS NOT NULL),
pk AS (SELECT respondent_id, variant, -1 AS j, CAST(NULL AS INT) AS list, CAST(NULL AS BIGINT) AS m, 0 AS tb, 0 AS th, 0 AS tc, nb, nh, nc FROM per
  UNION ALL SELECT respondent_id, variant, j, src, CASE src WHEN 0 THEN tb WHEN 1 THEN th ELSE tc END, tb + CAST(src = 0 AS INT), th + CAST(src = 1 AS INT), tc + CAST(src = 2 AS INT), nb, nh, nc
  FROM (SELECT *, CASE WHEN tb < nb THEN 0 WHEN tc < nc AND (draw < {EPSILON}::DOUBLE OR th >= nh) THEN 2 WHEN th < nh THEN 1 END AS src
    FROM (SELECT * EXCLUDE (j), j + 1 AS j, {_number("respondent_id", "variant", "j + 1", "'branch'")} AS draw FROM pk WHERE j < {SLOTS - 1})) WHERE src IS NOT NULL)
SELECT respondent_id, slot, variant, question_id FROM slots JOIN pk USING (respondent_id, variant, j) JOIN unasked USING (respondent_id, list, variant, m)"""


@query("h2_next_questions", "responses rankings respondents pool", _NEXT)
def h2_next_questions(b):
    """All bridges, all cold and all hot questions of the patch; nothing is cut."""
    b = b.keep()
    q = _questions(b)
    free = candidates.open_questions(q, b.pool, patch_id=B.CURRENT_PATCH)
    free = free.join(q.select("question_id", "exposure_count", "bridge_priority"), "question_id")
    free = pin(free.withColumn("place", -F.col("priority")))
    hot, cold = free.filter(F.col("exposure_count") >= COLD), free.filter(F.col("exposure_count") < COLD)
    answered = b.responses.select("respondent_id", "question_id")
    return candidates.next_questions(
        _people(b), hot, cold, free.filter("bridge_priority"), answered, SLOTS, EPSILON, seed=SEED
    )


@query(
    "h3_cadence_due",
    "identities",
    """
SELECT respondent_id, CAST(coalesce(CASE WHEN respondent_id % 2 = 0 THEN respondent_id END, answers_count + 12 - 1) AS BIGINT) AS next_gold_at,
  answers_count + 30 - 1 AS next_retest_at, answers_count >= coalesce(CASE WHEN respondent_id % 2 = 0 THEN respondent_id END, answers_count + 11) AS gold_due,
  false AS retest_due FROM identities""",
)
def h3_cadence_due(b):
    people = b.identities.withColumn(
        "next_gold_at", F.when(F.col("respondent_id") % 2 == 0, F.col("respondent_id"))
    ).withColumn("next_retest_at", F.lit(None).cast("int"))
    return candidates.due_flags(people, gold_every=(12, 12))


@query(
    "h4_retest_candidates",
    "responses rankings pool",
    f"""
WITH heads AS (SELECT s.respondent_id, s.response_id, s.created_at, s.ranking_id FROM responses s LEFT JOIN rankings k USING (ranking_id)
  WHERE s.ranking_id IS NULL OR question_id = anchor_question_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY respondent_id ORDER BY created_at, response_id) - 1 AS position,
  count(*) OVER (PARTITION BY respondent_id) AS total FROM heads),
old AS (SELECT * FROM pos WHERE position <= total - 15),
el AS (SELECT * FROM responses r WHERE patch_id = {B.CURRENT_PATCH} AND is_retest_of IS NULL AND NOT is_gold AND coalesce(choice, '') <> 'unknown'
  AND NOT EXISTS (SELECT 1 FROM responses x WHERE x.is_retest_of = r.response_id) AND item_a IN (SELECT item_id FROM pool)),
ext AS (SELECT DISTINCT respondent_id, dimension_id, least(submitted_order[1], submitted_order[-1]) AS a, greatest(submitted_order[1], submitted_order[-1]) AS b
  FROM rankings WHERE patch_id = {B.CURRENT_PATCH} AND ranking_id IN (SELECT ranking_id FROM old WHERE ranking_id IS NOT NULL))
SELECT respondent_id, response_id, question_id FROM el WHERE type <> 'pairwise_dimension' AND response_id IN (SELECT response_id FROM old)
UNION ALL SELECT respondent_id, response_id, question_id FROM el WHERE type = 'pairwise_dimension' AND EXISTS (
  SELECT 1 FROM ext WHERE ext.respondent_id = el.respondent_id AND ext.dimension_id = el.dimension_id AND ext.a = el.item_a AND ext.b = el.item_b)""",
)
def h4_retest_candidates(b):
    """Questions whose first item is in the pool stand for the admissible ones here."""
    b = b.keep()
    ok = b.questions.join(
        b.pool.select(F.col("item_id").alias("item_a")), "item_a", "left_semi"
    )
    return candidates.retest_candidates(b.responses, b.rankings, ok, B.CURRENT_PATCH)


@query(
    "h5_unseen_gold",
    "responses questions respondents",
    f"""
WITH g AS (SELECT question_id FROM questions WHERE is_gold AND patch_id = {B.CURRENT_PATCH}),
s AS (SELECT respondent_id, count(DISTINCT question_id) AS n FROM responses WHERE question_id IN (SELECT question_id FROM g) GROUP BY 1)
SELECT respondent_id, (SELECT count(*) FROM g) - coalesce(n, 0) AS unseen, n IS NULL OR n < (SELECT count(*) FROM g) AS has_pick
FROM respondents LEFT JOIN s USING (respondent_id)""",
)
def h5_unseen_gold(b):
    gold = b.questions.filter(F.col("is_gold") & (F.col("patch_id") == B.CURRENT_PATCH))
    found = candidates.unseen_gold(b.respondents, gold, b.responses, seed=3)
    return found.select("respondent_id", "unseen", F.col("question_id").isNotNull().alias("has_pick"))
