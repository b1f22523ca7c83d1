"""Scans, filters, joins and set operations (A1, A3, A5, A6, B, C, I, parts of J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import merge, select, validate
from crowdgauge.plans.registry import query
from crowdgauge.sources import binding as B

P6 = C.plain


def _joined(b: B.Binding):
    return b.pairs.join(b.respondents, "respondent_id")


@query(
    "a1_read_base",
    "compared respondents",
    """
SELECT response_id, respondent_id, question_id, dimension_id, item_a, item_b, choice,
  round(trust_score, 6) AS trust_score, declared_rank
FROM pairs JOIN respondents USING (respondent_id)""".replace("pairs", "compared"),
)
def a1_read_base(b):
    """The response log with question and respondent columns."""
    return select.join_base(
        b.pairs.select("response_id", "respondent_id", "question_id", "choice"),
        b.questions.filter("type = 'pairwise_dimension'").select(
            "question_id", "dimension_id", "item_a", "item_b"
        ),
        b.respondents,
    ).select(
        "response_id", "respondent_id", "question_id", "dimension_id", "item_a", "item_b",
        "choice", P6("trust_score").alias("trust_score"), "declared_rank",
    )


@query(
    "b1_aggregable_filter",
    "pairs respondents",
    """
SELECT response_id, respondent_id, item_a, item_b, dimension_id, choice
FROM pairs JOIN respondents USING (respondent_id)
WHERE is_retest_of IS NULL AND NOT is_gold AND NOT is_flagged AND trust_score >= 0.3""",
)
def b1_aggregable_filter(b):
    return select.aggregable(_joined(b), B.MIN_TRUST).select(
        "response_id", "respondent_id", "item_a", "item_b", "dimension_id", "choice"
    )


@query(
    "b2_patch_window",
    "pairs patches",
    """
SELECT patch_id, count(*) AS n FROM pairs WHERE patch_id IN (
  SELECT patch_id FROM patches WHERE released_at BETWEEN
    (SELECT released_at FROM patches WHERE version = '16.6')
    AND (SELECT released_at FROM patches WHERE version = '16.18'))
GROUP BY patch_id""",
)
def b2_patch_window(b):
    inside = select.patch_window(b.patches, *B.WINDOW)
    kept = b.pairs.join(inside, "patch_id", "left_semi")
    return kept.groupBy("patch_id").agg(F.count("*").alias("n"))


@query(
    "b3_exclusion_cascade",
    "pairs respondents",
    """
SELECT count(*) AS "window", count(*) FILTER (is_retest_of IS NOT NULL) AS retest,
  count(*) FILTER (is_retest_of IS NULL AND is_gold) AS gold,
  count(*) FILTER (is_retest_of IS NULL AND NOT is_gold AND is_flagged) AS flagged,
  count(*) FILTER (is_retest_of IS NULL AND NOT is_gold AND NOT is_flagged AND trust_score < 0.3)
    AS trust,
  count(*) FILTER (is_retest_of IS NULL AND NOT is_gold AND NOT is_flagged AND trust_score >= 0.3)
    AS included
FROM pairs JOIN respondents USING (respondent_id) WHERE patch_id BETWEEN 1996 AND 2000""",
)
def b3_exclusion_cascade(b):
    inside = select.patch_window(b.patches, *B.WINDOW)
    return select.excluded(_joined(b).join(inside, "patch_id", "left_semi"), B.MIN_TRUST)


@query(
    "b4_recency_trust_weight",
    "wpairs",
    "SELECT response_id, round(weight, 9) AS weight FROM wpairs",
)
def b4_recency_trust_weight(b):
    return b.wpairs.select("response_id", P6("weight", 9).alias("weight"))


@query(
    "b5_submission_heads",
    "pairs rankings",
    """
SELECT response_id, respondent_id, question_id, ranking_id FROM pairs JOIN rankings USING (ranking_id)
WHERE question_id = anchor_question_id""".replace(
        "response_id, respondent_id", "response_id, pairs.respondent_id"
    ),
)
def b5_submission_heads(b):
    return select.heads(b.pairs, b.rankings).select(
        "response_id", "respondent_id", "question_id", "ranking_id"
    )


@query(
    "b6_validate_answers",
    "raw_answers traits",
    """
SELECT response_id, type, CASE
  WHEN NOT json_valid(raw) THEN 'malformed'
  WHEN type IN ('pairwise_dimension', 'lane_matchup', 'duo_synergy') THEN CASE
    WHEN json_keys(answer) <> ['choice'] THEN 'keys'
    WHEN json_extract_string(answer, '$.choice') NOT IN (SELECT unnest(CASE type
        WHEN 'pairwise_dimension' THEN ['a', 'b', 'unknown']
        WHEN 'lane_matchup' THEN ['a_strong', 'a_slight', 'even', 'b_slight', 'b_strong']
        ELSE ['pair_1', 'pair_2', 'similar'] END)) THEN 'choice' END
  WHEN type = 'peak_timing' THEN CASE
    WHEN json_keys(answer) <> ['minute'] THEN 'keys'
    WHEN json_type(answer, '$.minute') NOT IN ('UBIGINT', 'BIGINT') THEN 'minute_integer'
    WHEN CAST(json_extract_string(answer, '$.minute') AS DOUBLE) NOT BETWEEN 0 AND 40
      THEN 'minute_range' END
  WHEN type = 'trait_multiselect' THEN CASE
    WHEN json_keys(answer) <> ['traits'] THEN 'keys'
    WHEN len(t) = 0 THEN 'traits_empty'
    WHEN len(list_distinct(t)) <> len(t) THEN 'traits_repeated'
    WHEN NOT list_has_all((SELECT list(code) FROM traits), t) THEN 'traits_unknown' END
  END AS reason
FROM (SELECT response_id, type, raw, CASE WHEN json_valid(raw) THEN raw END AS answer,
        CASE WHEN json_valid(raw) AND type = 'trait_multiselect'
             THEN from_json(json_extract(CASE WHEN json_valid(raw) THEN raw END, '$.traits'), '["VARCHAR"]')
        END AS t
      FROM (SELECT response_id, type, answer AS raw FROM raw_answers))""",
)
def b6_validate_answers(b):
    return validate.validate_answers(b.raw_answers, b.traits).select("response_id", "type", "reason")


def _bent(b: B.Binding):
    """Questions of which some are bent out of shape, to give the rules something to find."""
    q, k = b.questions, F.col("question_id") % 17
    return (
        q.withColumn("item_b", F.when(k == 3, F.col("item_a")).otherwise(F.col("item_b")))
        .withColumn("role", F.when(k == 5, F.lit("jungle")).otherwise(F.col("role")))
        .withColumn("role_a", F.when(k == 7, F.lit("mid")).otherwise(F.col("role_a")))
        .withColumn("expected", F.when(k == 9, F.lit(None)).otherwise(F.col("expected")))
    )


@query(
    "b7_question_constraints",
    "questions",
    """
WITH q AS (SELECT * REPLACE (
  CASE WHEN question_id % 17 = 3 THEN item_a ELSE item_b END AS item_b,
  CASE WHEN question_id % 17 = 5 THEN 'jungle' ELSE role END AS role,
  CASE WHEN question_id % 17 = 7 THEN 'mid' ELSE role_a END AS role_a,
  CASE WHEN question_id % 17 = 9 THEN NULL ELSE expected END AS expected) FROM questions)
SELECT question_id, 'shape' AS rule FROM q WHERE NOT coalesce(CASE type
  WHEN 'pairwise_dimension' THEN item_b IS NOT NULL AND item_c IS NULL AND item_d IS NULL
    AND dimension_id IS NOT NULL AND role IS NULL AND duo_ctx IS NULL
  WHEN 'peak_timing' THEN item_b IS NULL AND item_c IS NULL AND item_d IS NULL
    AND dimension_id IS NULL AND role IS NULL AND duo_ctx IS NULL
  WHEN 'trait_multiselect' THEN item_b IS NULL AND item_c IS NULL AND item_d IS NULL
    AND dimension_id IS NULL AND role IS NULL AND duo_ctx IS NULL
  WHEN 'lane_matchup' THEN dimension_id IS NULL AND (
    (item_b IS NOT NULL AND item_c IS NULL AND item_d IS NULL AND role IN ('top', 'mid', 'adc')
      AND duo_ctx IS NULL)
    OR (item_b IS NOT NULL AND item_c IS NOT NULL AND item_d IS NOT NULL AND role IS NULL
      AND duo_ctx = 'bot'))
  WHEN 'duo_synergy' THEN item_b IS NOT NULL AND item_c IS NOT NULL AND item_d IS NOT NULL
    AND dimension_id IS NULL AND role IS NULL AND duo_ctx IS NOT NULL END, false)
UNION ALL
SELECT question_id, 'canonical_order' FROM q WHERE NOT coalesce(CASE
  WHEN type = 'pairwise_dimension' OR (type = 'lane_matchup' AND item_c IS NULL) THEN item_a < item_b
  WHEN type IN ('lane_matchup', 'duo_synergy')
    THEN item_a < item_b AND item_c < item_d AND item_a < item_c ELSE true END, true)
UNION ALL
SELECT question_id, 'duo_roles' FROM q WHERE NOT coalesce(CASE
  WHEN duo_ctx IS NULL THEN role_a IS NULL AND role_b IS NULL AND role_c IS NULL AND role_d IS NULL
  ELSE list_sort([role_a, role_b]) = CASE duo_ctx WHEN 'bot' THEN ['adc', 'support']
      WHEN 'top_jungle' THEN ['jungle', 'top'] ELSE ['jungle', 'mid'] END
    AND list_sort([role_c, role_d]) = CASE duo_ctx WHEN 'bot' THEN ['adc', 'support']
      WHEN 'top_jungle' THEN ['jungle', 'top'] ELSE ['jungle', 'mid'] END END, false)
UNION ALL
SELECT question_id, 'gold_has_expected' FROM q WHERE is_gold AND expected IS NULL""",
)
def b7_question_constraints(b):
    return validate.check_questions(_bent(b))


@query(
    "b8_table_constraints",
    "respondents elog patches items",
    """
SELECT 'respondents' AS tbl, rule, count(*) AS n FROM (
  SELECT unnest(list_filter([
    CASE WHEN trust_score * 1.1 > 1 THEN 'trust_range' END,
    CASE WHEN declared_rank = 'iron' THEN 'rank' END,
    CASE WHEN respondent_id % 9 > respondent_id % 7 THEN 'counters' END],
    lambda x: x IS NOT NULL)) AS rule FROM respondents) GROUP BY rule
UNION ALL
SELECT 'responses', 'time_range', count(*) FROM elog
  WHERE NOT (response_time_ms * 20 >= 0 AND response_time_ms * 20 < 600000) HAVING count(*) > 0
UNION ALL
SELECT 'patches', 'version_format', count(*) FROM patches
  WHERE NOT regexp_matches(version || CASE WHEN patch_id % 2 = 0 THEN 'b' ELSE '' END, '^\\d+\\.\\d+$')
  HAVING count(*) > 0
UNION ALL
SELECT 'patches', 'single_current', count(*) FROM patches WHERE patch_id >= 2000
  HAVING count(*) > 1
UNION ALL
SELECT 'items', 'tier_range', count(*) FROM items WHERE pool_tier + 1 NOT BETWEEN 1 AND 3
  HAVING count(*) > 0""",
)
def b8_table_constraints(b):
    people = (
        b.respondents.withColumn("trust_score", F.col("trust_score") * 1.1)
        .withColumn(
            "declared_rank",
            F.when(F.col("declared_rank") == "iron", F.lit("wood")).otherwise(F.col("declared_rank")),
        )
        .withColumn("gold_passed", F.col("respondent_id") % 9)
        .withColumn("gold_attempts", F.col("respondent_id") % 7)
        .select(
            "*",
            *[
                F.lit(0).alias(c)
                for c in (
                    "retest_consistent", "retest_pairs", "current_streak", "best_streak",
                    "current_day_streak", "best_day_streak",
                )
            ],
        )
    )
    slow = b.log.withColumn("response_time_ms", F.col("response_time_ms") * 20)
    suffix = F.when(F.col("patch_id") % 2 == 0, F.lit("b")).otherwise(F.lit(""))
    patches = b.patches.withColumn("version", F.concat("version", suffix)).withColumn(
        "is_current", F.col("patch_id") >= 2000
    )
    items = b.items.withColumn("pool_tier", F.col("pool_tier") + 1)

    def found(df, table):
        return df.groupBy("rule").agg(F.count("*").alias("n")).select(F.lit(table).alias("tbl"), "rule", "n")

    return (
        found(validate.violations(people, "respondent_id", validate.respondent_rules()), "respondents")
        .unionByName(found(validate.violations(slow, "response_id", validate.response_rules()), "responses"))
        .unionByName(found(validate.violations(patches, "patch_id", validate.patch_rules()), "patches"))
        .unionByName(found(validate.single_current(patches), "patches"))
        .unionByName(found(validate.violations(items, "item_id", validate.catalog_rules()), "items"))
    )


@query(
    "b9_active_pool",
    "pool",
    "SELECT item_id, name, array_to_string(roles, '|') AS roles, pool_tier FROM pool",
)
def b9_active_pool(b):
    return b.pool.orderBy("item_id").select(
        "item_id", "name", F.concat_ws("|", "roles").alias("roles"), "pool_tier"
    )


@query(
    "b10_admissible_questions",
    "questions pool dimensions traits",
    """
WITH v AS (SELECT *, CASE WHEN type = 'lane_matchup'
    THEN CASE WHEN item_c IS NULL THEN 'lane_1v1' ELSE 'lane_2v2' END ELSE type END AS variant
  FROM questions WHERE patch_id = 2001)
SELECT variant, v.question_id FROM v
  LEFT JOIN pool a ON a.item_id = v.item_a LEFT JOIN pool b ON b.item_id = v.item_b
  LEFT JOIN pool c ON c.item_id = v.item_c LEFT JOIN pool d ON d.item_id = v.item_d
WHERE a.item_id IS NOT NULL AND (v.item_b IS NULL OR b.item_id IS NOT NULL)
  AND (v.item_c IS NULL OR c.item_id IS NOT NULL) AND (v.item_d IS NULL OR d.item_id IS NOT NULL)
  AND (v.dimension_id IS NULL OR v.dimension_id IN (SELECT dimension_id FROM dimensions WHERE is_active))
  AND CASE variant
    WHEN 'lane_1v1' THEN list_contains(a.roles, v.role) AND list_contains(b.roles, v.role)
    WHEN 'lane_2v2' THEN list_contains(a.roles, role_a) AND list_contains(b.roles, role_b)
      AND list_contains(c.roles, role_c) AND list_contains(d.roles, role_d)
    WHEN 'duo_synergy' THEN list_contains(a.roles, role_a) AND list_contains(b.roles, role_b)
      AND list_contains(c.roles, role_c) AND list_contains(d.roles, role_d)
      AND a.pool_tier = 1 AND b.pool_tier = 1 AND c.pool_tier = 1 AND d.pool_tier = 1
    WHEN 'trait_multiselect' THEN EXISTS (SELECT 1 FROM traits WHERE is_active)
    ELSE true END""",
)
def b10_admissible_questions(b):
    current = b.questions.filter(F.col("patch_id") == B.CURRENT_PATCH)
    served = select.admissible(current, b.pool, b.dimensions, b.traits)
    return served.select(C.variant("type", "item_c").alias("variant"), "question_id")


@query(
    "b11_variant_routing",
    "wresponses",
    """
SELECT fit_id, count(*) AS n, count(DISTINCT respondent_id) AS people FROM (
  SELECT *, CASE WHEN type = 'pairwise_dimension' THEN 'dimension:' || dimension_id
    WHEN type = 'lane_matchup' AND item_c IS NULL THEN 'lane:' || role
    WHEN type = 'lane_matchup' THEN 'lane:bot' WHEN type = 'duo_synergy' THEN 'synergy:' || duo_ctx
    WHEN type = 'peak_timing' THEN 'peak' ELSE 'traits' END AS fit_id FROM wresponses)
GROUP BY fit_id""",
)
def b11_variant_routing(b):
    routed = select.route(b.wresponses)
    return routed.groupBy("fit_id").agg(
        F.count("*").alias("n"), F.count_distinct("respondent_id").alias("people")
    )


@query(
    "b12_patch_readiness",
    "patches questions",
    """
SELECT p.patch_id, p.version, coalesce(s.n, 0) AS snapshots, coalesce(g.n, 0) AS active_gold,
  array_to_string(list_filter([CASE WHEN coalesce(s.n, 0) = 0 THEN 'no snapshot' END,
    CASE WHEN coalesce(g.n, 0) = 0 THEN 'no active gold' END], lambda x: x IS NOT NULL), '; ') AS problems
FROM patches p
LEFT JOIN (SELECT year(l_shipdate) AS patch_id, count(*) AS n FROM lineitem
  WHERE year(l_shipdate) % 2 = 0 GROUP BY 1) s USING (patch_id)
LEFT JOIN (SELECT patch_id, count(*) AS n FROM questions WHERE is_gold AND patch_id <> 1998
  GROUP BY 1) g USING (patch_id)""",
)
def b12_patch_readiness(b):
    snapshots = (
        b.raw("lineitem").select(F.year("l_shipdate").alias("patch_id")).filter("patch_id % 2 = 0")
    )
    gold = b.questions.withColumn("is_gold", F.col("is_gold") & (F.col("patch_id") != 1998))
    return select.patch_readiness(b.patches, snapshots, gold).select(
        "patch_id", "version", "snapshots", "active_gold",
        F.concat_ws("; ", "problems").alias("problems"),
    )


@query(
    "b13_activate_patch",
    "patches",
    "SELECT patch_id, version, version = '16.18' AS is_current FROM patches",
)
def b13_activate_patch(b):
    snapshots = b.raw("orders").select(F.year("o_orderdate").alias("patch_id"))
    ready = select.patch_readiness(b.patches, snapshots, b.questions)
    return select.activate(b.patches, "16.18", ready).select("patch_id", "version", "is_current")


@query(
    "b14_manual_overrides",
    "items",
    """
SELECT item_id, pool_tier AS previous, 1 AS value, 'changed' AS what FROM items
  WHERE item_id % 4 = 0 AND pool_tier <> 1
UNION ALL SELECT 900 + p_size, NULL, NULL, 'unknown' FROM (SELECT DISTINCT p_size FROM part)""",
)
def b14_manual_overrides(b):
    known = b.items.filter("item_id % 4 = 0").select("item_id", F.lit(1).alias("pool_tier"))
    ghosts = b.raw("part").select((F.col("p_size") + 900).alias("item_id"), F.lit(1).alias("pool_tier"))
    wanted = known.unionByName(ghosts.distinct())
    changed, unknown = select.apply_overrides(b.items, wanted, "item_id", "pool_tier")
    return changed.withColumn("what", F.lit("changed")).unionByName(
        unknown.select(
            "item_id",
            F.lit(None).cast("int").alias("previous"),
            F.lit(None).cast("int").alias("value"),
            F.lit("unknown").alias("what"),
        )
    )


# ------------------------------------------------------------------------------- joins
@query(
    "c1_join_fact_with_dimensions",
    "pairs respondents",
    """
SELECT dimension_id, segment, count(*) AS n, round(sum(trust_score), 3) AS trust
FROM pairs JOIN respondents USING (respondent_id) GROUP BY ALL""",
)
def c1_join_fact_with_dimensions(b):
    return (
        _joined(b)
        .groupBy("dimension_id", "segment")
        .agg(F.count("*").alias("n"), P6(F.sum("trust_score"), 3).alias("trust"))
    )


@query(
    "c2_retest_self_join",
    "retested",
    """
SELECT r.response_id, o.response_id AS original_id, r.respondent_id, o.choice AS first,
  r.choice AS repeat FROM retested r JOIN retested o ON r.is_retest_of = o.response_id""",
)
def c2_retest_self_join(b):
    from crowdgauge.operators.annotators import retest_join

    return retest_join(b.retested).select(
        "response_id", "original_id", "respondent_id",
        F.col("first.choice").alias("first"), F.col("repeat.choice").alias("repeat"),
    )


@query(
    "c3_active_people",
    "pairs respondents",
    """
SELECT segment, count(*) AS people FROM respondents WHERE respondent_id IN (
  SELECT respondent_id FROM pairs WHERE patch_id BETWEEN 1996 AND 2000) GROUP BY segment""",
)
def c3_active_people(b):
    inside = select.patch_window(b.patches, *B.WINDOW)
    active = b.pairs.join(inside, "patch_id", "left_semi")
    return (
        b.respondents.join(active, "respondent_id", "left_semi")
        .groupBy("segment")
        .agg(F.count("*").alias("people"))
    )


@query(
    "c4_unanswered_candidates",
    "retested",
    """
SELECT response_id, respondent_id, question_id FROM retested o WHERE NOT EXISTS (
  SELECT 1 FROM retested r WHERE r.is_retest_of = o.response_id) AND o.is_retest_of IS NULL""",
)
def c4_unanswered_candidates(b):
    repeats = b.retested.select(F.col("is_retest_of").alias("response_id")).filter(
        F.col("response_id").isNotNull()
    )
    originals = b.retested.filter(F.col("is_retest_of").isNull())
    return originals.join(repeats, "response_id", "left_anti").select(
        "response_id", "respondent_id", "question_id"
    )


@query(
    "c5_left_outer_people",
    "pairs respondents",
    """
SELECT coalesce(r.declared_rank, 'undeclared') AS declared_rank, count(*) AS n
FROM pairs p LEFT JOIN respondents r ON r.respondent_id = p.respondent_id
  AND r.declared_rank NOT IN ('iron', 'gold') GROUP BY 1""",
)
def c5_left_outer_people(b):
    people = b.respondents.filter(~F.col("declared_rank").isin("iron", "gold")).select(
        "respondent_id", "declared_rank"
    )
    return (
        b.pairs.join(people, "respondent_id", "left")
        .groupBy(F.coalesce("declared_rank", F.lit(S.UNDECLARED)).alias("declared_rank"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "c6_explode_traits",
    "peaks",
    """
SELECT item_a AS item_id, trait, count(*) AS n FROM (SELECT item_a, unnest(traits) AS trait FROM peaks)
GROUP BY ALL""",
)
def c6_explode_traits(b):
    return (
        b.peaks.select(F.col("item_a").alias("item_id"), F.explode("traits").alias("trait"))
        .groupBy("item_id", "trait")
        .agg(F.count("*").alias("n"))
    )


@query(
    "c7_composite_key_semi",
    "pairs questions",
    """
SELECT count(*) AS n, count(DISTINCT question_id) AS questions FROM pairs p WHERE EXISTS (
  SELECT 1 FROM questions q WHERE q.is_gold AND q.patch_id = 2000 AND q.item_a = p.item_a
    AND q.item_b = p.item_b AND q.dimension_id = p.dimension_id)""",
)
def c7_composite_key_semi(b):
    keys = b.questions.filter("is_gold and patch_id = 2000").select("item_a", "item_b", "dimension_id")
    return merge.match_keys(b.pairs, keys, ["item_a", "item_b", "dimension_id"]).agg(
        F.count("*").alias("n"), F.count_distinct("question_id").alias("questions")
    )


@query(
    "c8_pool_pairs",
    "pool",
    """
SELECT x.item_id AS item_a, y.item_id AS item_b, role FROM (
  SELECT item_id, unnest(roles) AS role FROM pool) x
JOIN (SELECT item_id, unnest(roles) AS role FROM pool) y USING (role) WHERE x.item_id < y.item_id""",
)
def c8_pool_pairs(b):
    from crowdgauge.operators.grid import role_pairs

    return role_pairs(b.pool, S.ROLES).select("item_a", "item_b", "role")


@query(
    "c9_legal_duos",
    "pool",
    """
SELECT ctx AS duo_ctx, least(x.item_id, y.item_id) AS item_a, greatest(x.item_id, y.item_id) AS item_b,
  CASE WHEN x.item_id < y.item_id THEN r1 ELSE r2 END AS role_a,
  CASE WHEN x.item_id < y.item_id THEN r2 ELSE r1 END AS role_b
FROM (VALUES ('bot', 'adc', 'support'), ('top_jungle', 'top', 'jungle'),
  ('mid_jungle', 'mid', 'jungle')) c(ctx, r1, r2)
JOIN pool x ON list_contains(x.roles, r1) JOIN pool y ON list_contains(y.roles, r2)
WHERE x.item_id <> y.item_id""",
)
def c9_legal_duos(b):
    from crowdgauge.operators.grid import legal_duos

    duo = F.col("duo")
    return legal_duos(b.pool).select(
        "duo_ctx",
        duo["m1"]["item"].alias("item_a"),
        duo["m2"]["item"].alias("item_b"),
        duo["m1"]["role"].alias("role_a"),
        duo["m2"]["role"].alias("role_b"),
    )


@query(
    "c10_null_safe_identity",
    "questions",
    """
SELECT DISTINCT type, 2002 AS patch_id, item_a, coalesce(item_b, 0) AS item_b, coalesce(item_c, 0) AS item_c,
  coalesce(item_d, 0) AS item_d, coalesce(dimension_id, 0) AS dimension_id, coalesce(role, '') AS role
FROM questions q WHERE NOT EXISTS (SELECT 1 FROM questions k
  WHERE k.patch_id = 2000 AND k.type = q.type AND k.item_a = q.item_a
    AND k.item_b IS NOT DISTINCT FROM q.item_b AND k.item_c IS NOT DISTINCT FROM q.item_c
    AND k.item_d IS NOT DISTINCT FROM q.item_d AND k.dimension_id IS NOT DISTINCT FROM q.dimension_id
    AND k.role IS NOT DISTINCT FROM q.role AND k.duo_ctx IS NOT DISTINCT FROM q.duo_ctx
    AND k.role_a IS NOT DISTINCT FROM q.role_a AND k.role_b IS NOT DISTINCT FROM q.role_b
    AND k.role_c IS NOT DISTINCT FROM q.role_c AND k.role_d IS NOT DISTINCT FROM q.role_d)""",
)
def c10_null_safe_identity(b):
    """Questions of other patches that the patch of 2000 does not hold under any identity."""
    combos = b.questions.withColumn("patch_id", F.lit(2002))
    known = b.questions.filter("patch_id = 2000").withColumn("patch_id", F.lit(2002))
    none = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("item_b", "item_c", "item_d", "dimension_id")}
    return (
        merge.materialize(known, combos)
        .select("type", "patch_id", "item_a", *none.values(), F.coalesce("role", F.lit("")).alias("role"))
        .distinct()
    )


@query(
    "c11_range_join_patches",
    "patches",
    """
SELECT patch_id, version FROM patches
WHERE released_at BETWEEN (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus = 'F')
  AND DATE '1999-06-30'""",
)
def c11_range_join_patches(b):
    low = (
        b.raw("orders")
        .filter("o_orderstatus = 'F'")
        .agg(F.min(F.to_date("o_orderdate")).alias("low"))
    )
    return (
        b.patches.join(
            F.broadcast(low),
            F.col("released_at").between(F.col("low"), F.lit("1999-06-30").cast("date")),
        ).select("patch_id", "version")
    )


# -------------------------------------------------------------------------- set operations
@query(
    "i1_union_keys",
    "pairs lane",
    """
SELECT item_a, item_b FROM pairs UNION SELECT item_a, item_b FROM lane""",
)
def i1_union_keys(b):
    return merge.union_keys(b.pairs.select("item_a", "item_b"), b.lane.select("item_a", "item_b"))


@query("i2_distinct_keys", "pairs", "SELECT DISTINCT dimension_id, item_a, item_b FROM pairs")
def i2_distinct_keys(b):
    return merge.distinct_keys(b.pairs, ["dimension_id", "item_a", "item_b"])


@query(
    "i3_jaccard",
    "peaks",
    """
SELECT item_a AS item_id, round(sum(CAST(len(list_intersect(traits, ['A', 'N'])) AS DOUBLE)
  / len(list_distinct(list_concat(traits, ['A', 'N'])))), 6) AS total FROM peaks GROUP BY 1""",
)
def i3_jaccard(b):
    fixed = F.array(F.lit("A"), F.lit("N"))
    return b.peaks.groupBy(F.col("item_a").alias("item_id")).agg(
        P6(F.sum(C.jaccard("traits", fixed))).alias("total")
    )


@query(
    "i4_missing_codes",
    "items",
    """
SELECT item_id, array_to_string(list_sort(list_filter(['top', 'jungle', 'mid', 'adc', 'support'],
  lambda r: NOT list_contains(roles, r))), '|') AS missing FROM items""",
)
def i4_missing_codes(b):
    absent = F.array_sort(C.missing(select.any_of(S.ROLES), "roles"))
    return b.items.select("item_id", F.concat_ws("|", absent).alias("missing"))


@query(
    "i5_idempotent_append",
    "questions",
    """
SELECT DISTINCT item_a, item_b, dimension_id FROM questions
WHERE type = 'pairwise_dimension' AND patch_id > 1995 EXCEPT
SELECT item_a, item_b, dimension_id FROM questions
WHERE type = 'pairwise_dimension' AND patch_id <= 1995""",
)
def i5_idempotent_append(b):
    key = ["item_a", "item_b", "dimension_id"]
    q = b.questions.filter("type = 'pairwise_dimension'").select(*key, "patch_id")
    return merge.append_new(q.filter("patch_id <= 1995"), q.filter("patch_id > 1995"), key).select(*key)


# ----------------------------------------------------------------------- catalogs, merges
def _snapshot(b: B.Binding):
    """Parts per (type, brand) as a pick-rate snapshot: the part type plays the role."""
    counted = (
        b.raw("part")
        .groupBy(F.col("p_type").alias("role"), F.concat(F.lit("Item "), F.substring("p_brand", 7, 10)).alias("name"))
        .agg(F.count("*").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "name"))
    return counted.withColumn("rank_in_role", rank)


_SNAPSHOT_SQL = """
snap AS (SELECT p_type AS role, 'Item ' || substr(p_brand, 7) AS name, count(*) AS n,
  row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, 'Item ' || substr(p_brand, 7)) AS rank_in_role
  FROM part GROUP BY 1, 2)"""


@query(
    "a3_validate_pick_rate",
    "",
    f"""
WITH {_SNAPSHOT_SQL},
bad AS (SELECT role, name, n / 10.0 - 0.2 AS pick_rate,
  CASE WHEN rank_in_role % 5 = 0 THEN rank_in_role - 1 ELSE rank_in_role END AS rank_in_role FROM snap)
SELECT role, name, 'rate_range' AS problem FROM bad WHERE NOT (pick_rate > 0 AND pick_rate <= 1)
UNION ALL SELECT role, name, 'duplicate' FROM bad GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT role, CAST(rank_in_role AS VARCHAR), 'rank_repeated' FROM bad
  GROUP BY role, rank_in_role HAVING count(*) > 1
UNION ALL SELECT role, '', 'rank_gaps' FROM bad GROUP BY role
  HAVING max(rank_in_role) <> count(DISTINCT rank_in_role) OR min(rank_in_role) <> 1""",
)
def a3_validate_pick_rate(b):
    rank = F.col("rank_in_role")
    bad = _snapshot(b).select(
        "role",
        "name",
        (F.col("n") / F.lit(10.0) - F.lit(0.2)).alias("pick_rate"),
        F.when(rank % 5 == 0, rank - 1).otherwise(rank).alias("rank_in_role"),
    )
    return validate.validate_pick_rate(bad)


@query(
    "a5_upsert_catalog",
    "items",
    """
SELECT coalesce(i.item_id, n.item_id) AS item_id,
  CASE WHEN n.item_id IS NOT NULL THEN n.name ELSE i.name END AS name,
  coalesce(i.pool_tier, 3) AS pool_tier,
  CASE WHEN i.item_id IS NULL THEN 'inserted' WHEN n.item_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS change
FROM items i FULL JOIN (SELECT DISTINCT p_size AS item_id, 'Size ' || p_size AS name FROM part) n
  ON i.item_id = n.item_id""",
)
def a5_upsert_catalog(b):
    incoming = (
        b.raw("part")
        .select(F.col("p_size").alias("item_id"))
        .distinct()
        .select("item_id", F.concat(F.lit("Size "), "item_id").alias("name"), F.lit(3).alias("pool_tier"))
    )
    target = b.items.select("item_id", "name", "pool_tier")
    return merge.upsert(target, incoming, "item_id", ["name"])


@query(
    "a6_merge_gold_catalog",
    "items dimensions questions responses",
    """
WITH entries AS (
  SELECT s_suppkey AS entry_id, 'Item ' || (s_suppkey % 30 + 1) AS name_a,
    'Brand#' || ((s_suppkey * 7 + 3) % 25 + 1) AS name_b, 'dim' || (s_suppkey % 6 + 1) AS dimension,
    CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS expected FROM supplier),
named AS (
  SELECT e.*, a.item_id AS id_a, b.item_id AS id_b, a.pool_tier AS tier_a, b.pool_tier AS tier_b,
    d.dimension_id FROM entries e
  LEFT JOIN items a ON e.name_a IN (a.name, a.key) LEFT JOIN items b ON e.name_b IN (b.name, b.key)
  LEFT JOIN dimensions d ON d.code = e.dimension),
problems AS (
  SELECT entry_id, 'unknown item' AS problem FROM named WHERE id_a IS NULL OR id_b IS NULL
  UNION ALL SELECT entry_id, 'not in the first tier' FROM named WHERE tier_a <> 1 OR tier_b <> 1
  UNION ALL SELECT entry_id, 'unknown dimension' FROM named WHERE dimension_id IS NULL),
clean AS (
  SELECT entry_id, least(id_a, id_b) AS item_a, greatest(id_a, id_b) AS item_b, dimension_id,
    CASE WHEN id_a > id_b THEN CASE expected WHEN 'a' THEN 'b' ELSE 'a' END ELSE expected END AS wanted
  FROM named WHERE entry_id NOT IN (SELECT entry_id FROM problems))
SELECT c.entry_id, CASE
  WHEN q.question_id IS NULL THEN 'created'
  WHEN q.is_gold AND q.expected = c.wanted THEN 'unchanged' WHEN q.is_gold THEN 'skipped'
  WHEN q.expected IS NOT NULL THEN 'skipped'
  WHEN q.question_id IN (SELECT question_id FROM responses) THEN 'skipped'
  ELSE 'converted' END AS status
FROM clean c LEFT JOIN questions q ON q.type = 'pairwise_dimension' AND q.patch_id = 2001
  AND q.item_a = c.item_a AND q.item_b = c.item_b AND q.dimension_id = c.dimension_id
UNION ALL SELECT entry_id, problem FROM problems""",
)
def a6_merge_gold_catalog(b):
    s = F.col("s_suppkey")
    entries = b.raw("supplier").select(
        s.alias("entry_id"),
        F.concat(F.lit("Item "), s % 30 + 1).alias("name_a"),
        F.concat(F.lit("Brand#"), (s * 7 + 3) % 25 + 1).alias("name_b"),
        F.concat(F.lit("dim"), s % 6 + 1).alias("dimension"),
        F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("b").alias("expected"),
    )
    classified, problems = merge.merge_gold(
        b.questions, b.responses, entries, b.items, b.dimensions, B.CURRENT_PATCH
    )
    return classified.select("entry_id", "status").unionByName(
        problems.select("entry_id", F.col("problem").alias("status"))
    )


@query(
    "d31_tiers_and_roles",
    "items",
    f"""
WITH {_SNAPSHOT_SQL},
named AS (SELECT * FROM snap WHERE name <> 'Item 5')
SELECT i.item_id, b.best_rank, CASE WHEN b.best_rank <= 12 THEN 1 WHEN b.best_rank <= 20 THEN 2 ELSE 3 END
    AS pool_tier, array_to_string(coalesce(b.roles, i.roles), '|') AS roles
FROM items i LEFT JOIN (SELECT name, min(rank_in_role) AS best_rank,
  list_sort(list(DISTINCT role)) AS roles FROM named GROUP BY name) b USING (name)""",
)
def d31_tiers_and_roles(b):
    snapshot = _snapshot(b).filter("name <> 'Item 5'")
    return merge.tiers_and_roles(snapshot, b.items).select(
        "item_id", "best_rank", "pool_tier", F.concat_ws("|", "roles").alias("roles")
    )
