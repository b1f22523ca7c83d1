"""Question statistics, consensus and coverage (D13-D30, D32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdgauge.functions import columns as C
from crowdgauge.operators import grid, select
from crowdgauge.operators import question_stats as Q
from crowdgauge.plans.registry import query
from crowdgauge.runtime import pin
from crowdgauge.sources import binding as B

P = C.plain
THRESHOLD = 5

_COUNTS = """
counts AS (
  SELECT question_id, type, CASE type WHEN 'peak_timing' THEN CAST(minute AS VARCHAR) ELSE choice END AS key,
    count(*) AS n FROM responses WHERE is_retest_of IS NULL AND type <> 'trait_multiselect' GROUP BY ALL
  UNION ALL
  SELECT question_id, type, key, count(*) AS n FROM (SELECT question_id, type,
    unnest(list_concat(traits, ['_total'])) AS key FROM responses
    WHERE is_retest_of IS NULL AND type = 'trait_multiselect') GROUP BY ALL)"""

_TOP = f"""
top AS (SELECT question_id, min_by(key, (-n, key)) AS majority, CAST(sum(n) AS BIGINT) AS sample_size FROM counts
  WHERE type NOT IN ('peak_timing', 'trait_multiselect') AND key <> 'unknown' GROUP BY 1
  HAVING sum(n) >= {THRESHOLD}),
topall AS (SELECT question_id, min_by(key, (-n, key)) AS majority, CAST(sum(n) AS BIGINT) AS sample_size FROM counts
  WHERE type NOT IN ('peak_timing', 'trait_multiselect') GROUP BY 1 HAVING sum(n) >= {THRESHOLD})"""


def _counts(b):
    return Q.answer_counts(b.responses)


@query(
    "d13_answer_histogram",
    "responses",
    f"WITH {_COUNTS} SELECT question_id, type, key, n FROM counts",
)
def d13_answer_histogram(b):
    return _counts(b)


@query(
    "d14_exposure",
    "responses",
    f"""
WITH {_COUNTS} SELECT question_id, CAST(sum(n) AS BIGINT) AS exposure FROM counts
WHERE type <> 'trait_multiselect' OR key = '_total' GROUP BY 1""",
)
def d14_exposure(b):
    return _counts(b).groupBy("question_id").agg(Q.exposure_sum().alias("exposure"))


_H = "(CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0 END)"


def _h(p: str) -> str:
    return _H.format(p=f"({p})")


_F4 = "CAST(printf('%.4f', least(1.0, greatest(0.0, {x}))) AS DOUBLE)"


def _f4(x: str) -> str:
    return _F4.format(x=x)


def _entropy(b, kind):
    stats = Q.entropies(_counts(b).filter(F.col("type") == kind), b.traits)
    return stats.select("question_id", F.col("entropy").cast("double").alias("entropy"))


@query(
    "d15_entropy_binary",
    "responses",
    f"""
WITH {_COUNTS}, t AS (SELECT question_id, CAST(coalesce(sum(n) FILTER (key = 'a'), 0) AS DOUBLE) AS a,
  CAST(coalesce(sum(n) FILTER (key = 'b'), 0) AS DOUBLE) AS b FROM counts
  WHERE type = 'pairwise_dimension' GROUP BY 1)
SELECT question_id, CASE WHEN a + b > 0 THEN {_f4(_h("a / (a + b)") + " + " + _h("1 - a / (a + b)"))} END
  AS entropy FROM t""",
)
def d15_entropy_binary(b):
    return _entropy(b, "pairwise_dimension")


@query(
    "d16_entropy_ternary",
    "responses",
    f"""
WITH {_COUNTS}, t AS (SELECT question_id, type,
  CAST(coalesce(sum(n) FILTER (key IN ('a_strong', 'a_slight', 'pair_1')), 0) AS DOUBLE) AS x,
  CAST(coalesce(sum(n) FILTER (key IN ('even', 'similar')), 0) AS DOUBLE) AS y,
  CAST(coalesce(sum(n) FILTER (key IN ('b_strong', 'b_slight', 'pair_2')), 0) AS DOUBLE) AS z
  FROM counts WHERE type IN ('lane_matchup', 'duo_synergy') GROUP BY 1, 2)
SELECT question_id, CASE WHEN x + y + z > 0 THEN {_f4("(" + " + ".join(_h(f"{v} / (x + y + z)") for v in "xyz") + ") / log2(3)")}
  END AS entropy FROM t""",
)
def d16_entropy_ternary(b):
    return _entropy(b, "lane_matchup").unionByName(_entropy(b, "duo_synergy"))


@query(
    "d17_peak_dispersion",
    "responses",
    f"""
SELECT question_id, CASE WHEN count(*) >= 2 THEN {_f4("least(1, (quantile_cont(CAST(minute AS DOUBLE), 0.75) - quantile_cont(CAST(minute AS DOUBLE), 0.25)) / 12)")}
  END AS entropy FROM responses WHERE type = 'peak_timing' AND is_retest_of IS NULL GROUP BY 1""",
)
def d17_peak_dispersion(b):
    return _entropy(b, "peak_timing")


@query(
    "d18_trait_entropy",
    "responses traits",
    f"""
WITH {_COUNTS}, tot AS (SELECT question_id, CAST(n AS DOUBLE) AS total FROM counts WHERE key = '_total'),
t AS (SELECT question_id, coalesce(n, 0) / total AS p FROM tot CROSS JOIN traits
  LEFT JOIN counts USING (question_id) WHERE counts.key = traits.code
  UNION ALL SELECT question_id, 0 FROM tot CROSS JOIN traits WHERE NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.question_id = tot.question_id AND c.key = traits.code))
SELECT question_id, {_f4("avg(" + _h("p") + " + " + _h("1 - p") + ")")} AS entropy FROM t GROUP BY 1""",
)
def d18_trait_entropy(b):
    return _entropy(b, "trait_multiselect")


@query(
    "d19_median_minute",
    "responses",
    """
SELECT question_id, CAST(floor(quantile_cont(CAST(minute AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median_minute
FROM responses WHERE type = 'peak_timing' AND is_retest_of IS NULL GROUP BY 1""",
)
def d19_median_minute(b):
    stats = Q.entropies(_counts(b).filter("type = 'peak_timing'"), b.traits)
    return stats.select("question_id", "median_minute")


# --------------------------------------------------------------------------------- coverage
_AGG = f"""
agg AS (SELECT s.*, CASE WHEN type = 'lane_matchup' THEN CASE WHEN item_c IS NULL THEN 'lane_1v1'
    ELSE 'lane_2v2' END ELSE type END AS variant
  FROM responses s JOIN respondents r USING (respondent_id)
  WHERE is_retest_of IS NULL AND NOT is_gold AND NOT is_flagged AND trust_score >= 0.3
    AND patch_id = {B.CURRENT_PATCH}),
touch AS (SELECT variant, unnest(list_filter([item_a, item_b, item_c, item_d], lambda x: x IS NOT NULL))
    AS item_id, CASE WHEN variant = 'pairwise_dimension' THEN CAST(dimension_id AS VARCHAR)
    WHEN variant = 'lane_1v1' THEN role WHEN variant IN ('lane_2v2', 'duo_synergy') THEN duo_ctx
    ELSE '' END AS cell FROM agg WHERE type <> 'pairwise_dimension' OR choice IN ('a', 'b')),
cells AS (SELECT variant, item_id, cell, count(*) AS n FROM touch GROUP BY ALL)"""

_LEGAL = """
legal AS (
  SELECT 'pairwise_dimension' AS variant, item_id, CAST(dimension_id AS VARCHAR) AS cell
    FROM pool CROSS JOIN dimensions
  UNION ALL SELECT 'peak_timing', item_id, '' FROM pool
  UNION ALL SELECT 'trait_multiselect', item_id, '' FROM pool
  UNION ALL SELECT 'lane_1v1', item_id, role FROM (SELECT item_id, unnest(roles) AS role FROM pool)
    WHERE role IN ('top', 'mid', 'adc')
  UNION ALL SELECT 'lane_2v2', item_id, 'bot' FROM pool
    WHERE list_contains(roles, 'adc') OR list_contains(roles, 'support')
  UNION ALL SELECT DISTINCT 'duo_synergy', item_id, ctx FROM (VALUES ('bot', 'adc'), ('bot', 'support'),
      ('top_jungle', 'top'), ('top_jungle', 'jungle'), ('mid_jungle', 'mid'), ('mid_jungle', 'jungle')) v(ctx, r)
    JOIN pool ON list_contains(roles, r) AND pool_tier = 1),
med AS (SELECT variant, quantile_cont(CAST(coalesce(n, 0) AS DOUBLE), 0.5) AS median, count(*) AS cells
  FROM legal LEFT JOIN cells USING (variant, item_id, cell) GROUP BY 1)"""


def _current(b):
    joined = b.responses.filter(F.col("patch_id") == B.CURRENT_PATCH).join(
        b.respondents, "respondent_id"
    )
    return select.aggregable(joined, B.MIN_TRUST)


@query(
    "d20_coverage_cells",
    "responses respondents",
    f"WITH {_AGG} SELECT variant, item_id, cell, n FROM cells",
)
def d20_coverage_cells(b):
    return Q.coverage_cells(_current(b))


@query(
    "d21_coverage_medians",
    "responses respondents pool dimensions",
    f"WITH {_AGG}, {_LEGAL} SELECT variant, median, cells FROM med",
)
def d21_coverage_medians(b):
    return Q.coverage_median(Q.coverage_cells(_current(b)), Q.pool_cells(b.pool, b.dimensions))


_DEFICIT = f"""
q AS (SELECT *, CASE WHEN type = 'lane_matchup' THEN CASE WHEN item_c IS NULL THEN 'lane_1v1'
    ELSE 'lane_2v2' END ELSE type END AS variant FROM questions WHERE patch_id = {B.CURRENT_PATCH}),
qc AS (SELECT question_id, variant, unnest(list_filter([item_a, item_b, item_c, item_d],
    lambda x: x IS NOT NULL)) AS item_id, CASE WHEN variant = 'pairwise_dimension'
    THEN CAST(dimension_id AS VARCHAR) WHEN variant = 'lane_1v1' THEN role
    WHEN variant IN ('lane_2v2', 'duo_synergy') THEN duo_ctx ELSE '' END AS cell FROM q),
deficit AS (SELECT question_id, CASE WHEN max(median) > 0 THEN {_f4("max(greatest(0, (median - coalesce(n, 0)) / nullif(median, 0)))")} END
  AS coverage_deficit FROM qc LEFT JOIN cells USING (variant, item_id, cell) LEFT JOIN med USING (variant)
  GROUP BY 1)"""


def _deficit(b):
    cells = pin(Q.coverage_cells(_current(b)))
    medians = Q.coverage_median(cells, Q.pool_cells(b.pool, b.dimensions))
    asked = b.questions.filter(F.col("patch_id") == B.CURRENT_PATCH)
    return Q.coverage_deficit(asked, cells, medians)


@query(
    "d22_coverage_deficit",
    "responses respondents pool dimensions questions",
    f"WITH {_AGG}, {_LEGAL}, {_DEFICIT} SELECT question_id, coverage_deficit FROM deficit",
)
def d22_coverage_deficit(b):
    return _deficit(b).withColumn("coverage_deficit", F.col("coverage_deficit").cast("double"))


@query(
    "d23_question_stats",
    "responses respondents pool dimensions questions",
    f"""
WITH {_AGG}, {_LEGAL}, {_DEFICIT}, {_COUNTS},
e AS (SELECT question_id, CAST(sum(n) FILTER (type <> 'trait_multiselect' OR key = '_total') AS BIGINT) AS exposure,
  string_agg(key || ':' || n, '|' ORDER BY key) AS histogram FROM counts GROUP BY 1)
SELECT question_id, q.type, coalesce(exposure, 0) AS exposure, histogram, coverage_deficit
FROM q LEFT JOIN e USING (question_id) LEFT JOIN deficit USING (question_id)""",
)
def d23_question_stats(b):
    current = F.col("patch_id") == B.CURRENT_PATCH
    stats = Q.question_stats(
        b.responses.filter(current),
        b.questions.filter(current),
        _current(b),
        b.pool,
        b.dimensions,
        b.traits,
    )
    entries = F.transform(
        F.array_sort(F.map_entries("answer_counts")),
        lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")),
    )
    return stats.select(
        "question_id",
        "type",
        F.col("exposure_count").alias("exposure"),
        F.when(F.col("answer_counts").isNotNull(), F.concat_ws("|", entries)).alias("histogram"),
        F.col("coverage_deficit").cast("double").alias("coverage_deficit"),
    )


# -------------------------------------------------------------------------------- consensus
@query(
    "d24_consensus_distribution",
    "responses",
    f"""
WITH {_COUNTS}, {_TOP} SELECT question_id, key, round(CAST(n AS DOUBLE) / sample_size, 6) AS share, majority,
  sample_size FROM counts JOIN topall USING (question_id)""",
)
def d24_consensus_distribution(b):
    return Q.consensus(_counts(b), THRESHOLD).withColumn("share", P("share"))


@query(
    "d25_trait_consensus",
    "responses traits",
    f"""
WITH {_COUNTS}, tot AS (SELECT question_id, n AS total FROM counts WHERE key = '_total' AND n >= {THRESHOLD}),
s AS (SELECT tot.question_id, total, code, coalesce(c.n, 0) / CAST(total AS DOUBLE) AS share
  FROM tot CROSS JOIN traits LEFT JOIN counts c ON c.question_id = tot.question_id AND c.key = code)
SELECT response_id, count(*) FILTER (list_contains(traits, code) = (share > 0.5)) AS agreed,
  count(*) AS compared, max(total) AS sample_size
FROM responses JOIN s USING (question_id) GROUP BY 1""",
)
def d25_trait_consensus(b):
    counts = _counts(b)
    return Q.trait_consensus(b.responses, Q.as_map(counts), b.traits, THRESHOLD)


@query(
    "d26_ranking_agreement",
    "responses",
    f"""
WITH {_COUNTS}, {_TOP} SELECT ranking_id, count(*) FILTER (choice = majority) AS agreed, count(*) AS compared,
  CAST(sum(sample_size) AS BIGINT) AS sample_size FROM responses JOIN top USING (question_id)
WHERE ranking_id IS NOT NULL AND choice <> 'unknown' GROUP BY 1""",
)
def d26_ranking_agreement(b):
    return Q.ranking_agreement(b.responses, _counts(b), THRESHOLD)


@query(
    "d27_agreement_rate",
    "responses respondents",
    f"""
WITH {_COUNTS}, {_TOP}, r AS (SELECT respondent_id, avg(CASE WHEN choice = majority THEN 1.0::DOUBLE ELSE 0 END)
  AS rate FROM responses JOIN top USING (question_id) WHERE choice <> 'unknown' GROUP BY 1)
SELECT respondent_id, round(coalesce(rate, 0), 6) AS agreement_rate FROM respondents LEFT JOIN r USING (respondent_id)""",
)
def d27_agreement_rate(b):
    rate = Q.agreement_rate(b.responses, _counts(b), b.respondents, THRESHOLD)
    return rate.withColumn("agreement_rate", P("agreement_rate"))


@query(
    "d28_type_coverage",
    "responses rankings respondents",
    """
WITH h AS (SELECT s.respondent_id, type FROM responses s LEFT JOIN rankings k USING (ranking_id)
  WHERE s.ranking_id IS NULL OR question_id = anchor_question_id)
SELECT r.respondent_id, count(type) FILTER (type = 'pairwise_dimension') AS pairwise_dimension,
  count(type) FILTER (type = 'peak_timing') AS peak_timing,
  count(type) FILTER (type = 'lane_matchup') AS lane_matchup,
  count(type) FILTER (type = 'duo_synergy') AS duo_synergy,
  count(type) FILTER (type = 'trait_multiselect') AS trait_multiselect
FROM respondents r LEFT JOIN h USING (respondent_id) GROUP BY 1""",
)
def d28_type_coverage(b):
    return Q.type_coverage(select.heads(b.responses, b.rankings), b.respondents)


@query(
    "d29_coverage_matrix",
    "responses respondents pool",
    f"""
WITH {_AGG}, c AS (SELECT p.item_id, p.name, {", ".join(f"CAST(coalesce(sum(n) FILTER (cell = '{d}' AND variant = 'pairwise_dimension'), 0) AS BIGINT) AS \"{d}\"" for d in range(1, 6))}
  FROM pool p LEFT JOIN cells USING (item_id) GROUP BY 1, 2)
SELECT *, least("1", "2", "3", "4", "5") AS min FROM c""",
)
def d29_coverage_matrix(b):
    return Q.coverage_matrix(_current(b), b.pool, [1, 2, 3, 4, 5])


@query(
    "d32_duo_space_size",
    "pool",
    """
WITH seats AS (SELECT ctx, list_contains(roles, r1) AS f, list_contains(roles, r2) AS s, item_id
  FROM (VALUES ('bot', 'adc', 'support'), ('top_jungle', 'top', 'jungle'), ('mid_jungle', 'mid', 'jungle')) c(ctx, r1, r2)
  CROSS JOIN pool),
duos AS (SELECT x.ctx, x.item_id AS a, y.item_id AS b, row_number() OVER () AS id FROM seats x JOIN seats y
  ON x.ctx = y.ctx AND x.f AND y.s AND x.item_id <> y.item_id)
SELECT d.ctx AS duo_ctx, (SELECT count(*) FROM duos k WHERE k.ctx = d.ctx) AS duos, count(*) AS disjoint_pairs
FROM duos d JOIN duos e ON d.ctx = e.ctx AND d.id < e.id AND d.a NOT IN (e.a, e.b) AND d.b NOT IN (e.a, e.b)
GROUP BY 1""",
)
def d32_duo_space_size(b):
    return grid.duo_space_size(b.pool)
