"""Agreement, segments, report tables and graphs (D30, D44-D48, G, E10, E11, E13, E14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdgauge.functions import columns as C
from crowdgauge.operators import agreement as AG
from crowdgauge.operators import annotators as A
from crowdgauge.operators import estimate, graph, paired, resample
from crowdgauge.operators import question_stats as Q
from crowdgauge.operators import report as R
from crowdgauge.plans.estimation import _MEDIAN_SQL, _TRAITS_SQL
from crowdgauge.plans.models import ATTEMPTS, REPS, SEED, admissible_sql
from crowdgauge.plans.people import _SEGMENT, _GOLD, _RC, _RETEST
from crowdgauge.plans.questions import _AGG, _current
from crowdgauge.plans.registry import ORACLES, query
from crowdgauge.runtime import pin
from crowdgauge.sources import binding as B

P = C.plain

# -------------------------------------------------------------------------------- agreement
_DUO_UNIT = """item_a || ':' || role_a || '|' || item_b || ':' || role_b || ' v '
  || item_c || ':' || role_c || '|' || item_d || ':' || role_d"""

_UNITS = f"""
units AS (
  SELECT 'score ' || dimension_id AS magnitude, 'nominal' AS scale, item_a || '-' || item_b AS unit,
    CASE choice WHEN 'a' THEN 1 ELSE 0 END AS value FROM wresponses WHERE type = 'pairwise_dimension' AND choice IN ('a', 'b')
  UNION ALL SELECT 'peak_minute', 'interval', CAST(item_a AS VARCHAR), minute FROM wresponses WHERE type = 'peak_timing'
  UNION ALL SELECT 'lane_strength ' || role, 'ordinal', item_a || '-' || item_b,
    list_position(['b_strong', 'b_slight', 'even', 'a_slight', 'a_strong'], choice) - 1
    FROM wresponses WHERE type = 'lane_matchup' AND item_c IS NULL
  UNION ALL SELECT 'duo lane_strength bot', 'ordinal', {_DUO_UNIT},
    list_position(['b_strong', 'b_slight', 'even', 'a_slight', 'a_strong'], choice) - 1
    FROM wresponses WHERE type = 'lane_matchup' AND item_c IS NOT NULL
  UNION ALL SELECT 'synergy ' || duo_ctx, 'nominal', {_DUO_UNIT},
    list_position(['pair_2', 'similar', 'pair_1'], choice) - 1 FROM wresponses WHERE type = 'duo_synergy'
  UNION ALL SELECT 'proportion ' || code, 'nominal', CAST(item_a AS VARCHAR),
    CASE WHEN list_contains(w.traits, code) THEN 1 ELSE 0 END
    FROM wresponses w CROSS JOIN traits WHERE type = 'trait_multiselect')"""

_ALPHA = """
cnt AS (SELECT magnitude, scale, unit, value, CAST(count(*) AS DOUBLE) AS n FROM units GROUP BY ALL),
pr AS (SELECT *, sum(n) OVER (PARTITION BY magnitude, unit) AS m FROM cnt QUALIFY m >= 2),
marg AS (SELECT magnitude, scale, value, sum(n) AS c FROM pr GROUP BY ALL),
dist AS (SELECT x.magnitude, x.value AS v, y.value AS k, x.c AS cv, y.c AS ck, CASE x.scale
    WHEN 'nominal' THEN CASE WHEN x.value = y.value THEN 0 ELSE 1 END
    WHEN 'interval' THEN (x.value - y.value) * (x.value - y.value)
    ELSE pow((SELECT sum(c) FROM marg g WHERE g.magnitude = x.magnitude AND g.value BETWEEN least(x.value, y.value)
      AND greatest(x.value, y.value)) - (x.c + y.c) / 2, 2) END AS d
  FROM marg x JOIN marg y USING (magnitude)),
obs AS (SELECT a.magnitude, sum((a.n * b.n - CASE WHEN a.value = b.value THEN a.n ELSE 0 END) / (a.m - 1) * d) AS o
  FROM pr a JOIN pr b ON a.magnitude = b.magnitude AND a.unit = b.unit
  JOIN dist ON dist.magnitude = a.magnitude AND dist.v = a.value AND dist.k = b.value GROUP BY 1),
ex AS (SELECT magnitude, sum(cv * ck * d) AS e FROM dist GROUP BY 1),
tot AS (SELECT magnitude, scale, sum(n) AS pairable, count(DISTINCT unit) AS units FROM pr GROUP BY 1, 2),
alphas AS (SELECT magnitude, scale, CASE WHEN pairable >= 2 AND e > 0 THEN 1 - (pairable - 1) * o / e END AS alpha,
  CAST(pairable AS BIGINT) AS pairable, units FROM tot JOIN obs USING (magnitude) JOIN ex USING (magnitude))"""


@query(
    "d44_krippendorff_alpha",
    "pairs",
    f"""
WITH units AS (SELECT 'price ' || dimension_id AS magnitude, 'nominal' AS scale, item_a || '-' || item_b AS unit,
  CASE choice WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END AS value FROM pairs), {_ALPHA}
SELECT magnitude, scale, round(alpha, 6) AS alpha, pairable, units FROM alphas""",
)
def d44_krippendorff_alpha(b):
    units = b.pairs.select(
        F.concat(F.lit("price "), "dimension_id").alias("magnitude"),
        F.lit("nominal").alias("scale"),
        F.concat_ws("-", "item_a", "item_b").alias("unit"),
        C.lookup("choice", {"a": 0.0, "b": 1.0, "unknown": 2.0}).alias("value"),
    )
    return AG.alpha(units).withColumn("alpha", P("alpha"))


@query(
    "d45_oriented_agreement",
    "wresponses traits",
    f"""
WITH {_UNITS}, {_ALPHA}
SELECT magnitude, scale, round(alpha, 6) AS alpha, pairable, units, CASE WHEN alpha IS NULL THEN 'not calculable'
  WHEN alpha >= 0.8 THEN 'reliable' WHEN alpha >= 0.667 THEN 'tentative' ELSE 'unreliable' END AS reading FROM alphas""",
)
def d45_oriented_agreement(b):
    return AG.agreement(b.wresponses, b.traits).withColumn("alpha", P("alpha"))


_SEG = f"""
seg AS (SELECT *, 'rank' AS variable, {_SEGMENT} AS segment FROM wpairs WHERE choice IN ('a', 'b')
  UNION ALL SELECT *, 'hours', coalesce(declared_hours_bucket, 'undeclared') FROM wpairs WHERE choice IN ('a', 'b'))"""


@query(
    "d46_segment_floors",
    "wpairs",
    f"""
WITH {_SEG} SELECT variable, dimension_id, segment, count(DISTINCT respondent_id) AS respondents, count(*) AS comparisons,
  count(DISTINCT respondent_id) >= 3 AND count(*) >= 30 AS calculable FROM seg GROUP BY 1, 2, 3""",
)
def d46_segment_floors(b):
    return R.segment_sizes(b.wpairs, 3, 30)


_SHARES = f"""
{_SEG}, won AS (SELECT dimension_id, segment, unnest([item_a, item_b]) AS item_id, unnest([choice = 'a', choice = 'b']) AS win, weight
  FROM seg WHERE variable = 'rank'),
est AS (SELECT dimension_id, segment, item_id, sum(CASE WHEN win THEN weight ELSE 0 END) / sum(weight) AS value,
  CASE WHEN count(*) >= 25 THEN 'solid' WHEN count(*) >= 10 THEN 'limited' ELSE 'insufficient' END AS support FROM won GROUP BY 1, 2, 3),
cmp AS (SELECT x.dimension_id, x.segment AS first, y.segment AS second, round(x.value, 9) AS x, round(y.value, 9) AS y, x.support AS sx, y.support AS sy
  FROM est x JOIN est y USING (dimension_id, item_id)
  WHERE list_position(['low', 'mid', 'high', 'unranked', 'undeclared'], x.segment)
    < list_position(['low', 'mid', 'high', 'unranked', 'undeclared'], y.segment)),
rk AS (SELECT *, rank() OVER (PARTITION BY dimension_id, first, second ORDER BY x)
    + (count(*) OVER (PARTITION BY dimension_id, first, second, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY dimension_id, first, second ORDER BY y)
    + (count(*) OVER (PARTITION BY dimension_id, first, second, y) - 1) / 2.0 AS ry FROM cmp),
res AS (SELECT dimension_id, first, second, count(*) AS common, avg(abs(x - y)) AS mean_abs_diff,
  count(*) FILTER (sx <> sy) AS support_changes, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho FROM rk GROUP BY 1, 2, 3)"""


def _shares(b):
    """Weighted win shares per rank segment, the estimate the comparison is shown on."""
    sides = F.array(
        F.struct(F.col("item_a").alias("item_id"), (F.col("choice") == "a").alias("win")),
        F.struct(F.col("item_b").alias("item_id"), (F.col("choice") == "b").alias("win")),
    )
    return (
        R.segment_labels(estimate.decisive(b.wpairs))
        .filter("variable = 'rank'")
        .select("dimension_id", "segment", "weight", F.explode(sides).alias("s"))
        .groupBy("dimension_id", "segment", F.col("s.item_id").alias("item_id"))
        .agg(
            P(F.sum(F.when(F.col("s.win"), F.col("weight")).otherwise(0.0)) / F.sum("weight"), 9).alias("value"),
            F.count("*").alias("n"),
        )
        .withColumn(
            "support",
            F.when(F.col("n") >= 25, "solid").when(F.col("n") >= 10, "limited").otherwise("insufficient"),
        )
    )


@query(
    "d47_segment_comparison",
    "wpairs",
    f"""
WITH {_SHARES} SELECT dimension_id, first, second, common, round(mean_abs_diff, 6) AS mean_abs_diff, support_changes,
  round(rho, 6) AS rho FROM res""",
)
def d47_segment_comparison(b):
    compared = R.compare_segments(_shares(b), "rank")
    return compared.withColumn("mean_abs_diff", P("mean_abs_diff")).withColumn("rho", P("rho"))


@query(
    "d48_segment_trigger",
    "wpairs",
    f"""
WITH {_SHARES} SELECT count(*) AS dimensions, count(*) >= 3 AS finding,
  coalesce(string_agg(CAST(dimension_id AS VARCHAR), ',' ORDER BY dimension_id), '') AS which
FROM res WHERE first = 'low' AND second = 'high' AND rho < 0.7""",
)
def d48_segment_trigger(b):
    return R.segment_trigger(R.compare_segments(_shares(b), "rank"))


# ------------------------------------------------------------------------------ report tables
@query(
    "g1_pair_coverage",
    "wpairs wlane wduos pool",
    """
WITH legal AS (SELECT x.item_id AS item_a, y.item_id AS item_b, role FROM (SELECT item_id, unnest(roles) AS role FROM pool) x
  JOIN (SELECT item_id, unnest(roles) AS role FROM pool) y USING (role) WHERE x.item_id < y.item_id AND role IN ('top', 'mid', 'adc')),
ld AS (SELECT DISTINCT ctx AS duo_ctx, least(x.item_id, y.item_id) AS a, greatest(x.item_id, y.item_id) AS b,
    CASE WHEN x.item_id < y.item_id THEN r1 ELSE r2 END AS ra, CASE WHEN x.item_id < y.item_id THEN r2 ELSE r1 END AS rb
  FROM (VALUES ('bot', 'adc', 'support'), ('top_jungle', 'top', 'jungle'), ('mid_jungle', 'mid', 'jungle')) c(ctx, r1, r2)
  JOIN pool x ON list_contains(x.roles, r1) JOIN pool y ON list_contains(y.roles, r2) WHERE x.item_id <> y.item_id),
sides AS (SELECT duo_ctx, item_a AS a, item_b AS b, role_a AS ra, role_b AS rb FROM wduos
  UNION ALL SELECT duo_ctx, item_c, item_d, role_c, role_d FROM wduos),
c AS (
  SELECT 'score ' || dimension_id AS magnitude, count(*) AS n FROM wpairs WHERE choice IN ('a', 'b')
    AND item_a IN (SELECT item_id FROM pool) AND item_b IN (SELECT item_id FROM pool) GROUP BY dimension_id, item_a, item_b
  UNION ALL SELECT 'lane_strength ' || role, count(*) FROM wlane JOIN legal USING (role, item_a, item_b) GROUP BY role, item_a, item_b
  UNION ALL SELECT 'duo lane_strength bot', count(*) FROM sides JOIN ld USING (duo_ctx, a, b, ra, rb) WHERE duo_ctx = 'bot' GROUP BY a, b, ra, rb
  UNION ALL SELECT 'synergy ' || duo_ctx, count(*) FROM sides JOIN ld USING (duo_ctx, a, b, ra, rb) GROUP BY duo_ctx, a, b, ra, rb),
poss AS (
  SELECT DISTINCT 'score ' || dimension_id AS magnitude, (SELECT count(*) * (count(*) - 1) // 2 FROM pool) AS possible FROM wpairs
  UNION ALL SELECT 'lane_strength ' || role, count(*) FROM legal GROUP BY role
  UNION ALL SELECT 'duo lane_strength bot', count(*) FROM ld WHERE duo_ctx = 'bot'
  UNION ALL SELECT 'synergy ' || duo_ctx, count(*) FROM ld GROUP BY duo_ctx)
SELECT magnitude, possible, count(n) AS observed, min(n) AS least, median(CAST(n AS DOUBLE)) AS median, max(n) AS most
FROM poss LEFT JOIN c USING (magnitude) GROUP BY 1, 2""",
)
def g1_pair_coverage(b):
    bot = b.wduos.filter("duo_ctx = 'bot'")
    return R.pair_coverage(b.wpairs, b.wlane, bot, b.wduos, b.pool)


@query(
    "g3_magnitude_summary",
    "wpeaks traits",
    f"""
WITH {_TRAITS_SQL}, l AS (SELECT *, CASE WHEN n >= 20 AND high - low <= 0.25 THEN 'solid'
  WHEN n >= 10 AND high - low <= 0.45 THEN 'limited' ELSE 'insufficient' END AS support FROM est)
SELECT 'proportion ' || trait AS magnitude, count(*) FILTER (support = 'solid') AS solid, count(*) FILTER (support = 'limited') AS limited,
  count(*) FILTER (support = 'insufficient') AS insufficient, round(avg(high - low), 6) AS mean_width FROM l GROUP BY 1""",
)
def g3_magnitude_summary(b):
    est = estimate.proportions(b.wpeaks, b.traits).withColumn(
        "magnitude", F.concat(F.lit("proportion "), "trait")
    )
    return R.magnitude_summary(est).withColumn("mean_width", P("mean_width"))


@query(
    "g4_concentration",
    "wpairs",
    """
WITH c AS (SELECT respondent_id, count(*) AS k FROM wpairs GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY k DESC) AS rn, CAST(ceil((SELECT count(*) FROM c) / 10.0) AS BIGINT) AS top FROM c)
SELECT count(*) AS respondents, max(top) AS top, CAST(sum(k) AS BIGINT) AS rows,
  CAST(sum(k) FILTER (rn <= top) AS BIGINT) AS top_rows, round(sum(k) FILTER (rn <= top) / CAST(sum(k) AS DOUBLE), 6) AS index,
  sum(k) FILTER (rn <= top) / CAST(sum(k) AS DOUBLE) > 0.4 AS flagged FROM r""",
)
def g4_concentration(b):
    return R.concentration(b.wpairs).withColumn("index", P("index"))


@query(
    "g5_sample_composition",
    "wpairs",
    """
WITH listed AS (
  SELECT 'declared_rank' AS variable, unnest(['iron', 'bronze', 'silver', 'gold', 'platinum', 'emerald', 'diamond', 'master',
    'grandmaster', 'challenger', 'unranked', '']) AS value
  UNION ALL SELECT 'declared_main_role', unnest(['top', 'jungle', 'mid', 'adc', 'support', ''])
  UNION ALL SELECT 'declared_hours_bucket', unnest(['<5', '5-15', '15-30', '30+', ''])),
said AS (SELECT respondent_id, unnest(['declared_rank', 'declared_main_role', 'declared_hours_bucket']) AS variable,
  unnest([coalesce(declared_rank, ''), coalesce(declared_main_role, ''), coalesce(declared_hours_bucket, '')]) AS value FROM wpairs)
SELECT variable, value, count(DISTINCT respondent_id) AS respondents, count(respondent_id) AS responses
FROM listed LEFT JOIN said USING (variable, value) GROUP BY 1, 2""",
)
def g5_sample_composition(b):
    return R.sample_tables(b.wpairs)


@query(
    "g6_role_coverage",
    "wlane wduos",
    """
SELECT 'lane_strength ' || role AS magnitude, count(*) AS responses, count(*) FILTER (declared_main_role = role) AS mains,
  count(*) FILTER (declared_main_role IS NULL) AS undeclared FROM wlane GROUP BY 1
UNION ALL SELECT 'duo lane_strength bot', count(*), count(*) FILTER (declared_main_role IN ('adc', 'support')),
  count(*) FILTER (declared_main_role IS NULL) FROM wduos WHERE duo_ctx = 'bot' HAVING count(*) > 0""",
)
def g6_role_coverage(b):
    return R.role_coverage(b.wlane, b.wduos.filter("duo_ctx = 'bot'"))


@query(
    "g7_trust_by_hours",
    "respondents",
    """
WITH p AS (SELECT * FROM respondents WHERE NOT is_flagged),
d AS (SELECT list_position(['<5', '5-15', '15-30', '30+'], declared_hours_bucket) AS x, trust_score AS y FROM p WHERE declared_hours_bucket IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)
SELECT coalesce(declared_hours_bucket, '') AS bucket, count(*) AS n,
  """
    + ", ".join(f"round(quantile_cont(trust_score, {i / 4}), 6) AS q{i * 25}" for i in range(5))
    + """, CAST(NULL AS DOUBLE) AS rho FROM p GROUP BY 1
UNION ALL SELECT 'rho', count(*), NULL, NULL, NULL, NULL, NULL, round(corr(rx, ry), 6) FROM r""",
)
def g7_trust_by_hours(b):
    names = [f"q{i * 25}" for i in range(5)]
    none = F.lit(None).cast("double")
    table = R.trust_by_hours(b.respondents).select(
        "bucket", "n", *[P(c).alias(c) for c in names], none.alias("rho")
    )
    rho = R.trust_hours_rho(b.respondents).select(
        F.lit("rho").alias("bucket"), "n", *[none.alias(c) for c in names], P("rho").alias("rho")
    )
    return table.unionByName(rho)


@query(
    "g8_consistency_checks",
    "wpeaks",
    f"""
WITH {_MEDIAN_SQL}, iv AS (SELECT item_a AS item_id, quantile_cont(CAST(minute AS DOUBLE), 0.025) AS low,
  quantile_cont(CAST(minute AS DOUBLE), 0.975) AS high FROM wpeaks GROUP BY 1),
un AS (SELECT item_a AS item_id, trait, count(*) AS n FROM (SELECT item_a, unnest(traits) AS trait FROM wpeaks) GROUP BY 1, 2)
SELECT 'wide_peak' AS rule, item_id, round(high - low, 6) AS value FROM med JOIN iv USING (item_id) WHERE n >= 20 AND high - low > 4
UNION ALL SELECT 'uneven_traits', item_id, CAST(count(DISTINCT n) AS DOUBLE) FROM un GROUP BY item_id HAVING count(DISTINCT n) > 1""",
)
def g8_consistency_checks(b):
    samples = b.wpeaks.select(F.col("item_a").alias("item_id"), F.col("minute").alias("value"))
    peaks = estimate.peak_values(b.wpeaks).join(
        estimate.percentile_interval(samples, ["item_id"]), "item_id"
    )
    marks = (
        b.wpeaks.select(F.col("item_a").alias("item_id"), F.explode("traits").alias("trait"))
        .groupBy("item_id", "trait")
        .agg(F.count("*").alias("n"))
    )
    wide = R.wide_peaks(peaks).select(
        F.lit("wide_peak").alias("rule"), "item_id", P(F.col("high") - F.col("low")).alias("value")
    )
    uneven = R.uneven_traits(marks).select(
        F.lit("uneven_traits").alias("rule"), "item_id", F.col("sizes").cast("double").alias("value")
    )
    return wide.unionByName(uneven)


# -------------------------------------------------------------------------------------- graphs
_PAIRS = """
counted AS (SELECT dimension_id, item_a AS u, item_b AS v, count(*) AS n FROM wpairs WHERE choice IN ('a', 'b')
  AND item_a IN (SELECT item_id FROM pool) AND item_b IN (SELECT item_id FROM pool) GROUP BY ALL)"""
_WALK = """
nodes AS (SELECT dimension_id, item_id AS node FROM dimensions CROSS JOIN pool),
both_ AS (SELECT dimension_id, u, v FROM e UNION SELECT dimension_id, v, u FROM e),
walk AS (SELECT dimension_id, node, node AS seen FROM nodes
  UNION SELECT w.dimension_id, w.node, b.v FROM walk w JOIN both_ b ON b.dimension_id = w.dimension_id AND b.u = w.seen),
comp AS (SELECT dimension_id, node, min(seen) AS label FROM walk GROUP BY 1, 2)"""
_EDGES = f"{_PAIRS}, e AS (SELECT dimension_id, u, v FROM counted), {_WALK}"
def _nodes(b):
    from crowdgauge.operators import select

    nodes = select.with_catalog(b.pool.select("item_id"), b.dimensions, ["dimension_id"])
    return nodes.withColumnRenamed("item_id", "node")


def _whole(b):
    """Edges of all comparisons inside the pool and the pool's nodes, per dimension."""
    return graph.inside(graph.comparison_edges(b.wpairs), b.pool), _nodes(b)


_PATCH_WALK = """
every AS (SELECT dimension_id, patch_id, item_a AS u, item_b AS v FROM wpairs WHERE choice IN ('a', 'b')
  AND item_a IN (SELECT item_id FROM pool) AND item_b IN (SELECT item_id FROM pool) GROUP BY ALL),
nodes AS (SELECT dimension_id, patch_id, item_id AS node FROM (SELECT DISTINCT dimension_id, patch_id FROM wpairs) CROSS JOIN pool),
both_ AS (SELECT dimension_id, patch_id, u, v FROM every UNION SELECT dimension_id, patch_id, v, u FROM every),
walk AS (SELECT dimension_id, patch_id, node, node AS seen FROM nodes
  UNION SELECT w.dimension_id, w.patch_id, w.node, b.v FROM walk w
  JOIN both_ b ON b.dimension_id = w.dimension_id AND b.patch_id = w.patch_id AND b.u = w.seen),
comp AS (SELECT dimension_id, patch_id, node, min(seen) AS label FROM walk GROUP BY ALL)"""
_GRAPH = ["dimension_id", "patch_id"]


def _patches(b):
    """Edges of all comparisons of every dimension and patch inside the pool, and the pool's nodes."""
    from crowdgauge.operators import select

    said = estimate.decisive(b.wpairs).select(*_GRAPH, F.col("item_a").alias("u"), F.col("item_b").alias("v"))
    graphs = b.wpairs.select(*_GRAPH).distinct()
    nodes = select.with_catalog(b.pool.select("item_id"), graphs, _GRAPH).withColumnRenamed("item_id", "node")
    return graph.inside(said.distinct(), b.pool), nodes


def _by_patch(b):
    """Components of all comparisons of every dimension and patch inside the pool."""
    return graph.components(*_patches(b), _GRAPH)


@query(
    "e10_connected_components",
    "wpairs pool",
    f"WITH RECURSIVE {_PATCH_WALK} SELECT dimension_id, patch_id, node, label FROM comp",
)
def e10_connected_components(b):
    return _by_patch(b)


@query(
    "e11_largest_component",
    "wpairs pool",
    f"""
WITH RECURSIVE {_PATCH_WALK}, s AS (SELECT dimension_id, patch_id, label, count(*) AS n FROM comp GROUP BY ALL)
SELECT dimension_id, patch_id, min_by(label, (-n, label)) AS main, max(n) AS largest, count(*) AS components FROM s GROUP BY ALL""",
)
def e11_largest_component(b):
    return graph.largest(_by_patch(b), _GRAPH)


@query(
    "e13_comparison_edges",
    "wpairs",
    "SELECT DISTINCT dimension_id, item_a AS u, item_b AS v FROM wpairs WHERE choice IN ('a', 'b')",
)
def e13_comparison_edges(b):
    return graph.comparison_edges(b.wpairs)


def _marked(b, keys=("dimension_id",)):
    """Marked bridges: one question per pair whose ids add up to a multiple of seven."""
    q = b.questions.filter(
        (F.col("type") == "pairwise_dimension") & ((F.col("item_a") + F.col("item_b")) % 7 == 0)
    )
    marked = q.groupBy(*keys, F.col("item_a").alias("u"), F.col("item_b").alias("v")).agg(
        F.min("question_id").alias("question_id")
    )
    return graph.inside(marked, b.pool)


def _patch_bridges(b):
    """(edges, nodes, marked bridges, gold pairs) of every dimension and patch, named by one column.

    All are as short as the catalogs and read in every round of the plan, so they are kept.
    """

    def named(df):
        return pin(df.withColumn("graph", F.concat_ws("|", *_GRAPH)).drop(*_GRAPH))

    edges, nodes = _patches(b)
    gold = b.questions.filter("is_gold").select(*_GRAPH, "item_a", "item_b").distinct()
    return named(edges), named(nodes), named(_marked(b, _GRAPH)), named(gold)


def _unnamed(df):
    """The frame with its graph's dimension and patch again."""
    part = F.split("graph", r"\|")
    return df.select(
        *[part[i].cast("bigint").alias(k) for i, k in enumerate(_GRAPH)], *[c for c in df.columns if c != "graph"]
    )


@query("e14_bridge_plan")
def e14_bridge_plan(b):
    """Over all comparisons of every dimension and patch."""
    return _unnamed(graph.bridge_plan(*_patch_bridges(b), seed=7, key="graph"))


@query(
    "e14_bridge_effect",
    "wpairs pool questions",
    f"""
WITH RECURSIVE {_PATCH_WALK},
m AS (SELECT dimension_id, patch_id, item_a, item_b, min(question_id) AS question_id FROM questions WHERE type = 'pairwise_dimension'
  AND (item_a + item_b) % 7 = 0 AND item_a IN (SELECT item_id FROM pool) AND item_b IN (SELECT item_id FROM pool) GROUP BY ALL),
x AS (SELECT m.*, cu.label AS lu, cv.label AS lv FROM m
  JOIN comp cu ON cu.dimension_id = m.dimension_id AND cu.patch_id = m.patch_id AND cu.node = m.item_a
  JOIN comp cv ON cv.dimension_id = m.dimension_id AND cv.patch_id = m.patch_id AND cv.node = m.item_b),
hop AS (SELECT question_id, dimension_id, patch_id, lu AS s, lv AS t FROM x WHERE lu <> lv
  UNION ALL SELECT question_id, dimension_id, patch_id, lv, lu FROM x WHERE lu <> lv),
reach AS (SELECT question_id, dimension_id, patch_id, lu AS label FROM x WHERE lu <> lv
  UNION SELECT r.question_id, r.dimension_id, r.patch_id, h.t FROM reach r JOIN hop h
    ON h.dimension_id = r.dimension_id AND h.patch_id = r.patch_id AND h.s = r.label AND h.question_id < r.question_id),
marks AS (SELECT x.*, lu <> lv AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.question_id = x.question_id AND r.label = x.lv) AS stays FROM x),
bridges AS (SELECT dimension_id, patch_id, count(*) FILTER (stays) AS kept, sum(question_id) FILTER (stays) AS kept_ids,
  count(*) FILTER (NOT stays) AS cleared, sum(question_id) FILTER (NOT stays) AS cleared_ids FROM marks GROUP BY ALL),
parts AS (SELECT dimension_id, patch_id, count(DISTINCT label) AS components FROM comp GROUP BY ALL)
SELECT dimension_id, patch_id, components, coalesce(kept, 0) AS kept, CAST(coalesce(kept_ids, 0) AS BIGINT) AS kept_ids, coalesce(cleared, 0) AS cleared,
  CAST(coalesce(cleared_ids, 0) AS BIGINT) AS cleared_ids, components - coalesce(kept, 0) - 1 AS marked, 0 AS gold_marked, 1 AS components_after
FROM parts LEFT JOIN bridges USING (dimension_id, patch_id)""",
)
def e14_bridge_effect(b):
    """What the plan keeps and clears in every graph, and that its new pairs, none of them gold, leave
    one component: as many as components less one, so none is wasted."""
    edges, nodes, marked, gold = _patch_bridges(b)
    labels = pin(graph.components(edges, nodes, ["graph"]))
    plan = pin(graph.bridge_plan(edges, nodes, marked, gold, seed=7, key="graph"))
    said = lambda action, value: F.sum(F.when(F.col("action") == action, value).otherwise(0))
    done = plan.groupBy("graph").agg(
        said("keep", F.lit(1)).alias("kept"),
        said("keep", F.col("question_id")).alias("kept_ids"),
        said("clear", F.lit(1)).alias("cleared"),
        said("clear", F.col("question_id")).alias("cleared_ids"),
        said("mark", F.lit(1)).alias("marked"),
    )
    wrong = plan.filter("action = 'mark'").join(gold, ["graph", "item_a", "item_b"], "left_semi")
    joining = plan.filter("action <> 'clear'").select("graph", F.col("item_a").alias("u"), F.col("item_b").alias("v"))
    parts = labels.groupBy("graph").agg(F.count_distinct("label").alias("components"))
    same = labels.select("graph", F.col("node").alias("u"), F.col("label").alias("v")).filter("u <> v")
    after = graph.components(joining.unionByName(same), nodes, ["graph"])
    found = (
        parts.join(done, "graph", "left")
        .join(wrong.groupBy("graph").agg(F.count("*").alias("gold_marked")), "graph", "left")
        .join(after.groupBy("graph").agg(F.count_distinct("label").alias("components_after")), "graph")
    )
    return _unnamed(found.na.fill(0))


@query(
    "g14_connectivity_report",
    "wpairs pool dimensions questions",
    f"""
WITH RECURSIVE {_EDGES}, s AS (SELECT dimension_id, label, count(*) AS n FROM comp GROUP BY 1, 2),
m AS (SELECT dimension_id, item_a, item_b FROM questions WHERE type = 'pairwise_dimension' AND (item_a + item_b) % 7 = 0
  AND item_a IN (SELECT item_id FROM pool) AND item_b IN (SELECT item_id FROM pool) GROUP BY ALL)
SELECT dimension_id, count(*) AS components, max(n) AS largest,
  (SELECT count(*) FROM m WHERE m.dimension_id = s.dimension_id) AS pending_bridges, count(*) <= 1 AS connected FROM s GROUP BY 1""",
)
def g14_connectivity_report(b):
    edges, nodes = _whole(b)
    return graph.connectivity_report(graph.components(edges, nodes, ["dimension_id"]), _marked(b))


@query(
    "d30_tier_readiness",
    "responses respondents items dimensions wpairs pool",
    f"""
WITH RECURSIVE {_EDGES}, {_AGG}, s AS (SELECT dimension_id, count(DISTINCT label) AS components FROM comp GROUP BY 1),
legal AS (SELECT item_id, CAST(dimension_id AS VARCHAR) AS cell FROM items CROSS JOIN dimensions WHERE items.is_active AND pool_tier = 1),
md AS (SELECT quantile_cont(CAST(coalesce(n, 0) AS DOUBLE), 0.5) AS median_dn FROM legal
  LEFT JOIN (SELECT * FROM cells WHERE variant = 'pairwise_dimension') c USING (item_id, cell)),
cn AS (SELECT count(*) FILTER (components <= 1) AS connected, count(*) AS dimensions FROM s)
SELECT median_dn, connected, cn.dimensions, median_dn >= 25 AS meets_median, connected >= 6 AS meets_connectivity,
  median_dn >= 25 AND connected >= 6 AS ready FROM md, cn""",
)
def d30_tier_readiness(b):
    edges, nodes = _whole(b)
    report = graph.largest(graph.components(edges, nodes, ["dimension_id"]), ["dimension_id"])
    return Q.tier_readiness(_current(b), b.items, b.dimensions, report)


# ------------------------------------------------------------------------ findings and truth
@query(
    "g9_findings",
    "wresponses traits wpairs patches questions retested identities wpeaks",
    f"""
WITH {_UNITS}, {_ALPHA}, {_GOLD}, {_RETEST}, {_RC},
c AS (SELECT respondent_id, count(*) AS k FROM wpairs GROUP BY 1),
cr AS (SELECT *, row_number() OVER (ORDER BY k DESC) AS rn, ceil((SELECT count(*) FROM c) / 10.0) AS top FROM c),
ci AS (SELECT sum(k) FILTER (rn <= top) / CAST(sum(k) AS DOUBLE) AS index FROM cr),
a AS (SELECT g.*, coalesce(retest_pairs, 0) AS rp, coalesce(retest_consistent, 0) AS rs
  FROM gold g JOIN identities i USING (respondent_id) LEFT JOIN rc USING (respondent_id) WHERE passed IS NOT NULL AND NOT is_flagged),
gr AS (SELECT question_id, count(*) AS attempts FROM a GROUP BY 1 HAVING count(*) >= 5 AND sum(rp) FILTER (NOT passed) > 0
  AND sum(rp) FILTER (passed) > 0
  AND sum(rs) FILTER (NOT passed) * sum(rp) FILTER (passed) >= sum(rs) FILTER (passed) * sum(rp) FILTER (NOT passed)),
un AS (SELECT item_a AS item_id, trait, count(*) AS n FROM (SELECT item_a, unnest(traits) AS trait FROM wpeaks) GROUP BY 1, 2)
SELECT 'alpha_unreliable' AS rule, magnitude AS subject, round(alpha, 6) AS value FROM alphas WHERE alpha < 0.667
UNION ALL SELECT 'concentration', 'rows', round(index, 6) FROM ci WHERE index > 0.4
UNION ALL SELECT 'gold_suspicious', CAST(question_id AS VARCHAR), CAST(attempts AS DOUBLE) FROM gr
UNION ALL SELECT 'patch_without_gold', version, 0.0 FROM patches p WHERE NOT EXISTS (SELECT 1 FROM questions q
  WHERE q.patch_id = p.patch_id AND q.is_gold AND q.patch_id <> 1998)
UNION ALL SELECT 'traits_uneven', CAST(item_id AS VARCHAR), CAST(count(DISTINCT n) AS DOUBLE) FROM un GROUP BY item_id HAVING count(DISTINCT n) > 1""",
)
def g9_findings(b):
    """The rules that need no fit."""
    no_fits = b.spark.createDataFrame([], "fit string, failed boolean, discarded bigint, components bigint")
    no_trigger = b.spark.createDataFrame([], "dimensions bigint, finding boolean, which string")
    return _findings(b, no_fits, no_trigger)


def _findings(b, fits, trigger):
    from crowdgauge.operators import select

    snapshots = b.raw("orders").select(F.year("o_orderdate").alias("patch_id"))
    gold_now = b.questions.withColumn("is_gold", F.col("is_gold") & (F.col("patch_id") != 1998))
    ready = select.patch_readiness(b.patches, snapshots, gold_now)
    marks = (
        b.wpeaks.select(F.col("item_a").alias("item_id"), F.explode("traits").alias("trait"))
        .groupBy("item_id", "trait")
        .agg(F.count("*").alias("n"))
    )
    found = R.findings(
        AG.agreement(b.wresponses, b.traits),
        fits,
        R.concentration(b.wpairs),
        trigger,
        A.gold_report(b.retested, b.identities, 5),
        ready,
        R.uneven_traits(marks),
    )
    return found.withColumn("value", P("value"))


_PATCH_ROWS = """SELECT dimension_id, patch_id, weight, CASE choice WHEN 'a' THEN item_a ELSE item_b END AS winner,
  CASE choice WHEN 'a' THEN item_b ELSE item_a END AS loser FROM wpairs WHERE choice IN ('a', 'b')"""


@query(
    "g9_findings_of_all_rules",
    "wpairs",
    f"""
WITH RECURSIVE {admissible_sql(_GRAPH, _PATCH_ROWS)},
fits AS (SELECT 'score ' || dimension_id || ' patch ' || patch_id AS fit, parts, {ATTEMPTS} FROM s)
SELECT 'fit_failed' AS rule, fit AS subject, CAST(discarded AS DOUBLE) AS value FROM fits WHERE failed
UNION ALL SELECT 'graph_split', fit, CAST(parts AS DOUBLE) FROM fits WHERE parts > 1
UNION ALL SELECT 'segments_disagree', which, CAST(dimensions AS DOUBLE) FROM ({ORACLES["d48_segment_trigger"]}) WHERE finding
UNION ALL SELECT rule, subject, value FROM ({ORACLES["g9_findings"]})""",
)
def g9_findings_of_all_rules(b):
    """All eight rules: the fits are those of every dimension and patch, judged by their replicates and
    graphs, and the trigger compares the rank segments."""
    b = b.keep()
    a_won = F.col("choice") == "a"
    rows = estimate.decisive(b.wpairs).select(
        *_GRAPH,
        "respondent_id",
        F.when(a_won, F.col("item_a")).otherwise(F.col("item_b")).alias("winner"),
        F.when(a_won, F.col("item_b")).otherwise(F.col("item_a")).alias("loser"),
        "weight",
    )
    edges = pin(paired._edges_of(rows, _GRAPH))  # the nodes are read off the edges
    nodes = edges.select(*_GRAPH, F.explode(F.array("u", "v")).alias("node"))
    labels = pin(graph.components(edges, nodes, _GRAPH))
    _, report = resample.replicate_stats(rows, labels, _GRAPH, ["winner", "loser"], paired._edges_of, REPS, SEED)
    name = F.concat(F.lit("score "), F.col("dimension_id"), F.lit(" patch "), F.col("patch_id"))
    fits = report.join(graph.largest(labels, _GRAPH), _GRAPH).select(
        name.alias("fit"), "failed", "discarded", "components"
    )
    return _findings(b, fits, R.segment_trigger(R.compare_segments(_shares(b), "rank")))


@query(
    "g16_estimates_against_truth",
    "wpeaks traits pool",
    f"""
WITH {_TRAITS_SQL}, l AS (SELECT *, round(value, 9) AS v, CASE WHEN n >= 20 AND high - low <= 0.25 THEN 'solid' ELSE 'other' END AS support FROM est),
t AS (SELECT l.*, (item_id % 7) / 10.0::DOUBLE + 0.3::DOUBLE AS truth FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY trait ORDER BY v) + (count(*) OVER (PARTITION BY trait, v) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY trait ORDER BY truth) + (count(*) OVER (PARTITION BY trait, truth) - 1) / 2.0 AS ry FROM t)
SELECT trait, count(*) AS n, round(avg(abs(v - truth)), 6) AS mae, round(avg(CASE WHEN truth BETWEEN low AND high THEN 1.0::DOUBLE ELSE 0 END), 6) AS covered,
  count(*) FILTER (support = 'solid') AS solid, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""",
)
def g16_estimates_against_truth(b):
    est = estimate.proportions(b.wpeaks, b.traits).withColumn("value", P("value", 9))
    truth = est.select(
        "item_id", "trait", (F.col("item_id") % 7 / F.lit(10.0) + F.lit(0.3)).alias("truth")
    )
    out = R.evaluate_estimates(est, truth, ["trait"])
    return out.select(
        "trait", "n", P("mae").alias("mae"), P("covered").alias("covered"), "solid", P("rho").alias("rho")
    )
