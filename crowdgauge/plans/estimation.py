"""Estimators (D1-D12), intervals, ranks and scalar functions (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import estimate, select, validate
from crowdgauge.plans.registry import query
from crowdgauge.sources import binding as B

P = C.plain

_Z = "1.959963984540054"


@query(
    "d1_win_edges",
    "wpairs",
    """
SELECT dimension_id, CASE choice WHEN 'a' THEN item_a ELSE item_b END AS winner,
  CASE choice WHEN 'a' THEN item_b ELSE item_a END AS loser, round(sum(weight), 6) AS weight, count(*) AS n
FROM wpairs WHERE choice IN ('a', 'b') GROUP BY ALL""",
)
def d1_win_edges(b):
    edges = estimate.win_edges(b.wpairs, ["dimension_id"])
    return edges.select("dimension_id", "winner", "loser", P("weight").alias("weight"), "n")


@query(
    "d2_unknown_rate",
    "wpairs",
    """
SELECT dimension_id, item_id, round(sum(CASE choice WHEN 'unknown' THEN weight ELSE 0 END)
  / sum(weight), 6) AS unknown_rate
FROM (SELECT *, unnest([item_a, item_b]) AS item_id FROM wpairs) GROUP BY 1, 2""",
)
def d2_unknown_rate(b):
    rates = estimate.unknown_rate(b.wpairs, ["dimension_id"])
    return rates.select("dimension_id", "item_id", P("unknown_rate").alias("unknown_rate"))


@query(
    "d3_sample_sizes",
    "wpairs wlane",
    """
SELECT 'item' AS kind, CAST(dimension_id AS VARCHAR) AS fit, item_id AS item_a, 0 AS item_b, count(*) AS n
FROM (SELECT dimension_id, unnest([item_a, item_b]) AS item_id FROM wpairs WHERE choice IN ('a', 'b'))
GROUP BY ALL
UNION ALL SELECT 'pair', role, item_a, item_b, count(*) FROM wlane GROUP BY ALL""",
)
def d3_sample_sizes(b):
    items = estimate.sample_sizes(estimate.decisive(b.wpairs), ["dimension_id"]).select(
        F.lit("item").alias("kind"),
        F.col("dimension_id").cast("string").alias("fit"),
        F.col("item_id").alias("item_a"),
        F.lit(0).alias("item_b"),
        "n",
    )
    pairs = estimate.pair_sizes(b.wlane, ["role"]).select(
        F.lit("pair").alias("kind"), F.col("role").alias("fit"), "item_a", "item_b", "n"
    )
    return items.unionByName(pairs)


_MEDIAN_SQL = """
totals AS (SELECT item_a AS item_id, CAST(minute AS DOUBLE) AS v, sum(weight) AS w, count(*) AS n
  FROM wpeaks GROUP BY 1, 2),
run AS (SELECT *, sum(w) OVER (PARTITION BY item_id) / 2 AS half,
  sum(w) OVER (PARTITION BY item_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum,
  lead(v) OVER (PARTITION BY item_id ORDER BY v) AS nxt FROM totals),
hit AS (SELECT item_id, min(v) AS v FROM run
  WHERE cum >= half OR abs(cum - half) <= 1e-12 * greatest(cum, half) GROUP BY 1),
med AS (SELECT r.item_id, CASE WHEN abs(cum - half) <= 1e-12 * greatest(cum, half) AND nxt IS NOT NULL
    THEN (r.v + nxt) / 2 ELSE r.v END AS median,
  (SELECT sum(n) FROM totals t WHERE t.item_id = r.item_id) AS n
  FROM run r JOIN hit h ON h.item_id = r.item_id AND h.v = r.v)"""


@query(
    "d4_weighted_median",
    "wpeaks",
    f"WITH {_MEDIAN_SQL} SELECT item_id, median, CAST(n AS BIGINT) AS n FROM med",
)
def d4_weighted_median(b):
    return estimate.weighted_median(b.wpeaks, ["item_a"], "minute", "weight").select(
        F.col("item_a").alias("item_id"), "median", "n"
    )


@query(
    "d5_peak_values",
    "wpeaks",
    f"WITH {_MEDIAN_SQL} SELECT item_id, floor(median + 0.5) AS value, CAST(n AS BIGINT) AS n FROM med",
)
def d5_peak_values(b):
    return estimate.peak_values(b.wpeaks)


_TRAITS_SQL = f"""
tot AS (SELECT item_a AS item_id, sum(weight) AS total, sum(weight) * sum(weight) / sum(weight * weight)
    AS n_eff, count(*) AS n FROM wpeaks GROUP BY 1),
mark AS (SELECT item_a AS item_id, trait, sum(weight) AS marked
  FROM (SELECT item_a, weight, unnest(traits) AS trait FROM wpeaks) GROUP BY 1, 2),
prop AS (SELECT t.*, c.code AS trait, coalesce(m.marked, 0) / t.total AS value
  FROM tot t CROSS JOIN (SELECT code FROM traits) c
  LEFT JOIN mark m ON m.item_id = t.item_id AND m.trait = c.code),
ci AS (SELECT *, 1 + {_Z} * {_Z} / n_eff AS den, value + {_Z} * {_Z} / (2 * n_eff) AS mid,
  {_Z} * sqrt(value * (1 - value) / n_eff + {_Z} * {_Z} / (4 * n_eff * n_eff)) AS hw FROM prop),
est AS (SELECT item_id, trait, value, greatest(0, mid / den - hw / den) AS low,
  least(1, mid / den + hw / den) AS high, n, n_eff FROM ci)"""


@query(
    "d6_weighted_proportions",
    "wpeaks traits",
    f"""
WITH {_TRAITS_SQL} SELECT item_id, trait, round(value, 6) AS value, round(low, 6) AS low,
  round(high, 6) AS high, n, CASE WHEN n >= 20 AND high - low <= 0.25 THEN 'solid'
  WHEN n >= 10 AND high - low <= 0.45 THEN 'limited' ELSE 'insufficient' END AS support FROM est""",
)
def d6_weighted_proportions(b):
    est = estimate.proportions(b.wpeaks, b.traits)
    return est.select(
        "item_id", "trait", *[P(c).alias(c) for c in ("value", "low", "high")], "n", "support"
    )


@query(
    "d7_kish_effective_size",
    "wpairs",
    """
SELECT dimension_id, choice, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_eff,
  count(*) AS n FROM wpairs GROUP BY 1, 2""",
)
def d7_kish_effective_size(b):
    return b.wpairs.groupBy("dimension_id", "choice").agg(
        P(C.kish("weight")).alias("n_eff"), F.count("*").alias("n")
    )


@query(
    "d8_wilson_interval",
    "respondents pairs",
    f"""
WITH s AS (SELECT respondent_id, CAST(count(*) FILTER (choice = 'a') AS DOUBLE) / count(*) AS p,
  CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY 1),
c AS (SELECT *, 1 + {_Z} * {_Z} / n AS den, p + {_Z} * {_Z} / (2 * n) AS mid,
  {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) AS hw FROM s)
SELECT respondent_id, round(greatest(0, mid / den - hw / den), 6) AS low,
  round(least(1, mid / den + hw / den), 6) AS high FROM c""",
)
def d8_wilson_interval(b):
    a = F.col("choice") == "a"
    shares = b.pairs.groupBy("respondent_id").agg(
        (F.count_if(a) / F.count("*")).alias("p"), F.count("*").cast("double").alias("n")
    )
    low, high = C.wilson("p", "n")
    return shares.select("respondent_id", P(low).alias("low"), P(high).alias("high"))


@query(
    "d9_support_levels",
    "wpeaks traits",
    f"""
WITH {_TRAITS_SQL} SELECT item_id, trait,
  CASE WHEN n >= 25 AND high - low <= 0.60 THEN 'solid' WHEN n >= 10 AND high - low <= 1.20
    THEN 'limited' ELSE 'insufficient' END AS dimension,
  CASE WHEN n >= 15 AND high - low <= 0.80 THEN 'solid' WHEN n >= 6 AND high - low <= 1.50
    THEN 'limited' ELSE 'insufficient' END AS synergy,
  CASE WHEN n >= 20 AND high - low <= 0.25 THEN 'solid' WHEN n >= 10 AND high - low <= 0.45
    THEN 'limited' ELSE 'insufficient' END AS trait_level, 'insufficient' AS no_interval FROM est""",
)
def d9_support_levels(b):
    est = estimate.proportions(b.wpeaks, b.traits)
    none = F.lit(None).cast("double")
    return est.select(
        "item_id",
        "trait",
        C.support("dimension", "n", "low", "high").alias("dimension"),
        C.support("synergy", "n", "low", "high").alias("synergy"),
        C.support("trait", "n", "low", "high").alias("trait_level"),
        C.support("trait", "n", none, F.col("high")).alias("no_interval"),
    )


@query(
    "d10_min_max_norm",
    "wpairs pool",
    """
WITH won AS (SELECT dimension_id, unnest([item_a, item_b]) AS item_id,
    unnest([choice = 'a', choice = 'b']) AS win, weight FROM wpairs WHERE choice IN ('a', 'b')),
rate AS (SELECT dimension_id, item_id, sum(CASE WHEN win THEN weight ELSE 0 END) / sum(weight) AS value
  FROM won WHERE item_id IN (SELECT item_id FROM pool) GROUP BY 1, 2)
SELECT dimension_id, item_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6)
  AS norm FROM rate WINDOW w AS (PARTITION BY dimension_id)""",
)
def d10_min_max_norm(b):
    sides = F.array(
        F.struct(F.col("item_a").alias("item_id"), (F.col("choice") == "a").alias("win")),
        F.struct(F.col("item_b").alias("item_id"), (F.col("choice") == "b").alias("win")),
    )
    rate = (
        estimate.decisive(b.wpairs)
        .select("dimension_id", "weight", F.explode(sides).alias("s"))
        .groupBy("dimension_id", F.col("s.item_id").alias("item_id"))
        .agg(
            (F.sum(F.when(F.col("s.win"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(
                "value"
            )
        )
        .join(b.pool.select("item_id"), "item_id", "left_semi")
    )
    return estimate.min_max_norm(rate, ["dimension_id"]).select(
        "dimension_id", "item_id", P("norm").alias("norm")
    )


@query(
    "d11_power_curve",
    "wpeaks",
    f"""
WITH {_MEDIAN_SQL}, pk AS (SELECT item_id, floor(median + 0.5) AS value FROM med)
SELECT item_id, value, """
    + ", ".join(
        f"round(exp(-(({m}.0 - value) * ({m}.0 - value)) / 112.5), 6) AS power_at_{m}"
        for m in S.POWER_MINUTES
    )
    + " FROM pk",
)
def d11_power_curve(b):
    curve = estimate.power_curve(estimate.peak_values(b.wpeaks))
    return curve.select(
        "item_id", "value", *[P(f"power_at_{m}").alias(f"power_at_{m}") for m in S.POWER_MINUTES]
    )


@query(
    "d12_inclusion_counts",
    "wresponses",
    """
WITH v AS (SELECT *, CASE WHEN type = 'lane_matchup' THEN CASE WHEN item_c IS NULL THEN 'lane_1v1'
    ELSE 'lane_2v2' END ELSE type END AS variant FROM wresponses),
d AS (SELECT respondent_id, unnest(CASE variant WHEN 'pairwise_dimension' THEN ['champion_dimensions']
  WHEN 'peak_timing' THEN ['peak_timing'] WHEN 'lane_1v1' THEN ['champion_lane_strength', 'matchup_matrix']
  WHEN 'trait_multiselect' THEN ['champion_traits'] ELSE ['duo_features'] END) AS dataset FROM v
  UNION ALL SELECT respondent_id, 'quality_report' FROM v)
SELECT dataset, count(*) AS responses, count(DISTINCT respondent_id) AS respondents FROM d GROUP BY 1""",
)
def d12_inclusion_counts(b):
    return estimate.included(select.route(b.wresponses))


@query(
    "e9_percentile_interval",
    "wpeaks",
    """
SELECT item_a AS item_id, round(quantile_cont(CAST(minute AS DOUBLE), 0.025), 6) AS low,
  round(quantile_cont(CAST(minute AS DOUBLE), 0.975), 6) AS high, count(*) AS replicates
FROM wpeaks GROUP BY 1""",
)
def e9_percentile_interval(b):
    samples = b.wpeaks.select(F.col("item_a").alias("item_id"), F.col("minute").cast("double").alias("value"))
    return estimate.percentile_interval(samples, ["item_id"]).select(
        "item_id", P("low").alias("low"), P("high").alias("high"), "replicates"
    )


@query(
    "f11_cumulative_mass",
    "wpeaks",
    """
SELECT item_id, minute, round(sum(w) OVER (PARTITION BY item_id ORDER BY minute ROWS UNBOUNDED PRECEDING), 6)
  AS mass FROM (SELECT item_a AS item_id, minute, sum(weight) AS w FROM wpeaks GROUP BY 1, 2)""",
)
def f11_cumulative_mass(b):
    summed = b.wpeaks.groupBy(F.col("item_a").alias("item_id"), "minute").agg(F.sum("weight").alias("w"))
    mass = estimate.running_sum(summed, ["item_id"], "minute", "w", "mass")
    return mass.select("item_id", "minute", P("mass").alias("mass"))


_RANK_SQL = """
r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM d)"""


@query(
    "g2_spearman",
    "wpeaks",
    "WITH d AS (SELECT item_a AS item_id, minute AS x, trust_score AS y FROM wpeaks), "
    + _RANK_SQL.format(by="item_id")
    + """
SELECT item_id, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1
  THEN round(corr(rx, ry), 6) END AS rho FROM r GROUP BY 1""",
)
def g2_spearman(b):
    rho = estimate.spearman(b.wpeaks, ["item_a"], "minute", "trust_score")
    return rho.select(F.col("item_a").alias("item_id"), "n", P("rho").alias("rho"))


# ---------------------------------------------------------------------- scalar functions
@query(
    "j1_canonical_forms",
    "duos",
    """
SELECT response_id, item_a, item_b, item_c, item_d, role_a, role_b, role_c, role_d, choice FROM duos""",
)
def j1_canonical_forms(b):
    """The bound duos turned round, then brought back to canonical order."""
    turned = b.duos.select(
        "response_id",
        F.col("item_d").alias("item_a"),
        F.col("item_c").alias("item_b"),
        F.col("item_b").alias("item_c"),
        F.col("item_a").alias("item_d"),
        F.col("role_d").alias("role_a"),
        F.col("role_c").alias("role_b"),
        F.col("role_b").alias("role_c"),
        F.col("role_a").alias("role_d"),
        C.flip_choice("choice").alias("choice"),
    )
    return validate.canonical_question(turned)


@query(
    "j2_ranking_to_pairs",
    "rankings",
    """
SELECT ranking_id, least(x.item, y.item) AS item_a, greatest(x.item, y.item) AS item_b,
  CASE WHEN x.item < y.item THEN 'a' ELSE 'b' END AS choice,
  x.pos = 1 AND y.pos = len AS is_extreme
FROM (SELECT ranking_id, len(submitted_order) AS len, unnest(submitted_order) AS item,
    generate_subscripts(submitted_order, 1) AS pos FROM rankings) x
JOIN (SELECT ranking_id, unnest(submitted_order) AS item, generate_subscripts(submitted_order, 1) AS pos
  FROM rankings) y USING (ranking_id)
WHERE x.pos < y.pos AND (least(x.item, y.item) * 31 + greatest(x.item, y.item)) % 19 <> 0""",
)
def j2_ranking_to_pairs(b):
    from crowdgauge.operators.rankings import ranking_to_pairs

    gold = b.questions.filter("is_gold").select("item_a", "item_b", "dimension_id").distinct()
    return ranking_to_pairs(b.rankings, gold).select(
        "ranking_id", "item_a", "item_b", "choice", "is_extreme"
    )


@query(
    "j3_level_maps",
    "duos lane",
    """
SELECT 'synergy' AS scale, CASE choice WHEN 'pair_2' THEN 0 WHEN 'similar' THEN 1 ELSE 2 END AS level,
  '' AS outcome, count(*) AS n FROM duos GROUP BY ALL
UNION ALL SELECT 'lane', CASE choice WHEN 'b_strong' THEN 0 WHEN 'b_slight' THEN 1 WHEN 'even' THEN 2
  WHEN 'a_slight' THEN 3 ELSE 4 END, CASE WHEN choice = 'even' THEN 'even' ELSE substr(choice, 1, 1) END,
  count(*) FROM lane GROUP BY ALL""",
)
def j3_level_maps(b):
    duos = b.duos.groupBy(
        F.lit("synergy").alias("scale"), C.level("choice", "synergy").alias("level"), F.lit("").alias("outcome")
    ).agg(F.count("*").alias("n"))
    lane = b.lane.groupBy(
        F.lit("lane").alias("scale"),
        C.level("choice", "lane").alias("level"),
        C.lane_outcome("choice").alias("outcome"),
    ).agg(F.count("*").alias("n"))
    return duos.unionByName(lane)


@query(
    "j4_rounding",
    "respondents",
    """
SELECT respondent_id, CAST(floor(trust_score * 17 + 0.5) AS BIGINT) AS half_up,
  CAST(round(CAST(CAST(trust_score / 7 AS VARCHAR) AS DECIMAL(30, 18)), 3) AS DOUBLE) AS quantised,
  round(least(1, greatest(0, trust_score * 1.5 - 0.4)), 6) AS unit FROM respondents""",
)
def j4_rounding(b):
    t = F.col("trust_score")
    return b.respondents.select(
        "respondent_id",
        C.half_up(t * 17).alias("half_up"),
        C.quantise(t / 7, 3).cast("double").alias("quantised"),
        P(C.unit(t * 1.5 - 0.4)).alias("unit"),
    )


@query(
    "j5_fixed_formatting",
    "",
    """
SELECT event_id, printf('%.3f', value - 100) AS three, printf('%.2f', value / 8) AS two,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS whole,
  CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END AS flag,
  CASE WHEN event_id % 2 = 0 THEN '0.000' ELSE '' END AS zero FROM events""",
)
def j5_fixed_formatting(b):
    value, key = F.col("value"), F.col("event_id")
    return b.raw("events").select(
        "event_id",
        C.fmt_number(value - 100, 3).alias("three"),
        C.fmt_number(value / 8, 2).alias("two"),
        C.fmt_integer(F.when(key % 5 != 0, key)).alias("whole"),
        C.fmt_boolean(F.col("event_type") == "click").alias("flag"),
        C.fmt_number(F.when(key % 2 == 0, F.lit(-0.0001)), 3).alias("zero"),
    )


@query(
    "j6_logistic_levels",
    "respondents",
    """
WITH p AS (SELECT respondent_id, trust_score * 4 - 2 AS d FROM respondents),
g AS (SELECT *, 1 / (1 + exp(-(d + 1.1))) AS g1, 1 / (1 + exp(-(d + 0.4))) AS g2,
  1 / (1 + exp(-(d - 0.4))) AS g3, 1 / (1 + exp(-(d - 1.1))) AS g4 FROM p)
SELECT respondent_id, round(1 - g1, 6) AS p0, round(g1 - g2, 6) AS p1, round(g2 - g3, 6) AS p2,
  round(g3 - g4, 6) AS p3, round(g4, 6) AS p4,
  round(-1 * (1 - g1) - 0.5 * (g1 - g2) + 0.5 * (g3 - g4) + g4, 6) AS margin FROM g""",
)
def j6_logistic_levels(b):
    delta = F.col("trust_score") * 4 - 2
    t1, t2 = F.lit(0.4), F.lit(1.1)
    probs = C.level_probs(delta, t1, t2)
    return b.respondents.select(
        "respondent_id",
        *[P(p).alias(f"p{k}") for k, p in enumerate(probs)],
        P(C.expected_margin(delta, t1, t2)).alias("margin"),
    )


@query(
    "j7_entropy_terms",
    "pairs",
    """
SELECT question_id, CASE WHEN p > 0 AND p < 1 THEN round(-p * log2(p), 6) ELSE 0.0::DOUBLE END AS term
FROM (SELECT question_id, CAST(count(*) FILTER (choice = 'a') AS DOUBLE) / count(*) AS p
  FROM pairs GROUP BY 1)""",
)
def j7_entropy_terms(b):
    p = F.count_if(F.col("choice") == "a") / F.count("*")
    shares = b.pairs.groupBy("question_id").agg(p.alias("p"))
    return shares.select("question_id", P(C.entropy_term("p")).alias("term"))


@query(
    "j8_local_days",
    "",
    """
SELECT event_id, CAST(CAST(timezone('America/Argentina/Buenos_Aires', timezone('UTC', ts)) AS DATE) AS VARCHAR)
  AS local_day, CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_day FROM events""",
)
def j8_local_days(b):
    ts = F.col("ts").cast("timestamp")
    tz = S.DEFAULTS["gamification.streak_timezone"]
    return b.raw("events").select(
        "event_id",
        C.local_day(ts, tz).cast("string").alias("local_day"),
        F.to_date(ts).cast("string").alias("utc_day"),
    )


@query(
    "j9_json_access",
    "",
    """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n
FROM events GROUP BY ALL""",
)
def j9_json_access(b):
    k = C.json_get("props", "$.k").cast("int") % 10
    return b.raw("events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


def _hmac_pads() -> tuple[str, str]:
    key = b"pepper".ljust(64, b"\0")
    return tuple("".join(f"\\x{x ^ pad:02x}" for x in key) for pad in (0x36, 0x5C))


_IPAD, _OPAD = _hmac_pads()


@query(
    "j10_pseudonyms",
    "respondents",
    f"""
SELECT respondent_id, sha256(fingerprint_hash || '|' || sha256(ip_hash)) AS fingerprint,
  sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode(ip_hash)))) AS ip FROM respondents""",
)
def j10_pseudonyms(b):
    return b.respondents.select(
        "respondent_id",
        C.fingerprint("fingerprint_hash", "ip_hash").alias("fingerprint"),
        C.hmac256("ip_hash", "pepper").alias("ip"),
    )


@query(
    "j11_array_functions",
    "items",
    """
SELECT item_id, list_contains(roles, 'mid') AS has_mid,
  array_to_string(list_sort(list_distinct(list_concat(roles, ['mid', 'adc']))), '|') AS joined FROM items""",
)
def j11_array_functions(b):
    more = F.concat("roles", select.any_of(("mid", "adc")))
    return b.items.select(
        "item_id",
        C.has("roles", "mid").alias("has_mid"),
        F.concat_ws("|", C.sorted_set(more)).alias("joined"),
    )


@query(
    "j12_run_seeds",
    "patches",
    """
SELECT version, CAST(('0x' || substr(sha256(version || '..16.21|0.300|21|7.5|2000|1.0.1'), 1, 16))::UBIGINT
  AS VARCHAR) AS seed FROM patches""",
)
def j12_run_seeds(b):
    text = F.concat("version", F.lit("..16.21|0.300|21|7.5|2000|1.0.1"))
    return b.patches.select("version", C.seed_text(text).alias("seed"))
