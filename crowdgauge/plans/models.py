"""Iterative models and resampling (E)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from crowdgauge.functions import columns as C
from crowdgauge.operators import estimate, graph, paired, resample
from crowdgauge.operators import report as R
from crowdgauge.plans.draws import hash_sql, times_sql
from crowdgauge.plans.registry import query

P = C.plain
REPS, SEED = 20, 20260101


def _bt_sql(steps: int) -> str:
    ctes = [
        """win AS (SELECT dimension_id, CASE choice WHEN 'a' THEN item_a ELSE item_b END AS winner,
  CASE choice WHEN 'a' THEN item_b ELSE item_a END AS loser, sum(weight) AS w FROM wpairs WHERE choice IN ('a', 'b') GROUP BY ALL)""",
        """p0 AS (SELECT dimension_id, item_id, sum(won) AS won, 1.0::DOUBLE AS pi FROM (SELECT dimension_id, winner AS item_id, w AS won FROM win
  UNION ALL SELECT dimension_id, loser, 0 FROM win) GROUP BY 1, 2)""",
    ]
    for k in range(1, steps + 1):
        ctes.append(f"""s{k} AS (SELECT dimension_id, unnest([winner, loser]) AS item_id, share FROM (
  SELECT e.dimension_id, winner, loser, e.w / (x.pi + y.pi) AS share FROM win e JOIN p{k - 1} x ON x.dimension_id = e.dimension_id AND x.item_id = e.winner
  JOIN p{k - 1} y ON y.dimension_id = e.dimension_id AND y.item_id = e.loser))""")
        ctes.append(f"""u{k} AS (SELECT p.dimension_id, p.item_id, p.won, (p.won + 0.5::DOUBLE) / (d.share + 1.0::DOUBLE / (p.pi + 1)) AS v FROM p{k - 1} p
  JOIN (SELECT dimension_id, item_id, sum(share) AS share FROM s{k} GROUP BY 1, 2) d USING (dimension_id, item_id))""")
        ctes.append(
            f"p{k} AS (SELECT dimension_id, item_id, won, v / exp(avg(ln(v)) OVER (PARTITION BY dimension_id)) AS pi FROM u{k})"
        )
    return ",\n".join(ctes)


def _five_steps(b):
    win = estimate.win_edges(b.wpairs, ["dimension_id"])
    return paired.bt_iterate(win, ["dimension_id"], max_iter=5, tol=None)


@query(
    "e1_scores_five_steps",
    "wpairs pool",
    f"""
WITH {_bt_sql(5)}, t AS (SELECT dimension_id, item_id, ln(pi) AS theta, item_id IN (SELECT item_id FROM pool) AS in_pool FROM p5),
c AS (SELECT *, theta - avg(CASE WHEN in_pool THEN theta END) OVER (PARTITION BY dimension_id) AS score FROM t)
SELECT dimension_id, item_id, round(score, 6) AS score, CASE WHEN in_pool THEN
  round((score - min(CASE WHEN in_pool THEN score END) OVER (PARTITION BY dimension_id))
  / (max(CASE WHEN in_pool THEN score END) OVER (PARTITION BY dimension_id) - min(CASE WHEN in_pool THEN score END) OVER (PARTITION BY dimension_id)), 6) END AS norm
FROM c""",
)
def e1_scores_five_steps(b):
    """Five rounds from equal strengths, centred on the pool and rescaled: log to score."""
    centred = paired.center(_five_steps(b), b.pool.select("item_id"), ["dimension_id"])
    est = centred.withColumnRenamed("theta", "value")
    norm = estimate.min_max_norm(
        est.join(b.pool.select("item_id"), "item_id", "left_semi"), ["dimension_id"]
    ).select("dimension_id", "item_id", "norm")
    return est.join(norm, ["dimension_id", "item_id"], "left").select(
        "dimension_id", "item_id", P("value").alias("score"), P("norm").alias("norm")
    )


@query(
    "e2_component_centering",
    "wpairs pool",
    f"""
WITH {_bt_sql(5)}, t AS (SELECT dimension_id, item_id, ln(pi) AS theta FROM p5)
SELECT dimension_id, item_id, round(theta - CASE WHEN dimension_id = 3 THEN avg(theta) OVER (PARTITION BY dimension_id)
  ELSE avg(CASE WHEN item_id IN (SELECT item_id FROM pool) THEN theta END) OVER (PARTITION BY dimension_id) END, 6) AS theta FROM t""",
)
def e2_component_centering(b):
    """Dimension 3 has no reference item here, so it is centred on all of its items."""
    members = b.pool.join(b.dimensions.filter("dimension_id <> 3"), F.lit(True)).select(
        "dimension_id", "item_id"
    )
    return paired.center(_five_steps(b), members, ["dimension_id"]).withColumn("theta", P("theta"))


@query("e1_scores_converged")
def e1_scores_converged(b):
    win = estimate.win_edges(b.wpairs, ["dimension_id"])
    theta = paired.bt_fit(win, ["dimension_id"])
    return theta.withColumn("theta", P("theta"))


_COMPARED = """SELECT dimension_id, respondent_id, weight, CASE choice WHEN 'a' THEN item_a ELSE item_b END AS winner,
  CASE choice WHEN 'a' THEN item_b ELSE item_a END AS loser FROM wpairs WHERE choice IN ('a', 'b')"""
_TIMES = " + ".join(f"CAST(draw >= {t!r}e0 AS BIGINT)" for t in resample.poisson_steps())
_REPS = f"(SELECT CAST(unnest(range({REPS})) AS INTEGER) AS rep)"
_TRIES = resample.candidates(REPS)


def _units_sql(fit: str = "dimension_id", rows: str = "r", stat: str = "winner, loser") -> str:
    """Equal rows of a cell as units, in the order in which they are drawn from."""
    return f"""units AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {fit} ORDER BY {stat}, weight) - 1 AS i FROM
  (SELECT {fit}, {stat}, weight, count(*) AS c FROM {rows} GROUP BY ALL))"""


def _people_sql(rows: str = "r") -> str:
    return f"""units AS MATERIALIZED (SELECT dimension_id, respondent_id, 1 AS c, row_number() OVER (PARTITION BY dimension_id ORDER BY respondent_id) - 1 AS i
  FROM (SELECT DISTINCT dimension_id, respondent_id FROM {rows}))"""


def _compared(b):
    a_won = F.col("choice") == "a"
    return estimate.decisive(b.wpairs).select(
        "dimension_id",
        "response_id",
        "respondent_id",
        F.when(a_won, F.col("item_a")).otherwise(F.col("item_b")).alias("winner"),
        F.when(a_won, F.col("item_b")).otherwise(F.col("item_a")).alias("loser"),
        "weight",
    )


def _draw_summary(drawn):
    return drawn.groupBy("dimension_id", "rep").agg(F.sum("times").alias("rows"), P(F.sum("weight")).alias("weight"))


@query(
    "e7_bootstrap_by_comparison",
    "wpairs",
    f"""
WITH r AS ({_COMPARED}),
{_units_sql()},
{times_sql("units", ["dimension_id"], REPS, SEED)}
SELECT dimension_id, rep, CAST(sum(times) AS BIGINT) AS rows, round(sum(weight * times), 6) AS weight
FROM times JOIN units USING (dimension_id, i) GROUP BY ALL""",
)
def e7_bootstrap_by_comparison(b):
    """As many draws as comparisons, summed per replicate."""
    return _draw_summary(resample.resample(_compared(b), ["dimension_id"], ["winner", "loser"], REPS, SEED))


@query(
    "e7_bootstrap_poisson",
    "wpairs",
    f"""
WITH d AS (SELECT *, {hash_sql(13, SEED, "dimension_id", "rep", "response_id")} / 4503599627370496e0 AS draw FROM
  (SELECT dimension_id, response_id, weight FROM wpairs WHERE choice IN ('a', 'b')), {_REPS}),
t AS (SELECT *, {_TIMES} AS times FROM d)
SELECT dimension_id, rep, CAST(sum(times) AS BIGINT) AS rows, round(sum(weight * times), 6) AS weight FROM t WHERE times > 0 GROUP BY ALL""",
)
def e7_bootstrap_poisson(b):
    drawn = resample.poisson(_compared(b), ["dimension_id"], REPS, SEED)
    return _draw_summary(drawn.withColumn("weight", F.col("weight") * F.col("times")))


@query(
    "e8_bootstrap_by_respondent",
    "wpairs",
    f"""
WITH r AS ({_COMPARED}),
{_people_sql()},
{times_sql("units", ["dimension_id"], REPS, SEED)},
p AS (SELECT dimension_id, respondent_id, count(*) AS n, sum(weight) AS weight FROM r GROUP BY ALL)
SELECT dimension_id, rep, CAST(sum(n * times) AS BIGINT) AS rows, round(sum(weight * times), 6) AS weight
FROM times JOIN units USING (dimension_id, i) JOIN p USING (dimension_id, respondent_id) GROUP BY ALL""",
)
def e8_bootstrap_by_respondent(b):
    """As many draws of people as there are people; their comparisons follow them."""
    drawn = resample.resample(
        _compared(b), ["dimension_id"], ["winner", "loser"], REPS, SEED, cluster="respondent_id"
    )
    return _draw_summary(drawn)


def admissible_sql(fit: Sequence[str], rows: str) -> str:
    """CTEs of the draws of every fit and of the graphs they keep: ``k`` has the parts of a replicate, those
    of all comparisons as replicate -1, and ``s`` the attempts that kept as many."""
    f = ", ".join(fit)
    of = lambda x: ", ".join(f"{x}.{c}" for c in fit)
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in fit)
    return f"""
r AS ({rows}),
{_units_sql(f)},
{times_sql("units", list(fit), _TRIES, SEED)},
e AS (SELECT DISTINCT {f}, rep, least(winner, loser) AS u, greatest(winner, loser) AS v FROM times JOIN units USING ({f}, i)
  UNION ALL SELECT DISTINCT {f}, -1, least(winner, loser), greatest(winner, loser) FROM r),
both_ AS (SELECT {f}, rep, u, v FROM e UNION SELECT {f}, rep, v, u FROM e),
walk AS (SELECT {f}, rep, node, node AS seen FROM (SELECT DISTINCT {f}, unnest([winner, loser]) AS node FROM r), (SELECT unnest(range(-1, {_TRIES})) AS rep)
  UNION SELECT {of("w")}, w.rep, w.node, b.v FROM walk w JOIN both_ b ON {same("b", "w")} AND b.rep = w.rep AND b.u = w.seen),
k AS (SELECT {f}, rep, count(DISTINCT label) AS parts FROM (SELECT {f}, rep, node, min(seen) AS label FROM walk GROUP BY ALL) GROUP BY ALL),
good AS (SELECT {of("k")}, k.rep, row_number() OVER (PARTITION BY {of("k")} ORDER BY k.rep) AS place
  FROM k JOIN k f ON {same("f", "k")} AND f.rep = -1 AND f.parts = k.parts WHERE k.rep >= 0),
s AS (SELECT {of("f")}, any_value(f.parts) AS parts, count(place) AS got, max(good.rep) FILTER (place = {REPS}) + 1 AS tries
  FROM k f LEFT JOIN good USING ({f}) WHERE f.rep = -1 GROUP BY ALL)"""


#: Of the rows of ``s``: attempts, how many of them are discarded, and whether the fit has too few replicates.
ATTEMPTS = f"coalesce(tries, {_TRIES}) AS attempts, coalesce(tries - {REPS}, {_TRIES} - got) AS discarded, got < {REPS} AS failed"


@query(
    "e12_replicate_admissibility",
    "wpairs",
    f"WITH RECURSIVE {admissible_sql(['dimension_id'], _COMPARED)} SELECT dimension_id, {ATTEMPTS} FROM s",
)
def e12_replicate_admissibility(b):
    """Replicates of all comparisons, and which of them keep the graph."""
    rows = _compared(b)
    edges = paired._edges_of(rows, ["dimension_id"])
    nodes = edges.select("dimension_id", F.explode(F.array("u", "v")).alias("node"))
    labels = graph.components(edges, nodes, ["dimension_id"])
    _, report = resample.replicate_stats(
        rows, labels, ["dimension_id"], ["winner", "loser"], paired._edges_of, REPS, SEED
    )
    return report


@query("e15_dimension_scores")
def e15_dimension_scores(b):
    est, _ = paired.fit_dimensions(b.wpairs, b.pool, n_rep=REPS, seed=SEED)
    rounded = [P(c).alias(c) for c in ("value", "low", "high", "unknown_rate", "norm")]
    return est.select("dimension_id", "item_id", *rounded, "n", "support")


@query("e16_segment_refits")
def e16_segment_refits(b):
    labelled = R.segment_labels(b.wpairs)
    sizes = R.segment_sizes(b.wpairs, 3, 30)
    est, _ = paired.fit_segments(labelled, b.pool, sizes, n_rep=5, seed=SEED)
    return est.select(
        "variable", "segment", "dimension_id", "item_id",
        *[P(c).alias(c) for c in ("value", "low", "high")], "n", "support",
    )


@query("g10_bootstrap_width_ratio")
def g10_bootstrap_width_ratio(b):
    ready = paired.compared(b.wpairs)
    plain, _ = paired.fit_dimensions(b.wpairs, b.pool, n_rep=REPS, seed=SEED, ready=ready)
    people, _ = paired.fit_dimensions(
        b.wpairs, b.pool, n_rep=REPS, seed=SEED, cluster="respondent_id", ready=ready
    )
    ratio = R.width_ratio(plain, people, "dimension_id")
    return ratio.select("dimension_id", *[P(c).alias(c) for c in ("narrow", "honest", "ratio")])


# ------------------------------------------------------------------------------ ordinal models
def _tau_frame(b, stats):
    return stats.select("role").distinct().select(
        "role", F.lit(0.4).alias("tau1"), F.lit(1.1).alias("tau2")
    )


_CELLS = """cells AS (SELECT role, item_a, item_b, list_position(['b_strong', 'b_slight', 'even', 'a_slight', 'a_strong'], choice) - 1 AS level,
  sum(weight) AS w FROM wlane GROUP BY ALL),
d AS (SELECT *, (item_a % 7 - item_b % 7) / 5.0::DOUBLE AS delta FROM cells),
g AS (SELECT *, CASE level WHEN 0 THEN 1.0::DOUBLE ELSE 1 / (1 + exp(-(delta - ([-1.1, -0.4, 0.4, 1.1])[level]))) END AS u,
  CASE level WHEN 4 THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-(delta - ([-1.1, -0.4, 0.4, 1.1])[level + 1]))) END AS l FROM d)"""


@query(
    "e3_ordinal_gradient",
    "wlane",
    f"""
WITH {_CELLS}, s AS (
  SELECT role, CAST(item_a AS VARCHAR) AS param, w * (1 - u - l) AS s, w * (u * (1 - u) + l * (1 - l)) AS c FROM g
  UNION ALL SELECT role, CAST(item_b AS VARCHAR), -w * (1 - u - l), w * (u * (1 - u) + l * (1 - l)) FROM g
  UNION ALL SELECT role, 'tau1', w * (CASE level WHEN 2 THEN u * (1 - u) WHEN 3 THEN -u * (1 - u) ELSE 0 END
    + CASE level WHEN 1 THEN -l * (1 - l) WHEN 2 THEN l * (1 - l) ELSE 0 END) / (u - l), 0 FROM g
  UNION ALL SELECT role, 'tau2', w * (CASE level WHEN 1 THEN u * (1 - u) WHEN 4 THEN -u * (1 - u) ELSE 0 END
    + CASE level WHEN 0 THEN -l * (1 - l) WHEN 3 THEN l * (1 - l) ELSE 0 END) / (u - l), 0 FROM g),
t AS (SELECT role, param, sum(s) AS slope, sum(c) AS curvature FROM s GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN param LIKE 'tau%' THEN NULL ELSE (CAST(replace(param, 'tau', '') AS INTEGER) % 7) / 5.0::DOUBLE END AS v FROM t)
SELECT role, param, round(slope - coalesce(0.5::DOUBLE * (2 / (1 + exp(-v)) - 1), 0), 5) AS slope,
  CASE WHEN v IS NOT NULL THEN round(curvature + 1.0::DOUBLE / (1 + exp(-v)) * (1 - 1 / (1 + exp(-v))), 5) END AS curvature FROM x""",
)
def e3_ordinal_gradient(b):
    """Slope and curvature of the penalised likelihood at fixed strengths and thresholds."""
    from crowdgauge.operators import ordinal as O

    leveled = b.wlane.withColumn("level", C.level("choice", "lane"))
    stats = O._lane_sides(O.lane_stats(leveled, ["role"]))
    params = (
        stats.select("role", F.explode(F.array("item_a", "item_b")).alias("i"))
        .distinct()
        .select("role", F.col("i").cast("string").alias("param"), (F.col("i") % 7 / F.lit(5.0)).alias("value"))
    )
    gradient = O.ordinal_gradient(stats, params, _tau_frame(b, stats), ["role"], 5)
    full = O.penalised(gradient, params, ["role"], "epsilon", F.lit(0.5))
    return full.select(
        "role",
        "param",
        P("slope", 5).alias("slope"),
        F.when(F.col("value").isNotNull(), P("curvature", 5)).alias("curvature"),
    )


@query("e3_lane_strengths")
def e3_lane_strengths(b):
    from crowdgauge.operators import ordinal as O

    strengths, _, _ = O.fit_lanes(b.wlane, b.pool, n_rep=REPS, seed=SEED)
    return strengths.select("role", "item_id", *[P(c).alias(c) for c in ("value", "low", "high")], "n", "support")


@query(
    "e4_advantage_matrix",
    "wlane pool",
    """
WITH it AS (SELECT DISTINCT role, unnest([item_a, item_b]) AS item_id FROM wlane),
pr AS (SELECT x.role, x.item_id AS item_a, y.item_id AS item_b, (x.item_id % 7 - y.item_id % 7) / 5.0::DOUBLE AS d
  FROM it x JOIN it y ON x.role = y.role AND x.item_id < y.item_id
  JOIN pool px ON px.item_id = x.item_id AND list_contains(px.roles, x.role)
  JOIN pool py ON py.item_id = y.item_id AND list_contains(py.roles, y.role)),
g AS (SELECT *, 1 / (1 + exp(-(d + 1.1))) AS g1, 1 / (1 + exp(-(d + 0.4))) AS g2, 1 / (1 + exp(-(d - 0.4))) AS g3, 1 / (1 + exp(-(d - 1.1))) AS g4 FROM pr),
m AS (SELECT *, -1 * (1 - g1) - 0.5 * (g1 - g2) + 0.5 * (g3 - g4) + g4 AS a FROM g)
SELECT role, item_a, item_b, CASE WHEN abs(a) < 5e-7 THEN 0.0::DOUBLE ELSE round(a, 6) END AS value FROM m""",
)
def e4_advantage_matrix(b):
    """Expected margins at fixed strengths, so that SQL can say the same."""
    from crowdgauge.operators import ordinal as O

    seen = b.wlane.select("role", F.explode(F.array("item_a", "item_b")).alias("item_id")).distinct()
    theta = seen.withColumn("theta", F.col("item_id") % 7 / F.lit(5.0))
    labels = seen.select("role", F.col("item_id").alias("node"), F.lit(1).alias("label"))
    margins = O.advantage(theta, _tau_frame(b, seen), labels, b.pool, ["role"])
    return margins.select("role", "item_a", "item_b", P("value").alias("value"))


@query("e4_matchups_with_intervals")
def e4_matchups_with_intervals(b):
    from crowdgauge.operators import ordinal as O

    _, matchups, _ = O.fit_lanes(b.wlane, b.pool, n_rep=REPS, seed=SEED)
    return matchups.select(
        "role", "item_a", "item_b", *[P(c).alias(c) for c in ("value", "low", "high")], "n", "support", "is_observed",
    )


def _duo_rows(duos):
    return duos.select(
        "duo_ctx", C.duo_label(F.col("duo")).alias("duo"),
        *[P(c).alias(c) for c in ("value", "low", "high")], "n", "support", "is_observed",
    )


@query("e5_duo_synergy")
def e5_duo_synergy(b):
    from crowdgauge.operators import ordinal as O

    duos, _ = O.fit_duos(b.wduos, b.pool, "synergy", n_rep=REPS, seed=SEED)
    return _duo_rows(duos)


@query("e5_duo_lane_strength")
def e5_duo_lane_strength(b):
    from crowdgauge.operators import ordinal as O

    lane = b.wduos.filter("duo_ctx = 'bot'").withColumn("choice", F.col("lane_choice"))
    duos, _ = O.fit_duos(lane, b.pool, "lane", n_rep=REPS, seed=SEED)
    return _duo_rows(duos)


@query(
    "e6_duo_grid",
    "wduos pool",
    """
WITH sides AS (SELECT duo_ctx, item_a AS a, role_a AS ra, item_b AS b, role_b AS rb FROM wduos
  UNION SELECT duo_ctx, item_c, role_c, item_d, role_d FROM wduos),
seen AS (SELECT DISTINCT duo_ctx, unnest([a, b]) AS item_id FROM sides),
legal AS (SELECT ctx AS duo_ctx, least(x.item_id, y.item_id) AS a, CASE WHEN x.item_id < y.item_id THEN r1 ELSE r2 END AS ra,
    greatest(x.item_id, y.item_id) AS b, CASE WHEN x.item_id < y.item_id THEN r2 ELSE r1 END AS rb
  FROM (VALUES ('bot', 'adc', 'support'), ('top_jungle', 'top', 'jungle'), ('mid_jungle', 'mid', 'jungle')) c(ctx, r1, r2)
  JOIN pool x ON list_contains(x.roles, r1) JOIN pool y ON list_contains(y.roles, r2)
  JOIN seen sx ON sx.duo_ctx = ctx AND sx.item_id = x.item_id JOIN seen sy ON sy.duo_ctx = ctx AND sy.item_id = y.item_id
  WHERE x.item_id <> y.item_id),
grid AS (SELECT * FROM sides UNION SELECT * FROM legal),
v AS (SELECT g.*, (a % 5) * 0.3::DOUBLE + (b % 5) * 0.3::DOUBLE + CASE WHEN s.a IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END AS value
  FROM grid g LEFT JOIN sides s USING (duo_ctx, a, ra, b, rb)),
c AS (SELECT *, value - avg(value) OVER (PARTITION BY duo_ctx) AS cv FROM v)
SELECT duo_ctx, a || ':' || ra || '|' || b || ':' || rb AS duo, CASE WHEN abs(cv) < 5e-7 THEN 0.0::DOUBLE ELSE round(cv, 6) END AS value FROM c""",
)
def e6_duo_grid(b):
    """The prediction grid at fixed effects: 0.3 (item mod 5) and 0.1 per observed duo."""
    from crowdgauge.operators import ordinal as O

    stats = O._duo_columns(b.wduos)
    grid = O.duo_candidates(stats, b.pool)
    duos = stats.select("duo_ctx", F.explode(F.array("top", "bottom")).alias("duo")).distinct()
    items = duos.select("duo_ctx", F.explode(F.array("duo.m1.item", "duo.m2.item")).alias("i")).distinct()
    params = items.select(
        "duo_ctx", F.col("i").cast("string").alias("param"), (F.col("i") % 5 * F.lit(0.3)).alias("value")
    ).unionByName(
        duos.select("duo_ctx", C.duo_label(F.col("duo")).alias("param"), F.lit(0.1).alias("value"))
    )
    out = O.duo_grid(params, grid, ["duo_ctx"])
    return out.select("duo_ctx", C.duo_label(F.col("duo")).alias("duo"), P("value").alias("value"))
