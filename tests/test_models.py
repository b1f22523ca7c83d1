"""Iterative models, graphs and resampling: invariants, and both execution ways against each other."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdgauge.functions import columns as C
from crowdgauge.operators import behaviour, graph, multinomial, newton, ordinal, paired, resample
from crowdgauge.operators.scan import OrderedGroups
from crowdgauge.plans import models, replicates

WIN = "fit string, winner int, loser int, weight double"


def _wins(spark):
    rows = [
        ("x", 1, 2, 3.0), ("x", 2, 1, 1.0), ("x", 2, 3, 4.0), ("x", 1, 3, 2.0), ("x", 3, 1, 0.5),
        ("y", 7, 8, 1.0), ("y", 8, 9, 2.0), ("y", 9, 7, 1.5),
    ]
    return spark.createDataFrame(rows, WIN)


def _theta(df):
    return {(r["fit"], r["item_id"]): r["theta"] for r in df.collect()}


def test_strengths_by_joins_equal_strengths_by_groups(spark):
    win = _wins(spark)
    joined = _theta(paired.bt_iterate(win, ["fit"], 0.5, 30, None))
    grouped = _theta(paired.bt_grouped(win, ["fit"], 0.5, 30, 0.0))
    assert joined.keys() == grouped.keys()
    for key, value in joined.items():
        assert value == pytest.approx(grouped[key], abs=1e-10)


def test_strengths_are_ordered_finite_and_at_the_optimum(spark):
    theta = _theta(paired.bt_fit(_wins(spark), ["fit"], 0.5, 500, 1e-12))
    assert theta["x", 1] > theta["x", 2] > theta["x", 3]
    assert all(np.isfinite(v) for v in theta.values())
    assert sum(v for (fit, _), v in theta.items() if fit == "x") == pytest.approx(0, abs=1e-9)


def test_an_unbeaten_item_stays_finite(spark):
    win = spark.createDataFrame([("x", 1, 2, 50.0), ("x", 2, 3, 5.0)], WIN)
    theta = _theta(paired.bt_fit(win, ["fit"], 0.5, 500, 1e-10))
    assert np.isfinite(theta["x", 1]) and theta["x", 1] > theta["x", 2]


def test_centering_uses_the_reference_members_or_all(spark):
    theta = spark.createDataFrame(
        [("x", 1, 1.0), ("x", 2, 3.0), ("x", 3, 8.0), ("y", 9, 5.0), ("y", 8, 7.0)],
        "fit string, item_id int, theta double",
    )
    members = spark.createDataFrame([(1,), (2,)], "item_id int")
    got = _theta(paired.center(theta, members, ["fit"]))
    assert got == {("x", 1): -1.0, ("x", 2): 1.0, ("x", 3): 6.0, ("y", 9): -1.0, ("y", 8): 1.0}


def _graph(spark):
    rng = random.Random(5)
    edges = [("a", i, i + 1) for i in range(1, 40)] + [("a", 100, 101)]
    edges += [("b", *sorted(rng.sample(range(60), 2))) for _ in range(35)]
    nodes = [("a", i) for i in (*range(1, 41), 100, 101, 200)] + [("b", i) for i in range(60)]
    return (
        edges,
        nodes,
        spark.createDataFrame(edges, "k string, u int, v int"),
        spark.createDataFrame(nodes, "k string, node int"),
    )


def _brute_labels(edges, nodes):
    label = {n: n[1] for n in nodes}
    changed = True
    while changed:
        changed = False
        for k, u, v in edges:
            low = min(label[k, u], label[k, v])
            for end in (u, v):
                if label[k, end] != low:
                    label[k, end], changed = low, True
    return label


def test_components_against_brute_force(spark):
    edges, nodes, e, n = _graph(spark)
    wanted = _brute_labels(edges, nodes)
    for found in (
        graph.components(e, n, ["k"]),
        graph.components_of_many(e, n, ["k"]),
        graph.components_of_many(e, n, ["k"], edges_per_task=1),
    ):
        assert {(r["k"], r["node"]): r["label"] for r in found.collect()} == wanted


def test_bridge_plan_joins_everything_and_avoids_gold(spark):
    edges = [(1, 1, 2), (1, 3, 4), (1, 5, 6)]
    nodes = [(1, i) for i in range(1, 9)]
    marked = [(1, 2, 3, 10), (1, 1, 4, 11), (1, 5, 6, 12)]
    gold = [(1, a, b) for a in range(1, 9) for b in range(a + 1, 9) if (a + b) % 3 == 0]
    plan = graph.bridge_plan(
        spark.createDataFrame(edges, "dimension_id int, u int, v int"),
        spark.createDataFrame(nodes, "dimension_id int, node int"),
        spark.createDataFrame(marked, "dimension_id int, u int, v int, question_id bigint"),
        spark.createDataFrame(gold, "dimension_id int, item_a int, item_b int"),
        seed=3,
    ).collect()
    by = {}
    for r in plan:
        by.setdefault(r["action"], []).append((r["item_a"], r["item_b"], r["question_id"]))
    assert [x[2] for x in by["keep"]] == [10]
    assert sorted(x[2] for x in by["clear"]) == [11, 12]
    new = [(1, a, b) for a, b, _ in by["mark"]]
    assert not {(a, b) for _, a, b in new} & {(a, b) for _, a, b in gold}
    joined = _brute_labels(edges + [(1, 2, 3)] + new, nodes)
    assert len(set(joined.values())) == 1
    assert len(new) == 3  # four components after the kept bridge


def test_bridge_plan_joins_all_that_allowed_pairs_can_join(spark):
    """Every dimension is another graph: nearly all pairs gold, in every order, some beyond joining."""
    rng = random.Random(4)
    edges, nodes, gold = [], [], []
    for d in range(12):
        n = rng.randint(3, 7)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        nodes += [(d, i) for i in range(n)]
        gold += [(d, a, b) for a, b in pairs if rng.random() < (0.2, 0.6, 0.9, 1.0)[d % 4]]
        edges += [(d, a, b) for a, b in pairs if rng.random() < 0.1]
    nodes += [(99, i) for i in range(6)]
    gold += [(99, 0, 1), (99, 1, 2), (99, 2, 3)]
    plan = graph.bridge_plan(
        spark.createDataFrame(edges, "dimension_id int, u int, v int"),
        spark.createDataFrame(nodes, "dimension_id int, node int"),
        spark.createDataFrame([], "dimension_id int, u int, v int, question_id bigint"),
        spark.createDataFrame(gold, "dimension_id int, item_a int, item_b int"),
        seed=5,
    ).collect()
    new = [(r["dimension_id"], r["item_a"], r["item_b"]) for r in plan]
    assert not set(new) & set(gold)
    places = {}
    for d, i in nodes:
        places.setdefault(d, []).append(i)
    allowed = [(d, a, b) for d, ids in places.items() for a in ids for b in ids if a < b and (d, a, b) not in set(gold)]
    before, after, best = (_brute_labels(e, nodes) for e in (edges, edges + new, edges + allowed))
    assert after == best
    roots = lambda labels: sum(k[1] == v for k, v in labels.items())
    assert len(new) == roots(before) - roots(after)  # no circles


@pytest.mark.parametrize("limit", [10**6, 7])
def test_ordered_scan_in_blocks(spark, limit):
    """lag, running sum and position agree with brute force whether a group fits a task or not."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "cold", t, rng.randrange(9)) for t in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, v int")
    groups = OrderedGroups(df, ["k"], ["t"], rows_per_task=limit)
    assert groups.blocked == (limit == 7)
    result = groups.with_lag("v", "before").with_running_sum(F.col("v").cast("bigint"), "sum").with_position("at").result
    wanted, state = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        before, total, at = state.get(k, (None, 0, -1))
        wanted[k, t] = (before, total + v, at + 1)
        state[k] = (v, total + v, at + 1)
    got = {(r["k"], r["t"]): (r["before"], r["sum"], r["at"]) for r in result.collect()}
    assert got == wanted


def _rows(spark, n=60):
    rows = [("f" if i % 3 else "g", i, f"p{i % 7}", i % 9, 1.0 + i % 5) for i in range(n)]
    return spark.createDataFrame(
        rows, "fit string, response_id bigint, respondent_id string, cell_of int, weight double"
    )


def _drawn(df):
    return sorted(map(tuple, df.collect()))


def test_draws_do_not_depend_on_partitions_bundles_or_runs(spark):
    rows = _rows(spark)
    draw = lambda df, seed=9, **o: _drawn(resample.resample(df, ["fit"], ["cell_of"], 5, seed, **o))
    one = draw(rows.coalesce(1))
    assert one == draw(rows.repartition(7))
    assert one == draw(rows, rows_per_task=1) == draw(rows, rows_per_task=4, reps_per_task=2)
    sizes = {}
    for fit, rep, _, _, times in one:
        sizes[fit, rep] = sizes.get((fit, rep), 0) + times
    assert sizes == {(f, r): (40 if f == "f" else 20) for f in "fg" for r in range(5)}
    assert one != draw(rows, 10)
    by_person = draw(rows, cluster="respondent_id")
    assert by_person == draw(rows, cluster="respondent_id", rows_per_task=1, reps_per_task=1)


def test_cluster_draws_keep_people_whole(spark):
    rows = _rows(spark)
    drawn = resample.resample(rows, ["fit"], ["response_id"], 5, 4, cluster="respondent_id")
    times = {}
    for r in drawn.join(rows.select("response_id", "respondent_id", F.col("weight").alias("one")), "response_id").collect():
        assert r["weight"] == pytest.approx(r["times"] * r["one"])
        times.setdefault((r["fit"], r["rep"], r["respondent_id"]), set()).add(r["times"])
    assert all(len(v) == 1 for v in times.values())
    for fit in "fg":
        for rep in range(5):
            assert sum(next(iter(v)) for k, v in times.items() if k[:2] == (fit, rep)) == 7


def test_units_of_many_bundles_travel_once(spark):
    """Few bundles are dealt out by runs of replicates, many go to one task each; the draws are the same."""
    rows = _rows(spark, 1200)
    found = resample.cells(rows, ["fit"], ["cell_of"])
    blocks = lambda **o: resample.replicate_blocks(rows, found, ["fit"], ["cell_of"], 21, 9, **o)
    firsts = lambda df: {r["first"] for r in df.collect()}
    assert firsts(blocks()) == {0, 11} and firsts(blocks(rows_per_task=1)) == {0}
    drawn = [_drawn(resample.long(b, found, ["fit"], ["cell_of"])) for b in (blocks(), blocks(rows_per_task=1))]
    assert drawn[0] == drawn[1] == _drawn(resample.resample(rows, ["fit"], ["cell_of"], 21, 9, reps_per_task=8))


def test_both_widths_read_the_log_once(spark):
    draw = random.Random(6)
    rows = [(1, i % 17, *sorted(draw.sample((1, 2, 3, 4), 2)), draw.choice("ab"), 1.0) for i in range(400)]
    columns = "dimension_id int, respondent_id int, item_a int, item_b int, choice string, weight double"
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for part in batches:
            read.add(len(part))
            yield part

    log = spark.createDataFrame(rows, columns).mapInPandas(counted, columns)
    pool = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "item_id int")
    for plan in (models.g10_bootstrap_width_ratio, replicates.g10_width_ratio_fixed_rounds):
        read.value = 0
        ratio = plan(SimpleNamespace(wpairs=log, pool=pool)).collect()
        assert read.value == 400 and len(ratio) == 1 and ratio[0]["ratio"] > 0
    apart, _ = paired.fit_dimensions(log, pool, n_rep=20, seed=3, cluster="respondent_id")
    ready = paired.compared(log)
    paired.fit_dimensions(log, pool, n_rep=20, seed=3, ready=ready)
    shared, _ = paired.fit_dimensions(log, pool, n_rep=20, seed=3, cluster="respondent_id", ready=ready)
    ends = lambda df: sorted((r["item_id"], r["n"], r["support"], *(round(r[c], 9) for c in ("value", "low", "high"))) for r in df.collect())
    assert ends(apart) == ends(shared)


def test_draws_have_the_moments_of_a_multinomial():
    size = np.array([1, 5, 50, 500, 3, 41, 4_000])
    n, reps = size.sum(), np.arange(4_000)
    times = multinomial.times((77, 88), reps, len(size), n, size)
    assert (times.sum(axis=0) == n).all()
    assert times.mean(axis=1) == pytest.approx(size, rel=0.06)
    assert times.var(axis=1) == pytest.approx(size * (1 - size / n), rel=0.12)
    joint = np.cov(times) + np.outer(size, size) / n
    assert abs(joint[3, 6]) < 20  # covariances are -a b / n, here about 435


def test_bundles_draw_as_the_whole_tree_does():
    draw = np.random.default_rng(3)
    for size in (draw.integers(1, 2_000, 700), np.ones(700, int)):
        n, reps = int(size.sum()), np.arange(6)
        whole = multinomial.times((1, 2), reps, len(size), n, size)
        for width in (1, 8, 64, 1_024):
            parts = [size[i : i + width] for i in range(0, len(size), width)]
            totals = np.array([p.sum() for p in parts])
            got = [multinomial.times((1, 2), reps, len(size), n, p, k, totals) for k, p in enumerate(parts)]
            assert (np.concatenate(got) == whole).all()


def test_binomial_quantiles_by_sums_and_by_integrals_agree():
    u = np.random.default_rng(5).random(5_000)
    for m, p in ((8_000, 0.5), (100_000, 0.03), (120_000, 0.4)):
        m, p = np.full(len(u), m), np.full(len(u), p)
        assert (multinomial._enumerated(m, p, u) != multinomial._integrated(m, p, u)).sum() <= 1
    for m, p in ((131_071, 1e-5), (100_000, 2e-3)):
        m, p = np.full(len(u), m), np.full(len(u), p)
        rare = multinomial._enumerated(m, p, u, multinomial._log_mass_rare)
        assert (multinomial._enumerated(m, p, u) == rare).all()
    huge = np.full(len(u), 10**12)
    hit = multinomial.binomial(huge, np.full(len(u), 1), np.full(len(u), 10**6 - 1), u)
    assert hit.mean() == pytest.approx(10**6, rel=1e-4) and hit.std() == pytest.approx(10**3, rel=0.05)
    assert multinomial.binomial(np.array([5, 5]), np.array([0, 3]), np.array([3, 0]), u[:2]).tolist() == [0, 5]


def test_replicates_side_by_side_equal_replicates_one_by_one(spark):
    """Two parts, one of them without a cycle; a warm start ends at the same strengths."""
    draw = random.Random(2)
    rows = [("x", *draw.sample((1, 2, 3, 4), 2), 1.0 + draw.random()) for _ in range(300)]
    rows += [("x", *draw.sample((7, 8, 9), 2), 1.0) for _ in range(200)]
    df = spark.createDataFrame(rows, "fit string, winner int, loser int, weight double")
    found = resample.cells(df, ["fit"], ["winner", "loser"])
    edges = paired._edges_of(found, ["fit"])
    labels = graph.components(edges, edges.select("fit", F.explode(F.array("u", "v")).alias("node")), ["fit"])
    blocks = resample.replicate_blocks(df, found, ["fit"], ["winner", "loser"], 6, 5, rows_per_task=64)
    stats = resample.long(blocks, found, ["fit"], ["winner", "loser"])
    one = paired.bt_grouped(paired._labelled(stats, labels, ["fit"]), ["fit", "rep", "label"], 0.5, 500, 1e-11)
    want = {(r["rep"], r["item_id"]): r["theta"] for r in one.collect()}
    start = labels.select("fit", F.col("node").alias("item_id"), (F.col("node") / 10.0).alias("theta"))
    for begin in (None, start):
        solved = paired.bt_blocks(blocks, found, labels, ["fit"], 0.5, 500, 1e-11, begin).collect()
        assert len(solved) == 6 and all(r["preserved"] for r in solved)
        got = {(r["rep"], i): t for r in solved for i, t in zip(r["items"], r["theta"], strict=True)}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_poisson_draws_average_to_one(spark):
    rows = _rows(spark, 300)
    drawn = resample.poisson(rows, ["fit"], 40, 1)
    total = drawn.agg(F.sum("times")).first()[0]
    assert total / (300 * 40) == pytest.approx(1.0, abs=0.03)


def test_replicates_that_split_the_graph_are_dropped(spark):
    """Items 3 and 4 hang on one single comparison: many replicates miss it and the fit fails."""
    rows = [("x", i, 1, 2, 1.0) for i in range(30)] + [("x", 99, 2, 3, 1.0)]
    rows += [("whole", i, 1 + i % 2, 3, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "fit string, response_id bigint, winner int, loser int, weight double")
    edges = paired._edges_of(df, ["fit"])
    nodes = edges.select("fit", F.explode(F.array("u", "v")).alias("node"))
    labels = graph.components(edges, nodes, ["fit"])
    stats, report = resample.replicate_stats(
        df, labels, ["fit"], ["winner", "loser"], paired._edges_of, 20, 5
    )
    got = {r["fit"]: r for r in report.collect()}
    assert got["x"]["failed"] and not got["whole"]["failed"]
    assert got["whole"]["attempts"] == 20 and got["whole"]["discarded"] == 0
    assert {r["fit"] for r in stats.select("fit").distinct().collect()} == {"whole"}


def _answers(spark):
    rng = random.Random(3)
    strength = {1: 1.2, 2: 0.4, 3: -0.3, 4: -1.0}
    rows = []
    for i in range(400):
        a, b = sorted(rng.sample(sorted(strength), 2))
        x = strength[a] - strength[b] + rng.gauss(0, 1.2)
        level = sum(x > t for t in (-1.5, -0.5, 0.5, 1.5))
        rows.append(("mid", i, a, b, level, 1.0))
    return spark.createDataFrame(
        rows, "role string, response_id bigint, item_a int, item_b int, level int, weight double"
    )


def _lane_problem(spark):
    rows = _answers(spark)
    stat = ["item_a", "item_b", "level"]
    found = resample.cells(rows, ["role"], stat)
    ends = F.array(F.struct(F.col("item_a").alias("u"), F.col("item_b").alias("v")))
    sided = ordinal._lane_sides(found).withColumn("ends", ends)
    edges = ordinal._lane_edges(found, ["role"])
    labels = graph.components(edges, edges.select("role", F.explode(F.array("u", "v")).alias("node")), ["role"])
    return rows, stat, found, sided, labels


def test_ordinal_fit_reaches_a_zero_gradient(spark):
    _, _, _, sided, labels = _lane_problem(spark)
    model = (labels, ["role"], 5, "epsilon", {"item": 0.5}, 100, 1e-12)
    params = ordinal.long_params(ordinal.ordinal_blocks(ordinal.whole(sided, ["role"]), sided, *model), ["role"])
    raw, taus = ordinal.split_taus(params, ["role"])
    slopes = ordinal.penalised(
        ordinal.ordinal_gradient(sided, raw, taus, ["role"], 5), raw, ["role"], "epsilon", F.lit(0.5)
    ).collect()
    assert len(slopes) == 6
    assert max(abs(r["slope"]) for r in slopes) < 1e-6
    value = {r["param"]: r["value"] for r in raw.collect()}
    assert value["1"] > value["2"] > value["3"] > value["4"]
    tau = taus.first()
    assert 0 < tau["tau1"] < tau["tau2"]


def test_spread_rows_end_where_rows_in_one_task_end(spark):
    """One solver: the same replicates with every sum a job, and from a warm start."""
    rows, stat, found, sided, labels = _lane_problem(spark)
    blocks = resample.replicate_blocks(rows, found, ["role"], stat, 3, 5)
    model = (labels, ["role"], 5, "epsilon", {"item": 0.5}, 30, 1e-9)
    read = lambda df: {(r["rep"], p): v for r in df.collect() for p, v in zip(r["names"], r["values"], strict=True)}
    near = ordinal.ordinal_blocks(blocks, sided, *model)
    want = read(near)
    assert all(r["preserved"] for r in near.collect())
    begin = ordinal.ordinal_blocks(ordinal.whole(sided, ["role"]), sided, *model).select("role", "names", "values")
    for other in (
        ordinal.ordinal_blocks(blocks, sided, *model, rows_per_task=0),
        ordinal.ordinal_blocks(blocks, sided, *model, start=begin),
    ):
        got = read(other)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_sparse_newton_equals_a_dense_one():
    """Rows of up to six parameters, a ridge: the gradient is zero and every part of it is right."""
    draw = np.random.default_rng(4)
    index = np.array([draw.choice(9, 6, replace=False) for _ in range(40)])
    sign = np.tile([1.0, 1.0, 1.0, -1.0, -1.0, -1.0], (40, 1))
    for levels in (3, 5):
        weight = draw.random((40, levels, 2)) * (draw.random((40, levels, 2)) > 0.3)
        rows, ridge = newton.Rows(index, sign, weight, 9), newton.Ridge(np.linspace(0.1, 1.0, 9))
        x, tau = newton.maximise(rows, 9, levels, 2, ridge, weight.sum(axis=(0, 1)), 100, 1e-12)
        cost = lambda x, tau: rows.value(x, tau) - ridge.cost(x)  # noqa: B023, E731
        top = cost(x, tau)
        for i in range(9 + len(tau)):
            for h in (1e-4, -1e-4):
                y, t = x.copy(), tau.copy()
                (y if i < 9 else t)[i if i < 9 else i - 9] += h
                assert (cost(y, t) <= top + 1e-12).all()
        v = draw.normal(size=(9 + len(tau), 2))
        ahead, behind = (rows.slope(x + s * v[:9], tau + s * v[9:]) for s in (1e-6, -1e-6))
        change = (np.concatenate(behind[:2]) - np.concatenate(ahead[:2])) / 2e-6
        assert rows.curve(x, tau, v) == pytest.approx(change, abs=1e-4)


def test_margins_of_pairs_over_replicates(spark, monkeypatch):
    """Percentiles of every pair's margin, also with items in several blocks."""
    monkeypatch.setattr(ordinal, "ITEMS_PER_BLOCK", 2)
    draw = np.random.default_rng(1)
    values = draw.normal(size=(7, 5)).tolist()
    rows = [("mid", r, [*"12345", "tau1", "tau2"], [*values[r], 0.4, 1.1]) for r in range(7)]
    solved = spark.createDataFrame(rows, "role string, rep int, names array<string>, values array<double>")
    labels = spark.createDataFrame([("mid", i, 1 if i < 5 else 9) for i in range(1, 6)], "role string, node int, label int")
    pool = spark.createDataFrame([(i, ["mid"]) for i in range(1, 6)], "item_id int, roles array<string>")
    got = {(r["item_a"], r["item_b"]): (r["low"], r["high"]) for r in ordinal.margin_intervals(solved, labels, pool).collect()}
    assert got.keys() == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    for (a, b), ends in got.items():
        d = np.array([v[a - 1] - v[b - 1] for v in values])
        reach = [1 / (1 + np.exp(c - d)) for c in (-1.1, -0.4, 0.4, 1.1)]
        assert ends == pytest.approx(tuple(np.percentile(sum(reach) / 2 - 1, [2.5, 97.5])))


def test_streaks_in_blocks(spark):
    minutes = [0, 10, 40, 71, 72, 200, 230, 260, 290, 400]
    rows = [("p", i, m * 60) for i, m in enumerate(minutes)]
    heads = spark.createDataFrame(rows, "respondent_id string, response_id bigint, s bigint").withColumn(
        "created_at", F.timestamp_seconds("s")
    )
    for limit in (10**6, 2):
        row = behaviour.answer_streak(heads, 30, rows_per_task=limit).first()
        assert (row["current_streak"], row["best_streak"]) == (1, 4)


def test_poisson_hashes_a_draw_once(spark):
    rows = spark.range(50).select(F.lit("f").alias("fit"), F.col("id").alias("response_id"))
    drawn = resample.poisson(rows, ["fit"], 10, 1)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "lambda" not in plan
    steps = resample.poisson_steps()
    wanted = spark.range(50).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("rep")).select(
        "rep", "id", C.hash_draw(1, F.lit("f"), "rep", "id").alias("d")
    )
    times = {(r["rep"], r["id"]): sum(r["d"] >= t for t in steps) for r in wanted.collect()}
    assert {(r["rep"], r["response_id"]): r["times"] for r in drawn.collect()} == {k: n for k, n in times.items() if n}


def test_published_peaks_take_all_replicates_of_a_run(monkeypatch):
    import __spark_entry__ as entry
    from crowdgauge import settings as S

    asked = []
    monkeypatch.setattr(replicates.full, "fit_peaks", lambda w, pool, n_rep, seed: asked.append(n_rep))
    monkeypatch.setattr(replicates.outputs, "peak_table", lambda *_: None)
    replicates.a7_peak_table(SimpleNamespace(wpeaks=None, pool=None, items=None))
    assert asked == [S.DEFAULTS["aggregation.bootstrap_samples"]] == [2000]
    assert "range(2000)" in entry.oracle_sql()["a7_peak_table"]


def test_sql_of_single_draws_sums_to_the_same_times():
    import duckdb

    from crowdgauge.plans.draws import drawn_sql, times_sql

    rows = ", ".join(f"({k}, {i}, {1 + (7 * i + k) % 900})" for k in (1, 2) for i in range(3 + 40 * k))
    units = f"WITH units(k, i, c) AS (VALUES {rows}), "
    said = duckdb.sql(f"{units}{times_sql('units', ['k'], 3, 5)} SELECT * FROM times ORDER BY ALL").fetchall()
    summed = "SELECT k, rep, i, sum(times)::BIGINT AS times FROM drawn GROUP BY ALL ORDER BY ALL"
    assert said and duckdb.sql(f"{units}{drawn_sql('units', ['k'], 3, 5)} {summed}").fetchall() == said
