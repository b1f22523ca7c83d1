"""Closed formulas against published and table-driven values."""

from __future__ import annotations

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import agreement, annotators, estimate, question_stats

COUNTERS = (
    "gold_attempts", "gold_passed", "retest_pairs", "retest_consistent", "fast_answers",
    "straightline_runs", "answers_count",
)


def test_trust_table(spark):
    rows = [
        (0, 0, 0, 0, 0, 0, 0, "0.500"),
        (1, 0, 0, 0, 0, 0, 0, "0.400"),
        (1, 1, 0, 0, 0, 0, 0, "0.600"),
        (4, 0, 0, 0, 0, 0, 0, "0.300"),
        (5, 0, 0, 0, 0, 0, 0, "0.286"),
        (10, 10, 10, 8, 0, 0, 200, "0.850"),
        (0, 0, 0, 0, 2, 0, 5, "0.475"),
        (0, 0, 0, 0, 3, 0, 200, "0.475"),
        (0, 0, 0, 0, 0, 1, 5, "0.475"),
        (0, 0, 0, 0, 400, 0, 100, "0.250"),
    ]
    df = spark.createDataFrame(rows, [*COUNTERS, "wanted"])
    for row in df.withColumn("trust", C.trust(*COUNTERS)).collect():
        assert str(row["trust"]) == row["wanted"], row


def test_trust_stays_in_the_unit_interval(spark):
    df = spark.createDataFrame([(9, 9, 0, 0, 100, 0, 20)], list(COUNTERS))
    generous = C.trust(*COUNTERS, weights={"honeypot": 1.0, "retest": 1.0, "degenerate": 0.0})
    harsh = C.trust(*COUNTERS, weights={"honeypot": 0.6, "retest": 0.4, "degenerate": 2.0})
    row = df.select(generous.alias("high"), harsh.alias("low")).first()
    assert (str(row["high"]), str(row["low"])) == ("1.000", "0.000")


def test_retest_rules(spark):
    rows = [
        ("pairwise_dimension", ("a", None, None), ("a", None, None), True),
        ("pairwise_dimension", ("a", None, None), ("b", None, None), False),
        ("pairwise_dimension", ("unknown", None, None), ("a", None, None), None),
        ("pairwise_dimension", ("b", None, None), ("unknown", None, None), None),
        ("lane_matchup", ("a_strong", None, None), ("a_slight", None, None), True),
        ("lane_matchup", ("even", None, None), ("even", None, None), True),
        ("lane_matchup", ("a_slight", None, None), ("even", None, None), False),
        ("lane_matchup", ("a_strong", None, None), ("b_strong", None, None), False),
        ("peak_timing", (None, 20, None), (None, 25, None), True),
        ("peak_timing", (None, 20, None), (None, 15, None), True),
        ("peak_timing", (None, 20, None), (None, 26, None), False),
        ("duo_synergy", ("similar", None, None), ("similar", None, None), True),
        ("duo_synergy", ("pair_1", None, None), ("similar", None, None), False),
        ("trait_multiselect", (None, None, ["engage", "dive"]), (None, None, ["engage", "dive", "peel"]), True),
        ("trait_multiselect", (None, None, ["engage", "dive"]), (None, None, ["engage", "poke"]), False),
    ]
    answer = "struct<choice:string,minute:int,traits:array<string>>"
    df = spark.createDataFrame(rows, f"type string, x {answer}, y {answer}, wanted boolean")
    for row in df.withColumn("got", C.consistent(F.col("type"), F.col("x"), F.col("y"))).collect():
        assert row["got"] == row["wanted"], row


def test_krippendorff_published_example(spark):
    """Krippendorff (2011): four observers, twelve units, values 1 to 5 with gaps."""
    observers = [
        [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
        [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
        [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
        [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
    ]
    rows = [
        (scale, scale, str(unit), float(value))
        for scale in ("nominal", "ordinal", "interval")
        for line in observers
        for unit, value in enumerate(line)
        if value is not None
    ]
    units = spark.createDataFrame(rows, "magnitude string, scale string, unit string, value double")
    got = {r["magnitude"]: r for r in agreement.alpha(units).collect()}
    wanted = {"nominal": 0.743, "ordinal": 0.815, "interval": 0.849}
    for scale, value in wanted.items():
        assert got[scale]["alpha"] == pytest.approx(value, abs=5e-4)
        assert (got[scale]["units"], got[scale]["pairable"]) == (11, 40)


def test_alpha_is_null_without_variation(spark):
    rows = [("same", "nominal", str(u), 1.0) for u in (1, 1, 2, 2)]
    units = spark.createDataFrame(rows, "magnitude string, scale string, unit string, value double")
    assert agreement.alpha(units).first()["alpha"] is None


def _history(spark, sequences):
    rows = []
    for name, choices in sequences.items():
        for i, choice in enumerate(choices):
            kind, _, value = choice.rpartition("/")
            rows.append((name, i, i, kind or "lane_matchup", value))
    return spark.createDataFrame(
        rows, "respondent_id string, response_id bigint, created_at bigint, type string, choice string"
    )


RUNS = {
    "eight": (["even"] * 8, 1),
    "seven": (["even"] * 7, 0),
    "sixteen": (["even"] * 16, 1),
    "two": (["even"] * 8 + ["a_slight"] + ["even"] * 8, 2),
    "cut": (["even"] * 4 + ["unknown"] + ["even"] * 4, 0),
    "unsure": (["unknown"] * 20, 0),
    "levels": (["a_strong", "a_slight"] * 4, 0),
    "mixed": (["lane_matchup/even", "peak_timing/20"] * 8, 1),
    "ranking": (["pairwise_dimension/a"] * 20, 0),
}


@pytest.mark.parametrize("rows_per_task", [1_000_000, 3])
def test_straightline_runs(spark, rows_per_task):
    """The blocked scan counts the same runs as the plain window."""
    heads = _history(spark, {k: v[0] for k, v in RUNS.items()})
    got = {
        r["respondent_id"]: r["straightline_runs"]
        for r in annotators.straightline_runs(heads, 8, rows_per_task).collect()
    }
    for name, (_, wanted) in RUNS.items():
        assert got.get(name, 0) == wanted, name


def test_entropies_and_median(spark):
    cases = [
        (1, "pairwise_dimension", {"a": 50, "b": 50}, "1.0000", None),
        (2, "pairwise_dimension", {"a": 40, "unknown": 7}, "0.0000", None),
        (3, "pairwise_dimension", {"unknown": 5}, None, None),
        (4, "lane_matchup", {"a_strong": 5, "a_slight": 5, "even": 10, "b_strong": 10}, "1.0000", None),
        (5, "lane_matchup", {"a_strong": 7, "a_slight": 3}, "0.0000", None),
        (6, "peak_timing", {"20": 1, "26": 1, "32": 1}, "0.5000", 26),
        (7, "peak_timing", {"0": 1, "40": 1}, "1.0000", 20),
        (8, "peak_timing", {"27": 30}, "0.0000", 27),
        (9, "peak_timing", {"27": 1}, None, 27),
        (10, "peak_timing", {"24": 1, "25": 1}, "0.0417", 25),
        (11, "peak_timing", {"9": 1, "10": 1, "30": 1}, "0.8750", 10),
        (12, "trait_multiselect", {"_total": 4, "x": 2, "y": 4}, "0.5000", None),
    ]
    rows = [(q, kind, k, n) for q, kind, counts, _, _ in cases for k, n in counts.items()]
    counts = spark.createDataFrame(rows, "question_id bigint, type string, key string, n bigint")
    traits = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "code string, is_active boolean")
    got = {r["question_id"]: r for r in question_stats.entropies(counts, traits).collect()}
    for q, _, _, entropy, median in cases:
        assert (None if got[q]["entropy"] is None else str(got[q]["entropy"])) == entropy, q
        assert got[q]["median_minute"] == median, q


def test_weighted_median_boundary(spark):
    rows = [("edge", 10, 1.0), ("edge", 20, 1.0), ("heavy", 10, 1.0), ("heavy", 20, 1.0), ("heavy", 30, 5.0)]
    df = spark.createDataFrame(rows, "k string, v int, w double")
    got = {r["k"]: r["median"] for r in estimate.weighted_median(df, ["k"], "v", "w").collect()}
    assert got == {"edge": 15.0, "heavy": 30.0}


def test_proportions_and_effective_size(spark):
    rows = [(1, ["engage"], 3.0), (1, ["poke"], 1.0)]
    w = spark.createDataFrame(rows, "item_a int, traits array<string>, weight double")
    options = spark.createDataFrame([("engage",), ("poke",), ("peel",)], "code string")
    got = {r["trait"]: r for r in estimate.proportions(w, options).collect()}
    assert got["engage"]["value"] == pytest.approx(0.75)
    assert got["peel"]["value"] == 0.0 and got["engage"]["n"] == 2
    assert got["engage"]["n_eff"] == pytest.approx(16 / 10)
    by_count = spark.range(1).select(*C.wilson(F.lit(0.5), F.lit(8.0))).first()
    narrow = spark.range(1).select(*C.wilson(F.lit(0.5), F.lit(3.5**2 / 3.05))).first()
    assert narrow[1] - narrow[0] > by_count[1] - by_count[0]


def test_number_format(spark):
    values = [0.0625, -0.0001, 2.675, 1234.5, None, -1.5, 0.0005, -0.0015, 0.0025, 1.0005, 12.3455, 7e15]
    values += [k / 2000 for k in range(-41, 41)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(C.fmt_number("x", 3)).collect()]
    wanted = []
    for v in values:
        text = "" if v is None else f"{v:.3f}"
        wanted.append(text[1:] if text.startswith("-") and float(text) == 0 else text)
    assert got == wanted


def test_hmac_matches_the_standard_library(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("",), (None,)], "ip string")
    got = [r[0] for r in df.select(C.hmac256("ip", "pepper" * 20)).collect()]
    key = ("pepper" * 20).encode()
    assert got == [hmac.new(key, b"10.0.0.1", hashlib.sha256).hexdigest(), None, None]
    assert df.select(C.hmac256("ip", "")).first()[0] is None


def test_support_needs_sample_and_width(spark):
    df = spark.createDataFrame(
        [(25, 0.0, 0.6), (25, 0.0, 0.7), (24, 0.0, 0.1), (9, 0.0, 0.1), (99, None, 1.0)],
        "n int, low double, high double",
    )
    got = [r[0] for r in df.select(C.support("dimension", "n", "low", "high")).collect()]
    assert got == ["solid", "limited", "limited", "insufficient", "insufficient"]


def test_expected_margin_is_antisymmetric(spark):
    row = spark.range(1).select(
        C.expected_margin(F.lit(0.7), F.lit(0.4), F.lit(1.1)).alias("x"),
        C.expected_margin(F.lit(-0.7), F.lit(0.4), F.lit(1.1)).alias("y"),
        C.expected_margin(F.lit(0.0), F.lit(0.4), F.lit(1.1)).alias("z"),
    ).first()
    assert row["x"] == pytest.approx(-row["y"]) and row["x"] > 0
    assert row["z"] == pytest.approx(0.0, abs=1e-12)


def test_power_curve(spark):
    got = spark.range(1).select(C.power_at(15, F.lit(20.0), 7.5)).first()[0]
    assert got == pytest.approx(math.exp(-25 / (2 * 7.5**2)))


def test_spearman_with_ties(spark):
    rows = [("k", 1.0, 2.0), ("k", 2.0, 1.0), ("k", 2.0, 4.0), ("k", 5.0, 4.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in estimate.spearman(df, ["g"], "x", "y").collect()}
    # average ranks 1, 2.5, 2.5, 4 against 2, 1, 3.5, 3.5
    assert got["k"] == pytest.approx(0.5, abs=1e-9)
    assert got["flat"] is None


def test_thresholds_are_the_published_ones():
    assert len(S.SUPPORT_THRESHOLDS) == 10 and S.DEFAULTS["aggregation.bootstrap_samples"] == 2000
