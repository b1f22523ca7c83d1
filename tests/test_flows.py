"""Whole flows on small fixtures: selection, publication, candidates and streams."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.operators import behaviour, candidates, merge, rankings, select, validate
from crowdgauge.plans import run as full
from crowdgauge.sources import binding, catalogs, outputs
from crowdgauge.streaming import streams

DIRECTORY = "/root/testdata/sf0.001"


def test_window_is_resolved_by_release_date(spark):
    rows = [(1, "16.9", dt.date(2030, 1, 1)), (2, "16.10", dt.date(2030, 2, 1)), (3, "16.20", dt.date(2030, 3, 1))]
    patches = spark.createDataFrame(rows, "patch_id int, version string, released_at date")
    got = {r["patch_id"] for r in select.patch_window(patches, "16.9", "16.20").collect()}
    assert got == {1, 2, 3}
    with pytest.raises(ValueError, match="inverted"):
        select.patch_window(patches, "16.20", "16.9")
    with pytest.raises(ValueError, match="unknown"):
        select.patch_window(patches, "16.1", "16.9")


def test_an_answer_after_the_export_never_gains_weight(spark):
    rows = [(1.0, dt.datetime(2030, 1, 30)), (1.0, dt.datetime(2030, 1, 10)), (0.5, dt.datetime(2029, 12, 20))]
    df = spark.createDataFrame(rows, "trust_score double, created_at timestamp")
    got = [r["weight"] for r in select.with_weight(df, "2030-01-10", 21).collect()]
    assert got == pytest.approx([1.0, 1.0, 0.25])


def test_ranking_pairs_and_not_sure(spark):
    rows = [(1, "p", 1, 1, [3, 1, 2], [2, 3, 1]), (2, "p", 1, 1, [1, 2], None)]
    df = spark.createDataFrame(
        rows,
        "ranking_id int, respondent_id string, patch_id int, dimension_id int, items array<int>, submitted_order array<int>",
    )
    got = {(r["ranking_id"], r["item_a"], r["item_b"]): (r["choice"], r["is_extreme"]) for r in rankings.ranking_to_pairs(df).collect()}
    assert got == {
        (1, 2, 3): ("a", False),
        (1, 1, 2): ("b", True),
        (1, 1, 3): ("b", False),
        (2, 1, 2): ("unknown", True),
    }


def test_ranking_orders_are_checked(spark):
    rows = [([1, 2, 3], [3, 2, 1]), ([1, 2, 3], None), ([1, 2, 3], [1, 2]), ([1, 2, 3], [1, 1, 2]), ([1, 2, 3], [1, 2, 9])]
    df = spark.createDataFrame(rows, "shown array<int>, said array<int>")
    got = [r[0] for r in df.select(validate.ranking_problem(F.col("said"), F.col("shown"))).collect()]
    assert got == [None, None, "length", "repeated", "foreign"]


def test_upsert_protects_columns_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "one", 1), (2, "two", 2)], "id int, name string, tier int")
    incoming = spark.createDataFrame([(2, "TWO", 3), (3, "three", 3)], "id int, name string, tier int")
    once = merge.upsert(target, incoming, "id", ["name"])
    assert sorted((r["id"], r["name"], r["tier"], r["change"]) for r in once.collect()) == [
        (1, "one", 1, "kept"),
        (2, "TWO", 2, "updated"),
        (3, "three", 3, "inserted"),
    ]
    again = merge.upsert(once.drop("change"), incoming, "id", ["name"])
    assert sorted(map(tuple, again.drop("change").collect())) == sorted(map(tuple, once.drop("change").collect()))


def test_pick_rate_file(spark, tmp_path):
    path = tmp_path / "snapshot.csv"
    path.write_text("# source: x\n# taken by hand\nrole,name,pick_rate,rank_in_role\nmid,Item 1,0.1200,1\nmid,Item 2,0.1000,3\n")
    snapshot = catalogs.read_pick_rate(spark, str(path))
    assert [(r["role"], float(r["pick_rate"])) for r in snapshot.collect()] == [("mid", 0.12), ("mid", 0.1)]
    assert {r["problem"] for r in validate.validate_pick_rate(snapshot).collect()} == {"rank_gaps"}


def test_run_parameters_are_checked_and_seeded():
    with pytest.raises(ValueError):
        catalogs.check_run_ranges(0, 21, 7.5, 10)
    seed = catalogs.run_seed("16.18..16.20", 0.3, 21.0, 7.5, 2000)
    assert seed == catalogs.run_seed("16.18..16.20", 0.30, 21, 7.5, 2000)
    assert seed != catalogs.run_seed("16.18..16.20", 0.3, 21, 7.5, 100)


def test_digest_ignores_order_and_files(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(100)], "a int, b string")
    one = outputs.digest(df.coalesce(1)).first()
    many = outputs.digest(df.orderBy(F.desc("a")).repartition(9)).first()
    assert tuple(one) == tuple(many)
    assert one["digest"] != outputs.digest(df.withColumn("b", F.upper("b"))).first()["digest"]


@pytest.fixture(scope="module")
def small_run(spark):
    b = binding.Binding(spark, DIRECTORY)
    options = full.RunOptions("16.6..16.18", binding.EXPORTED_AT, n_rep=6, seed=5)
    return b, full.run(b.wresponses, b.items, b.pool, b.dimensions, b.traits, options)


def test_full_run_tables_have_the_published_headers(small_run):
    b, result = small_run
    pool = b.pool.count()
    assert list(result.tables) == list(S.HEADERS)
    for name, table in result.tables.items():
        assert tuple(table.columns) == S.HEADERS[name], name
    assert result.tables["champion_dimensions"].count() == pool * 5
    assert result.tables["champion_lane_strength"].count() == pool * 3
    assert result.tables["peak_timing"].count() == pool
    assert result.tables["champion_traits"].count() == pool * 3
    listed = {r["dataset"]: r for r in result.manifest.collect()}
    assert set(listed) == {*S.HEADERS, "quality_report"}
    assert listed["peak_timing"]["responses"] > 0


def test_full_run_intervals_hold_values_and_norms_span(small_run):
    scores = small_run[1].extra["scores"].toPandas()
    inside = (scores["low"] <= scores["value"] + 0.5) & (scores["value"] - 0.5 <= scores["high"])
    assert inside.all()
    span = scores.groupby("dimension_id")["norm"].agg(["min", "max"])
    assert (span["min"] == 0).all() and (span["max"] == 1).all()


def test_full_run_is_reproducible(spark, small_run):
    b, result = small_run
    options = full.RunOptions("16.6..16.18", binding.EXPORTED_AT, n_rep=6, seed=5)
    again = full.run(b.wresponses, b.items, b.pool, b.dimensions, b.traits, options)
    one = {r["dataset"]: r["digest"] for r in result.manifest.collect() if r["dataset"] != "quality_report"}
    two = {r["dataset"]: r["digest"] for r in again.manifest.collect() if r["dataset"] != "quality_report"}
    assert one == two


def test_a_run_without_data_fails(spark):
    b = binding.Binding(spark, DIRECTORY)
    options = full.RunOptions("w", binding.EXPORTED_AT, n_rep=2)
    with pytest.raises(full.NoDataError):
        full.run(b.wresponses.filter("false"), b.items, b.pool, b.dimensions, b.traits, options)


def test_a_run_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    out, columns = str(tmp_path / "runs"), {"peak_timing": ("key", "level"), "champion_traits": ("key", "value")}
    rows = [(f"k{i}", "limited" if i % 2 else None) for i in range(40)]
    tables = {n: spark.createDataFrame(rows, [f"{c}" for c in names]).repartition(3) for n, names in columns.items()}
    included = spark.createDataFrame([("peak_timing", 3, 2)], "dataset string, responses bigint, respondents bigint")

    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # the files are there, the manifest is not
        m.setattr(outputs, "manifest", broken)
        with pytest.raises(RuntimeError):
            outputs.publish(tables, included, "1", out, "a")
    assert outputs.published_runs(spark, out) == []
    with pytest.raises(outputs.NotPublished):
        outputs.read_published(spark, columns, "1", out, "a")
    listing = outputs.publish(tables, included, "1", out, "a")
    assert outputs.published_runs(spark, out) == ["a"]
    rows = {r["dataset"]: (r["digest"], r["rows"]) for r in listing.collect()}
    assert rows == {n: tuple(outputs.digest(t).first()) for n, t in tables.items()}
    back = outputs.read_published(spark, columns, "1", out, "a")
    assert {n: t.count() for n, t in back.items()} == {n: t.count() for n, t in tables.items()}
    with pytest.raises(FileExistsError):
        outputs.publish(tables, included, "1", out, "a")
    part = next((tmp_path / "runs" / "a" / "peak_timing_v1").glob("part-*.csv"))
    part.write_text(part.read_text().replace("limited", "solid"))
    (part.parent / f".{part.name}.crc").unlink()  # a change that the file system does not notice
    with pytest.raises(outputs.NotPublished, match="peak_timing"):
        outputs.read_published(spark, columns, "1", out, "a")


def test_a_run_without_data_writes_nothing(spark, tmp_path):
    b, out = binding.Binding(spark, DIRECTORY), str(tmp_path / "runs")
    with pytest.raises(full.NoDataError):
        full.run_and_publish(
            b.wresponses.filter("false"), b.items, b.pool, b.dimensions, b.traits,
            full.RunOptions("w", binding.EXPORTED_AT, n_rep=2), "1", out, "a",
        )
    assert not (tmp_path / "runs").exists()


def test_next_questions_are_new_distinct_and_varied(spark):
    variants = ["pairwise_dimension", "peak_timing", "lane_1v1", "duo_synergy"]
    hot = spark.createDataFrame(
        [(v, p + 1, 100 * i + p) for i, v in enumerate(variants) for p in range(6)],
        "variant string, place int, question_id bigint",
    )
    cold = spark.createDataFrame(
        [(v, 1000 + 100 * i + p) for i, v in enumerate(variants) for p in range(6)],
        "variant string, question_id bigint",
    )
    bridges = spark.createDataFrame([(1, 2), (2, 3)], "place int, question_id bigint")
    people = spark.createDataFrame(
        [("new", 0, []), ("old", 50, ["peak_timing"] * 3), ("mid", 9, ["lane_matchup", "peak_timing"])],
        "respondent_id string, answers_count int, recent array<string>",
    )
    answered = spark.createDataFrame([("old", 2), ("old", 1001), ("mid", 100)], "respondent_id string, question_id bigint")
    rows = candidates.next_questions(people, hot, cold, bridges, answered, 8, 0.5, seed=4).collect()
    per = {}
    for r in sorted(rows, key=lambda r: r["slot"]):
        per.setdefault(r["respondent_id"], []).append((r["variant"], r["question_id"]))
    assert all(len(v) == 8 for v in per.values())
    assert all(len({q for _, q in v}) == 8 for v in per.values())
    assert not {q for _, q in per["old"]} & {2, 1001} and 100 not in {q for _, q in per["mid"]}
    assert [v for v, _ in per["new"][:3]] == ["pairwise_dimension"] * 3
    assert [q for _, q in per["new"][:2]] == [2, 3]
    assert per["old"][0][0] != "peak_timing"
    for who, history in (("new", []), ("old", ["peak_timing"] * 3), ("mid", ["lane_matchup", "peak_timing"])):
        kinds = history + [candidates.VARIANT_TYPE[v] for v, _ in per[who]]
        for i in range(len(kinds) - 3):
            assert len(set(kinds[i : i + 4])) > 1, (who, kinds)


def test_next_questions_of_long_lists_reach_every_question(spark):
    """Bridges beyond the salted front, cold questions without a cut, and slots until nothing is left."""
    bridges = spark.createDataFrame([(i // 2, i) for i in range(400)], "place int, question_id bigint")
    hot = spark.createDataFrame([("peak_timing", 1, 5000), ("pairwise_dimension", 1, 7)], "variant string, place int, question_id bigint")
    cold = spark.createDataFrame(
        [("duo_synergy", 1000 + i) for i in range(900)] + [("peak_timing", 5000)], "variant string, question_id bigint"
    )
    done = {"late": set(range(300)) | {310}, "all": set(range(400)) | {5000} | set(range(1000, 1898)), "new": set()}
    log = [(w, q) for w, asked in done.items() for q in asked] + [("late", 0), ("all", 1000), ("stranger", 3)]
    answered = spark.createDataFrame(log, "respondent_id string, question_id bigint")
    people = spark.createDataFrame(
        [*((w, 99, []) for w in done), *((f"p{i}", 99, ["peak_timing"] * 2) for i in range(300))],
        "respondent_id string, answers_count int, recent array<string>",
    )
    rows = candidates.next_questions(people, hot, cold, bridges, answered, 5, 0.5, seed=9).collect()
    per, explored = {}, set()
    for r in sorted(rows, key=lambda r: r["slot"]):
        per.setdefault(r["respondent_id"], []).append((r["slot"], r["variant"], r["question_id"]))
    for who, batch in per.items():
        asked, paired = done.get(who, set()), [q for _, v, q in batch if v == "pairwise_dimension"]
        assert paired == [q for q in range(400) if q not in asked][: len(paired)], who
        assert [s for s, _, _ in batch] == list(range(2 if who == "all" else 5)), who
        found = [q for _, _, q in batch]
        assert len(set(found)) == len(found) and not set(found) & asked, who
        explored |= {q for q in found if 1000 <= q < 1900}
    assert {q for _, _, q in per["all"]} == {1898, 1899} and len(per) == 303
    assert len(explored) > 50 and max(explored) - min(explored) > 700


def test_next_questions_without_candidates(spark):
    people = spark.createDataFrame([("a", 0, [])], "respondent_id string, answers_count int, recent array<string>")
    none = spark.createDataFrame([], "variant string, place int, question_id bigint")
    seen = spark.createDataFrame([("a", 1)], "respondent_id string, question_id bigint")
    assert candidates.next_questions(people, none, none, none, seen, 3).count() == 0


def test_streams_over_many_files_equal_the_batch(spark, tmp_path):
    """The same log in eight files, one per trigger and newest first, against the batch twins.

    Files are read by modification time. With the newest first, everything else is late: a
    watermark that reaches over the whole log keeps it all, a short one drops answers.
    """
    b = binding.Binding(spark, DIRECTORY)
    log = b.log.select("response_id", "respondent_id", "question_id", "type", "choice", "created_at", "is_gold", "expected")
    log = log.withColumn("is_retest_of", F.lit(None).cast("bigint"))
    path = str(tmp_path / "log")
    log.repartitionByRange(8, "created_at").write.parquet(path)
    # part numbers follow the ranges, so the highest one holds the newest answers
    parts = sorted((tmp_path / "log").glob("part-*.parquet"), reverse=True)
    assert len(parts) == 8
    for age, part in enumerate(parts):
        os.utime(part, (1_700_000_000 + 60 * age,) * 2)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)

    def live():
        return streams.read_stream(spark, path, schema, files_per_trigger=1)

    deduped = streams.drain(streams.dedupe(live()), str(tmp_path / "d"))
    key = ["respondent_id", "question_id"]
    assert deduped.count() == deduped.select(key).distinct().count() == streams.dedupe_batch(log).count()
    state = streams.drain(streams.running_counters(live(), log), str(tmp_path / "c"), "complete")
    twin = streams.running_counters(log, log)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, twin.collect()))

    def best(delay):
        sessions = streams.answer_sessions(live(), delay=delay)
        table = streams.drain(sessions, str(tmp_path / f"s-{delay}"), "complete")
        grouped = table.groupBy("respondent_id").agg(F.max("n").alias("best"), F.sum("n").alias("answers"))
        return {r["respondent_id"]: (r["best"], r["answers"]) for r in grouped.collect()}

    volume = {r["respondent_id"]: r["n"] for r in log.groupBy("respondent_id").agg(F.count("*").alias("n")).collect()}
    want = {r["respondent_id"]: (r["best_streak"], volume[r["respondent_id"]]) for r in behaviour.answer_streak(log).collect()}
    assert best("60 days") == want
    assert sum(n for _, n in best("1 hour").values()) < sum(volume.values())


def test_admissible_with_and_without_a_folded_pool(spark, monkeypatch):
    b = binding.Binding(spark, DIRECTORY)
    asked = b.questions.filter(F.col("patch_id") == binding.CURRENT_PATCH)

    def served():
        rows = select.admissible(asked, b.pool, b.dimensions, b.traits).select("question_id").collect()
        return sorted(r[0] for r in rows)

    folded = served()
    monkeypatch.setattr(select, "CATALOG_LIMIT", 0)
    assert folded and served() == folded


def test_unseen_gold_against_brute_force(spark):
    gold = spark.createDataFrame([(q,) for q in range(7)], "question_id bigint")
    people = spark.createDataFrame([("none",), ("some",), ("all",), ("one",)], "respondent_id string")
    seen = {"some": [0, 3, 5], "all": range(7), "one": [2]}
    rows = [(p, q) for p, qs in seen.items() for q in qs] + [("some", 3), ("some", 99)]
    log = spark.createDataFrame(rows, "respondent_id string, question_id bigint")
    picks = set()
    for seed in range(3):
        got = {r["respondent_id"]: r for r in candidates.unseen_gold(people, gold, log, seed).collect()}
        for person in ("none", "some", "all", "one"):
            left = set(range(7)) - set(seen.get(person, []))
            assert got[person]["unseen"] == len(left)
            assert got[person]["question_id"] in left if left else got[person]["question_id"] is None
        picks.add(got["some"]["question_id"])
    assert len(picks) > 1


def test_members_inside_both_ways(spark, monkeypatch):
    rows = [(1, 1, 2, None, None), (2, 1, 9, None, None), (3, 3, None, None, None), (4, 1, 2, 3, 9)]
    q = spark.createDataFrame(rows, "question_id int, item_a int, item_b int, item_c int, item_d int")
    pool = spark.createDataFrame([(i,) for i in (1, 2, 3)], "item_id int")
    for limit in (20_000, 0):
        monkeypatch.setattr(select, "CATALOG_LIMIT", limit)
        got = {r["question_id"] for r in select.members_inside(q, pool).collect()}
        assert got == {1, 3}


def test_gold_catalog_files_are_checked(spark):
    rows = [
        (1, "A", "B", "poke", "a", "longer reach"),
        (2, "B", "A", "poke", "b", "the same pair"),
        (3, "C", "C", "poke", "a", "alone"),
        (4, "A", "C", "scaling", "a", "no fact decides"),
        (5, "A", "D", "peel", "even", " "),
    ]
    schema = "entry_id int, name_a string, name_b string, dimension string, expected string, rationale string"
    got = {(r["entry_id"], r["problem"]) for r in validate.validate_gold_entries(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (2, "repeated_pair"),
        (3, "same_item"),
        (4, "dimension_not_allowed"),
        (5, "expected"),
        (5, "no_rationale"),
    }


def _partitions(df, condition):
    return df.filter(condition).select(F.spark_partition_id().alias("p")).distinct().count()


def test_answers_without_a_ranking_are_spread_over_tasks(spark):
    """The key they lack must not put them all into one task."""
    rows = [(i, i % 7 if i % 4 == 0 else None, i % 3) for i in range(400)]
    log = spark.createDataFrame(rows, "response_id bigint, ranking_id bigint, question_id bigint")
    anchors = [(0, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0)]
    rankings_ = spark.createDataFrame(anchors, "ranking_id bigint, anchor_question_id bigint")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        found = select.heads(log, rankings_)
        assert _partitions(found, "ranking_id is null") > 1
        got = sorted(r["response_id"] for r in found.collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    wanted = [i for i, k, q in rows for a, x in anchors if k is not None and a == k and x == q]
    assert got == sorted(wanted + [i for i, k, _ in rows if k is None])


def test_answers_that_repeat_nothing_are_spread_over_tasks(spark):
    rows = [(i, i % 5, "pairwise_dimension", False, "a", "a", i - 5 if i % 10 == 9 else None) for i in range(100)]
    log = spark.createDataFrame(
        rows,
        "response_id bigint, respondent_id bigint, type string, is_gold boolean, choice string, expected string, is_retest_of bigint",
    ).withColumn("created_at", F.timestamp_seconds(F.col("response_id")))
    state = streams.running_counters(log, log)
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert "hash(response_id" in plan
    got = {r["respondent_id"]: (r["answers_count"], r["retest_pairs"], r["retest_consistent"]) for r in state.collect()}
    assert got == {i: (20, 10, 10) if i == 4 else (20, 0, 0) for i in range(5)}


def test_questions_come_out_of_the_log_without_sorting_it(spark):
    b = binding.Binding(spark, DIRECTORY)
    plan = b.questions._jdf.queryExecution().optimizedPlan().toString()
    assert "first(" not in plan and "count(1)" in plan
    ids = b.questions.select("question_id")
    assert ids.count() == ids.distinct().count() == b.responses.select("question_id").distinct().count()


def test_histograms_scan_the_log_once(spark):
    from crowdgauge.operators import agreement
    from crowdgauge.operators import question_stats as Q

    log = spark.range(120).select(
        (F.col("id") % 4).alias("question_id"), F.lit("lane_matchup").alias("type"), F.col("id").alias("respondent_id"),
        F.when(F.col("id") % 3 == 0, "even").otherwise("a_slight").alias("choice"), F.lit(1).alias("minute"),
        F.array(F.lit("A")).alias("traits"), F.lit(None).cast("bigint").alias("is_retest_of"),
    )

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")

    counts = Q.answer_counts(log)
    shares = Q.consensus(counts, 5)
    assert scans(shares) == 0 and shares.count() == 8
    rate = Q.agreement_rate(log, counts, spark.createDataFrame([(1,), (3,)], "respondent_id bigint"), 5)
    assert scans(rate) == 1 and {r[0]: r[1] for r in rate.collect()} == {1: 1.0, 3: 0.0}
    units = log.select(
        F.lit("m").alias("magnitude"), F.lit("nominal").alias("scale"), F.col("question_id").cast("string").alias("unit"),
        (F.col("choice") == "even").cast("double").alias("value"),
    )
    assert scans(agreement.alpha(units)) == 0


def test_published_run_counts_the_log_that_the_run_kept(spark, monkeypatch):
    from types import SimpleNamespace

    kept = spark.createDataFrame([("pairwise_dimension", "a", 7)], "type string, choice string, respondent_id bigint")
    result = full.RunResult({}, kept, kept, kept, {"log": kept})
    seen = SimpleNamespace()
    monkeypatch.setattr(full, "run", lambda *a: result)
    monkeypatch.setattr(full.estimate, "included", lambda log: log)
    monkeypatch.setattr(full.outputs, "publish", lambda tables, log, *a, **k: setattr(seen, "log", log))
    options = full.RunOptions("w", "2030-01-01")
    full.run_and_publish(None, None, None, None, None, options, "16.1", "out", "first")
    assert seen.log is kept


def test_gold_bridges_and_old_answers_are_taken_from_the_log_once(spark):
    from crowdgauge.plans import reporting

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    for part in reporting._patch_bridges(binding.Binding(spark, DIRECTORY)):
        assert "l_orderkey" not in plan(part) and "o_orderkey" not in plan(part)
    gold = spark.range(0, 5, 1, 1).withColumnRenamed("id", "question_id")
    people = spark.createDataFrame([(1,), (2,)], "respondent_id bigint")
    answers = spark.createDataFrame([(1, i) for i in range(5)], "respondent_id bigint, question_id bigint")
    found = candidates.unseen_gold(people, gold, answers, 3)
    assert "Range (" not in plan(found)
    assert {r["respondent_id"]: (r["unseen"], r["question_id"] is None) for r in found.collect()} == {1: (0, True), 2: (5, False)}
    log = spark.range(40).select(
        F.col("id").alias("response_id"), F.lit(1).alias("respondent_id"), (F.col("id") % 2).alias("question_id"),
        F.lit("lane_matchup").alias("type"), F.timestamp_seconds("id").alias("created_at"), F.lit("even").alias("choice"),
        F.lit(False).alias("is_gold"), F.lit(1).alias("patch_id"), F.lit(None).cast("bigint").alias("ranking_id"),
        F.lit(None).cast("bigint").alias("is_retest_of"), F.lit(1).alias("dimension_id"), F.lit(1).alias("item_a"), F.lit(2).alias("item_b"),
    )
    none = spark.createDataFrame(
        [], "ranking_id bigint, anchor_question_id bigint, respondent_id int, patch_id int, dimension_id int, submitted_order array<int>"
    )
    asked = spark.range(0, 1, 1, 1).withColumnRenamed("id", "question_id")
    again = candidates.retest_candidates(log, none, asked, 1, 15)
    assert "Range (0, 1," not in plan(again)
    assert sorted(r["response_id"] for r in again.collect()) == list(range(0, 26, 2))


def _small_tables(spark, folder):
    """Orders of seven lines, some of them twice, without a customer, brand, key or known part."""
    day = F.make_date(F.lit(1995) + F.col("id").cast("int") % 7, F.lit(2), F.lit(3)).cast("timestamp")
    status = F.element_at(F.array(*[F.lit(x) for x in "FOP"]), (F.col("id") % 3 + 1).cast("int"))
    orders = spark.range(60).select(
        F.when(F.col("id") != 7, F.col("id")).alias("o_orderkey"),
        F.when(F.col("id") % 11 != 3, F.col("id") % 4 + 20).alias("o_custkey"), status.alias("o_orderstatus"),
        F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"), day.alias("o_orderdate"),
    )
    lines = spark.range(420).select(
        F.when(F.col("id") % 60 != 7, F.col("id") % 60).alias("l_orderkey"), (F.col("id") * 7 % 31).alias("l_partkey"),
        F.when(F.col("id") % 13 != 5, (F.col("id") % 50).cast("double")).alias("l_quantity"),
        (F.col("id") * 37 % 100).cast("double").alias("l_extendedprice"),
        F.when(F.col("id") % 9 != 2, F.element_at(F.array(F.lit("A"), F.lit("N")), (F.col("id") % 2 + 1).cast("int"))).alias("l_returnflag"),
    )
    part = spark.range(30).select(
        F.col("id").alias("p_partkey"),
        F.when(F.col("id") != 4, F.concat(F.lit("Brand#"), F.col("id") % 14 + 11)).alias("p_brand"),
    )
    customer = spark.range(20, 24).select(F.col("id").alias("c_custkey"), F.lit("S").alias("c_mktsegment"))
    twice = {"orders": orders.union(orders.limit(9)), "lineitem": lines.union(lines.limit(20)), "part": part, "customer": customer}
    for name, df in twice.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_kept_submissions_bind_the_same_rows(spark, tmp_path):
    d = _small_tables(spark, tmp_path)
    plain, kept = binding.Binding(spark, d), binding.Binding(spark, d).keep()
    for view in ("responses", "rankings", "pairs", "lane", "peaks", "duos", "wresponses", "wpeaks", "wpairs", "questions"):
        a, b = getattr(plain, view), getattr(kept, view)
        assert a.schema.names == b.schema.names
        rows = [sorted(map(repr, x.collect())) for x in (a, b)]
        assert rows[0] == rows[1] and rows[0], view
        assert "l_orderkey" not in b._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_written_leaves_no_shuffle_files(spark):
    from crowdgauge import runtime

    before = spark.conf.get(runtime.CLEAR, None)
    folders = [f.getPath() for f in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {str(p) for f in folders for p in Path(f).rglob("shuffle_*.data")}
    there = files()
    kept = runtime.pin(spark.range(0, 50_000, 1, 4).groupBy((F.col("id") % 999).alias("k")).count())
    assert not files() - there
    assert kept.count() == 999
    assert spark.conf.get(runtime.CLEAR, None) == before


@pytest.mark.parametrize("name", ["h4_retest_candidates", "h2_next_questions"])
def test_questions_to_ask_read_the_lines_once(spark, tmp_path, name):
    from crowdgauge.plans import sampling

    found = getattr(sampling, name)(binding.Binding(spark, _small_tables(spark, tmp_path)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_findings_of_all_rules_read_the_lines_once(spark, tmp_path, monkeypatch):
    from crowdgauge.plans import reporting

    class Reached(Exception):
        pass

    def fits(rows, labels, *_):
        raise Reached(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(reporting.resample, "replicate_stats", fits)
    with pytest.raises(Reached) as plan:
        reporting.g9_findings_of_all_rules(binding.Binding(spark, _small_tables(spark, tmp_path)))
    assert "winner" in str(plan.value) and "l_orderkey" not in str(plan.value)
