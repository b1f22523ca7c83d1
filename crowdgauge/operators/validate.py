"""Answers, rankings, questions and tables against their declared rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C


def _first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first broken rule, or null. A rule is (condition that is wrong, name)."""
    result = None
    for wrong, name in rules:
        broken = F.coalesce(wrong, F.lit(False))
        result = F.when(broken, F.lit(name)) if result is None else result.when(broken, F.lit(name))
    return result


def answer_problem(type_: Column, answer: Column, codes: Column) -> Column:
    """Why a raw JSON answer is rejected, or null. ``codes`` holds the active trait codes."""
    keys = F.json_object_keys(answer)
    parsed = F.try_parse_json(answer)
    choice = F.try_variant_get(parsed, "$.choice", "string")
    minute_kind = F.schema_of_variant(F.try_variant_get(parsed, "$.minute", "variant"))
    minute = F.try_variant_get(parsed, "$.minute", "bigint")
    traits_kind = F.schema_of_variant(F.try_variant_get(parsed, "$.traits", "variant"))
    traits = F.try_variant_get(parsed, "$.traits", "array<string>")
    choice_kind = F.schema_of_variant(F.try_variant_get(parsed, "$.choice", "variant"))

    def exactly(key: str) -> Column:
        return ~((F.size(keys) == 1) & (keys[0] == key))

    def choice_rules(valid: tuple[str, ...]) -> list[tuple[Column, str]]:
        known = (choice_kind == "STRING") & choice.isin(*valid)
        return [(exactly("choice"), "keys"), (~F.coalesce(known, F.lit(False)), "choice")]

    per_type = {
        "pairwise_dimension": choice_rules(S.PAIRWISE_CHOICES),
        "lane_matchup": choice_rules(S.LANE_CHOICES),
        "duo_synergy": choice_rules(S.SYNERGY_CHOICES),
        "peak_timing": [
            (exactly("minute"), "keys"),
            (minute_kind != "BIGINT", "minute_integer"),
            (~minute.between(S.PEAK_MIN_MINUTE, S.PEAK_MAX_MINUTE), "minute_range"),
        ],
        "trait_multiselect": [
            (exactly("traits"), "keys"),
            (~traits_kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "traits_strings"),
            (F.size(traits) == 0, "traits_empty"),
            (F.size(F.array_distinct(traits)) != F.size(traits), "traits_repeated"),
            (F.size(F.array_except(traits, codes)) > 0, "traits_unknown"),
        ],
    }
    result = F.when(parsed.isNull() | keys.isNull(), F.lit("malformed"))
    for name, rules in per_type.items():
        result = result.when(type_ == name, _first_failure(rules))
    return result.otherwise(F.lit("type"))


def validate_answers(raw: DataFrame, traits: DataFrame) -> DataFrame:
    """The raw log with a ``reason`` column, null where the answer is accepted.

    The active trait codes form one row, attached by broadcast.
    """
    codes = traits.filter("is_active").agg(F.collect_set("code").alias("_codes"))
    return (
        raw.join(F.broadcast(codes), F.lit(True))
        .withColumn("reason", answer_problem(F.col("type"), F.col("answer"), F.col("_codes")))
        .drop("_codes")
    )


def split_valid(raw: DataFrame, traits: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_answers(raw, traits)
    valid = checked.filter(F.col("reason").isNull()).drop("reason")
    return valid, checked.filter(F.col("reason").isNotNull())


def ranking_problem(order: Column, shown: Column, size: int | None = None) -> Column:
    """A submitted order must be a permutation of the items shown; null order is 'not sure'."""
    length = F.size(shown) if size is None else F.lit(size)
    return _first_failure(
        [
            (order.isNotNull() & (F.size(order) != length), "length"),
            (F.size(F.array_distinct(order)) != F.size(order), "repeated"),
            (F.size(F.array_except(order, shown)) > 0, "foreign"),
            (F.size(F.array_except(shown, order)) > 0, "missing"),
        ]
    )


def question_rules() -> list[tuple[Column, str]]:
    """(condition that is wrong, rule name) for every question constraint."""
    a, b, c, d = (F.col(f"item_{m}") for m in "abcd")
    dim, role, ctx, kind = (F.col(n) for n in ("dimension_id", "role", "duo_ctx", "type"))
    alone = b.isNull() & c.isNull() & d.isNull()
    two = b.isNotNull() & c.isNull() & d.isNull()
    four = b.isNotNull() & c.isNotNull() & d.isNotNull()
    free = dim.isNull() & role.isNull() & ctx.isNull()
    lane_one = two & F.coalesce(role.isin(*S.LANE_ROLES), F.lit(False)) & ctx.isNull()
    lane_two = four & role.isNull() & F.coalesce(ctx == "bot", F.lit(False))
    shape = (
        F.when(kind == "pairwise_dimension", two & dim.isNotNull() & role.isNull() & ctx.isNull())
        .when(kind.isin("peak_timing", "trait_multiselect"), alone & free)
        .when(kind == "lane_matchup", dim.isNull() & (lane_one | lane_two))
        .when(kind == "duo_synergy", four & dim.isNull() & role.isNull() & ctx.isNotNull())
        .otherwise(F.lit(False))
    )
    canonical = (
        F.when(kind == "pairwise_dimension", a < b)
        .when((kind == "lane_matchup") & c.isNull(), a < b)
        .when(kind.isin("lane_matchup", "duo_synergy"), (a < b) & (c < d) & (a < c))
        .otherwise(F.lit(True))
    )
    roles = F.array("role_a", "role_b", "role_c", "role_d")
    no_roles = F.forall(roles, lambda r: r.isNull())

    def legal(first: str, second: str) -> Column:
        def pair(x: str, y: str) -> Column:
            return ((F.col(x) == first) & (F.col(y) == second)) | (
                (F.col(x) == second) & (F.col(y) == first)
            )

        return F.coalesce(pair("role_a", "role_b") & pair("role_c", "role_d"), F.lit(False))

    duo_roles = F.when(ctx.isNull(), no_roles)
    for name, (first, second) in S.DUO_CONTEXTS.items():
        duo_roles = duo_roles.when(ctx == name, legal(first, second))
    duo_roles = duo_roles.otherwise(F.lit(False))
    return [
        (~shape, "shape"),
        (~canonical, "canonical_order"),
        (~duo_roles, "duo_roles"),
        (F.col("is_gold") & F.col("expected").isNull(), "gold_has_expected"),
    ]


def violations(df: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """One row per (key, broken rule)."""
    names = F.array_compact(
        F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for wrong, name in rules])
    )
    return df.select(key, F.explode(names).alias("rule"))


def check_questions(questions: DataFrame) -> DataFrame:
    return violations(questions, "question_id", question_rules())


def respondent_rules() -> list[tuple[Column, str]]:
    """Enumerations, ranges and counter order of a respondent row."""
    rules = [
        (~F.col("trust_score").between(0, 1), "trust_range"),
        (F.col("declared_rank").isNotNull() & ~F.col("declared_rank").isin(*S.RANKS), "rank"),
        (
            F.col("declared_hours_bucket").isNotNull()
            & ~F.col("declared_hours_bucket").isin(*S.HOURS_BUCKETS),
            "hours",
        ),
    ]
    smaller = [
        ("gold_passed", "gold_attempts"),
        ("retest_consistent", "retest_pairs"),
        ("current_streak", "best_streak"),
        ("current_day_streak", "best_day_streak"),
    ]
    broken = reduce(lambda x, y: x | y, [F.col(lo) > F.col(hi) for lo, hi in smaller])
    return [*rules, (broken, "counters")]


def response_rules() -> list[tuple[Column, str]]:
    ms = F.col("response_time_ms")
    return [(~((ms >= 0) & (ms < 600_000)), "time_range")]


def estimate_rules() -> list[tuple[Column, str]]:
    """Interval order, canonical pair and the shape each estimate scope allows."""
    b, dim, trait, role, ctx = (
        F.col(n) for n in ("item_b_id", "dimension_id", "trait_id", "role", "duo_ctx")
    )
    wanted = {
        "champion_dimension": (False, True, False, False, False),
        "champion_peak": (False, False, False, False, False),
        "matchup_pair": (True, False, False, True, False),
        "duo_synergy": (True, False, False, False, True),
        "duo_lane_strength": (True, False, False, False, True),
        "champion_trait": (False, False, True, False, False),
    }
    shape = None
    for scope, present in wanted.items():
        match = reduce(
            lambda x, y: x & y,
            [
                column.isNotNull() if there else column.isNull()
                for column, there in zip((b, dim, trait, role, ctx), present, strict=True)
            ],
        )
        if scope == "duo_lane_strength":
            match = match & (ctx == "bot")
        test = F.col("scope") == scope
        shape = F.when(test, match) if shape is None else shape.when(test, match)
    return [
        (F.col("ci_low") > F.col("ci_high"), "interval_order"),
        (~shape.otherwise(F.lit(False)), "scope_shape"),
        (F.col("item_id") >= b, "canonical_pair"),
    ]


def catalog_rules(tier: str = "pool_tier", roles: str = "roles") -> list[tuple[Column, str]]:
    return [(~F.col(tier).between(1, 3), "tier_range"), (F.size(roles) == 0, "has_roles")]


def patch_rules() -> list[tuple[Column, str]]:
    return [(~F.col("version").rlike(r"^\d+\.\d+$"), "version_format")]


def single_current(patches: DataFrame) -> DataFrame:
    """At most one current patch: every current one is a violation where there are several."""
    several = patches.agg((F.count_if("is_current") > 1).alias("_several"))
    return (
        patches.filter("is_current")
        .join(F.broadcast(several), F.lit(True))
        .filter("_several")
        .select("patch_id", F.lit("single_current").alias("rule"))
    )


def settings_rules() -> list[tuple[Column, str]]:
    return [(~F.col("key").rlike(r"^[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*$"), "key_format")]


def code_rules() -> list[tuple[Column, str]]:
    return [(~F.col("code").rlike(r"^[a-z][a-z0-9_]{1,30}$"), "code_format")]


def validate_pick_rate(snapshot: DataFrame) -> DataFrame:
    """Problems of a pick-rate snapshot: (role, name, problem)."""
    outside = snapshot.filter(~((F.col("pick_rate") > 0) & (F.col("pick_rate") <= 1))).select(
        "role", "name", F.lit("rate_range").alias("problem")
    )
    twice = (
        snapshot.groupBy("role", "name")
        .count()
        .filter("count > 1")
        .select("role", "name", F.lit("duplicate").alias("problem"))
    )
    rank = F.col("rank_in_role")
    repeated = (
        snapshot.groupBy("role", "rank_in_role")
        .count()
        .filter("count > 1")
        .select("role", rank.cast("string").alias("name"), F.lit("rank_repeated").alias("problem"))
    )
    gaps = (
        snapshot.groupBy("role")
        .agg(F.max(rank).alias("top"), F.min(rank).alias("low"), F.count_distinct(rank).alias("n"))
        .filter((F.col("low") != 1) | (F.col("top") != F.col("n")))
        .select("role", F.lit("").alias("name"), F.lit("rank_gaps").alias("problem"))
    )
    return outside.unionByName(twice).unionByName(repeated).unionByName(gaps)


def validate_gold_entries(entries: DataFrame) -> DataFrame:
    """Problems of a gold catalog file: (entry_id, problem).

    Entries have name_a, name_b, dimension, expected and rationale. A pair may appear once per
    dimension, in whichever order it is written.
    """
    blank = F.trim(F.coalesce("rationale", F.lit(""))) == ""
    single = violations(
        entries,
        "entry_id",
        [
            (
                F.col("name_a").isNull() | F.col("name_b").isNull() | F.col("dimension").isNull(),
                "missing_field",
            ),
            (F.col("name_a") == F.col("name_b"), "same_item"),
            (~F.col("dimension").isin(*S.GOLD_DIMENSIONS), "dimension_not_allowed"),
            (~F.coalesce(F.col("expected").isin("a", "b"), F.lit(False)), "expected"),
            (blank, "no_rationale"),
        ],
    ).withColumnRenamed("rule", "problem")
    low, high = C.canonical_pair("name_a", "name_b")
    keyed = entries.select("entry_id", low.alias("_a"), high.alias("_b"), "dimension")
    first = keyed.groupBy("_a", "_b", "dimension").agg(F.min("entry_id").alias("_first"))
    repeated = (
        keyed.join(first, ["_a", "_b", "dimension"])
        .filter(F.col("entry_id") != F.col("_first"))
        .select("entry_id", F.lit("repeated_pair").alias("problem"))
    )
    return single.unionByName(repeated)


def canonical_question(questions: DataFrame) -> DataFrame:
    """Members in canonical order, roles travelling with their item, the answer flipped when the
    two sides of the question change places."""
    two = F.col("item_b").isNotNull() & F.col("item_c").isNull()
    four = F.col("item_d").isNotNull()
    one = C.duo_struct(F.col("item_a"), F.col("role_a"), F.col("item_b"), F.col("role_b"))
    other = C.duo_struct(F.col("item_c"), F.col("role_c"), F.col("item_d"), F.col("role_d"))
    swap_pair = two & (F.col("item_a") > F.col("item_b"))
    base = questions.withColumn("_one", one).withColumn("_other", other)
    swap_duo = four & (F.col("_other.m1.item") < F.col("_one.m1.item"))
    base = (
        base.withColumn("_swap", F.coalesce(swap_pair | swap_duo, F.lit(False)))
        .withColumn("_top", F.when(swap_duo, F.col("_other")).otherwise(F.col("_one")))
        .withColumn("_bottom", F.when(swap_duo, F.col("_one")).otherwise(F.col("_other")))
        .withColumn("_four", four)
        .withColumn("_pair", swap_pair)
    )
    low, high = C.canonical_pair("item_a", "item_b")
    return (
        base.withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn(
            "item_a",
            F.when(F.col("_four"), F.col("_top.m1.item"))
            .when(two, F.col("_low"))
            .otherwise(F.col("item_a")),
        )
        .withColumn(
            "item_b",
            F.when(F.col("_four"), F.col("_top.m2.item"))
            .when(F.col("_high").isNotNull() & F.col("item_c").isNull(), F.col("_high"))
            .otherwise(F.col("item_b")),
        )
        .withColumn("item_c", F.when(F.col("_four"), F.col("_bottom.m1.item")))
        .withColumn("item_d", F.when(F.col("_four"), F.col("_bottom.m2.item")))
        .withColumn(
            "role_a", F.when(F.col("_four"), F.col("_top.m1.role")).otherwise(F.col("role_a"))
        )
        .withColumn(
            "role_b", F.when(F.col("_four"), F.col("_top.m2.role")).otherwise(F.col("role_b"))
        )
        .withColumn("role_c", F.when(F.col("_four"), F.col("_bottom.m1.role")))
        .withColumn("role_d", F.when(F.col("_four"), F.col("_bottom.m2.role")))
        .withColumn(
            "choice", F.when(F.col("_swap"), C.flip_choice("choice")).otherwise(F.col("choice"))
        )
        .drop("_one", "_other", "_swap", "_top", "_bottom", "_four", "_pair", "_low", "_high")
    )
