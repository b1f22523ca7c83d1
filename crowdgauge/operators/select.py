"""Choosing and weighting the rows that count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C


def join_base(responses: DataFrame, questions: DataFrame, respondents: DataFrame) -> DataFrame:
    """Responses with the columns of their question and their respondent."""
    own = set(responses.columns)
    q = questions.select(
        "question_id", *[c for c in questions.columns if c not in own and c != "question_id"]
    )
    own |= set(q.columns)
    r = respondents.select(
        "respondent_id", *[c for c in respondents.columns if c not in own and c != "respondent_id"]
    )
    return responses.join(q, "question_id").join(r, "respondent_id")


def aggregable(joined: DataFrame, min_trust: float = S.DEFAULTS["export.min_trust"]) -> DataFrame:
    """Not a retest, not gold, not from a flagged respondent, trusted enough."""
    return joined.filter(
        F.col("is_retest_of").isNull()
        & ~F.col("is_gold")
        & ~F.col("is_flagged")
        & (F.col("trust_score") >= F.lit(float(min_trust)))
    )


def patch_window(patches: DataFrame, first: str, last: str) -> DataFrame:
    """Patches released between two versions, by release date and never by version text.

    Two rows of the patch catalog decide, so they are read on the driver to reject unknown or
    inverted bounds before any response is touched.
    """
    found = {
        row["version"]: row["released_at"]
        for row in patches.filter(F.col("version").isin(first, last))
        .select("version", "released_at")
        .collect()
    }
    for version in (first, last):
        if version not in found:
            raise ValueError(f"unknown patch {version}")
    if found[first] > found[last]:
        raise ValueError(f"inverted window {first}..{last}")
    return patches_between(patches, found[first], found[last])


def patches_between(patches: DataFrame, low, high) -> DataFrame:
    return patches.filter(F.col("released_at").between(F.lit(low), F.lit(high)))


def exclusion_label(min_trust: float) -> Column:
    """The first rule that removes a row, or null for a row that stays."""
    return (
        F.when(F.col("is_retest_of").isNotNull(), "retest")
        .when(F.col("is_gold"), "gold")
        .when(F.col("is_flagged"), "flagged")
        .when(F.col("trust_score") < F.lit(float(min_trust)), "trust")
    )


def excluded(joined: DataFrame, min_trust: float) -> DataFrame:
    """One row: the window total, what each rule removed first, and what is left."""
    label = exclusion_label(min_trust)
    return joined.select(label.alias("label")).agg(
        F.count("*").alias("window"),
        *[
            F.count_if(F.col("label") == name).alias(name)
            for name in ("retest", "gold", "flagged", "trust")
        ],
        F.count_if(F.col("label").isNull()).alias("included"),
    )


def with_weight(df: DataFrame, exported_at: str, halflife: float) -> DataFrame:
    """``trust * 0.5 ^ (age / halflife)``; the age in whole UTC days never drops below zero."""
    age = F.datediff(F.lit(exported_at).cast("date"), F.to_date("created_at"))
    days = F.greatest(age, F.lit(0)).cast("double")
    decay = F.pow(F.lit(0.5), days / F.lit(float(halflife)))
    return df.withColumn("weight", F.col("trust_score") * decay)


def join_spread(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join by a key that many left rows lack.

    Rows without the key match nothing, but hash to one task. They are dealt by ``spread`` instead.
    """
    none = F.pmod(F.hash(key), F.lit(1))  # zero for every key
    dealt = left.withColumn("_salt", F.when(F.col(key).isNull(), F.hash(spread)).otherwise(none))
    return dealt.join(right.withColumn("_salt", none), [key, "_salt"], "left").drop("_salt")


def heads(responses: DataFrame, rankings: DataFrame) -> DataFrame:
    """One row per submission: rows without a ranking, and the anchor row of each ranking.

    Rows without a ranking stay where they are; only the others travel to their anchors.
    """
    anchors = rankings.select("ranking_id", F.col("anchor_question_id").alias("question_id"))
    alone = responses.filter(F.col("ranking_id").isNull())
    ranked = responses.filter(F.col("ranking_id").isNotNull())
    return alone.unionByName(ranked.join(anchors, ["ranking_id", "question_id"]).select(*responses.columns))


def pool(items: DataFrame, enabled_tiers: int) -> DataFrame:
    return items.filter(F.col("is_active") & (F.col("pool_tier") <= enabled_tiers))


def active(catalog: DataFrame, key: str) -> DataFrame:
    """Active catalog rows in display order."""
    return catalog.filter("is_active").orderBy("display_order", key)


CATALOG_LIMIT = 20_000


def _shaped(questions: DataFrame) -> DataFrame:
    """Questions whose columns fit their variant, with what each member needs."""
    duo = F.col("variant").isin("lane_2v2", "duo_synergy")
    members = F.filter(
        F.array(
            *[
                F.struct(
                    F.col(f"item_{m}").alias("item_id"),
                    F.when(duo, F.col(f"role_{m}"))
                    .when(F.col("variant") == "lane_1v1", F.col("role"))
                    .alias("needs"),
                )
                for m in "abcd"
            ]
        ),
        lambda m: m["item_id"].isNotNull(),
    )
    fits = (
        F.when(F.col("variant") == "lane_1v1", F.coalesce(F.col("role").isin(*S.LANE_ROLES), F.lit(False)))
        .when(
            duo,
            F.col("duo_ctx").isNotNull()
            & F.col("item_d").isNotNull()
            & F.col("role_d").isNotNull()
            & ((F.col("variant") != "lane_2v2") | (F.col("duo_ctx") == "bot")),
        )
        .when(F.col("variant") == "pairwise_dimension", F.col("dimension_id").isNotNull())
        .otherwise(F.lit(True))
    )
    return (
        questions.withColumn("variant", C.variant("type", "item_c"))
        .filter(fits)
        .withColumn("members", members)
    )


def _refuses(needs: Column, tier: Column, roles: Column, variant: Column) -> Column:
    """Whether one member rules a question out."""
    return (
        roles.isNull()
        | (needs.isNotNull() & ~F.array_contains(roles, needs))
        | ((variant == "duo_synergy") & (tier != S.SYNERGY_TIER))
    )


def admissible(
    questions: DataFrame, items: DataFrame, dimensions: DataFrame, traits: DataFrame
) -> DataFrame:
    """Questions the current pool can still serve.

    ``items`` is the enabled pool. Every member must be in it; one-against-one members need the
    role, duo members the role they were asked in; the synergy type is limited to the first tier.
    A pool within ``CATALOG_LIMIT`` is folded into one broadcast map and decides row by row;
    a longer one goes through an anti-join of the members that rule their question out.
    """
    shaped = _shaped(questions)
    catalog = items.select("item_id", "roles", "pool_tier")
    if catalog.limit(CATALOG_LIMIT + 1).count() <= CATALOG_LIMIT:
        entry = F.struct("item_id", F.struct("roles", "pool_tier"))
        folded = catalog.agg(F.map_from_entries(F.collect_list(entry)).alias("_pool"))

        def member_refused(m: Column) -> Column:
            found = F.try_element_at(F.col("_pool"), m["item_id"])
            return _refuses(m["needs"], found["pool_tier"], found["roles"], F.col("variant"))

        served = (
            shaped.join(F.broadcast(folded), F.lit(True))
            .filter(~F.exists("members", member_refused))
            .drop("_pool")
        )
    else:
        member = shaped.select("question_id", "variant", F.explode("members").alias("m")).select(
            "question_id", "variant", "m.item_id", "m.needs"
        )
        refused = member.join(catalog, "item_id", "left").filter(
            _refuses(F.col("needs"), F.col("pool_tier"), F.col("roles"), F.col("variant"))
        )
        served = shaped.join(refused.select("question_id"), "question_id", "left_anti")
    live = (
        dimensions.filter("is_active")
        .agg(F.collect_set("dimension_id").alias("_live"))
        .join(F.broadcast(traits.agg(F.coalesce(F.bool_or("is_active"), F.lit(False)).alias("_traits"))), F.lit(True))
    )
    open_dimension = F.col("dimension_id").isNull() | F.array_contains("_live", F.col("dimension_id"))
    open_traits = (F.col("variant") != "trait_multiselect") | F.col("_traits")
    return (
        served.join(F.broadcast(live), F.lit(True))
        .filter(open_dimension & open_traits)
        .drop("_live", "_traits", "members", "variant")
    )


def members_inside(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """Questions whose items are all in the pool, by a folded pool or, beyond the limit, by an
    anti-join of the questions with an item outside."""
    members = F.array_compact(F.array("item_a", "item_b", "item_c", "item_d"))
    ids = pool.select("item_id")
    if ids.limit(CATALOG_LIMIT + 1).count() <= CATALOG_LIMIT:
        folded = ids.agg(F.collect_set("item_id").alias("_pool"))
        return (
            questions.join(F.broadcast(folded), F.lit(True))
            .filter(F.size(F.array_except(members, F.col("_pool"))) == 0)
            .drop("_pool")
        )
    outside = questions.select("question_id", F.explode(members).alias("item_id")).join(
        ids, "item_id", "left_anti"
    )
    return questions.join(outside.select("question_id"), "question_id", "left_anti")


def fit_id() -> Column:
    """The independent model a weighted response feeds, so that all fits share one plan."""
    kind = C.variant("type", "item_c")
    return (
        F.when(kind == "pairwise_dimension", F.concat(F.lit("dimension:"), "dimension_id"))
        .when(kind == "lane_1v1", F.concat(F.lit("lane:"), "role"))
        .when(kind == "lane_2v2", F.lit("lane:bot"))
        .when(kind == "duo_synergy", F.concat(F.lit("synergy:"), "duo_ctx"))
        .when(kind == "peak_timing", F.lit("peak"))
        .when(kind == "trait_multiselect", F.lit("traits"))
    )


def route(weighted: DataFrame) -> DataFrame:
    return weighted.withColumn("variant", C.variant("type", "item_c")).withColumn("fit_id", fit_id())


def patch_readiness(patches: DataFrame, snapshots: DataFrame, questions: DataFrame) -> DataFrame:
    """What a patch still lacks before it can be served."""
    counted = snapshots.groupBy("patch_id").agg(F.count("*").alias("snapshots"))
    gold = questions.groupBy("patch_id").agg(F.count_if("is_gold").alias("active_gold"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("snapshots") == 0, F.lit("no snapshot")),
            F.when(F.col("active_gold") == 0, F.lit("no active gold")),
        )
    )
    return (
        patches.join(counted, "patch_id", "left")
        .join(gold, "patch_id", "left")
        .fillna(0, ["snapshots", "active_gold"])
        .withColumn("problems", problems)
    )


def activate(
    patches: DataFrame, version: str, readiness: DataFrame, force: bool = False
) -> DataFrame:
    """The patch catalog with one current row; unchanged when the patch is refused."""
    target = readiness.filter(F.col("version") == version).select(
        (F.size("problems") == 0).alias("ready")
    )
    rows = target.collect()  # one row of the catalog
    if not rows:
        raise ValueError(f"unknown patch {version}")
    if not (rows[0]["ready"] or force):
        raise ValueError(f"patch {version} is not ready")
    return patches.withColumn("is_current", F.col("version") == version)


def apply_overrides(
    df: DataFrame, overrides: DataFrame, key: str, column: str
) -> tuple[DataFrame, DataFrame]:
    """Rows a manual override changes, with the previous value, and keys that do not exist."""
    wanted = overrides.select(key, F.col(column).alias("_new"))
    changed = (
        df.join(wanted, key)
        .filter(~F.col(column).eqNullSafe(F.col("_new")))
        .select(key, F.col(column).alias("previous"), F.col("_new").alias("value"))
    )
    unknown = overrides.join(df.select(key), key, "left_anti").select(key)
    return changed, unknown


def overridden(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """The full table after the overrides."""
    wanted = overrides.select(key, F.col(column).alias("_new"))
    return (
        df.join(wanted, key, "left")
        .withColumn(column, F.coalesce("_new", column))
        .drop("_new")
    )


def overview_totals(joined: DataFrame, rankings: DataFrame, min_trust: float) -> DataFrame:
    """Totals of one patch in one pass: rows, submissions, aggregable rows, people, flagged."""
    anchors = rankings.select("ranking_id", "anchor_question_id")
    is_head = F.col("ranking_id").isNull() | (F.col("question_id") == F.col("anchor_question_id"))
    return join_spread(joined, anchors, "ranking_id", "response_id").agg(
        F.count("*").alias("rows"),
        F.count_if(is_head).alias("submissions"),
        F.count_if(exclusion_label(min_trust).isNull()).alias("aggregable_rows"),
        F.count_distinct("respondent_id").alias("respondents"),
        F.count_distinct(F.when(F.col("is_flagged"), F.col("respondent_id"))).alias(
            "flagged_respondents"
        ),
    )


def with_catalog(df: DataFrame, catalog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row of ``df`` once per row of a catalog (dimensions, traits, roles).

    The catalog is folded to one row and attached as an array, then exploded in place: the only
    thing broadcast is that single row.
    """
    entry = F.struct(*columns)
    folded = catalog.agg(F.array_sort(F.collect_list(entry)).alias("_catalog"))
    return (
        df.join(F.broadcast(folded), F.lit(True))
        .withColumn("_entry", F.explode("_catalog"))
        .select(*df.columns, *[F.col(f"_entry.{c}").alias(c) for c in columns])
    )


def any_of(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])
