"""Keyed merges of catalogs and question sets: what an upsert does, as joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C

QUESTION_IDENTITY = (
    "type", "patch_id", "item_a", "item_b", "item_c", "item_d", "dimension_id", "role", "duo_ctx",
    "role_a", "role_b", "role_c", "role_d",
)


def null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(
        lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    )


def upsert(
    target: DataFrame, incoming: DataFrame, key: str, update_cols: Sequence[str]
) -> DataFrame:
    """New keys inserted, listed columns updated on a match, every other column protected.

    The ``change`` column says inserted, updated or kept.
    """
    new = incoming.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_in_{c}") for c in incoming.columns if c != key]
    )
    joined = target.join(new, target[key] == F.col("_key"), "full")
    is_new, hit = target[key].isNull(), F.col("_key").isNotNull()
    columns = [F.coalesce(target[key], F.col("_key")).alias(key)]
    for name in target.columns:
        if name == key:
            continue
        arrives = F.col(f"_in_{name}") if name in incoming.columns else F.lit(None)
        take = is_new | (hit if name in update_cols else F.lit(False))
        columns.append(F.when(take, arrives).otherwise(target[name]).alias(name))
    change = F.when(is_new, "inserted").when(hit, "updated").otherwise("kept")
    return joined.select(*columns, change.alias("change"))


def insert_only(target: DataFrame, incoming: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Settings semantics: existing keys keep their value unless forced."""
    protected = [] if not force else [c for c in target.columns if c != key]
    return upsert(target, incoming, key, protected)


def append_new(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of a batch whose key is not there yet, once each."""
    return batch.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def materialize(existing: DataFrame, combos: DataFrame) -> DataFrame:
    """Questions that must be created: identity over 13 columns where nulls are equal."""
    wanted = combos.select(*QUESTION_IDENTITY).distinct().alias("n")
    known = existing.select(*QUESTION_IDENTITY).alias("k")
    return wanted.join(known, null_safe("n", "k", QUESTION_IDENTITY), "left_anti")


def union_keys(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames).distinct()


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def match_keys(df: DataFrame, keys: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.join(keys, list(cols), "left_semi")


def tiers_and_roles(snapshot: DataFrame, items: DataFrame) -> DataFrame:
    """Tier from the best rank in any role, roles from the lanes an item appears in.

    Items outside the snapshot fall back to the last tier and keep their roles.
    """
    best = snapshot.groupBy("name").agg(
        F.min("rank_in_role").alias("best_rank"),
        F.array_sort(F.collect_set("role")).alias("new_roles"),
    )
    tier = (
        F.when(F.col("best_rank") <= S.TIER_1_RANK, 1)
        .when(F.col("best_rank") <= S.TIER_2_RANK, 2)
        .otherwise(3)
    )
    return (
        items.drop("pool_tier")
        .join(best, "name", "left")
        .withColumn("pool_tier", tier)
        .withColumn("roles", F.coalesce("new_roles", "roles"))
        .drop("new_roles")
    )


def unmatched_names(snapshot: DataFrame, items: DataFrame) -> DataFrame:
    return snapshot.join(items, "name", "left_anti").select("name").distinct()


def merge_gold(
    questions: DataFrame,
    responses: DataFrame,
    entries: DataFrame,
    items: DataFrame,
    dimensions: DataFrame,
    patch_id: int,
    force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Load a gold catalog: (classified entries, problems).

    An item answers to its name, its alternative name or its key. The pair is put in canonical order and
    the expected side flipped with it. An entry is created, converted, reactivated, unchanged or
    skipped against the question that already holds its identity.
    """
    names = [c for c in ("name", "alt_name", "key") if c in items.columns]
    aliases = items.select(
        "item_id", "pool_tier", F.explode(F.array_distinct(F.array(*names))).alias("alias")
    )

    def resolved(side: str) -> DataFrame:
        return aliases.select(
            F.col("alias").alias(f"name_{side}"),
            F.col("item_id").alias(f"id_{side}"),
            F.col("pool_tier").alias(f"tier_{side}"),
        )

    named = (
        entries.join(resolved("a"), "name_a", "left")
        .join(resolved("b"), "name_b", "left")
        .join(dimensions.select(F.col("code").alias("dimension"), "dimension_id"), "dimension", "left")
    )
    problem = F.array_compact(
        F.array(
            F.when(F.col("id_a").isNull() | F.col("id_b").isNull(), F.lit("unknown item")),
            F.when(
                (F.col("tier_a") != S.GOLD_TIER) | (F.col("tier_b") != S.GOLD_TIER),
                F.lit("not in the first tier"),
            ),
            F.when(F.col("dimension_id").isNull(), F.lit("unknown dimension")),
        )
    )
    problems = named.select("entry_id", F.explode(problem).alias("problem"))
    low, high = C.canonical_pair("id_a", "id_b")
    clean = (
        named.join(problems.select("entry_id"), "entry_id", "left_anti")
        .withColumn(
            "wanted",
            F.when(F.col("id_a") > F.col("id_b"), C.flip_choice("expected")).otherwise(
                F.col("expected")
            ),
        )
        .select("entry_id", low.alias("item_a"), high.alias("item_b"), "dimension_id", "wanted")
    )
    current = questions.filter(
        (F.col("type") == "pairwise_dimension") & (F.col("patch_id") == patch_id)
    ).select("question_id", "item_a", "item_b", "dimension_id", "is_gold", "expected")
    answered = responses.select("question_id").distinct().withColumn("_answered", F.lit(True))
    status = (
        F.when(F.col("question_id").isNull(), "created")
        .when(F.col("is_gold") & (F.col("expected") == F.col("wanted")), "unchanged")
        .when(F.col("is_gold"), "skipped")
        .when(F.col("expected").isNotNull(), "reactivated" if force else "skipped")
        .when(F.coalesce("_answered", F.lit(False)), "skipped")
        .otherwise("converted")
    )
    classified = (
        clean.join(current, ["item_a", "item_b", "dimension_id"], "left")
        .join(answered, "question_id", "left")
        .select("entry_id", "item_a", "item_b", "dimension_id", "wanted", status.alias("status"))
    )
    return classified, problems
