"""Combinations of catalog items: pairs inside a role and legal duos of a context.

Both grow with the square of the enabled pool, which is what the published tables list. The joins
carry an equality on the role, so they shuffle by role and never form a product of whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C


def playing(pool: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(item_id, role) for the listed roles."""
    return pool.select("item_id", F.explode("roles").alias("role")).filter(
        F.col("role").isin(*roles)
    )


def role_pairs(pool: DataFrame, roles: Sequence[str] = S.LANE_ROLES) -> DataFrame:
    """Ascending pairs of items that share a role."""
    left = playing(pool, roles).withColumnRenamed("item_id", "item_a")
    right = playing(pool, roles).withColumnRenamed("item_id", "item_b")
    return left.join(right, "role").filter(F.col("item_a") < F.col("item_b"))


def _seats(pool: DataFrame, seat: int) -> DataFrame:
    contexts = {name: roles[seat] for name, roles in S.DUO_CONTEXTS.items()}
    entries = F.array(
        *[F.struct(F.lit(n).alias("duo_ctx"), F.lit(r).alias("seat")) for n, r in contexts.items()]
    )
    return (
        pool.select("item_id", "roles", F.explode(entries).alias("e"))
        .filter(F.array_contains("roles", F.col("e.seat")))
        .select("item_id", "e.duo_ctx", F.col("e.seat").alias("seat_role"))
    )


def legal_duos(pool: DataFrame) -> DataFrame:
    """(duo_ctx, duo) for every pair of different items that can fill the two seats."""
    first = _seats(pool, 0).select(
        "duo_ctx", F.col("item_id").alias("x"), F.col("seat_role").alias("rx")
    )
    second = _seats(pool, 1).select(
        "duo_ctx", F.col("item_id").alias("y"), F.col("seat_role").alias("ry")
    )
    duo = C.duo_struct(F.col("x"), F.col("rx"), F.col("y"), F.col("ry"))
    return (
        first.join(second, "duo_ctx").filter(F.col("x") != F.col("y")).select("duo_ctx", duo.alias("duo"))
    )


def duo_space_size(pool: DataFrame) -> DataFrame:
    """Per context, how many pairs of duos share no item, without listing a single pair.

    Of all pairs of duos, those that share one item are subtracted; the ones that share both
    (the same two items with swapped roles) were subtracted twice and come back once.
    """
    seats = (
        _seats(pool, 0)
        .select("duo_ctx", "item_id", F.lit(0).alias("seat"))
        .unionByName(_seats(pool, 1).select("duo_ctx", "item_id", F.lit(1).alias("seat")))
    )
    per_item = seats.groupBy("duo_ctx", "item_id").agg(
        F.max((F.col("seat") == 0).cast("bigint")).alias("f"),
        F.max((F.col("seat") == 1).cast("bigint")).alias("s"),
    )
    sizes = per_item.groupBy("duo_ctx").agg(
        F.sum("f").alias("n_first"),
        F.sum("s").alias("n_second"),
        F.sum(F.col("f") * F.col("s")).alias("n_both"),
    )

    def choose2(x):
        return x * (x - 1) / F.lit(2)

    duos_of = F.col("f") * (F.col("n_second") - F.col("s")) + F.col("s") * (
        F.col("n_first") - F.col("f")
    )
    shared = (
        per_item.join(sizes, "duo_ctx").groupBy("duo_ctx").agg(F.sum(choose2(duos_of)).alias("shared"))
    )
    total = F.col("n_first") * F.col("n_second") - F.col("n_both")
    return sizes.join(shared, "duo_ctx").select(
        "duo_ctx",
        total.alias("duos"),
        (choose2(total) - F.col("shared") + choose2(F.col("n_both")))
        .cast("bigint")
        .alias("disjoint_pairs"),
    )
