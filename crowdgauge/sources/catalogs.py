"""Catalog sources: pick-rate snapshots, item catalogs and run parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgauge import settings as S

PICK_RATE_SCHEMA = "role STRING, name STRING, pick_rate DECIMAL(6,4), rank_in_role INT"
CATALOG_SCHEMA = "struct<version:string,data:map<string,struct<id:string,name:string,tags:array<string>>>>"


def read_pick_rate(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot CSV: comment lines start with ``#``, one header line, typed columns."""
    return (
        spark.read.option("header", "true")
        .option("comment", "#")
        .schema(PICK_RATE_SCHEMA)
        .csv(path)
    )


def read_catalog_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """Items of catalog documents: key, id, name and provisional roles from their tags.

    An item without a known tag plays mid.
    """
    by_tag = F.create_map(*[F.lit(x) for pair in S.ROLE_BY_TAG.items() for x in pair])
    tags = F.coalesce("item.tags", F.array().cast("array<string>"))
    known = F.filter(tags, lambda t: F.map_contains_key(by_tag, t))
    roles = F.array_sort(F.array_distinct(F.transform(known, lambda t: F.try_element_at(by_tag, t))))
    return (
        documents.select(F.from_json(column, CATALOG_SCHEMA).alias("d"))
        .select("d.version", F.explode("d.data").alias("key", "item"))
        .select(
            "version",
            "key",
            F.col("item.id").alias("id"),
            F.col("item.name").alias("name"),
            F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("mid"))).alias("roles"),
        )
    )


def resolve_params(
    settings: DataFrame, overrides: Mapping[str, str], defaults: Mapping[str, str]
) -> DataFrame:
    """(key, value, source): an explicit value, else the settings table, else the default."""
    spark = settings.sparkSession
    base = spark.createDataFrame(
        [(k, str(v), None if k not in overrides else str(overrides[k])) for k, v in defaults.items()],
        "key string, fallback string, given string",
    )
    stored = settings.select("key", F.col("value").cast("string").alias("stored"))
    source = (
        F.when(F.col("given").isNotNull(), "given")
        .when(F.col("stored").isNotNull(), "settings")
        .otherwise("default")
    )
    return base.join(stored, "key", "left").select(
        "key", F.coalesce("given", "stored", "fallback").alias("value"), source.alias("source")
    )


def check_run_ranges(min_trust: float, halflife: float, sigma: float, bootstrap: int) -> None:
    """Reject parameters that would divide by zero half way through a run."""
    if not 0 < min_trust <= 1:
        raise ValueError("min_trust must be above 0 and at most 1")
    if not halflife > 0:
        raise ValueError("halflife must be positive")
    if not sigma > 0:
        raise ValueError("sigma must be positive")
    if bootstrap < 1:
        raise ValueError("bootstrap must be a positive integer")


def run_seed(window: str, min_trust: float, halflife: float, sigma: float, bootstrap: int) -> int:
    """The seed of a run: the first 16 hex digits of a SHA-256 over its formatted parameters."""
    import hashlib

    text = f"{window}|{min_trust:.3f}|{halflife:g}|{sigma:g}|{bootstrap}|{S.AGGREGATION_VERSION}"
    return int(hashlib.sha256(text.encode()).hexdigest()[:16], 16)
