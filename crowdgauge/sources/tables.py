"""Typed scans of the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parquet schemas of the given star-schema tables: no footer inference job, columns prune freely.
TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}

#: Schemas of the measurement tables themselves (Parquet layout of a deployment).
MEASUREMENT_TABLES = {
    "respondents": "respondent_id STRING, fingerprint_hash STRING, ip_hash STRING, "
    "declared_rank STRING, declared_main_role STRING, declared_hours_bucket STRING, "
    "trust_score DOUBLE, gold_attempts INT, gold_passed INT, retest_pairs INT, "
    "retest_consistent INT, fast_answers INT, straightline_runs INT, answers_count INT, "
    "first_seen TIMESTAMP, last_seen TIMESTAMP, is_flagged BOOLEAN",
    "questions": "question_id BIGINT, type STRING, item_a INT, item_b INT, item_c INT, "
    "item_d INT, dimension_id INT, role STRING, duo_ctx STRING, role_a STRING, role_b STRING, "
    "role_c STRING, role_d STRING, patch_id INT, is_gold BOOLEAN, expected_answer STRING, "
    "bridge_priority BOOLEAN, exposure_count BIGINT, entropy DOUBLE, coverage_deficit DOUBLE",
    "rankings": "ranking_id BIGINT, respondent_id STRING, patch_id INT, dimension_id INT, "
    "anchor_question_id BIGINT, items ARRAY<INT>, submitted_order ARRAY<INT>",
    "responses": "response_id BIGINT, respondent_id STRING, question_id BIGINT, type STRING, "
    "patch_id INT, answer STRING, response_time_ms BIGINT, is_retest_of BIGINT, "
    "ranking_id BIGINT, created_at TIMESTAMP",
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    reader = spark.read
    schema = TABLES.get(name) or MEASUREMENT_TABLES.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_base(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The response log with its questions, respondents and rankings."""
    return {name: read_table(spark, directory, name) for name in MEASUREMENT_TABLES}
