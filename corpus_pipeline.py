"""From raw documents to packed training sequences: each stage calls one corpus operator."""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdgauge.llm import langid, line_dedup, mixing, ngram_join, packing
from crowdgauge.runtime import pin

#: A document goes if less than this share of its letters is in words that its languages explain. Mixed
#: texts are kept. In a text of fewer than ``SHORT`` bytes, one mail address or key can be most of it.
LEAST_KNOWN, LEAST_KNOWN_SHORT, SHORT = 1 / 2, 1 / 3, 100
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that a file can hold, so that its number and a place in it are one number.
FILE_ROWS = 1 << 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages: texts without letters, and those of which the learned languages
    explain less than ``LEAST_KNOWN``, go. The model learns from the rows that name a language."""
    model = langid.learn(docs)
    found = langid.identify(docs, model)
    least = F.when(F.octet_length("text") < SHORT, LEAST_KNOWN_SHORT).otherwise(LEAST_KNOWN)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("known") >= least)).select(
        *docs.columns
    )


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeated three-line windows cover; ``n_chars`` follows."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def _places(docs: DataFrame) -> tuple[Column, Column] | None:
    """(path of the file, place in it) of every row; None for what is not read from Parquet, or has a column
    ``_metadata`` of its own."""
    if "_metadata" in docs.columns:
        return None
    places = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        docs.select(*places)
    except AnalysisException:
        return None
    return places


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``_row``, a number that no other row has and that stays from one reading to the next.

    It is made of the file's number and the row's place in it, so no text is written again. Rows that are not
    read from Parquet, or of which several come from one place in a file, get a number that is written with them.
    """
    places = _places(docs)
    if places is not None:
        path, place = places
        found = docs.select(path.alias("_path")).distinct()
        by_name = Window.orderBy(F.length("_path"), "_path")
        files = pin(found.select("_path", (F.row_number().over(by_name) - 1).cast("bigint").alias("_file")))
        rows = docs.select("*", path.alias("_path"), place.alias("_place")).join(F.broadcast(files), "_path")
        rows = rows.select(*docs.columns, (F.col("_file") * FILE_ROWS + F.col("_place")).alias("_row"))
        if rows.groupBy("_row").count().filter("count > 1").isEmpty():
            return rows
    return pin(docs.withColumn("_row", F.monotonically_increasing_id()), codec="zstd")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8, the smallest id.

    Rows are told apart by a number of their own, so rows without a doc_id or with one
    that others have are documents of their own and go only as near duplicates. Of rows with one
    doc_id, or without any, the one with the least hash of its columns stays, on every run.
    """
    rows = _numbered(docs)
    found = ngram_join.jaccard_components(
        rows.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80, ratio=1.5, spare=0.3
    )
    digest = F.xxhash64(*(c for c in COLUMNS if c in docs.columns))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", digest, "_row")
    grouped = found.select(F.col("doc_id").alias("_row"), "component_id").join(
        rows.select("_row", order.alias("order")), "_row"
    )
    stays = pin(grouped.groupBy("component_id").agg(F.min("order")["_row"].alias("_row")).select("_row"))
    return rows.join(stays, "_row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole, sorted by training position.

    The files that are written keep that order, and ``pack_sequences`` takes it from them. Rows are told
    apart by a number of their own, so those without a doc_id and those that repeat one are documents of
    their own.
    """
    rows = _numbered(docs)
    plan = mixing.demand(rows, key="_row")
    order = pin(plan.select("_row", F.explode("passes.position").alias("_position")))
    return rows.join(order, "_row").orderBy("_position", "doc_id", "_row").select(*docs.columns)


def _as_written(docs: DataFrame) -> DataFrame:
    """The rows in the order in which they were written: by number of the file, then by place in it.

    Reading alone takes files by size. What is not read from Parquet, or has a column ``_metadata`` of its
    own, stays as it comes.
    """
    if "_metadata" in docs.columns:
        return docs
    try:
        name, place = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        rows = docs.select("doc_id", "text", F.length(name).alias("digits"), name, place)
    except AnalysisException:
        return docs
    return rows.orderBy("digits", "file_name", "row_index").select("doc_id", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, as the pieces of documents they hold.

    Sequence ids follow the order in which the documents were written, the training order, but for the
    windows that a task holds open and for what is left over at the end of a few tasks.
    """
    return packing.pack(_as_written(docs))


def _shielded(stage):
    """The stage with columns that ``documents`` does not have under names that no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = {c if c in COLUMNS else f"extra column {i}": c for i, c in enumerate(docs.columns)}
        done = stage(spark, docs.toDF(*inside), sf_dir)
        return done.toDF(*(inside.get(c, c) for c in done.columns))

    return run


STAGES = [
    ("language_id", _shielded(language_id)),
    ("line_dedup", _shielded(line_dedup_stage)),
    ("near_dedup", _shielded(near_dedup)),
    ("mix_sources", _shielded(mix_sources)),
    ("pack_sequences", _shielded(pack_sequences)),
]

#: Models, sketches and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = pin(docs)
    return docs
