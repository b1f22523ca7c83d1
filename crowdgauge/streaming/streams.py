"""The per-request and periodic work of a collection service as Structured Streaming jobs.

All state lives in built-in aggregations, so a busy respondent is pre-aggregated before the
shuffle. No answer is dropped for being late to its patch, and the ingest keeps every answer. The
windowed and session results are bounded by their watermark: an answer that arrives later than
``delay`` behind the newest one of an earlier trigger is left out of them. Choose the delay to cover
how late answers come; the batch operators over the stored log are always complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import annotators, question_stats, select, validate

DELAY = "1 hour"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files: a table folder, or one file of a folder of several tables."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(location).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


# ------------------------------------------------------------------------------- ingest
def checked(stream: DataFrame, traits: DataFrame, questions: DataFrame) -> DataFrame:
    """Raw answers with type and patch copied from their question and a ``reason`` if refused.

    Answers to unknown questions are refused too.
    """
    known = questions.select("question_id", "type", "patch_id")
    typed = stream.drop("type", "patch_id").join(known, "question_id", "left")
    reason = F.when(F.col("type").isNull(), F.lit("question")).otherwise(F.col("reason"))
    return validate.validate_answers(typed, traits).withColumn("reason", reason)


def ingest(
    stream: DataFrame, traits: DataFrame, questions: DataFrame, out: str, checkpoint: str, **trigger
):
    """Start the validated ingest: accepted answers and refused ones go to two append-only tables.

    Both writes carry the batch id, so a batch that is retried replaces itself.
    """
    labelled = checked(stream, traits, questions)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, rows in (
            ("accepted", batch.filter(F.col("reason").isNull()).drop("reason")),
            ("refused", batch.filter(F.col("reason").isNotNull())),
        ):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        batch.unpersist()

    writer = labelled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def dedupe(stream: DataFrame) -> DataFrame:
    """One answer per respondent and question, unless it is a claimed retest of a given answer.

    The first to arrive stays, however late it is. The state is the set of keys seen, as a unique index
    would hold it, spread by key; there is no watermark, so nothing new is dropped and no duplicate
    gets in after any time. For long logs keep the state store in RocksDB.
    """
    key = ["respondent_id", "question_id", "is_retest_of"]
    marked = stream.withColumn("is_retest_of", F.coalesce("is_retest_of", F.lit(-1).cast("bigint")))
    kept = marked.dropDuplicates(key)
    return kept.withColumn(
        "is_retest_of", F.when(F.col("is_retest_of") >= 0, F.col("is_retest_of"))
    )


def dedupe_batch(responses: DataFrame) -> DataFrame:
    """The batch twin of ``dedupe``: the first answer of every key."""
    rest = [c for c in responses.columns if c not in ("respondent_id", "question_id")]
    first = F.min_by(F.struct(*rest), F.struct("created_at", "response_id")).alias("_r")
    retest = F.coalesce("is_retest_of", F.lit(-1).cast("bigint")).alias("_retest")
    return (
        responses.groupBy("respondent_id", "question_id", retest)
        .agg(first)
        .select("respondent_id", "question_id", "_r.*")
    )


# ----------------------------------------------------------------------------- counters
def running_counters(stream: DataFrame, originals: DataFrame) -> DataFrame:
    """Per respondent: answers, gold and retest counters and the trust they give.

    ``originals`` is the stored log a retest refers to. Speed and repetition come from the
    periodic recount, so they enter as stored and count zero here. Works on a batch as well.
    """
    kinds = {"choice": "string", "minute": "int", "traits": "array<string>"}
    answer = F.struct(
        *[(F.col(n) if n in stream.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]
    )
    old = originals.select(
        F.col("response_id").alias("is_retest_of"),
        F.struct(
            *[(F.col(n) if n in originals.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]
        ).alias("_first"),
    )
    same = C.consistent(F.col("type"), F.col("_first"), F.col("_repeat"))
    gold = F.when(F.col("is_gold") & F.col("is_retest_of").isNull(), annotators.gold_outcome())
    # most answers repeat nothing
    counted = (
        select.join_spread(stream.withColumn("_repeat", answer), old, "is_retest_of", "response_id")
        .withColumn("_same", F.when(F.col("is_retest_of").isNotNull(), same))
        .withColumn("_gold", gold)
        .groupBy("respondent_id")
        .agg(
            F.count("*").alias("answers_count"),
            F.count("_gold").alias("gold_attempts"),
            F.count_if("_gold").alias("gold_passed"),
            F.count("_same").alias("retest_pairs"),
            F.count_if("_same").alias("retest_consistent"),
            F.max("created_at").alias("last_seen"),
        )
    )
    zero = F.lit(0)
    return counted.withColumn(
        "trust",
        C.trust(
            "gold_attempts", "gold_passed", "retest_pairs", "retest_consistent", zero, zero, "answers_count"
        ),
    )


def answer_sessions(
    stream: DataFrame, gap: str = f"{S.DEFAULTS['gamification.streak_gap_minutes']} minutes", delay: str = DELAY
) -> DataFrame:
    """Runs of submissions no more than a gap apart, with their length.

    A session window ends before ``start + gap``, while a pause of exactly the gap still continues
    a streak; the window is one microsecond longer for that.
    """
    return (
        stream.withWatermark("created_at", delay)
        .groupBy("respondent_id", F.session_window("created_at", f"{gap} 1 microsecond").alias("s"))
        .agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
        .select("respondent_id", F.col("s.start").alias("started"), "last_seen", "n")
    )


# -------------------------------------------------------------------------- sliding windows
def rate_stream(stream: DataFrame, key: str, limit: int = S.PER_MINUTE, delay: str = DELAY) -> DataFrame:
    """Keys above the limit in a minute that slides by ten seconds."""
    return (
        stream.withWatermark("created_at", delay)
        .groupBy(key, F.window("created_at", "1 minute", "10 seconds").alias("w"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > limit)
        .select(key, F.col("w.start").alias("window_start"), "n")
    )


def identity_bursts(
    identities: DataFrame, limit: int = S.DEFAULTS["quality.fingerprint_max_identities"], delay: str = DELAY
) -> DataFrame:
    """Fingerprints that created more than ``limit`` identities in 24 hours, sliding by the hour."""
    return (
        identities.withWatermark("first_seen", delay)
        .groupBy("fingerprint_hash", F.window("first_seen", "24 hours", "1 hour").alias("w"))
        .agg(F.count("*").alias("created"))
        .filter(F.col("created") > limit)
        .select("fingerprint_hash", F.col("w.start").alias("window_start"), "created")
    )


def submission_counts(stream: DataFrame, window: str, slide: str, delay: str = DELAY) -> DataFrame:
    """Submissions per respondent in a sliding window: what a rolling leaderboard reads."""
    return (
        stream.withWatermark("created_at", delay)
        .groupBy("respondent_id", F.window("created_at", window, slide).alias("w"))
        .agg(F.count("*").alias("answers"))
        .select("respondent_id", F.col("w.end").alias("window_end"), "answers")
    )


def leaderboard_of(counts: DataFrame, respondents: DataFrame, min_trust: float, k: int) -> DataFrame:
    """Top ``k`` of the newest window."""
    newest = counts.agg(F.max("window_end").alias("_end"))
    eligible = respondents.filter(~F.col("is_flagged") & (F.col("trust_score") >= min_trust))
    return (
        counts.join(F.broadcast(newest), F.col("window_end") == F.col("_end"))
        .join(eligible.select("respondent_id"), "respondent_id", "left_semi")
        .orderBy(F.desc("answers"), "respondent_id")
        .limit(k)
        .select("respondent_id", "answers", "window_end")
    )


def leaderboard_stream(
    stream: DataFrame,
    respondents: DataFrame,
    window: str,
    slide: str,
    path: str,
    checkpoint: str,
    k: int = S.DEFAULTS["gamification.leaderboard_size"],
    min_trust: float = S.DEFAULTS["export.min_trust"],
    **trigger,
):
    """Keep the current standing of a rolling window in a table, refreshed with every batch."""

    def write(batch: DataFrame, _: int) -> None:
        leaderboard_of(batch, respondents, min_trust, k).write.mode("overwrite").parquet(path)

    counts = submission_counts(stream, window, slide)
    writer = counts.writeStream.outputMode("complete").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def daily_volume_stream(
    stream: DataFrame, tz: str = S.DEFAULTS["gamification.streak_timezone"], delay: str = DELAY
) -> DataFrame:
    """Submissions per local day and type."""
    return (
        stream.withColumn("local_at", F.from_utc_timestamp("created_at", tz))
        .withWatermark("local_at", delay)
        .groupBy(F.window("local_at", "1 day").alias("w"), "type")
        .agg(F.count("*").alias("n"))
        .select(F.to_date("w.start").alias("day"), "type", "n")
    )


# ------------------------------------------------------------------------ refresh, lateness
def refresh_sink(
    stream: DataFrame, recompute: Callable[[], DataFrame], path: str, checkpoint: str, **trigger
):
    """Every trigger with new answers recomputes the question statistics from scratch and replaces
    the patches they belong to."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            question_stats.write_question_stats(recompute(), path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "15 minutes"})).start()


def late_policy(stream: DataFrame, exported_at: str, halflife: float) -> DataFrame:
    """Late answers stay, keep the patch of their question and never weigh more than their trust."""
    return select.with_weight(stream, exported_at, halflife)


# ---------------------------------------------------------------------------------- running
def drain(result: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now into a table and read the table.

    ``complete`` keeps the last state; other modes append, and every batch id writes its own part.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part = "state" if mode == "complete" else f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{folder}/table/{part}")

    handle = (
        result.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    handle.awaitTermination()
    reader = result.sparkSession.read.schema(result.schema)
    return reader.parquet(f"{folder}/table/{'state' if mode == 'complete' else '*'}")


def utc_micros(column: Column | str) -> Column:
    return F.unix_micros(column)
