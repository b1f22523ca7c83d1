"""Question histograms, entropies, coverage and consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import select
from crowdgauge.operators.grid import playing
from crowdgauge.runtime import pin

TOTAL = "_total"
QUESTION_KEY = ("question_id", "type")


# ----------------------------------------------------------------------------- histograms
def answer_counts(responses: DataFrame) -> DataFrame:
    """(question_id, type, key, n): answers per choice, minute or trait, retests left out.

    A multi-select question also carries ``_total``, its number of answers.
    """
    multi = F.col("type") == "trait_multiselect"
    single = F.when(F.col("type") == "peak_timing", F.col("minute").cast("string")).otherwise(
        F.col("choice")
    )
    keys = F.when(multi, F.concat(F.col("traits"), F.array(F.lit(TOTAL)))).otherwise(
        F.array(single)
    )
    return (
        responses.filter(F.col("is_retest_of").isNull())
        .select(*QUESTION_KEY, F.explode(keys).alias("key"))
        .groupBy(*QUESTION_KEY, "key")
        .agg(F.count("*").alias("n"))
    )


def as_map(counts: DataFrame) -> DataFrame:
    """The histogram as one map per question; it has as many entries as the answer has values."""
    return counts.groupBy(*QUESTION_KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("answer_counts")
    )


def _n(*keys: str) -> Column:
    return F.sum(F.when(F.col("key").isin(*keys), F.col("n")).otherwise(F.lit(0)))


def exposure_sum() -> Column:
    return F.sum(
        F.when((F.col("type") != "trait_multiselect") | (F.col("key") == TOTAL), F.col("n")).otherwise(
            F.lit(0)
        )
    )


def unit4(x: Column) -> Column:
    """Clamped to the unit interval, four decimals as the columns store them."""
    return C.fmt_number(C.unit(x), 4).cast("decimal(5,4)")


def entropy_binary(a: Column, b: Column) -> Column:
    total = (a + b).cast("double")
    p = a / total
    return F.when(total > 0, unit4(C.entropy_term(p) + C.entropy_term(F.lit(1.0) - p)))


def entropy_three(x: Column, y: Column, z: Column) -> Column:
    total = (x + y + z).cast("double")
    bits = C.entropy_term(x / total) + C.entropy_term(y / total) + C.entropy_term(z / total)
    return F.when(total > 0, unit4(bits / F.log2(F.lit(3.0))))


def entropy_traits(counts: Column, codes: Column) -> Column:
    """Mean binary entropy over the active options of a multi-select histogram map."""
    total = F.try_element_at(counts, F.lit(TOTAL)).cast("double")

    def term(code: Column) -> Column:
        p = F.coalesce(F.try_element_at(counts, code), F.lit(0)) / total
        return C.entropy_term(p) + C.entropy_term(F.lit(1.0) - p)

    mean = F.aggregate(F.transform(codes, term), F.lit(0.0), lambda x, y: x + y) / F.size(codes)
    return F.when((total > 0) & (F.size(codes) > 0), unit4(mean))


def entropies(counts: DataFrame, traits: DataFrame) -> DataFrame:
    """Exposure, entropy and median minute of every question, from its histogram."""
    minute = F.when(F.col("type") == "peak_timing", F.col("key").cast("double"))
    quartiles = F.percentile(minute, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    codes = traits.filter("is_active").agg(F.array_sort(F.collect_set("code")).alias("_codes"))
    grouped = counts.groupBy(*QUESTION_KEY).agg(
        exposure_sum().alias("exposure_count"),
        _n("a").alias("_a"),
        _n("b").alias("_b"),
        _n("a_strong", "a_slight").alias("_la"),
        _n("even").alias("_le"),
        _n("b_slight", "b_strong").alias("_lb"),
        _n("pair_1").alias("_p1"),
        _n("similar").alias("_ps"),
        _n("pair_2").alias("_p2"),
        quartiles.alias("_q"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("answer_counts"),
    )
    spread = F.least(F.lit(1.0), (F.col("_q")[2] - F.col("_q")[0]) / F.lit(S.PEAK_IQR_SCALE))
    kind = F.col("type")
    entropy = (
        F.when(kind == "pairwise_dimension", entropy_binary(F.col("_a"), F.col("_b")))
        .when(kind == "lane_matchup", entropy_three(F.col("_la"), F.col("_le"), F.col("_lb")))
        .when(kind == "duo_synergy", entropy_three(F.col("_p1"), F.col("_ps"), F.col("_p2")))
        .when(kind == "peak_timing", F.when(F.col("exposure_count") >= 2, unit4(spread)))
        .when(kind == "trait_multiselect", entropy_traits(F.col("answer_counts"), F.col("_codes")))
    )
    return grouped.join(F.broadcast(codes), F.lit(True)).select(
        *QUESTION_KEY,
        "answer_counts",
        "exposure_count",
        entropy.alias("entropy"),
        F.when(kind == "peak_timing", C.half_up(F.col("_q")[1])).alias("median_minute"),
    )


# ------------------------------------------------------------------------------- coverage
CELL = ("variant", "item_id", "cell")


def question_cells(questions: DataFrame) -> DataFrame:
    """(…, variant, item_id, cell) for every coverage cell a question touches."""
    variant = C.variant("type", "item_c")
    cell = (
        F.when(variant == "pairwise_dimension", F.col("dimension_id").cast("string"))
        .when(variant == "lane_1v1", F.col("role"))
        .when(variant.isin("lane_2v2", "duo_synergy"), F.col("duo_ctx"))
        .otherwise(F.lit(""))
    )
    members = F.array_compact(F.array("item_a", "item_b", "item_c", "item_d"))
    return (
        questions.withColumn("variant", variant)
        .withColumn("cell", cell)
        .filter(F.col("cell").isNotNull())
        .withColumn("item_id", F.explode(members))
    )


def coverage_cells(aggregable: DataFrame) -> DataFrame:
    """Answers that would be aggregated, per cell; paired comparison counts decisive ones only."""
    counts = F.col("choice").isin("a", "b") | (F.col("type") != "pairwise_dimension")
    return question_cells(aggregable.filter(counts)).groupBy(*CELL).agg(F.count("*").alias("n"))


def pool_cells(pool: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Every legal cell of the enabled pool, answered or not."""

    def of(df: DataFrame, variant: str, cell: Column) -> DataFrame:
        return df.select(F.lit(variant).alias("variant"), "item_id", cell.alias("cell"))

    per_dimension = select.with_catalog(
        pool.select("item_id"), dimensions.filter("is_active"), ["dimension_id"]
    )
    contexts = F.filter(
        F.array(
            *[
                F.when(F.arrays_overlap("roles", select.any_of(r)), F.lit(c))
                for c, r in S.DUO_CONTEXTS.items()
            ]
        ),
        lambda c: c.isNotNull(),
    )
    first_tier = pool.filter(F.col("pool_tier") == S.SYNERGY_TIER)
    frames = [
        of(per_dimension, "pairwise_dimension", F.col("dimension_id").cast("string")),
        of(pool, "peak_timing", F.lit("")),
        of(pool, "trait_multiselect", F.lit("")),
        of(playing(pool, S.LANE_ROLES), "lane_1v1", F.col("role")),
        of(
            pool.filter(F.arrays_overlap("roles", select.any_of(S.DUO_CONTEXTS["bot"]))),
            "lane_2v2",
            F.lit("bot"),
        ),
        of(
            first_tier.select("item_id", F.explode(contexts).alias("c")), "duo_synergy", F.col("c")
        ),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def coverage_median(cells: DataFrame, legal: DataFrame) -> DataFrame:
    """Median answers per legal cell and variant, empty cells counting zero."""
    filled = legal.join(cells, list(CELL), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.groupBy("variant").agg(
        F.percentile("n", F.lit(0.5)).alias("median"), F.count("*").alias("cells")
    )


def coverage_deficit(questions: DataFrame, cells: DataFrame, medians: DataFrame) -> DataFrame:
    """Shortfall of the worst covered cell of a question; null where the median is zero."""
    median = F.col("median")
    gap = (median - F.coalesce("n", F.lit(0))) / median
    short = F.when(median > 0, F.greatest(F.lit(0.0), gap))
    return (
        question_cells(questions)
        .select("question_id", *CELL)
        .join(cells, list(CELL), "left")
        .join(medians, "variant", "left")
        .groupBy("question_id")
        .agg(unit4(F.max(short)).alias("coverage_deficit"))
    )


def question_stats(
    responses: DataFrame,
    questions: DataFrame,
    aggregable: DataFrame,
    pool: DataFrame,
    dimensions: DataFrame,
    traits: DataFrame,
) -> DataFrame:
    """All denormalised statistics of the given questions, recomputed from scratch.

    Questions and cells are read twice, so they are kept: each scans the log behind it once.
    """
    questions, cells = pin(questions), pin(coverage_cells(aggregable))
    medians = coverage_median(cells, pool_cells(pool, dimensions))
    stats = entropies(answer_counts(responses), traits)
    deficit = coverage_deficit(questions, cells, medians)
    return (
        questions.select(*QUESTION_KEY, "patch_id")
        .join(stats, list(QUESTION_KEY), "left")
        .join(deficit, "question_id", "left")
        .withColumn("exposure_count", F.coalesce("exposure_count", F.lit(0)))
    )


def write_question_stats(stats: DataFrame, path: str) -> None:
    """Idempotent refresh: only the patches present are replaced."""
    (
        stats.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("patch_id")
        .parquet(path)
    )


# ------------------------------------------------------------------------------ consensus
def majority(counts: DataFrame, threshold: int, without_unknown: bool = True) -> DataFrame:
    """Most frequent choice of every question with enough support; a tie goes to the smallest
    choice text."""
    asked = counts.filter(~F.col("type").isin("peak_timing", "trait_multiselect"))
    if without_unknown:
        asked = asked.filter(F.col("key") != "unknown")
    return (
        asked.groupBy("question_id")
        .agg(
            F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("majority"),
            F.sum("n").alias("sample_size"),
            F.max("n").alias("majority_n"),
        )
        .filter(F.col("sample_size") >= threshold)
    )


def consensus(counts: DataFrame, threshold: int) -> DataFrame:
    """Share of every choice of the questions with enough support.

    The histogram is read twice, so it is kept: the log behind it is scanned once.
    """
    counts = pin(counts)
    top = majority(counts, threshold, without_unknown=False)
    return counts.join(top, "question_id").select(
        "question_id",
        "key",
        (F.col("n") / F.col("sample_size")).alias("share"),
        "majority",
        "sample_size",
    )


def consensus_feedback(responses: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Whether each answer agrees with the exact most frequent choice."""
    top = pin(majority(counts, threshold, without_unknown=False))
    return responses.join(top, "question_id").select(
        "response_id",
        "question_id",
        (F.col("choice") == F.col("majority")).alias("agreed"),
        "sample_size",
    )


def trait_consensus(
    responses: DataFrame, maps: DataFrame, traits: DataFrame, threshold: int
) -> DataFrame:
    """In how many options each multi-select answer sides with the majority."""
    codes = traits.filter("is_active").agg(F.array_sort(F.collect_set("code")).alias("_codes"))
    counts = F.col("answer_counts")
    total = F.try_element_at(counts, F.lit(TOTAL))

    def agrees(code: Column) -> Column:
        share = F.coalesce(F.try_element_at(counts, code), F.lit(0)) / total
        return F.array_contains("traits", code) == (share > 0.5)

    asked = maps.filter((F.col("type") == "trait_multiselect") & (total >= threshold))
    asked = pin(asked.select("question_id", "answer_counts"))
    return (
        responses.filter(F.col("type") == "trait_multiselect")
        .join(asked, "question_id")
        .join(F.broadcast(codes), F.lit(True))
        .select(
            "response_id",
            F.size(F.filter("_codes", agrees)).alias("agreed"),
            F.size("_codes").alias("compared"),
            total.alias("sample_size"),
        )
    )


def ranking_agreement(rows: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Per ranking: pairs with support, pairs that agree with the majority, answers behind them."""
    decided = rows.filter(F.col("ranking_id").isNotNull() & (F.col("choice") != "unknown"))
    return (
        decided.join(pin(majority(counts, threshold)), "question_id")
        .groupBy("ranking_id")
        .agg(
            F.count_if(F.col("choice") == F.col("majority")).alias("agreed"),
            F.count("*").alias("compared"),
            F.sum("sample_size").alias("sample_size"),
        )
    )


def agreement_rate(
    responses: DataFrame, counts: DataFrame, respondents: DataFrame, threshold: int
) -> DataFrame:
    """Share of a respondent's choices that equal the majority; 0.0 with none eligible.

    The majorities are kept, so that their true size decides how they meet the log: a few questions
    hold most of its rows.
    """
    own = responses.filter(F.col("choice").isNotNull() & (F.col("choice") != "unknown"))
    rated = (
        own.join(pin(majority(counts, threshold)), "question_id")
        .groupBy("respondent_id")
        .agg(F.avg((F.col("choice") == F.col("majority")).cast("double")).alias("rate"))
    )
    return (
        respondents.select("respondent_id")
        .join(rated, "respondent_id", "left")
        .select("respondent_id", F.coalesce("rate", F.lit(0.0)).alias("agreement_rate"))
    )


def type_coverage(heads: DataFrame, respondents: DataFrame) -> DataFrame:
    """Submissions per respondent and type, zeros kept."""
    counted = (
        heads.groupBy("respondent_id").pivot("type", list(S.QUESTION_TYPES)).agg(F.count(F.lit(1)))
    )
    return respondents.select("respondent_id").join(counted, "respondent_id", "left").na.fill(0)


def dimension_counts(aggregable: DataFrame) -> DataFrame:
    """Decisive comparisons per (item, dimension)."""
    return coverage_cells(aggregable.filter(F.col("type") == "pairwise_dimension")).select(
        "item_id", F.col("cell").cast("int").alias("dimension_id"), "n"
    )


def coverage_matrix(
    aggregable: DataFrame, pool: DataFrame, dimension_ids: Sequence[int]
) -> DataFrame:
    """Item by dimension counts with the row minimum, thinnest items first."""
    wide = (
        dimension_counts(aggregable).groupBy("item_id").pivot("dimension_id", list(dimension_ids)).sum("n")
    )
    names = [str(d) for d in dimension_ids]
    cells = pool.select("item_id", "name").join(wide, "item_id", "left").na.fill(0, names)
    lowest = F.least(*names) if len(names) > 1 else F.col(names[0])
    return cells.withColumn("min", lowest).orderBy("min", "name")


def tier_readiness(
    aggregable: DataFrame, items: DataFrame, dimensions: DataFrame, connected: DataFrame
) -> DataFrame:
    """Median decisive count over first-tier cells and connected dimensions against their floors.

    ``connected`` holds (dimension_id, components) of the active dimensions.
    """
    first = items.filter(F.col("is_active") & (F.col("pool_tier") == 1)).select("item_id")
    legal = select.with_catalog(first, dimensions.filter("is_active"), ["dimension_id"])
    counts = dimension_counts(aggregable)
    median = (
        legal.join(counts, ["item_id", "dimension_id"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .agg(F.percentile("n", F.lit(0.5)).alias("median_dn"))
    )
    joined = connected.agg(
        F.count_if(F.col("components") <= 1).alias("connected"), F.count("*").alias("dimensions")
    )
    return median.join(F.broadcast(joined), F.lit(True)).select(
        "median_dn",
        "connected",
        "dimensions",
        F.coalesce(F.col("median_dn") >= S.TIER_READY_MEDIAN, F.lit(False)).alias("meets_median"),
        (F.col("connected") >= S.TIER_READY_CONNECTED).alias("meets_connectivity"),
        (
            F.coalesce(F.col("median_dn") >= S.TIER_READY_MEDIAN, F.lit(False))
            & (F.col("connected") >= S.TIER_READY_CONNECTED)
        ).alias("ready"),
    )
