"""The tables of the data-quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators.annotators import rank_segment
from crowdgauge.operators.estimate import decisive, pair_sizes, spearman
from crowdgauge.operators.grid import legal_duos, role_pairs


# ------------------------------------------------------------------------------ segments
def segment_labels(w: DataFrame) -> DataFrame:
    """Every answer once per segmenting variable: (…, variable, segment)."""
    hours = F.coalesce("declared_hours_bucket", F.lit(S.UNDECLARED))
    both = F.array(
        F.struct(F.lit("rank").alias("variable"), rank_segment().alias("segment")),
        F.struct(F.lit("hours").alias("variable"), hours.alias("segment")),
    )
    return w.withColumn("_s", F.explode(both)).select(*w.columns, "_s.variable", "_s.segment")


def segment_sizes(
    w: DataFrame,
    min_respondents: int = S.DEFAULTS["aggregation.segment_min_respondents"],
    min_comparisons: int = S.DEFAULTS["aggregation.segment_min_comparisons"],
) -> DataFrame:
    """People and decisive comparisons per variable, dimension and segment against the floors."""
    return (
        segment_labels(decisive(w))
        .groupBy("variable", "dimension_id", "segment")
        .agg(
            F.count_distinct("respondent_id").alias("respondents"),
            F.count("*").alias("comparisons"),
        )
        .withColumn(
            "calculable",
            (F.col("respondents") >= min_respondents) & (F.col("comparisons") >= min_comparisons),
        )
    )


def segment_order(variable: str, column: str = "segment") -> Column:
    names = [*(S.RANK_SEGMENTS if variable == "rank" else S.HOURS_BUCKETS), S.UNDECLARED]
    return C.lookup(column, {n: i for i, n in enumerate(names)})


def compare_segments(est: DataFrame, variable: str, by: Sequence[str] = ("dimension_id",)) -> DataFrame:
    """Pairs of segments of one variable: common items, rank correlation, mean absolute
    difference and support changes. ``est`` has (by, segment, item_id, value, support)."""
    placed = est.filter(F.col("value").isNotNull()).withColumn("_o", segment_order(variable))
    left = placed.select(
        *by, "item_id", F.col("segment").alias("first"), F.col("value").alias("x"),
        F.col("support").alias("sx"), F.col("_o").alias("ox"),
    )
    right = placed.select(
        *by, "item_id", F.col("segment").alias("second"), F.col("value").alias("y"),
        F.col("support").alias("sy"), F.col("_o").alias("oy"),
    )
    common = left.join(right, [*by, "item_id"]).filter(F.col("ox") < F.col("oy"))
    keys = [*by, "first", "second"]
    rho = spearman(common, keys, "x", "y").drop("n")
    rest = common.groupBy(*keys).agg(
        F.count("*").alias("common"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"),
        F.count_if(F.col("sx") != F.col("sy")).alias("support_changes"),
    )
    return rest.join(rho, keys)


def segment_trigger(comparisons: DataFrame, by: str = "dimension_id") -> DataFrame:
    """Dimensions where the low and the high rank segment disagree, and whether that is enough
    of them for a finding."""
    low = comparisons.filter(
        (F.col("first") == "low") & (F.col("second") == "high") & (F.col("rho") < S.TRIGGER_RHO)
    )
    return low.agg(
        F.count("*").alias("dimensions"),
        (F.count("*") >= S.TRIGGER_DIMENSIONS).alias("finding"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.col(by).cast("string")))).alias("which"),
    )


# ------------------------------------------------------------------------------ coverage
def _spread(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(
        F.count("*").alias("observed"),
        F.min("n").alias("least"),
        F.percentile("n", F.lit(0.5)).alias("median"),
        F.max("n").alias("most"),
    )


def pair_coverage(
    pairwise: DataFrame, lane: DataFrame, bot: DataFrame, duos: DataFrame, pool: DataFrame
) -> DataFrame:
    """Possible and observed pairs per magnitude, with the answers behind an observed pair.

    ``bot`` holds the two-against-two lane answers, ``duos`` the synergy answers.
    """
    ids = pool.select("item_id")

    def in_pool(df: DataFrame) -> DataFrame:
        for side in ("item_a", "item_b"):
            df = df.join(ids.withColumnRenamed("item_id", side), side, "left_semi")
        return df

    size = ids.agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("possible"))
    scores = _spread(in_pool(pair_sizes(decisive(pairwise), ["dimension_id"])), ["dimension_id"])
    score_rows = scores.join(F.broadcast(size), F.lit(True)).withColumn(
        "magnitude", F.concat(F.lit("score "), F.col("dimension_id").cast("string"))
    )
    legal = role_pairs(pool)
    lanes = pair_sizes(lane, ["role"]).join(legal, ["role", "item_a", "item_b"], "left_semi")
    lane_rows = (
        legal.groupBy("role")
        .agg(F.count("*").alias("possible"))
        .join(_spread(lanes, ["role"]), "role", "left")
        .withColumn("magnitude", F.concat(F.lit("lane_strength "), "role"))
    )
    legal_duo = legal_duos(pool).distinct()
    possible = legal_duo.groupBy("duo_ctx").agg(F.count("*").alias("possible"))

    def duo_rows(answers: DataFrame, label: Column) -> DataFrame:
        shown = duo_sides(answers).groupBy("duo_ctx", "duo").agg(F.count("*").alias("n"))
        counted = _spread(shown.join(legal_duo, ["duo_ctx", "duo"], "left_semi"), ["duo_ctx"])
        return possible.join(counted, "duo_ctx", "left").withColumn("magnitude", label)

    synergy_rows = duo_rows(duos, F.concat(F.lit("synergy "), "duo_ctx"))
    bot_rows = duo_rows(bot, F.lit("duo lane_strength bot")).filter("duo_ctx = 'bot'")
    columns = ["magnitude", "possible", "observed", "least", "median", "most"]
    out = score_rows.select(*columns)
    for frame in (lane_rows, bot_rows, synergy_rows):
        out = out.unionByName(frame.select(*columns))
    return out.withColumn("observed", F.coalesce("observed", F.lit(0)))


def duo_sides(duos: DataFrame, *columns: str) -> DataFrame:
    """One row per side of a two-against-two answer: (columns, duo_ctx, duo, sign)."""
    top = C.duo_struct(F.col("item_a"), F.col("role_a"), F.col("item_b"), F.col("role_b"))
    bottom = C.duo_struct(F.col("item_c"), F.col("role_c"), F.col("item_d"), F.col("role_d"))
    sides = F.array(
        F.struct(top.alias("duo"), F.lit(1.0).alias("sign")),
        F.struct(bottom.alias("duo"), F.lit(-1.0).alias("sign")),
    )
    return duos.select("duo_ctx", *columns, F.explode(sides).alias("_s")).select(
        "duo_ctx", *columns, "_s.duo", "_s.sign"
    )


def magnitude_summary(est: DataFrame, by: Sequence[str] = ("magnitude",)) -> DataFrame:
    """Support tallies and mean interval width."""
    return est.groupBy(*by).agg(
        *[
            F.count_if(F.col("support") == level).alias(level)
            for level in ("solid", "limited", "insufficient")
        ],
        F.avg(F.col("high") - F.col("low")).alias("mean_width"),
    )


def concentration(w: DataFrame) -> DataFrame:
    """Share of the rows that the most active tenth of respondents contributed.

    The tenth is cut in the histogram of contributions: how many respondents gave exactly k rows.
    N rows have at most about sqrt(2 N) distinct k, so the ordered window stays short.
    """
    per_person = w.groupBy("respondent_id").agg(F.count("*").alias("k"))
    histogram = per_person.groupBy("k").agg(F.count("*").alias("people"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.ceil(F.sum("people").over(everyone) / 10)
    before = F.coalesce(F.sum("people").over(above), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("people"), top - before))
    index = F.col("top_rows") / F.col("rows")
    return (
        histogram.withColumn("top", top)
        .withColumn("taken", taken)
        .agg(
            F.sum("people").alias("respondents"),
            F.max("top").alias("top"),
            F.sum(F.col("people") * F.col("k")).alias("rows"),
            F.sum(F.col("taken") * F.col("k")).alias("top_rows"),
        )
        .withColumn("index", index)
        .withColumn("flagged", F.col("index") > S.CONCENTRATION_LIMIT)
    )


# ------------------------------------------------------------------------ declared data
SAMPLE_VARIABLES = {
    "declared_rank": S.RANKS,
    "declared_main_role": S.ROLES,
    "declared_hours_bucket": S.HOURS_BUCKETS,
}


def sample_tables(w: DataFrame) -> DataFrame:
    """Respondents and responses per declared value, every valid value listed, '' for not said."""
    said = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.coalesce(v, F.lit("")).alias("value"))
            for v in SAMPLE_VARIABLES
        ]
    )
    people = w.groupBy("respondent_id", *SAMPLE_VARIABLES).agg(F.count("*").alias("n"))
    counted = (
        people.select("n", F.explode(said).alias("s"))
        .groupBy("s.variable", "s.value")
        .agg(F.count("*").alias("respondents"), F.sum("n").alias("responses"))
    )
    listed = w.sparkSession.createDataFrame(
        [(v, value) for v, values in SAMPLE_VARIABLES.items() for value in (*values, "")],
        "variable string, value string",
    )
    return listed.join(counted, ["variable", "value"], "left").na.fill(0)


def none_declared(w: DataFrame) -> DataFrame:
    people = w.select("respondent_id", *SAMPLE_VARIABLES).distinct()
    nothing = F.coalesce(*SAMPLE_VARIABLES).isNull()
    return people.agg(F.count_if(nothing).alias("none"), F.count("*").alias("respondents"))


def role_coverage(lane: DataFrame, bot_duos: DataFrame) -> DataFrame:
    """How many opinions on a lane come from people who play it."""
    main = F.col("declared_main_role")

    def tally(df: DataFrame, name: Column, plays: Column) -> DataFrame:
        return df.groupBy(name.alias("magnitude")).agg(
            F.count("*").alias("responses"),
            F.count_if(plays).alias("mains"),
            F.count_if(main.isNull()).alias("undeclared"),
        )

    lanes = tally(lane, F.concat(F.lit("lane_strength "), "role"), main == F.col("role"))
    bot = tally(bot_duos, F.lit("duo lane_strength bot"), main.isin(*S.DUO_CONTEXTS["bot"]))
    return lanes.unionByName(bot)


def trust_by_hours(people: DataFrame) -> DataFrame:
    """Trust quartiles per hours bucket over unflagged people, '' for not said."""
    q = F.percentile("trust_score", F.array(*[F.lit(x / 4) for x in range(5)]))
    return (
        people.filter(~F.col("is_flagged"))
        .groupBy(F.coalesce("declared_hours_bucket", F.lit("")).alias("bucket"))
        .agg(F.count("*").alias("n"), q.alias("_q"))
        .select(
            "bucket", "n", *[F.col("_q")[i].alias(f"q{i * 25}") for i in range(5)]
        )
    )


def trust_hours_rho(people: DataFrame) -> DataFrame:
    order = C.lookup("declared_hours_bucket", {b: i for i, b in enumerate(S.HOURS_BUCKETS)})
    declared = people.filter(
        ~F.col("is_flagged") & F.col("declared_hours_bucket").isNotNull()
    ).withColumn("bucket", order)
    return spearman(declared, [], "bucket", "trust_score")


# ---------------------------------------------------------------------- checks, findings
def wide_peaks(peaks: DataFrame) -> DataFrame:
    """Peaks with the sample of a solid one and a wider interval: the mark of two camps."""
    least_n, width = next(
        (n, w) for kind, level, n, w in S.SUPPORT_THRESHOLDS if (kind, level) == ("peak_minute", "solid")
    )
    return peaks.filter((F.col("n") >= least_n) & (F.col("high") - F.col("low") > width))


def uneven_traits(proportions: DataFrame) -> DataFrame:
    """Items whose sample differs between options."""
    return (
        proportions.groupBy("item_id")
        .agg(F.count_distinct("n").alias("sizes"))
        .filter("sizes > 1")
    )


def findings(
    agreements: DataFrame,
    fits: DataFrame,
    concentration_row: DataFrame,
    trigger: DataFrame,
    gold: DataFrame,
    patch_gold: DataFrame,
    uneven: DataFrame,
) -> DataFrame:
    """Everything the report calls a finding: (rule, subject, value)."""

    def rows(df: DataFrame, rule: str, subject: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(rule).alias("rule"),
            subject.cast("string").alias("subject"),
            value.cast("double").alias("value"),
        )

    frames = [
        rows(
            agreements.filter(F.col("reading") == "unreliable"),
            "alpha_unreliable",
            F.col("magnitude"),
            F.col("alpha"),
        ),
        rows(fits.filter("failed"), "fit_failed", F.col("fit"), F.col("discarded")),
        rows(fits.filter("components > 1"), "graph_split", F.col("fit"), F.col("components")),
        rows(concentration_row.filter("flagged"), "concentration", F.lit("rows"), F.col("index")),
        rows(trigger.filter("finding"), "segments_disagree", F.col("which"), F.col("dimensions")),
        rows(gold.filter("suspicious"), "gold_suspicious", F.col("question_id"), F.col("attempts")),
        rows(patch_gold.filter("active_gold = 0"), "patch_without_gold", F.col("version"), F.lit(0)),
        rows(uneven, "traits_uneven", F.col("item_id"), F.col("sizes")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def width_ratio(by_comparison: DataFrame, by_respondent: DataFrame, fit: str) -> DataFrame:
    """Mean interval width of the two bootstrap versions and their ratio."""

    def width(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(fit).agg(F.avg(F.col("high") - F.col("low")).alias(name))

    narrow, honest = F.col("narrow"), F.col("honest")
    return (
        width(by_comparison, "narrow")
        .join(width(by_respondent, "honest"), fit, "left")
        .withColumn("ratio", F.when(narrow > 0, honest / narrow))
    )


# ------------------------------------------------------------------------------ truth
def evaluate_estimates(est: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """Estimates against a known truth: rank correlation, mean absolute error, how often the
    interval holds the truth, and how many estimates are solid."""
    keys = [c for c in truth.columns if c != "truth"]
    both = est.filter(F.col("value").isNotNull()).join(truth, keys)
    rho = spearman(both, list(by), "value", "truth").drop("n")
    rest = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("value") - F.col("truth"))).alias("mae"),
        F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("double")).alias("covered"),
        F.count_if(F.col("support") == "solid").alias("solid"),
    )
    return rest.join(rho, list(by))


def metrics(df: DataFrame, section: str, key: Column, values: Sequence[str], n: Column) -> DataFrame:
    """A section as long metrics: (section, metric, key, n, value)."""
    entries = F.array(
        *[
            F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value"))
            for v in values
        ]
    )
    return df.select(
        F.lit(section).alias("section"),
        key.cast("string").alias("key"),
        n.cast("bigint").alias("n"),
        F.explode(entries).alias("_e"),
    ).select("section", "_e.metric", "key", "n", "_e.value")


def quality_report(sections: Sequence[DataFrame]) -> DataFrame:
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out
