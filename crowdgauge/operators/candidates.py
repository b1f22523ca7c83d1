"""Which questions to ask next: priorities, batches, cadences, retests and gold."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import behaviour, select
from crowdgauge.operators.scan import OrderedGroups
from crowdgauge.runtime import pin, unpin

VARIANT_TYPE = {
    "pairwise_dimension": "pairwise_dimension",
    "peak_timing": "peak_timing",
    "lane_1v1": "lane_matchup",
    "lane_2v2": "lane_matchup",
    "duo_synergy": "duo_synergy",
    "trait_multiselect": "trait_multiselect",
}
#: Lists of candidates, in the order in which a question in several of them counts.
BRIDGE, HOT, COLD = 0, 1, 2
#: Places at the front of a list that many respondents want, and the parts their rows are dealt to.
FRONT, SALTS = 256, 32


def priority(weights: Mapping[str, float] = S.DEFAULTS["sampler.weights"]) -> Column:
    """Scarcity, information, coverage and bridge; what is not known counts zero."""
    exposure = F.col("exposure_count").cast("double")
    return (
        F.lit(weights["escasez"]) * (F.lit(1.0) / (F.lit(1.0) + exposure))
        + F.lit(weights["informacion"]) * F.coalesce(F.col("entropy").cast("double"), F.lit(0.0))
        + F.lit(weights["cobertura"])
        * F.coalesce(F.col("coverage_deficit").cast("double"), F.lit(0.0))
        + F.lit(weights["puente"])
        * F.when(F.col("bridge_priority"), F.lit(1.0)).otherwise(F.lit(0.0))
    )


def open_questions(
    questions: DataFrame,
    pool: DataFrame,
    weights: Mapping[str, float] = S.DEFAULTS["sampler.weights"],
    cold: int = 0,
    patch_id: int | None = None,
) -> DataFrame:
    """(question_id, variant, priority) of all questions that are not gold, have at least ``cold``
    answers and all members in the pool; with ``patch_id`` only those of that patch."""
    kept = questions.filter(~F.col("is_gold") & (F.col("exposure_count") >= cold))
    if patch_id is not None:
        kept = kept.filter(F.col("patch_id") == patch_id)
    return select.members_inside(kept, pool).select(
        "question_id", C.variant("type", "item_c").alias("variant"), priority(weights).alias("priority")
    )


def priority_topk(
    questions: DataFrame,
    pool: DataFrame,
    weights: Mapping[str, float] = S.DEFAULTS["sampler.weights"],
    cold: int = S.DEFAULTS["sampler.cold_threshold"],
    k: int = S.DEFAULTS["sampler.candidate_limit"],
    patch_id: int | None = None,
) -> DataFrame:
    """The best ``k`` questions per variant above the cold threshold, all members in the pool.

    With ``patch_id`` only questions of that patch are served.

    Keeping the first k of a window prunes before the shuffle, so six groups are no bottleneck.
    """
    hot = open_questions(questions, pool, weights, cold, patch_id)
    place = Window.partitionBy("variant").orderBy(F.desc("priority"), "question_id")
    return hot.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def _draw_variant(draw: Column, blocked: Column, left: Column) -> Column:
    """A variant by weight among those with questions ``left`` and of another type than the blocked one."""

    def weight(i: int, name: str) -> Column:
        barred = F.coalesce(blocked == F.lit(VARIANT_TYPE[name]), F.lit(False))
        return F.when((F.get(left, F.lit(i)) > 0) & ~barred, float(S.VARIANT_WEIGHTS[name])).otherwise(0.0)

    total = reduce(lambda x, y: x + y, [weight(i, n) for i, n in enumerate(S.VARIANTS)])
    result, passed = None, F.lit(0.0)
    for i, name in enumerate(S.VARIANTS):
        passed = passed + weight(i, name)
        test = (weight(i, name) > 0) & (draw * total < passed)
        result = F.when(test, F.lit(name)) if result is None else result.when(test, F.lit(name))
    return result


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _candidate_index(hot: DataFrame, cold: DataFrame, bridges: DataFrame, seed: int) -> DataFrame:
    """Every candidate once, in the first of its lists, with its place there: (list, variant, at,
    question_id). Cold questions stand in an order drawn by hash. Lists of any length."""

    def tagged(df: DataFrame, number: int, variant: Column, order: Column) -> DataFrame:
        entry = F.struct(
            F.lit(number).alias("list"), variant.alias("variant"), order.cast("double").alias("order")
        )
        return df.select(F.col("question_id").cast("bigint").alias("question_id"), entry.alias("entry"))

    every = (
        tagged(bridges, BRIDGE, F.lit("pairwise_dimension"), F.col("place"))
        .unionByName(tagged(hot, HOT, F.col("variant"), F.col("place")))
        .unionByName(tagged(cold, COLD, F.col("variant"), C.hash_draw(seed, "question_id", F.lit("cold"))))
    )
    once = pin(every.groupBy("question_id").agg(F.min("entry").alias("e")).select("question_id", "e.*"))
    placed = OrderedGroups(once, ["list", "variant"], ["order", "question_id"]).with_position("at").result
    return pin(placed.select("list", "variant", F.col("at").cast("bigint").alias("at"), "question_id"))


def next_questions(
    respondents: DataFrame,
    hot: DataFrame,
    cold: DataFrame,
    bridges: DataFrame,
    answered: DataFrame,
    n: int,
    epsilon: float = S.DEFAULTS["sampler.epsilon"],
    seed: int = 0,
) -> DataFrame:
    """A batch of ``n`` questions for every respondent: (respondent_id, slot, variant, question_id).

    ``hot`` (variant, place, question_id), ``cold`` (variant, question_id) and ``bridges``
    (place, question_id) may have any length; a smaller place comes first, ties by question_id, and
    a question in several lists counts as a bridge, then as hot. A respondent brings the answered
    questions, the last types (``recent``, oldest first) and ``answers_count``. The first positions
    are paired comparisons, no type comes four times in a row while another is open, and a paired
    slot takes the best unanswered bridge first. Then a draw chooses between the best hot question
    and a cold one; the cold ones form a circle in hash order, in which each respondent and variant
    starts at a place of their own. All randomness is a hash of seed, respondent and place.

    Nobody meets a whole list: the m-th question not answered is m plus the number of answered ones
    before it, which follows from the answered places alone. A slot stays empty only if nothing is
    left to ask. Rows that repeat an answer count once; empty lists have no share in the draws.
    """
    index = _candidate_index(hot, cold, bridges, seed)
    key = F.concat_ws(" ", F.col("list").cast("string"), "variant")
    sizes = index.groupBy("list", "variant").agg(F.count("*").alias("size"))  # a row per list and variant
    start = F.when(
        F.col("list") == COLD,
        F.floor(C.hash_draw(seed, "respondent_id", "variant", F.lit("start")) * F.col("size")),
    ).otherwise(F.lit(0))
    met = (
        answered.select("respondent_id", F.col("question_id").cast("bigint").alias("question_id"))
        .join(index, "question_id")
        .join(F.broadcast(sizes), ["list", "variant"])
        .select("respondent_id", "list", "variant", F.pmod(F.col("at") - start, F.col("size")).alias("at"))
        .distinct()
    )
    groups = ["respondent_id", "list", "variant"]
    missing = F.col("at") - F.col("i")  # places not answered before an answered one
    passed = (
        OrderedGroups(pin(met), groups, ["at"]).with_position("i").result.groupBy(*groups)
        .agg(
            F.count("*").alias("seen"),
            F.array(*[F.count_if(missing <= m) for m in range(n)]).alias("skip"),
        )
        .groupBy("respondent_id")
        .agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct("seen", "skip")))).alias("_met"))
    )
    all_sizes = sizes.agg(F.map_from_entries(F.collect_list(F.struct(key, "size"))).alias("_size"))
    who = (
        respondents.select("respondent_id", "answers_count", "recent")
        .join(passed, "respondent_id", "left")
        .join(F.broadcast(all_sizes), F.lit(True))
    )

    def left(number: int, variant: Column) -> Column:
        name = F.concat(F.lit(f"{number} "), variant)
        seen = F.try_element_at("_met", name)["seen"]
        return F.coalesce(F.try_element_at("_size", name), F.lit(0)) - F.coalesce(seen, F.lit(0))

    def step(state: Column, slot: Column) -> Column:
        same = (state["a"] == state["b"]) & (state["b"] == state["c"])
        warm = (F.col("answers_count") + slot < S.WARMUP_PAIRWISE) & (F.get(state["l"], F.lit(0)) > 0)

        def choose(draw: Column) -> Column:
            free = _draw_variant(draw, F.lit(None).cast("string"), state["l"])
            varied = F.coalesce(_draw_variant(draw, state["c"], state["l"]), free)
            return F.when(warm, F.lit("pairwise_dimension")).otherwise(F.when(same, varied).otherwise(free))

        def after(chosen: Column) -> Column:
            taken = [F.when(chosen == F.lit(name), 1).otherwise(0) for name in S.VARIANTS]
            return F.struct(
                F.concat(state["out"], F.array(chosen)).alias("out"),
                state["b"].alias("a"),
                state["c"].alias("b"),
                C.lookup(chosen, VARIANT_TYPE).alias("c"),
                F.array(*[F.get(state["l"], F.lit(i)) - t for i, t in enumerate(taken)]).alias("l"),
            )

        draw = C.hash_draw(seed, "respondent_id", slot, F.lit("variant"))
        return _let(_let(draw, choose), after)

    lefts = F.array(
        *[
            sum((left(x, F.lit(v)) for x in (HOT, COLD)), left(BRIDGE, F.lit(v))).cast("bigint")
            for v in S.VARIANTS
        ]
    )
    first = F.struct(
        F.array().cast("array<string>").alias("out"),
        *[F.get("recent", F.size("recent") - back).alias(k) for k, back in (("a", 3), ("b", 2), ("c", 1))],
        F.col("_left").alias("l"),
    )
    slots = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), first, step, lambda s: s["out"])

    def take(state: Column, j: Column) -> Column:
        """The j-th pick of a variant: the list it comes from and its number among the unanswered."""
        draw = C.hash_draw(seed, "respondent_id", "variant", j, F.lit("branch"))
        bridge, has_hot, has_cold = (
            F.get(state["n"], F.lit(x)) < F.get("_lists", F.lit(x)) for x in (BRIDGE, HOT, COLD)
        )
        explore = has_cold & ((draw < F.lit(float(epsilon))) | ~has_hot)
        source = F.when(bridge, BRIDGE).when(explore, COLD).when(has_hot, HOT)
        return _let(
            source,
            lambda x: F.struct(
                F.concat(
                    state["out"], F.array(F.struct(x.alias("list"), F.get(state["n"], x).alias("m")))
                ).alias("out"),
                F.transform(state["n"], lambda c, i: c + F.when(i == x, 1).otherwise(0)).alias("n"),
            ),
        )

    zero = F.struct(
        F.array().cast("array<struct<list:int,m:int>>").alias("out"), F.array(*[F.lit(0)] * 3).alias("n")
    )
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero, take, lambda s: s["out"])
    of_variant = F.filter(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("_slots", i) == F.col("variant")
    )
    name = F.concat_ws(" ", F.col("pick.list").cast("string"), "variant")
    skipped = F.get(F.try_element_at("_met", name)["skip"], F.col("pick.m"))
    wanted = (
        who.withColumn("_left", lefts)
        .withColumn("_slots", slots)
        .select(
            "respondent_id", "_met", "_size", "_slots",
            F.explode(F.array_compact(F.array_distinct("_slots"))).alias("variant"),
        )
        .withColumn("_lists", F.array(*[left(x, F.col("variant")) for x in (BRIDGE, HOT, COLD)]))
        .withColumn("_picks", picks)
        .select("respondent_id", "variant", "_met", "_size", "_picks", F.posexplode(of_variant).alias("j", "slot"))
        .withColumn("pick", F.get("_picks", F.col("j")))
        .withColumn("list", F.col("pick.list"))
        .withColumn("size", F.try_element_at("_size", name))
        .withColumn("_m", F.col("pick.m") + F.coalesce(skipped, F.lit(0)))
        .withColumn("at", F.pmod(F.col("_m") + start, F.col("size")))
        .select("respondent_id", "slot", "variant", "list", "at")
    )
    # everybody starts at the front of the bridges and hot lists: those places are salted
    front = (F.col("list") != COLD) & (F.col("at") < FRONT)
    salted = wanted.withColumn(
        "_salt", F.when(front, F.pmod(F.xxhash64("respondent_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    spread = F.when(front, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(
        index.withColumn("_salt", F.explode(spread)), ["list", "variant", "at", "_salt"]
    ).select("respondent_id", "slot", "variant", "question_id")


def due_flags(
    respondents: DataFrame,
    gold_every: tuple[int, int] = tuple(S.DEFAULTS["quality.honeypot_every"]),
    retest_every: int = S.DEFAULTS["quality.retest_every"],
    seed: int = 0,
) -> DataFrame:
    """Open the cadence windows that are not open yet and tell what is due at this position."""
    low, high = gold_every
    step = F.lit(low) + F.floor(C.hash_draw(seed, "respondent_id", "answers_count") * (high - low + 1))
    position = F.col("answers_count")
    gold_at = F.coalesce(F.col("next_gold_at").cast("bigint"), position + step - 1)
    retest_at = F.coalesce(F.col("next_retest_at").cast("bigint"), position + retest_every - 1)
    return respondents.select(
        "respondent_id",
        gold_at.alias("next_gold_at"),
        retest_at.alias("next_retest_at"),
        (position >= gold_at).alias("gold_due"),
        (position >= retest_at).alias("retest_due"),
    )


def retest_candidates(
    responses: DataFrame,
    rankings: DataFrame,
    admissible: DataFrame,
    patch_id: int,
    min_distance: int = S.DEFAULTS["quality.retest_min_distance"],
) -> DataFrame:
    """Own original answers that may be asked again: (respondent_id, response_id, question_id).

    At least ``min_distance`` submissions old, of a question still admissible, never retested, not
    gold and not 'unknown'. Of a ranking only its extreme pair qualifies, and the age is that of
    the ranking's head. Admissible ids, heads and old submissions are kept: their true size decides
    how they meet the log, where a few questions hold most of the rows.
    """
    admissible = pin(admissible.select("question_id"))
    current = responses.filter(F.col("patch_id") == patch_id)
    repeated = responses.select(F.col("is_retest_of").alias("response_id")).filter(
        F.col("response_id").isNotNull()
    )
    eligible = (
        current.filter(
            F.col("is_retest_of").isNull()
            & ~F.col("is_gold")
            & (F.coalesce("choice", F.lit("")) != "unknown")
        )
        .join(repeated, "response_id", "left_anti")
        .join(admissible, "question_id", "left_semi")
    )
    heads = select.heads(responses, rankings)
    slim = pin(heads.select("respondent_id", "response_id", "created_at", "ranking_id"), "zstd")
    placed = behaviour.positions(slim)
    volume = placed.groupBy("respondent_id").agg(F.count("*").alias("answers_count"))
    old = pin(
        placed.join(volume, "respondent_id")
        .filter(F.col("position") <= F.col("answers_count") - min_distance)
        .select("response_id", "ranking_id"),
        "zstd",
    )
    unpin(slim)
    single = eligible.filter(F.col("type") != "pairwise_dimension").join(
        old.select("response_id"), "response_id", "left_semi"
    )
    low, high = C.canonical_pair(
        F.element_at("submitted_order", 1), F.element_at("submitted_order", -1)
    )
    extremes = (
        rankings.filter(F.col("submitted_order").isNotNull() & (F.col("patch_id") == patch_id))
        .join(old.select("ranking_id").filter("ranking_id is not null"), "ranking_id", "left_semi")
        .select("respondent_id", "dimension_id", low.alias("item_a"), high.alias("item_b"))
        .distinct()
    )
    paired = eligible.filter(F.col("type") == "pairwise_dimension").join(
        extremes, ["respondent_id", "dimension_id", "item_a", "item_b"], "left_semi"
    )
    columns = ["respondent_id", "response_id", "question_id"]
    return single.select(*columns).unionByName(paired.select(*columns))


def unseen_gold(
    respondents: DataFrame, gold: DataFrame, responses: DataFrame, seed: int = 0
) -> DataFrame:
    """Per respondent the number of gold questions not seen yet and one of them.

    Gold is put in one hash-drawn circle; a respondent starts at an own place and takes the first
    one not seen. That is the smallest number missing among the places already seen, so nobody
    meets the whole catalog: a respondent's window holds only the gold they answered.
    """
    circle = pin(gold.select("question_id").distinct())  # its size and its order are read apart
    size = circle.agg(F.count("*").cast("bigint").alias("_size"))
    drawn = circle.withColumn("_draw", C.hash_draw(seed, "question_id"))
    # always in blocks: one sort by ranges, one row per block carries the count on
    placed = OrderedGroups(drawn, [], ["_draw", "question_id"], rows_per_task=0).with_position("_g").result
    placed = pin(placed.select("question_id", F.col("_g").cast("bigint").alias("_g")).join(F.broadcast(size), F.lit(True)))
    start = F.pmod(F.xxhash64(F.lit(seed), "respondent_id"), F.col("_size"))
    seen = (
        responses.select("respondent_id", "question_id")
        .join(placed, "question_id")
        .select("respondent_id", F.pmod(F.col("_g") - start, F.col("_size")).alias("_at"))
        .distinct()
    )
    steps = Window.partitionBy("respondent_id").orderBy("_at")
    gaps = (
        seen.withColumn("_i", (F.row_number().over(steps) - 1).cast("bigint"))
        .groupBy("respondent_id")
        .agg(
            F.count("*").alias("_seen"),
            F.min(F.when(F.col("_at") != F.col("_i"), F.col("_i"))).alias("_gap"),
        )
    )
    known = F.coalesce("_seen", F.lit(0))
    who = (
        respondents.select("respondent_id")
        .join(gaps, "respondent_id", "left")
        .join(F.broadcast(size), F.lit(True))
        .withColumn("unseen", F.col("_size") - known)
        .withColumn(
            "_g",
            F.when(
                F.col("unseen") > 0,
                F.pmod(F.coalesce("_gap", known) + start, F.nullif(F.col("_size"), F.lit(0))),
            ),
        )
    )
    return who.join(placed.select("_g", "question_id"), "_g", "left").select(
        "respondent_id", "unseen", "question_id"
    )
