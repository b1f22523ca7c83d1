"""The measurement tables as views over the given star schema.

Items are part brands, respondents are customers, every order is one submission: its brands ranked
by price give paired comparisons, its quantities give ordinal, minute, multi-select and duo answers.
The ``events`` table plays the behaviour log.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdgauge import settings as S
from crowdgauge.functions import columns as C
from crowdgauge.operators import select
from crowdgauge.operators.scan import OrderedGroups
from crowdgauge.runtime import pin, unpin
from crowdgauge.sources.tables import read_table

#: Parameters of the bound run.
EXPORTED_AT = "2000-06-01"
HALFLIFE = 365.0
WINDOW = ("16.6", "16.18")
MIN_TRUST = 0.30
ENABLED_TIERS = 2
CURRENT_PATCH = 2001
TRAITS = ("A", "N", "R")
EVENTS = ("view", "click", "signup", "purchase", "error")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _five_levels(d: Column) -> Column:
    return (
        F.when(d >= 20, "a_strong")
        .when(d >= 5, "a_slight")
        .when(d > -5, "even")
        .when(d > -20, "b_slight")
        .otherwise("b_strong")
    )


class Binding:
    def __init__(self, spark: SparkSession, directory: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)

    # ---------------------------------------------------------------------------- catalogs
    @cached_property
    def items(self) -> DataFrame:
        """One row per brand. The catalog is as long as the list of brands, so ranking it in one
        task is bounded."""
        item_id = F.substring("p_brand", 7, 10).cast("int")
        counted = self.raw("part").groupBy("p_brand").agg(F.count("*").alias("n_parts"))
        rank = F.row_number().over(Window.orderBy(F.desc("n_parts"), "item_id"))
        third = F.col("item_id") % 3
        roles = F.array(
            F.when(third != 1, F.lit("adc")),
            F.when(F.col("item_id") % 5 == 0, F.lit("jungle")),
            F.when(F.col("item_id") % 4 == 1, F.lit("mid")),
            F.when(third != 0, F.lit("support")),
            F.when(F.col("item_id") % 2 == 0, F.lit("top")),
        )
        return (
            counted.withColumn("item_id", item_id)
            .withColumn("rank_in_role", rank)
            .select(
                "item_id",
                F.col("p_brand").alias("key"),
                F.concat(F.lit("Item "), "item_id").alias("name"),
                F.array_compact(roles).alias("roles"),
                F.when(F.col("rank_in_role") <= S.TIER_1_RANK, 1)
                .when(F.col("rank_in_role") <= S.TIER_2_RANK, 2)
                .otherwise(3)
                .alias("pool_tier"),
                (F.col("item_id") % 13 != 0).alias("is_active"),
                "rank_in_role",
                "n_parts",
            )
        )

    @cached_property
    def pool(self) -> DataFrame:
        return select.pool(self.items, ENABLED_TIERS)

    @cached_property
    def respondents(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("respondent_id"),
            F.concat(F.lit("f"), key % 40).alias("fingerprint_hash"),
            F.concat(F.lit("ip"), key % 50).alias("ip_hash"),
            _pick(S.RANKS, key % 12).alias("declared_rank"),
            _pick(S.ROLES, key % 6).alias("declared_main_role"),
            _pick(S.HOURS_BUCKETS, key % 5).alias("declared_hours_bucket"),
            ((F.lit(200) + F.lit(8) * (key % 101)).cast("double") / F.lit(1000.0)).alias(
                "trust_score"
            ),
            (key % 37 == 0).alias("is_flagged"),
            F.col("c_mktsegment").alias("segment"),
        )

    @cached_property
    def patches(self) -> DataFrame:
        years = self.raw("orders").select(F.year("o_orderdate").alias("patch_id")).distinct()
        return years.select(
            "patch_id",
            F.concat(F.lit("16."), (F.col("patch_id") - 1994) * 3).alias("version"),
            F.make_date("patch_id", F.lit(1), F.lit(1)).alias("released_at"),
            (F.col("patch_id") == CURRENT_PATCH).alias("is_current"),
        )

    @cached_property
    def dimensions(self) -> DataFrame:
        return (
            self.raw("orders")
            .select(F.substring("o_orderpriority", 1, 1).cast("int").alias("dimension_id"))
            .distinct()
            .select(
                "dimension_id",
                F.concat(F.lit("dim"), "dimension_id").alias("code"),
                F.col("dimension_id").alias("display_order"),
                F.lit(True).alias("is_active"),
            )
        )

    @cached_property
    def traits(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .select(F.col("l_returnflag").alias("code"))
            .distinct()
            .select(
                F.ascii("code").alias("trait_id"),
                "code",
                F.ascii("code").alias("display_order"),
                F.lit(True).alias("is_active"),
            )
        )

    # ------------------------------------------------------------------------- submissions
    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("respondent_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("dimension_id"),
            F.year("o_orderdate").alias("patch_id"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.col("o_orderstatus").alias("status"),
            (F.col("o_orderkey") * 37 % 4000).alias("response_time_ms"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """Lines reduced to (order, item) with map-side partial sums, before anything else."""
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"
        )
        brand = self.raw("part").select(
            "p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("item_id")
        )
        return (
            lines.join(brand, lines.l_partkey == brand.p_partkey)
            .groupBy(F.col("l_orderkey").alias("order_id"), "item_id")
            .agg(
                F.sum("l_quantity").alias("qty"),
                F.max("l_extendedprice").alias("price"),
                F.array_sort(F.collect_set("l_returnflag")).alias("traits"),
            )
        )

    def _ranked(self, *columns: str) -> DataFrame:
        """One row per submission with its items in id order: at most one entry per catalog item."""
        entry = F.struct("item_id", *columns)
        return (
            self.order_items.groupBy("order_id")
            .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
            .join(self.orders, "order_id")
        )

    def keep(self) -> Binding:
        """Write the submissions, one row an order, for a plan that reads the log several times.

        What is bound from here on comes out of those rows; the lines are read and shuffled once.
        """
        # two steps, so that the shuffles of the lines are gone before those of the orders begin
        self.order_items = lines = pin(self.order_items, "zstd")
        self.full_orders = kept = pin(self.full_orders, "zstd")
        del self.order_items
        unpin(lines)
        entry = F.transform("entries", lambda x: F.struct(*[x[c].alias(c) for c in ("item_id", "price", "qty")]))
        self.ranked_orders = kept.withColumn("entries", entry)
        self.item_answers = kept.withColumn("_e", F.explode("entries")).drop("entries").select("*", "_e.*").drop("_e")
        return self

    @cached_property
    def item_answers(self) -> DataFrame:
        """One row per submission and item."""
        return self.order_items.join(self.orders, "order_id")

    @cached_property
    def ranked_orders(self) -> DataFrame:
        return self._ranked("price", "qty")

    @cached_property
    def full_orders(self) -> DataFrame:
        return self._ranked("price", "qty", "traits")

    @cached_property
    def compared(self) -> DataFrame:
        """Canonical pairs of every submission."""
        e = F.col("entries")
        pairs = F.flatten(
            F.transform(
                e,
                lambda x, i: F.transform(
                    F.slice(e, i + 2, F.size(e)), lambda y: F.struct(x.alias("x"), y.alias("y"))
                ),
            )
        )
        a, b = F.col("pair.x.item_id"), F.col("pair.y.item_id")
        dims = (F.col("patch_id") * 10 + F.col("dimension_id")).cast("bigint")
        gold = (a * 31 + b) % 19 == 0
        return (
            self.ranked_orders.withColumn("pair", F.explode(pairs))
            .withColumn("item_a", a)
            .withColumn("item_b", b)
            .withColumn("qty_diff", F.col("pair.x.qty") - F.col("pair.y.qty"))
            .withColumn(
                "choice",
                F.when(F.col("order_id") % 23 == 0, F.lit("unknown"))
                .when(F.col("pair.x.price") >= F.col("pair.y.price"), F.lit("a"))
                .otherwise(F.lit("b")),
            )
            .withColumn("response_id", F.col("order_id") * 10000 + a * 100 + b)
            .withColumn("question_id", (dims * 100 + a) * 100 + b)
            .withColumn("is_gold", gold)
            .withColumn(
                "expected",
                F.when(gold, F.when(a % 2 == 0, F.lit("a")).otherwise(F.lit("b"))),
            )
            .withColumn(
                "is_retest_of", F.when(F.col("order_id") % 29 == 0, F.col("response_id") - 1)
            )
            .withColumn("ranking_id", F.col("order_id"))
            .drop("pair", "entries")
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return self.compared.drop("qty_diff", "status", "order_id")

    @cached_property
    def lane(self) -> DataFrame:
        """Five-level answers over the same pairs; the role is the order status."""
        d = F.col("qty_diff")
        return self.compared.select(
            "response_id",
            "respondent_id",
            "patch_id",
            "created_at",
            "item_a",
            "item_b",
            C.lookup("status", {"F": "top", "O": "mid", "P": "adc"}).alias("role"),
            _five_levels(d).alias("choice"),
            F.lit(False).alias("is_gold"),
            "is_retest_of",
        )

    @cached_property
    def peaks(self) -> DataFrame:
        """One minute and one set of traits per (submission, item)."""
        return self.item_answers.select(
            (F.col("order_id") * 100 + F.col("item_id")).alias("response_id"),
            "respondent_id",
            "patch_id",
            "created_at",
            F.col("item_id").alias("item_a"),
            (F.col("qty").cast("int") % 41).alias("minute"),
            "traits",
            F.lit(False).alias("is_gold"),
            F.lit(None).cast("bigint").alias("is_retest_of"),
        )

    @cached_property
    def _with_duo(self) -> DataFrame:
        """Submissions with their two-against-two answer, null where four items are missing."""
        e = F.col("entries")
        first = C.lookup("status", {"F": "adc", "O": "top", "P": "mid"})
        second = C.lookup("status", {"F": "support", "O": "jungle", "P": "jungle"})

        def duo(k: int) -> Column:
            x, y = F.get("c", F.lit(k))["item_id"], F.get("p", F.lit(k))["item_id"]
            return C.duo_struct(x, F.col("r1"), y, F.col("r2"))

        def qty(k: int) -> Column:
            return F.get("c", F.lit(k))["qty"] + F.get("p", F.lit(k))["qty"]

        d = F.col("d")
        steps = {
            "c": F.filter(e, lambda x: x["item_id"] % 3 != 1),
            "p": F.filter(e, lambda x: x["item_id"] % 3 == 1),
            "r1": first,
            "r2": second,
            "one": duo(0),
            "two": duo(1),
            "d": qty(0) - qty(1),
            "swap": F.col("two.m1.item") < F.col("one.m1.item"),
            "said": F.when(d > 10, "pair_1").when(d < -10, "pair_2").otherwise("similar"),
            "lane_said": _five_levels(d),
            "top": F.when(F.col("swap"), F.col("two")).otherwise(F.col("one")),
            "bottom": F.when(F.col("swap"), F.col("one")).otherwise(F.col("two")),
            "duo": F.when(
                (F.size("c") >= 2) & (F.size("p") >= 2),
                F.struct(
                    F.col("top.m1.item").alias("item_a"),
                    F.col("top.m2.item").alias("item_b"),
                    F.col("bottom.m1.item").alias("item_c"),
                    F.col("bottom.m2.item").alias("item_d"),
                    F.col("top.m1.role").alias("role_a"),
                    F.col("top.m2.role").alias("role_b"),
                    F.col("bottom.m1.role").alias("role_c"),
                    F.col("bottom.m2.role").alias("role_d"),
                    C.lookup("status", {"F": "bot", "O": "top_jungle", "P": "mid_jungle"}).alias(
                        "duo_ctx"
                    ),
                    F.when(F.col("swap"), C.flip_choice("said")).otherwise(F.col("said")).alias("choice"),
                    F.when(F.col("swap"), C.flip_choice("lane_said"))
                    .otherwise(F.col("lane_said"))
                    .alias("lane_choice"),
                ),
            ),
        }
        df = self.full_orders
        for name, column in steps.items():
            df = df.withColumn(name, column)
        return df.drop(*[n for n in steps if n != "duo"])

    @cached_property
    def duos(self) -> DataFrame:
        """Two against two: the first two carries and the first two partners of a submission."""
        return self._with_duo.filter(F.col("duo").isNotNull()).select(
            (F.col("order_id") * 10).alias("response_id"),
            "respondent_id",
            "patch_id",
            "created_at",
            "duo.*",
            F.lit(False).alias("is_gold"),
            F.lit(None).cast("bigint").alias("is_retest_of"),
        )

    @cached_property
    def rankings(self) -> DataFrame:
        """Each order of two items or more as a ranking; its first canonical pair is the anchor."""
        e = F.col("entries")
        ids = F.transform(e, lambda x: x["item_id"])
        best = F.array_sort(
            F.transform(e, lambda x: F.struct((-x["price"]).alias("k"), x["item_id"].alias("i")))
        )
        dims = (F.col("patch_id") * 10 + F.col("dimension_id")).cast("bigint")
        return self.ranked_orders.filter(F.size("entries") >= 2).select(
            F.col("order_id").alias("ranking_id"),
            "respondent_id",
            "patch_id",
            "dimension_id",
            ((dims * 100 + ids[0]) * 100 + ids[1]).alias("anchor_question_id"),
            ids.alias("items"),
            F.transform(best, lambda x: x["i"]).alias("submitted_order"),
        )

    @cached_property
    def responses(self) -> DataFrame:
        """The whole log: five types, six variants, with the columns of their questions.

        Every answer of a submission comes out of its one row of ranked items, so the lines are
        read and shuffled once for all types. The exploded entries stay slim; the columns of the
        log are plain expressions behind them.
        """
        e = F.col("entries")

        def entry(kind: int, a: Column, b: Column, up: Column, d: Column, traits: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"),
                a.cast("int").alias("a"),
                b.cast("int").alias("b"),
                up.cast("boolean").alias("up"),
                d.cast("double").alias("d"),
                traits.cast("array<string>").alias("traits"),
            )

        none = F.lit(None)

        def pair(x: Column, y: Column) -> Column:
            up, d = x["price"] >= y["price"], x["qty"] - y["qty"]
            return F.array(
                *[entry(k, x["item_id"], y["item_id"], up, d, none) for k in (0, 2)]
            )

        def single(x: Column) -> Column:
            return F.array(
                *[entry(k, x["item_id"], none, none, x["qty"], x["traits"]) for k in (1, 5)]
            )

        pairs = F.flatten(
            F.transform(
                e,
                lambda x, i: F.flatten(
                    F.transform(F.slice(e, i + 2, F.size(e)), lambda y: pair(x, y))
                ),
            )
        )
        four = F.array(*[entry(k, none, none, none, none, none) for k in (3, 4)])
        fours = F.when(F.col("duo").isNull(), F.slice(four, 1, 0)).otherwise(
            F.when(F.col("status") == "F", four).otherwise(F.slice(four, 2, 1))
        )
        rows = self._with_duo.withColumn(
            "x", F.explode(F.concat(pairs, F.flatten(F.transform(e, single)), fours))
        )
        order, kind = F.col("order_id"), F.col("x.kind")
        a, b = F.col("x.a"), F.col("x.b")
        patch, index = F.col("patch_id").cast("bigint"), C.lookup("status", {"F": 1, "O": 2, "P": 3})
        two, four_items = kind.isin(0, 2), kind.isin(3, 4)
        gold = F.when(kind == 0, (a * 31 + b) % 19 == 0).otherwise(F.lit(False))
        pair_id = order * 10000 + a * 100 + b
        local = F.when(two, pair_id).when(four_items, order * 10).otherwise(order * 100 + a)
        duo = F.col("duo")
        duo_q = ((patch * 10 + index) * 100 + duo["item_a"]) * 100 + duo["item_b"]
        duo_q = (duo_q * 100 + duo["item_c"]) * 100 + duo["item_d"]
        asked = (
            F.when(kind == 0, ((patch * 10 + F.col("dimension_id")) * 100 + a) * 100 + b)
            .when(kind == 1, F.lit(10**9) + patch * 100 + a)
            .when(kind == 2, F.lit(4 * 10**9) + ((patch * 10 + index) * 100 + a) * 100 + b)
            .when(kind == 3, F.lit(6 * 10**12) + duo_q)
            .when(kind == 4, F.lit(5 * 10**12) + duo_q)
            .otherwise(F.lit(15 * 10**8) + patch * 100 + a)
        )
        choice = (
            F.when(
                kind == 0,
                F.when(order % 23 == 0, "unknown").when(F.col("x.up"), "a").otherwise("b"),
            )
            .when(kind == 2, _five_levels(F.col("x.d")))
            .when(kind == 3, duo["lane_choice"])
            .when(kind == 4, duo["choice"])
        )
        types = {0: 0, 1: 1, 2: 2, 3: 2, 4: 3, 5: 4}
        return rows.select(
            _pick(S.QUESTION_TYPES, C.lookup(kind, types)).alias("type"),
            (kind.cast("bigint") * 10**13 + local).alias("response_id"),
            asked.alias("question_id"),
            F.when(four_items, duo["item_a"]).otherwise(a).alias("item_a"),
            F.when(four_items, duo["item_b"]).otherwise(b).alias("item_b"),
            F.when(four_items, duo["item_c"]).alias("item_c"),
            F.when(four_items, duo["item_d"]).alias("item_d"),
            F.when(kind == 0, F.col("dimension_id")).alias("dimension_id"),
            F.when(kind == 2, C.lookup("status", {"F": "top", "O": "mid", "P": "adc"})).alias("role"),
            F.when(four_items, duo["duo_ctx"]).alias("duo_ctx"),
            *[F.when(four_items, duo[f"role_{m}"]).alias(f"role_{m}") for m in "abcd"],
            choice.alias("choice"),
            F.when(kind == 1, F.col("x.d").cast("int") % 41).alias("minute"),
            F.when(kind == 5, F.col("x.traits")).alias("traits"),
            F.when(gold, F.when(a % 2 == 0, "a").otherwise("b")).alias("expected"),
            F.when(kind == 0, order).alias("ranking_id"),
            gold.alias("is_gold"),
            F.when(two & (order % 29 == 0), pair_id - 1).alias("is_retest_of"),
            "respondent_id",
            "patch_id",
            "created_at",
        )

    QUESTION_COLUMNS = (
        "question_id", "type", "patch_id", "item_a", "item_b", "item_c", "item_d", "dimension_id",
        "role", "duo_ctx", "role_a", "role_b", "role_c", "role_d", "is_gold", "expected",
    )

    @cached_property
    def questions(self) -> DataFrame:
        """Every question that was answered at least once.

        Equal rows are counted first, in hash tables as long as the distinct ones: picking a row per
        id out of the whole log would sort it. Where the rows of an id differ, the most frequent stays.
        """
        rest = [c for c in self.QUESTION_COLUMNS if c != "question_id"]
        counted = self.responses.groupBy(*self.QUESTION_COLUMNS).agg(F.count("*").alias("_n"))
        row = F.max_by(F.struct(*rest), F.struct("_n", *rest)).alias("_q")
        return counted.groupBy("question_id").agg(row).select("question_id", "_q.*")

    @cached_property
    def wresponses(self) -> DataFrame:
        return self.weighted(self.responses)

    # ------------------------------------------------------------------- the weighted log
    def weighted(self, log: DataFrame) -> DataFrame:
        """B2, B1 and B4 in one pass: window, exclusions, trust times recency."""
        inside = select.patch_window(self.patches, *WINDOW)
        people = self.respondents.select(
            "respondent_id",
            "trust_score",
            "is_flagged",
            "declared_rank",
            "declared_main_role",
            "declared_hours_bucket",
        )
        joined = log.join(inside.select("patch_id"), "patch_id", "left_semi").join(
            people, "respondent_id"
        )
        kept = select.aggregable(joined, MIN_TRUST)
        return select.with_weight(kept, EXPORTED_AT, HALFLIFE)

    @cached_property
    def wpairs(self) -> DataFrame:
        return self.weighted(self.pairs)

    @cached_property
    def wlane(self) -> DataFrame:
        return self.weighted(self.lane)

    @cached_property
    def wpeaks(self) -> DataFrame:
        return self.weighted(self.peaks)

    @cached_property
    def wduos(self) -> DataFrame:
        return self.weighted(self.duos)

    # ------------------------------------------------------------------------ behaviour log
    @cached_property
    def log(self) -> DataFrame:
        """Events as submissions, one row each."""
        k, event = C.json_get("props", "$.k").cast("int"), F.col("event_type")
        type_ = _pick(S.QUESTION_TYPES, k % 5)
        said = {
            "pairwise_dimension": ("a", "b", "a", "b", "unknown"),
            "lane_matchup": ("a_strong", "even", "b_slight", "a_slight", "b_strong"),
            "duo_synergy": ("pair_1", "pair_2", "similar", "pair_1", "pair_2"),
        }
        choice = None
        for name, answers in said.items():
            value = C.lookup(event, dict(zip(EVENTS, answers, strict=True)))
            choice = F.when(type_ == name, value) if choice is None else choice.when(type_ == name, value)
        sets = F.when(event == "view", F.array(F.lit("A")))
        for name, codes in {"click": "AN", "signup": "R", "purchase": "ANR", "error": "N"}.items():
            sets = sets.when(event == name, F.array(*[F.lit(c) for c in codes]))
        ms = F.round(F.col("value") * 100).cast("bigint")
        return self.raw("events").select(
            F.col("event_id").alias("response_id"),
            F.col("user_id").alias("respondent_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            k.alias("question_id"),
            type_.alias("type"),
            event.alias("event"),
            choice.alias("choice"),
            F.when(type_ == "peak_timing", (ms % 41).cast("int")).alias("minute"),
            F.when(type_ == "trait_multiselect", sets).alias("traits"),
            ms.alias("response_time_ms"),
            (k % 10 == 0).alias("is_gold"),
            F.when(k % 10 == 0, F.lit("b")).alias("expected"),
        )

    @cached_property
    def retested(self) -> DataFrame:
        """The log where an answer to a question already answered is a retest of the previous."""
        groups = OrderedGroups(
            self.log, ["respondent_id", "question_id"], ["created_at", "response_id"]
        )
        return groups.with_lag("response_id", "is_retest_of").result

    @cached_property
    def raw_answers(self) -> DataFrame:
        """Answers as a client might send them, malformed ones among them."""
        event = F.col("event")
        minute = F.concat(F.lit('{"minute": '), F.col("response_time_ms") % 50, F.lit("}"))
        cases = {
            "pairwise_dimension": ('{"choice":"a"}', '{"choice":"b"}', '{"choice":"unknown"}',
                                   '{"choice": "c"}', '{"choice":"a","why":"x"}'),
            "peak_timing": (minute, minute, '{"minute": true}', '{"minute": 7.5}', "{broken"),
            "lane_matchup": ('{"choice":"a_strong"}', '{"choice":"even"}', '{"choice":"b_slight"}',
                             '{"choice":"a"}', '{"minute": 3}'),
            "duo_synergy": ('{"choice":"pair_1"}', '{"choice":"pair_2"}', '{"choice":"similar"}',
                            '{"choice":"pair_3"}', "{}"),
            "trait_multiselect": ('{"traits":["A"]}', '{"traits":["A","N"]}', '{"traits":[]}',
                                  '{"traits":["A","A"]}', '{"traits":["A","Z"]}'),
        }
        text = None
        for type_, answers in cases.items():
            for name, answer in zip(EVENTS, answers, strict=True):
                value = F.lit(answer) if isinstance(answer, str) else answer
                test = (F.col("type") == type_) & (event == name)
                text = F.when(test, value) if text is None else text.when(test, value)
        return self.log.select(
            "response_id", "respondent_id", "question_id", "type", "created_at",
            "response_time_ms", text.alias("answer"),
        )

    @cached_property
    def identities(self) -> DataFrame:
        """Respondents of the behaviour log."""
        key = F.col("respondent_id")
        return (
            self.log.groupBy("respondent_id")
            .agg(
                F.min("created_at").alias("first_seen"),
                F.max("created_at").alias("last_seen"),
                F.count("*").alias("answers_count"),
            )
            .withColumn("fingerprint_hash", F.concat(F.lit("f"), key % 40))
            .withColumn("ip_hash", F.concat(F.lit("ip"), key % 7))
            .withColumn(
                "trust_score",
                (F.lit(200) + F.lit(8) * (key % 101)).cast("double") / F.lit(1000.0),
            )
            .withColumn("is_flagged", key % 37 == 0)
            .withColumn("declared_rank", _pick(S.RANKS, key % 12))
        )
