"""Column functions. All of them are built-in expressions: nothing here leaves the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdgauge import settings as S


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(value: Column | str, table: Mapping[str, object]) -> Column:
    """A literal mapping as a CASE expression; null for a value that is not listed."""
    source = _col(value)
    result = None
    for key, mapped in table.items():
        test = source == F.lit(key)
        result = F.when(test, F.lit(mapped)) if result is None else result.when(test, F.lit(mapped))
    return result


# ------------------------------------------------------------------------ canonical forms
def canonical_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b))


def duo_struct(x: Column, role_x: Column, y: Column, role_y: Column) -> Column:
    """A duo as two (item, role) members in ascending order."""
    first = F.struct(x.alias("item"), role_x.alias("role"))
    second = F.struct(y.alias("item"), role_y.alias("role"))
    return F.when(first <= second, F.struct(first.alias("m1"), second.alias("m2"))).otherwise(
        F.struct(second.alias("m1"), first.alias("m2"))
    )


def duo_label(duo: Column) -> Column:
    """``12:adc|31:support``"""
    return F.concat_ws(
        "|",
        F.concat_ws(":", duo["m1"]["item"].cast("string"), duo["m1"]["role"]),
        F.concat_ws(":", duo["m2"]["item"].cast("string"), duo["m2"]["role"]),
    )


def flip_choice(choice: Column | str) -> Column:
    """The same opinion with the two sides swapped."""
    table = {
        "a": "b", "b": "a", "a_strong": "b_strong", "a_slight": "b_slight",
        "b_slight": "a_slight", "b_strong": "a_strong", "pair_1": "pair_2", "pair_2": "pair_1",
    }
    return F.coalesce(lookup(choice, table), _col(choice))


def level(choice: Column | str, scale: str) -> Column:
    """Ordered level of a choice: five for ``lane``, three for ``synergy``."""
    return lookup(choice, S.LANE_LEVELS if scale == "lane" else S.SYNERGY_LEVELS)


def lane_outcome(choice: Column | str) -> Column:
    """Five lane levels collapsed to the side that wins."""
    return lookup(choice, S.LANE_OUTCOME)


def variant(type_: Column | str, item_c: Column | str) -> Column:
    """Question variant: the lane type splits in one-against-one and two-against-two."""
    kind = _col(type_)
    return F.when(
        kind == "lane_matchup",
        F.when(_col(item_c).isNull(), F.lit("lane_1v1")).otherwise(F.lit("lane_2v2")),
    ).otherwise(kind)


# ------------------------------------------------------------------------------- rounding
def half_up(x: Column | str) -> Column:
    return F.floor(_col(x) + F.lit(0.5))


def quantise(x: Column | str, digits: int) -> Column:
    """Decimal rounding, half away from zero, on the shortest decimal text of a double."""
    return F.round(_col(x).cast("double").cast("decimal(38,18)"), digits)


def unit(x: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _col(x)))


def plain(x: Column | str, digits: int = 6) -> Column:
    """A double rounded for publication, never a negative zero."""
    value = F.round(_col(x), digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def _untied(x: Column, digits: int) -> Column:
    """A value whose shortest text ends in a lone 5 behind the last digit, moved to the side its
    binary value lies on (the even digit when it lies exactly between).

    The residue of the product by twice the scale is exact because the scale has few bits.
    """
    scale = float(10**digits)
    size = F.abs(x)
    product = size * F.lit(2 * scale)
    high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)
    residue = (high * F.lit(2 * scale) - product) + (size - high) * F.lit(2 * scale)
    below = F.floor(product / 2)
    tied = (product < F.lit(9e15)) & (product == F.floor(product)) & (F.pmod(product, F.lit(2.0)) == 1)
    up = (residue > 0) | ((residue == 0) & (F.pmod(below, F.lit(2)) == 1))
    moved = (below + F.when(up, 1).otherwise(0)) / F.lit(scale)
    return F.when(tied, F.signum(x) * moved).otherwise(x)


def fmt_number(x: Column | str, digits: int) -> Column:
    """``%.Nf`` on the exact binary value, empty for null and never ``-0.000``."""
    value = _untied(_col(x).cast("double"), digits)
    text = F.translate(F.format_number(value, digits), ",", "")
    return F.coalesce(F.regexp_replace(text, r"^-(0(\.0*)?)$", "$1"), F.lit(""))


def fmt_integer(x: Column | str) -> Column:
    return F.coalesce(_col(x).cast("bigint").cast("string"), F.lit(""))


def fmt_boolean(x: Column | str) -> Column:
    return F.when(_col(x), F.lit("true")).otherwise(F.lit("false"))


# --------------------------------------------------------------------- statistics, scalars
def kish(weight: Column | str) -> Column:
    """Effective sample size of a weighted group (aggregate expression)."""
    w = _col(weight)
    total = F.sum(w)
    return total * total / F.sum(w * w)


def wilson(p: Column | str, n: Column | str) -> tuple[Column, Column]:
    """95 % Wilson interval, clipped to the unit interval."""
    share, size = _col(p), _col(n)
    z2 = S.Z95 * S.Z95
    scale = F.lit(1.0) + F.lit(z2) / size
    centre = (share + F.lit(z2) / (F.lit(2.0) * size)) / scale
    spread = share * (F.lit(1.0) - share) / size + F.lit(z2) / (F.lit(4.0) * size * size)
    half = F.lit(S.Z95) * F.sqrt(spread) / scale
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def support(
    kind: str,
    n: Column | str,
    low: Column | str,
    high: Column | str,
    thresholds: Sequence[tuple[str, str, int, float]] = S.SUPPORT_THRESHOLDS,
) -> Column:
    """``solid`` and ``limited`` need the sample size and the interval width, both."""
    size, bottom, top = _col(n), _col(low), _col(high)
    result = F.when(bottom.isNull() | top.isNull(), F.lit("insufficient"))
    for magnitude, name, least_n, width in thresholds:
        if magnitude == kind:
            result = result.when((size >= least_n) & (top - bottom <= width), F.lit(name))
    return result.otherwise(F.lit("insufficient"))


def logistic(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def level_probs(delta: Column | str, tau1: Column | str, tau2: Column | str) -> list[Column]:
    """P(level = 0..4) of the symmetric-threshold cumulative logit."""
    d, inner, outer = _col(delta), _col(tau1), _col(tau2)
    exceed = [logistic(d + outer), logistic(d + inner), logistic(d - inner), logistic(d - outer)]
    above = [F.lit(1.0), *exceed, F.lit(0.0)]
    return [above[k] - above[k + 1] for k in range(5)]


def expected_margin(delta: Column | str, tau1: Column | str, tau2: Column | str) -> Column:
    """Sum of level values times level probabilities, in (-1, 1)."""
    total = F.lit(0.0)
    for value, probability in zip(S.LANE_VALUES, level_probs(delta, tau1, tau2), strict=True):
        total = total + F.lit(value) * probability
    return total


def power_at(minute: int, peak: Column | str, sigma: float) -> Column:
    gap = F.lit(float(minute)) - _col(peak)
    return F.exp(-(gap * gap) / F.lit(2.0 * sigma * sigma))


def entropy_term(p: Column | str) -> Column:
    """``-p log2 p`` with the limit value 0 at p = 0."""
    share = _col(p)
    return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))


def trust(
    gold_attempts: Column | str,
    gold_passed: Column | str,
    retest_pairs: Column | str,
    retest_consistent: Column | str,
    fast_answers: Column | str,
    straightline_runs: Column | str,
    answers_count: Column | str,
    weights: Mapping[str, float] | None = None,
    smoothing: float | None = None,
) -> Column:
    """Trust score: smoothed gold pass rate and retest consistency, less a discount for
    degenerate answering, clamped and rounded half up to three decimals."""
    weights = weights or S.DEFAULTS["quality.trust_weights"]
    s = float(S.DEFAULTS["quality.trust_smoothing"] if smoothing is None else smoothing)
    prior = s * S.TRUST_PRIOR
    passed = (_col(gold_passed) + F.lit(prior)) / (_col(gold_attempts) + F.lit(s))
    consistent = (_col(retest_consistent) + F.lit(prior)) / (_col(retest_pairs) + F.lit(s))
    events = _col(fast_answers) + F.lit(S.STRAIGHTLINE_WEIGHT) * _col(straightline_runs)
    room = F.greatest(
        F.lit(float(S.DEGENERATE_FLOOR)), F.lit(S.DEGENERATE_SHARE) * _col(answers_count)
    )
    discount = F.least(F.lit(1.0), events / room)
    value = (F.lit(weights["honeypot"]) * passed + F.lit(weights["retest"]) * consistent) * (
        F.lit(1.0) - F.lit(weights["degenerate"]) * discount
    )
    return quantise(unit(value), 3)


def consistent(type_: Column, first: Column, repeat: Column) -> Column:
    """Whether a repeated answer says the same, by type; null where the pair does not count.

    ``first`` and ``repeat`` are parsed answers (choice, minute, traits).
    """
    a, b = first["choice"], repeat["choice"]
    return (
        F.when(
            type_ == "pairwise_dimension",
            F.when((a != "unknown") & (b != "unknown"), a == b),
        )
        .when(type_ == "lane_matchup", lane_outcome(a) == lane_outcome(b))
        .when(
            type_ == "peak_timing",
            F.abs(first["minute"] - repeat["minute"]) <= S.PEAK_TOLERANCE_MINUTES,
        )
        .when(type_ == "duo_synergy", a == b)
        .when(
            type_ == "trait_multiselect",
            jaccard(first["traits"], repeat["traits"]) >= S.TRAITS_MIN_JACCARD,
        )
    )


# --------------------------------------------------------------------------------- arrays
def jaccard(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b))) / F.size(F.array_union(_col(a), _col(b)))


def missing(wanted: Column | str, present: Column | str) -> Column:
    return F.array_except(_col(wanted), _col(present))


def has(arr: Column | str, value: Column | str) -> Column:
    return F.array_contains(_col(arr), value)


def sorted_set(arr: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_col(arr)))


# ------------------------------------------------------------------------- time and JSON
def local_day(ts: Column | str, tz: str) -> Column:
    """Calendar day in a named zone; the session runs in UTC."""
    return F.to_date(F.from_utc_timestamp(_col(ts), tz))


def json_get(column: Column | str, path: str) -> Column:
    return F.get_json_object(_col(column), path)


ANSWER_SCHEMA = "struct<choice:string,minute:int,traits:array<string>>"


def parse_answer(answer: Column | str) -> Column:
    return F.from_json(_col(answer), ANSWER_SCHEMA)


# --------------------------------------------------------------------- hashes and secrets
def fingerprint(client: Column | str, ip: Column | str) -> Column:
    """SHA-256 of the client part and the hashed address; the address never appears in clear."""
    hashed = F.sha2(F.coalesce(_col(ip), F.lit("")), 256)
    return F.sha2(F.concat_ws("|", F.coalesce(_col(client), F.lit("unknown")), hashed), 256)


def hmac256(column: Column | str, salt: str) -> Column:
    """Keyed HMAC-SHA-256 from two digests over padded keys; null without a salt or a value."""
    value = _col(column)
    if not salt:
        return F.lit(None).cast("string")
    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytearray(byte ^ 0x36 for byte in key))
    outer_pad = F.lit(bytearray(byte ^ 0x5C for byte in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, value.cast("binary")), 256))
    return F.when(value != "", F.sha2(F.concat(outer_pad, inner), 256))


def hash_bits(digits: int, seed: int, *keys: Column | str) -> Column:
    """The first hex digits of an MD5 over the seed and the keys, as a number any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def hash_draw(seed: int, *keys: Column | str) -> Column:
    """A uniform draw in [0, 1) that depends on nothing but the seed and the keys."""
    return hash_bits(13, seed, *keys).cast("double") / F.lit(float(2**52))


def seed_text(text: Column | str) -> Column:
    """Run seed: the first 16 hex digits of a SHA-256, as an unsigned decimal number."""
    return F.conv(F.substring(F.sha2(_col(text), 256), 1, 16), 16, 10)
