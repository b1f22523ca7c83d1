"""n draws with replacement from n units, for many replicates at once, without a row per draw.

Units of a fit stand in key order, each with the number of equal rows it stands for. A balanced
binary tree over the positions splits the draws of a node between its two halves by a binomial number,
from the root down; a node with at most ``DIRECT`` draws places each of them by a position of its
own. This is an exact multinomial, its work grows with the units that are hit and not with rows,
and every random number is a pure hash of (seed, fit, replicate, node), so partitions and retries
cannot change a draw. Integer and double steps only, so that SQL can repeat them.
"""

from __future__ import annotations

import numpy as np

#: Draws of a node that are placed one by one instead of split.
DIRECT = 256
#: Binomial masses, and (unit, replicate) counts, held at a time.
MASSES, COUNTS = 1 << 21, 1 << 22

_U, _MASK = np.uint64, (1 << 32) - 1
#: Odd multipliers below 2**31, so that no product of two numbers leaves 63 bits.
STEP_REP, STEP_NODE, STEP_DRAW = 1_640_531_527, 1_481_765_933, 335_903_615
MIX_1, MIX_2 = 2_146_121_005, 73_244_475


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser on numbers below 2**32."""
    x = x ^ (x >> _U(16))
    x = (x * _U(MIX_1)) & _U(_MASK)
    x = x ^ (x >> _U(15))
    x = (x * _U(MIX_2)) & _U(_MASK)
    return x ^ (x >> _U(16))


def uniform(keys: tuple[int, int], rep: np.ndarray, node: np.ndarray, draw: np.ndarray | None = None) -> np.ndarray:
    """Numbers in (0, 1) with 52 bits, from two lanes of 32."""
    lanes = []
    for key in keys:
        h = mix((_U(key) + rep.astype(_U) * _U(STEP_REP)) & _U(_MASK))
        h = mix((h + node.astype(_U) * _U(STEP_NODE)) & _U(_MASK))
        if draw is not None:
            h = mix((h + (draw.astype(_U) + _U(1)) * _U(STEP_DRAW)) & _U(_MASK))
        lanes.append(h)
    whole = (lanes[0] << _U(20)) | (lanes[1] >> _U(12))
    return (whole.astype(np.float64) + 0.5) / float(1 << 52)


def _stirling_rest(x: np.ndarray) -> np.ndarray:
    """ln x! less the leading terms of Stirling's series, for x of 16 and more."""
    return (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x


def _log_factorials(n: int) -> np.ndarray:
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 64)))])
    x = np.arange(64, n, dtype=np.float64)
    return np.concatenate([small, x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + _stirling_rest(x)])


#: Numbers of draws whose masses are summed one by one; beyond ``SPREAD`` deviations sums are integrals.
_LOG_FACTORIALS = _log_factorials(1 << 17)
SPREAD = 40.0
#: Standard deviations, and units besides, from the mean on which masses are summed. Fixed values.
REACH, BESIDES = 6, 8


def _log_mass_few(k: np.ndarray, n: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the masses at k, ``n`` of them for each binomial, of draws that the table holds."""
    lf = _LOG_FACTORIALS
    odds, rest = np.log(p) - np.log1p(-p), lf[m] + m * np.log1p(-p)
    return np.repeat(rest, n) + k * np.repeat(odds, n) - lf[k] - lf[np.repeat(m, n) - k]


def _log_mass_rare(k: np.ndarray, n: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same for any number of draws, of which few hit."""
    hits, own = np.repeat(np.log(m * p), n), np.repeat(m.astype(np.float64), n)
    chosen = k * hits - k - (own - k + 0.5) * np.log1p(-k / own) + _stirling_rest(own) - _stirling_rest(own - k)
    return chosen - _LOG_FACTORIALS[k] + (own - k) * np.repeat(np.log1p(-p), n)


def _enumerated(m: np.ndarray, p: np.ndarray, u: np.ndarray, log_mass=_log_mass_few) -> np.ndarray:
    """Quantiles by summing masses from the lowest on."""
    mean, reach = m * p, REACH * np.sqrt(m * p * (1 - p)) + BESIDES
    low = np.floor(np.maximum(mean - reach, 0.0)).astype(np.int64)
    high = np.minimum(np.ceil(mean + reach).astype(np.int64), m)
    sizes, out = high - low + 1, np.empty_like(m)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(m):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + MASSES, side="right")))
        part = slice(first, last)
        n = sizes[part]
        stop = np.cumsum(n)
        begin = stop - n
        k = np.arange(stop[-1]) + np.repeat(low[part] - begin, n)
        total = np.cumsum(np.exp(log_mass(k, n, m[part], p[part])))
        before = np.concatenate([[0.0], total])[begin]
        reached = np.searchsorted(total, before + u[part], side="right") - begin
        out[part] = np.minimum(low[part] + reached, high[part])
        first = last
    return out


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def _log_mass(x: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of the binomial mass continued to all x, by deviances, which lose no digits near the mean."""
    y = m - x
    a, b = (x - m * p) / (m * p), (y - m * (1 - p)) / (m * (1 - p))
    deviance = x * np.log1p(a) - m * p * a + y * np.log1p(b) - m * (1 - p) * b
    rest = _stirling_rest(m) - _stirling_rest(x) - _stirling_rest(y)
    return rest - deviance - 0.5 * np.log(2 * np.pi * x * y / m)


def _below(x: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(X <= x), mass at x) at whole x, by Euler and Maclaurin's formula: an integral and its ends."""
    low = np.maximum(m * p - (REACH + 2) * np.sqrt(m * p * (1 - p)), 20.0)
    half = np.maximum(x - low, 0.0) / 2
    at = low[:, None] + half[:, None] * (1 + _NODES)
    integral = half * (np.exp(_log_mass(at, m[:, None], p[:, None])) @ _WEIGHTS)
    mass = np.exp(_log_mass(x, m, p))
    slope = mass * (np.log(m - x) - np.log(x) + np.log(p) - np.log1p(-p))
    return integral + mass / 2 + slope / 12, mass


def _integrated(m: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantiles of wide binomials: bisected to a whole number on the integral of the masses."""
    m = m.astype(np.float64)
    spread = np.sqrt(m * p * (1 - p))
    low, high = np.floor(m * p - REACH * spread), np.ceil(m * p + REACH * spread)
    x = np.clip(np.round(m * p), low, high)
    while True:  # the least whole x in (low, high] with P(X <= x) > u, by Newton steps inside the bracket
        below, mass = _below(x, m, p)
        over = below > u
        high, low = np.where(over, np.minimum(high, x), high), np.where(over, low, np.maximum(low, x))
        if (high - low <= 1).all():
            return high.astype(np.int64)
        step = np.round(x + np.clip((u - below) / np.maximum(mass, 1e-300), -spread, spread))
        step = np.where(step <= low, low + 1, np.where(step >= high, high - 1, step))
        # a step that stays where it is moves to the other side of the bracket
        step = np.where(step == x, np.where(over, x - 1, x + 1), step)
        x = np.clip(np.where(high - low <= 1, x, step), low, high)


def binomial(m: np.ndarray, left: np.ndarray, right: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The u-quantile of Binomial(m, left / (left + right)) for each entry."""
    out = np.where(left > 0, m, 0)
    p = left / np.maximum(left + right, 1)
    open_ = (left > 0) & (right > 0) & (m > 0)
    wide = open_ & (np.sqrt(m * p * (1 - p)) > SPREAD)
    many = open_ & ~wide & (m >= len(_LOG_FACTORIALS))
    few = open_ & ~wide & ~many
    if few.any():
        out[few] = _enumerated(m[few], p[few], u[few])
    if wide.any():
        out[wide] = _integrated(m[wide], p[wide], u[wide])
    for which, q, v, back in ((many & (p <= 0.5), p, u, False), (many & (p > 0.5), 1 - p, 1 - u, True)):
        if which.any():
            hit = _enumerated(m[which], q[which], v[which], _log_mass_rare)
            out[which] = m[which] - hit if back else hit
    return out


def depth(units: int) -> int:
    """Levels of the tree below its root."""
    return (units - 1).bit_length() if units > 0 else 0


def _direct(keys, rep, node, m, before, count):
    """(entry, place among the counted rows) of every single draw of nodes with few draws."""
    entry = np.repeat(np.arange(len(m)), m)
    turn = np.arange(len(entry)) - np.repeat(np.cumsum(m) - m, m)
    u = uniform(keys, rep[entry], node[entry], turn)
    return entry, before[entry] + np.floor(u * count[entry]).astype(np.int64)


def times(
    keys: tuple[int, int],
    reps: np.ndarray,
    units: int,
    draws: int,
    counts: np.ndarray,
    bundle: int = 0,
    totals: np.ndarray | None = None,
) -> np.ndarray:
    """[unit, replicate]: how often each unit of one bundle is drawn.

    A bundle is one of the equally wide subtrees that make up the tree; ``totals`` are the counts of
    all of them in order, ``counts`` those of this one's units. Without it the bundle is the tree.
    """
    totals = np.array([counts.sum()]) if totals is None else totals
    size, out = len(counts), np.zeros((len(counts), len(reps)), np.int64)
    step = max(1, COUNTS // max(size, min(draws, DIRECT * size), 1))
    for first in range(0, len(reps), step):
        some = reps[first : first + step]
        flat, more = _places(keys, some, units, draws, counts, bundle, totals)
        out[:, first : first + step] = np.bincount(flat, more, size * len(some)).reshape(size, len(some))
    return out


def _places(keys, reps, units: int, draws: int, counts, bundle: int, totals):
    """(unit and replicate as one number, how many draws) of all draws that meet the bundle."""
    sums = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
    top, levels = depth(len(totals)), depth(units)
    cum = sums[bundle] + np.concatenate([[0], np.cumsum(counts)])
    start, size = bundle << (levels - top), len(counts)
    flat, more = [np.zeros(0, np.int64)], [np.zeros(0)]

    def place(column: np.ndarray, at: np.ndarray) -> None:
        mine = (at >= cum[0]) & (at < cum[-1])
        unit = np.searchsorted(cum, at[mine], side="right") - 1
        flat.append(unit * len(reps) + column[mine])
        more.append(np.ones(len(unit)))

    # from the root to the bundle, one node a level
    m, j = np.full(len(reps), draws), 0
    for level in range(top):
        width = top - level
        a, middle, b = (min(x, len(totals)) for x in (j << width, (2 * j + 1) << (width - 1), (j + 1) << width))
        node = np.full(len(reps), (1 << level) + j)
        few = np.flatnonzero((m <= DIRECT) & (m > 0))
        if len(few):
            n = len(few)
            entry, at = _direct(
                keys, reps[few], node[few], m[few], np.full(n, sums[a]), np.full(n, sums[b] - sums[a])
            )
            place(few[entry], at)
            m[few] = 0
        left = binomial(
            m, np.full(len(m), sums[middle] - sums[a]), np.full(len(m), sums[b] - sums[middle]),
            uniform(keys, reps, node),
        )
        right = (bundle >> (width - 1)) & 1
        m, j = (m - left, 2 * j + 1) if right else (left, 2 * j)
    # inside the bundle, all nodes of a level
    column = np.flatnonzero(m > 0)
    m, j = m[column], np.full(len(column), j)
    for level in range(top, levels + 1):
        width = levels - level
        edge = lambda x: cum[np.clip((x << width) - start, 0, size)]  # noqa: B023, E731
        node, before, after = (1 << level) + j, edge(j), edge(j + 1)
        few = m <= DIRECT
        entry, at = _direct(keys, reps[column[few]], node[few], m[few], before[few], (after - before)[few])
        place(column[few][entry], at)
        column, j, m, node = column[~few], j[~few], m[~few], node[~few]
        if level == levels:
            flat.append((j - start) * len(reps) + column)
            more.append(m.astype(np.float64))
            break
        before, after = before[~few], after[~few]
        half = cum[np.clip(((2 * j + 1) << (width - 1)) - start, 0, size)]
        left = binomial(m, half - before, after - half, uniform(keys, reps[column], node))
        column = np.concatenate([column, column])
        j, m = np.concatenate([2 * j, 2 * j + 1]), np.concatenate([left, m - left])
        column, j, m = column[m > 0], j[m > 0], m[m > 0]
    return np.concatenate(flat), np.concatenate(more)
