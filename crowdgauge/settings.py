"""Fixed values and default parameters.

Everything here is a published constant of the measurement method: results only agree with
earlier exports when these values stay as they are. Parameters that a run may override live in
``DEFAULTS`` under their dotted settings key.
"""

from __future__ import annotations

import json

# ---------------------------------------------------------------- fixed values: vocabularies
QUESTION_TYPES = (
    "pairwise_dimension",
    "peak_timing",
    "lane_matchup",
    "duo_synergy",
    "trait_multiselect",
)
VARIANTS = (
    "pairwise_dimension",
    "peak_timing",
    "lane_1v1",
    "lane_2v2",
    "duo_synergy",
    "trait_multiselect",
)
PAIRWISE_CHOICES = ("a", "b", "unknown")
LANE_CHOICES = ("a_strong", "a_slight", "even", "b_slight", "b_strong")
SYNERGY_CHOICES = ("pair_1", "pair_2", "similar")
ROLES = ("top", "jungle", "mid", "adc", "support")
LANE_ROLES = ("top", "mid", "adc")
DUO_CONTEXTS = {
    "bot": ("adc", "support"),
    "top_jungle": ("top", "jungle"),
    "mid_jungle": ("mid", "jungle"),
}
RANKS = (
    "iron", "bronze", "silver", "gold", "platinum", "emerald",
    "diamond", "master", "grandmaster", "challenger", "unranked",
)
RANK_SEGMENTS = {
    "low": ("iron", "bronze", "silver"),
    "mid": ("gold", "platinum", "emerald"),
    "high": ("diamond", "master", "grandmaster", "challenger"),
    "unranked": ("unranked",),
}
HOURS_BUCKETS = ("<5", "5-15", "15-30", "30+")
UNDECLARED = "undeclared"

# ------------------------------------------------------------- fixed values: numeric scales
LANE_LEVELS = {"b_strong": 0, "b_slight": 1, "even": 2, "a_slight": 3, "a_strong": 4}
SYNERGY_LEVELS = {"pair_2": 0, "similar": 1, "pair_1": 2}
LANE_OUTCOME = {
    "a_strong": "a",
    "a_slight": "a",
    "even": "even",
    "b_slight": "b",
    "b_strong": "b",
}
LANE_VALUES = (-1.0, -0.5, 0.0, 0.5, 1.0)
POWER_MINUTES = (5, 10, 15, 20, 25)
PEAK_MIN_MINUTE, PEAK_MAX_MINUTE = 0, 40
PEAK_IQR_SCALE = 12.0
Z95 = 1.959963984540054
RANKING_SIZE = 5
TIER_1_RANK, TIER_2_RANK = 12, 20
SYNERGY_TIER = 1
GOLD_TIER = 1
MAX_DISCARDED = 0.05
ALPHA_RELIABLE, ALPHA_TENTATIVE = 0.800, 0.667
CONCENTRATION_LIMIT = 0.40
TRIGGER_RHO, TRIGGER_DIMENSIONS = 0.70, 3
PEAK_TOLERANCE_MINUTES = 5
TRAITS_MIN_JACCARD = 0.60
TRUST_PRIOR, DEGENERATE_FLOOR, DEGENERATE_SHARE, STRAIGHTLINE_WEIGHT = 0.5, 20, 0.15, 2
TRUST_BINS = 20
TIER_READY_MEDIAN, TIER_READY_CONNECTED = 25, 6
VARIETY_RUN, WARMUP_PAIRWISE = 3, 3
VARIANT_WEIGHTS = {
    "pairwise_dimension": 50,
    "peak_timing": 20,
    "lane_1v1": 15,
    "lane_2v2": 5,
    "duo_synergy": 5,
    "trait_multiselect": 5,
}
GOLD_DIMENSIONS = ("mobility", "cc", "poke", "waveclear", "engage", "peel")
ROLE_BY_TAG = {
    "Marksman": "adc",
    "Support": "support",
    "Mage": "mid",
    "Assassin": "mid",
    "Fighter": "top",
    "Tank": "top",
}
PER_MINUTE, PER_DAY = 40, 1500

#: (magnitude, level, minimum n, maximum interval width)
SUPPORT_THRESHOLDS = (
    ("dimension", "solid", 25, 0.60),
    ("dimension", "limited", 10, 1.20),
    ("peak_minute", "solid", 20, 4.0),
    ("peak_minute", "limited", 10, 8.0),
    ("lane_strength", "solid", 20, 0.60),
    ("lane_strength", "limited", 8, 1.20),
    ("synergy", "solid", 15, 0.80),
    ("synergy", "limited", 6, 1.50),
    ("trait", "solid", 20, 0.25),
    ("trait", "limited", 10, 0.45),
)

# -------------------------------------------------- fixed values: output headers, in order
ID_COLUMNS = (
    "champion_id", "riot_key", "display_name", "roles", "pool_tier", "patch_window", "exported_at",
)
HEADERS = {
    "champion_dimensions": (
        *ID_COLUMNS, "dimension", "score", "score_ci_low", "score_ci_high", "score_n",
        "score_support", "unknown_rate", "score_norm",
    ),
    "peak_timing": (
        *ID_COLUMNS, "peak_minute", "peak_minute_ci_low", "peak_minute_ci_high", "peak_minute_n",
        "peak_minute_support", "power_at_5", "power_at_10", "power_at_15", "power_at_20",
        "power_at_25",
    ),
    "champion_lane_strength": (
        *ID_COLUMNS, "role", "lane_strength", "lane_strength_ci_low", "lane_strength_ci_high",
        "lane_strength_n", "lane_strength_support",
    ),
    "champion_traits": (
        *ID_COLUMNS, "trait", "proportion", "proportion_ci_low", "proportion_ci_high",
        "proportion_n", "proportion_support",
    ),
    "matchup_matrix": (
        "champion_a_id", "champion_a_key", "champion_b_id", "champion_b_key", "role", "advantage",
        "advantage_ci_low", "advantage_ci_high", "n_responses", "support", "is_observed",
        "patch_window",
    ),
    "duo_features": (
        "champion_a_id", "champion_a_key", "champion_b_id", "champion_b_key", "role_a", "role_b",
        "synergy", "synergy_ci_low", "synergy_ci_high", "synergy_n", "synergy_support",
        "synergy_is_observed", "lane_strength", "lane_strength_ci_low", "lane_strength_ci_high",
        "lane_strength_n", "lane_strength_support", "lane_strength_is_observed", "patch_window",
    ),
}

# ---------------------------------------------------------- fixed values: default parameters
DEFAULTS = {
    "sampler.enabled_pool_tiers": 1,
    "sampler.epsilon": 1.00,
    "sampler.weights": {
        "escasez": 0.35,
        "informacion": 0.25,
        "cobertura": 0.20,
        "puente": 1.00,
    },
    "sampler.cold_threshold": 5,
    "sampler.consensus_threshold": 20,
    "sampler.candidate_limit": 50,
    "quality.honeypot_every": [10, 15],
    "quality.honeypot_min_pass_rate": 0.85,
    "quality.honeypot_min_attempts": 40,
    "quality.retest_every": 30,
    "quality.retest_min_distance": 15,
    "quality.fast_answer_ms": 800,
    "quality.straightline_run": 8,
    "quality.fingerprint_max_identities": 5,
    "quality.trust_weights": {"honeypot": 0.60, "retest": 0.40, "degenerate": 0.50},
    "quality.trust_smoothing": 2,
    "export.min_trust": 0.30,
    "gamification.streak_gap_minutes": 30,
    "gamification.day_streak_min_answers": 5,
    "gamification.streak_timezone": "America/Argentina/Buenos_Aires",
    "gamification.leaderboard_size": 50,
    "aggregation.decay_halflife_days": 21,
    "aggregation.bootstrap_samples": 2000,
    "aggregation.power_sigma": 7.5,
    "aggregation.bt_prior": 0.5,
    "aggregation.duo_lambda_champion": 0.10,
    "aggregation.duo_lambda_interaction": 1.00,
    "aggregation.max_iter": 500,
    "aggregation.tol": 1e-9,
    "aggregation.segment_min_respondents": 15,
    "aggregation.segment_min_comparisons": 300,
}
AGGREGATION_VERSION = "1.0.1"


def default_json(key: str) -> str:
    """A default as the JSON text the settings table would hold."""
    return json.dumps(DEFAULTS[key], sort_keys=True)
