"""The bound views again, as DuckDB SQL, for checking results against a second engine."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {}


def _view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


def _case(column: str, pairs: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {column} {whens} END"


RANKS_SQL = (
    "['iron','bronze','silver','gold','platinum','emerald','diamond','master','grandmaster',"
    "'challenger','unranked']"
)

_view(
    "items",
    "",
    """
SELECT item_id, key, 'Item ' || item_id AS name,
  list_filter([CASE WHEN item_id % 3 <> 1 THEN 'adc' END, CASE WHEN item_id % 5 = 0 THEN 'jungle' END,
    CASE WHEN item_id % 4 = 1 THEN 'mid' END, CASE WHEN item_id % 3 <> 0 THEN 'support' END,
    CASE WHEN item_id % 2 = 0 THEN 'top' END], lambda x: x IS NOT NULL) AS roles,
  CASE WHEN rk <= 12 THEN 1 WHEN rk <= 20 THEN 2 ELSE 3 END AS pool_tier,
  item_id % 13 <> 0 AS is_active, rk AS rank_in_role, n_parts
FROM (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS item_id, p_brand AS key, count(*) AS n_parts,
        row_number() OVER (ORDER BY count(*) DESC, CAST(substr(p_brand, 7) AS INTEGER)) AS rk
      FROM part GROUP BY p_brand)""",
)
_view("pool", "items", "SELECT * FROM items WHERE is_active AND pool_tier <= 2")
_view(
    "respondents",
    "",
    f"""
SELECT c_custkey AS respondent_id, 'f' || (c_custkey % 40) AS fingerprint_hash,
  'ip' || (c_custkey % 50) AS ip_hash,
  ({RANKS_SQL})[c_custkey % 12 + 1] AS declared_rank,
  (['top','jungle','mid','adc','support'])[c_custkey % 6 + 1] AS declared_main_role,
  (['<5','5-15','15-30','30+'])[c_custkey % 5 + 1] AS declared_hours_bucket,
  CAST(200 + 8 * (c_custkey % 101) AS DOUBLE) / 1000.0 AS trust_score,
  c_custkey % 37 = 0 AS is_flagged, c_mktsegment AS segment
FROM customer""",
)
_view(
    "patches",
    "",
    """
SELECT DISTINCT year(o_orderdate) AS patch_id, '16.' || ((year(o_orderdate) - 1994) * 3) AS version,
  make_date(year(o_orderdate), 1, 1) AS released_at, year(o_orderdate) = 2001 AS is_current
FROM orders""",
)
_view(
    "dimensions",
    "",
    """
SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS dimension_id,
  'dim' || substr(o_orderpriority, 1, 1) AS code,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS display_order, true AS is_active
FROM orders""",
)
_view("traits", "", "SELECT DISTINCT l_returnflag AS code, true AS is_active FROM lineitem")
_view(
    "ord",
    "",
    """
SELECT o_orderkey AS order_id, o_custkey AS respondent_id,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS dimension_id, year(o_orderdate) AS patch_id,
  o_orderdate AS created_at, o_orderstatus AS status, o_orderkey * 37 % 4000 AS response_time_ms
FROM orders""",
)
_view(
    "order_items",
    "",
    """
SELECT l_orderkey AS order_id, CAST(substr(p_brand, 7) AS INTEGER) AS item_id,
  sum(l_quantity) AS qty, max(l_extendedprice) AS price,
  list_sort(list(DISTINCT l_returnflag)) AS traits
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
_view(
    "compared",
    "ord order_items",
    """
SELECT o.*, x.item_id AS item_a, y.item_id AS item_b, x.qty - y.qty AS qty_diff,
  CASE WHEN o.order_id % 23 = 0 THEN 'unknown' WHEN x.price >= y.price THEN 'a' ELSE 'b' END AS choice,
  o.order_id * 10000 + x.item_id * 100 + y.item_id AS response_id,
  (CAST(o.patch_id * 10 + o.dimension_id AS BIGINT) * 100 + x.item_id) * 100 + y.item_id AS question_id,
  (x.item_id * 31 + y.item_id) % 19 = 0 AS is_gold,
  CASE WHEN (x.item_id * 31 + y.item_id) % 19 = 0
       THEN CASE WHEN x.item_id % 2 = 0 THEN 'a' ELSE 'b' END END AS expected,
  CASE WHEN o.order_id % 29 = 0
       THEN o.order_id * 10000 + x.item_id * 100 + y.item_id - 1 END AS is_retest_of,
  o.order_id AS ranking_id
FROM ord o JOIN order_items x USING (order_id) JOIN order_items y USING (order_id)
WHERE x.item_id < y.item_id""",
)
_view("pairs", "compared", "SELECT * FROM compared")
_view(
    "lane",
    "compared",
    f"""
SELECT response_id, respondent_id, patch_id, created_at, item_a, item_b,
  {_case("status", {"F": "top", "O": "mid", "P": "adc"})} AS role,
  CASE WHEN qty_diff >= 20 THEN 'a_strong' WHEN qty_diff >= 5 THEN 'a_slight'
       WHEN qty_diff > -5 THEN 'even' WHEN qty_diff > -20 THEN 'b_slight' ELSE 'b_strong' END AS choice,
  false AS is_gold, is_retest_of
FROM compared""",
)
_view(
    "peaks",
    "ord order_items",
    """
SELECT order_id * 100 + item_id AS response_id, respondent_id, patch_id, created_at,
  item_id AS item_a, CAST(qty AS INTEGER) % 41 AS minute, traits, false AS is_gold,
  CAST(NULL AS BIGINT) AS is_retest_of
FROM order_items JOIN ord USING (order_id)""",
)
_view(
    "duos_shown",
    "ord order_items",
    f"""
SELECT o.order_id, o.respondent_id, o.patch_id, o.created_at,
  {_case("status", {"F": "bot", "O": "top_jungle", "P": "mid_jungle"})} AS duo_ctx,
  {_case("status", {"F": "adc", "O": "top", "P": "mid"})} AS r1,
  {_case("status", {"F": "support", "O": "jungle", "P": "jungle"})} AS r2,
  max(item_id) FILTER (carry AND rn = 1) AS c1, max(item_id) FILTER (carry AND rn = 2) AS c2,
  max(item_id) FILTER (NOT carry AND rn = 1) AS p1, max(item_id) FILTER (NOT carry AND rn = 2) AS p2,
  sum(qty) FILTER (rn = 1) - sum(qty) FILTER (rn = 2) AS d
FROM (SELECT *, row_number() OVER (PARTITION BY order_id, carry ORDER BY item_id) AS rn
      FROM (SELECT *, item_id % 3 <> 1 AS carry FROM order_items)) t JOIN ord o USING (order_id)
WHERE rn <= 2
GROUP BY ALL
HAVING count(*) = 4""",
)
_view(
    "duos",
    "duos_shown",
    """
SELECT order_id * 10 AS response_id, respondent_id, patch_id, created_at, duo_ctx,
  CASE WHEN swap THEN a2 ELSE a1 END AS item_a, CASE WHEN swap THEN b2 ELSE b1 END AS item_b,
  CASE WHEN swap THEN a1 ELSE a2 END AS item_c, CASE WHEN swap THEN b1 ELSE b2 END AS item_d,
  CASE WHEN swap THEN ra2 ELSE ra1 END AS role_a, CASE WHEN swap THEN rb2 ELSE rb1 END AS role_b,
  CASE WHEN swap THEN ra1 ELSE ra2 END AS role_c, CASE WHEN swap THEN rb1 ELSE rb2 END AS role_d,
  CASE WHEN dd > 10 THEN 'pair_1' WHEN dd < -10 THEN 'pair_2' ELSE 'similar' END AS choice,
  CASE WHEN NOT swap THEN CASE WHEN d >= 20 THEN 'a_strong' WHEN d >= 5 THEN 'a_slight'
       WHEN d > -5 THEN 'even' WHEN d > -20 THEN 'b_slight' ELSE 'b_strong' END
       ELSE CASE WHEN d >= 20 THEN 'b_strong' WHEN d >= 5 THEN 'b_slight'
       WHEN d > -5 THEN 'even' WHEN d > -20 THEN 'a_slight' ELSE 'a_strong' END END AS lane_choice,
  false AS is_gold, CAST(NULL AS BIGINT) AS is_retest_of
FROM (SELECT *, a2 < a1 AS swap, CASE WHEN a2 < a1 THEN -d ELSE d END AS dd
  FROM (SELECT *, least(c1, p1) AS a1, greatest(c1, p1) AS b1, least(c2, p2) AS a2,
      greatest(c2, p2) AS b2,
      CASE WHEN c1 < p1 THEN r1 ELSE r2 END AS ra1, CASE WHEN c1 < p1 THEN r2 ELSE r1 END AS rb1,
      CASE WHEN c2 < p2 THEN r1 ELSE r2 END AS ra2, CASE WHEN c2 < p2 THEN r2 ELSE r1 END AS rb2
    FROM duos_shown))""",
)
_view(
    "rankings",
    "ord order_items",
    """
SELECT order_id AS ranking_id, respondent_id, patch_id, dimension_id,
  (CAST(patch_id * 10 + dimension_id AS BIGINT) * 100 + items[1]) * 100 + items[2] AS anchor_question_id,
  items, submitted_order
FROM (SELECT order_id, list(item_id ORDER BY item_id) AS items,
        list(item_id ORDER BY price DESC, item_id) AS submitted_order
      FROM order_items GROUP BY order_id) JOIN ord USING (order_id)
WHERE len(items) >= 2""",
)
_BLANKS = {
    "item_b": "INTEGER", "item_c": "INTEGER", "item_d": "INTEGER", "dimension_id": "INTEGER",
    "role": "VARCHAR", "duo_ctx": "VARCHAR", "role_a": "VARCHAR", "role_b": "VARCHAR",
    "role_c": "VARCHAR", "role_d": "VARCHAR", "choice": "VARCHAR", "minute": "INTEGER",
    "traits": "VARCHAR[]", "expected": "VARCHAR", "ranking_id": "BIGINT",
}


def _shape(source: str, type_: str, base: int, question: str, **extra: str) -> str:
    columns = ", ".join(
        f"{extra[name]} AS {name}" if name in extra else f"CAST(NULL AS {kind}) AS {name}"
        for name, kind in _BLANKS.items()
    )
    return (
        f"SELECT {base} + response_id AS response_id, respondent_id, {question} AS question_id, "
        f"'{type_}' AS type, patch_id, item_a, {columns}, is_gold, is_retest_of, created_at "
        f"FROM {source}"
    )


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_PATCH = "CAST(patch_id AS BIGINT)"
_ROLE_N = "CASE role WHEN 'top' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END"
_CTX_N = "CASE duo_ctx WHEN 'bot' THEN 1 WHEN 'top_jungle' THEN 2 ELSE 3 END"
_DUO_Q = (
    f"(((({_PATCH} * 10 + {_CTX_N}) * 100 + item_a) * 100 + item_b) * 100 + item_c) * 100 + item_d"
)
_DUO = _same("item_b", "item_c", "item_d", "duo_ctx", "role_a", "role_b", "role_c", "role_d")
_view(
    "responses",
    "pairs peaks lane duos",
    "\nUNION ALL ".join(
        [
            _shape(
                "pairs",
                "pairwise_dimension",
                0,
                "question_id",
                **_same("item_b", "dimension_id", "choice", "expected", "ranking_id"),
            ),
            _shape(
                "peaks",
                "peak_timing",
                10**13,
                f"1000000000 + {_PATCH} * 100 + item_a",
                **_same("minute"),
            ),
            _shape(
                "lane",
                "lane_matchup",
                2 * 10**13,
                f"4000000000 + (({_PATCH} * 10 + {_ROLE_N}) * 100 + item_a) * 100 + item_b",
                **_same("item_b", "role", "choice"),
            ),
            _shape(
                "(SELECT * FROM duos WHERE duo_ctx = 'bot') b",
                "lane_matchup",
                3 * 10**13,
                f"6000000000000 + {_DUO_Q}",
                **(_DUO | {"choice": "lane_choice"}),
            ),
            _shape(
                "duos",
                "duo_synergy",
                4 * 10**13,
                f"5000000000000 + {_DUO_Q}",
                **(_DUO | _same("choice")),
            ),
            _shape(
                "peaks",
                "trait_multiselect",
                5 * 10**13,
                f"1500000000 + {_PATCH} * 100 + item_a",
                **_same("traits"),
            ),
        ]
    ),
)
_view(
    "questions",
    "responses",
    """
SELECT DISTINCT question_id, type, patch_id, item_a, item_b, item_c, item_d, dimension_id, role,
  duo_ctx, role_a, role_b, role_c, role_d, is_gold, expected FROM responses""",
)
for _name in ("pairs", "lane", "peaks", "duos", "responses"):
    _view(
        f"w{_name}",
        f"{_name} respondents",
        f"""
SELECT t.*, r.trust_score, r.declared_rank, r.declared_main_role, r.declared_hours_bucket,
  r.trust_score * pow(0.5, CAST(greatest(date_diff('day', CAST(t.created_at AS DATE),
    DATE '2000-06-01'), 0) AS DOUBLE) / 365.0) AS weight
FROM {_name} t JOIN respondents r USING (respondent_id)
WHERE t.is_retest_of IS NULL AND NOT t.is_gold AND NOT r.is_flagged AND r.trust_score >= 0.3
  AND t.patch_id BETWEEN 1996 AND 2000""",
    )
_EVENTS = ("view", "click", "signup", "purchase", "error")
_SAID = {
    "pairwise_dimension": ("a", "b", "a", "b", "unknown"),
    "lane_matchup": ("a_strong", "even", "b_slight", "a_slight", "b_strong"),
    "duo_synergy": ("pair_1", "pair_2", "similar", "pair_1", "pair_2"),
}
_CHOICE = " ".join(
    f"WHEN '{kind}' THEN {_case('event', dict(zip(_EVENTS, answers, strict=True)))}"
    for kind, answers in _SAID.items()
)
_view(
    "elog",
    "",
    f"""
SELECT * EXCLUDE (k), k AS question_id, k % 10 = 0 AS is_gold, CASE WHEN k % 10 = 0 THEN 'b' END AS expected,
  CASE type {_CHOICE} END AS choice,
  CASE WHEN type = 'peak_timing' THEN CAST(response_time_ms % 41 AS INTEGER) END AS minute,
  CASE WHEN type = 'trait_multiselect' THEN CASE event WHEN 'view' THEN ['A'] WHEN 'click' THEN ['A', 'N']
    WHEN 'signup' THEN ['R'] WHEN 'purchase' THEN ['A', 'N', 'R'] ELSE ['N'] END END AS traits
FROM (SELECT event_id AS response_id, user_id AS respondent_id, ts AS created_at, event_type AS event, k,
    CAST(round(value * 100) AS BIGINT) AS response_time_ms,
    (['pairwise_dimension','peak_timing','lane_matchup','duo_synergy','trait_multiselect'])[k % 5 + 1] AS type
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))""",
)
_ANSWERS = {
    "pairwise_dimension": ['{"choice":"a"}', '{"choice":"b"}', '{"choice":"unknown"}',
                           '{"choice": "c"}', '{"choice":"a","why":"x"}'],
    "peak_timing": [None, None, '{"minute": true}', '{"minute": 7.5}', "{broken"],
    "lane_matchup": ['{"choice":"a_strong"}', '{"choice":"even"}', '{"choice":"b_slight"}',
                     '{"choice":"a"}', '{"minute": 3}'],
    "duo_synergy": ['{"choice":"pair_1"}', '{"choice":"pair_2"}', '{"choice":"similar"}',
                    '{"choice":"pair_3"}', "{}"],
    "trait_multiselect": ['{"traits":["A"]}', '{"traits":["A","N"]}', '{"traits":[]}',
                          '{"traits":["A","A"]}', '{"traits":["A","Z"]}'],
}
_WHENS = " ".join(
    f"WHEN type = '{kind}' AND event = '{name}' THEN "
    + ("'{\"minute\": ' || (response_time_ms % 50) || '}'" if text is None else f"'{text}'")
    for kind, answers in _ANSWERS.items()
    for name, text in zip(_EVENTS, answers, strict=True)
)
_view(
    "raw_answers",
    "elog",
    f"""
SELECT response_id, respondent_id, question_id, type, created_at, response_time_ms,
  CASE {_WHENS} END AS answer FROM elog""",
)
_view(
    "retested",
    "elog",
    """
SELECT *, lag(response_id) OVER (PARTITION BY respondent_id, question_id
  ORDER BY created_at, response_id) AS is_retest_of FROM elog""",
)
_view(
    "identities",
    "elog",
    f"""
SELECT respondent_id, min(created_at) AS first_seen, max(created_at) AS last_seen,
  count(*) AS answers_count, 'f' || (respondent_id % 40) AS fingerprint_hash,
  'ip' || (respondent_id % 7) AS ip_hash,
  CAST(200 + 8 * (respondent_id % 101) AS DOUBLE) / 1000.0 AS trust_score,
  respondent_id % 37 = 0 AS is_flagged, ({RANKS_SQL})[respondent_id % 12 + 1] AS declared_rank
FROM elog GROUP BY respondent_id""",
)


def with_views(needs: str, body: str) -> str:
    """A query with the views it names, each after the ones it builds on."""
    order: list[str] = []

    def add(name: str) -> None:
        for inner in VIEWS[name][0].split():
            add(inner)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    if not order:
        return body.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE') :].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[4:].strip()}"
    return f"WITH {views}\n{body}"
