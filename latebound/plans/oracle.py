"""Equivalent SQL for every catalog query, written for DuckDB over the raw
driver views (region nation customer supplier part orders lineitem).

Written independently of the DataFrame code: the fixture is re-derived with
CTEs, the first month comes from a self-join instead of ``min_by``, ranks
from plain SQL window functions, observable sellers from a non-equi count.
Every output column is cast to the type the Spark side produces.
"""

from __future__ import annotations

from ..operators.bootstrap import poisson_limits

_DIV = "CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def _div(a: str, b: str) -> str:
    return _DIV.format(a=a, b=b)


def _plain(x: str) -> str:
    """Lower, drop marks and qualifiers, fold accents, collapse, trim."""
    return ("NULLIF(trim(regexp_replace(translate(regexp_replace(regexp_replace(lower(" + x + "), '\\p{M}', '', 'g'), "
            "'[/,(\\\\].*$', ''), "
            "'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g')), '')")


def _key(x: str, state: str | None = None) -> str:
    """City key; with ``state``, without that state at the end."""
    k = _plain(x)
    if state is None:
        return k
    end = f"(' ' || {_plain(state)})"
    return f"CASE WHEN coalesce(ends_with({k}, {end}), FALSE) THEN left({k}, length({k}) - length({end})) ELSE {k} END"


def _located(table: str, key: str) -> str:
    """Rows of ``table`` with the city of the whole key or else of the key without the state."""
    return f"""
  SELECT p.{key}, p.city_raw, p.state, coalesce(a.city, b.city) AS city,
         CASE WHEN a.city IS NOT NULL THEN p.full_key ELSE p.short_key END AS city_key
  FROM (SELECT *, {_key('city_raw')} AS full_key, {_key('city_raw', 'state')} AS short_key FROM {table}) p
  LEFT JOIN lookup a ON a.city_key = p.full_key AND a.state = p.state
  LEFT JOIN lookup b ON b.city_key = p.short_key AND b.state = p.state"""


def _dirty(name: str, region: str, key: str) -> str:
    return (f"CASE {key} % 7 WHEN 0 THEN upper({name}) WHEN 1 THEN '  ' || lower({name}) || ' ' "
            f"WHEN 2 THEN replace({name}, '_', '-') WHEN 3 THEN {name} || ' / ' || {region} "
            f"WHEN 4 THEN translate(lower({name}), 'aeiou', 'áéíóú') WHEN 5 THEN {name} || ' - ' || {region} "
            f"ELSE CASE {key} % 4 WHEN 0 THEN 'Nowhere ' || CAST({key} % 3 AS VARCHAR) "
            f"WHEN 1 THEN replace({name}, 'TIO', 'TO') WHEN 2 THEN 'Cidade de ' || lower({region}) ELSE 'Nation' END END")


def _month(m: str) -> str:
    return f"printf('%04d-%02d', CAST({m} // 12 AS INTEGER), CAST({m} % 12 + 1 AS INTEGER))"


BASE = [
    ("fx", """
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, l.l_linestatus,
         o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority,
         greatest(0, least(79, year(o.o_orderdate) * 12 + month(o.o_orderdate) - (1995 * 12 + 1))) AS fx_month,
         l.l_partkey % 2 AS lane, (l.l_suppkey + 3 * (l.l_partkey % 2)) % 7 AS turn
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"""),
    ("lengths", "SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i, unnest([1, 2, 5, 9, 14, 21, 28]) AS months"),
    ("tiles", """
  SELECT t.turn, p.i AS place, l.months AS klen,
         sum(l.months) OVER (PARTITION BY t.turn ORDER BY p.i) - l.months AS k0
  FROM (SELECT i AS turn FROM lengths) t, (SELECT i FROM lengths) p, lengths l
  WHERE l.i = (t.turn + p.i) % 7"""),
    ("fx2", """
  SELECT fx.*, t.klen, fx.l_suppkey * 14 + fx.lane * 7 + t.place AS seller_id,
         (l_orderkey * 7 + l_partkey * 13 + l_suppkey * 31 + l_linenumber * 29) % 97 AS h,
         (l_orderkey * 11 + l_linenumber * 5) % 23 AS h2
  FROM fx JOIN tiles t ON t.turn = fx.turn AND fx.fx_month >= t.k0 AND fx.fx_month < t.k0 + t.klen"""),
    ("fx3", """
  SELECT f.*,
         greatest(0, 1 + f.h % 12 + p.p_size // 8 - f.klen // 10
                     + CASE WHEN f.seller_id % 11 = 3 OR (f.seller_id % 11 IN (0, 5) AND f.klen <= 9) THEN 6 ELSE 0 END) AS ship_d,
         9 + CAST(substr(f.o_orderpriority, 1, 1) AS INTEGER) AS limit_d,
         2 + abs(s.s_nationkey - c.c_nationkey) % 6 + f.h2 % 9 AS transit_d
  FROM fx2 f
  JOIN part p ON p.p_partkey = f.l_partkey
  JOIN supplier s ON s.s_suppkey = f.l_suppkey
  JOIN customer c ON c.c_custkey = f.o_custkey"""),
    ("fulfilment_lines", """
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, seller_id,
         o_custkey AS customer_id, o_orderdate AS ordered_at,
         CASE WHEN h2 <> 7 THEN o_orderdate + to_days(CAST(limit_d AS INTEGER)) END AS ship_limit_at,
         o_orderdate + to_days(CAST(ship_d AS INTEGER)) AS shipped_at,
         CASE WHEN o_orderstatus = 'P' AND l_linestatus = 'O' AND h % 5 = 0 THEN NULL
              ELSE o_orderdate + to_days(CAST(ship_d + transit_d AS INTEGER)) END AS delivered_at,
         o_orderdate + to_days(CAST(limit_d + 9 AS INTEGER)) AS estimated_at,
         CAST(l_extendedprice AS DECIMAL(12, 2)) AS price
  FROM fx3"""),
    ("el", """
  SELECT *,
         CAST(date_diff('day', ship_limit_at, shipped_at) AS INTEGER) AS dispatch_delay,
         CAST(date_diff('day', estimated_at, delivered_at) AS INTEGER) AS delivery_delay,
         CAST(date_diff('day', ordered_at, shipped_at) AS INTEGER) AS ship_days,
         CAST(year(ordered_at) * 12 + month(ordered_at) - 1 AS INTEGER) AS m_idx
  FROM fulfilment_lines"""),
    ("el2", """
  SELECT *,
         CASE WHEN delivery_delay IS NULL THEN NULL WHEN delivery_delay > 0 THEN 1 ELSE 0 END AS late,
         CASE WHEN dispatch_delay IS NULL THEN NULL WHEN dispatch_delay > 0 THEN 1 ELSE 0 END AS dispatch_late
  FROM el"""),
    ("el3", """
  SELECT *,
         CASE WHEN late IS NULL THEN 'undelivered'
              WHEN late = 1 AND dispatch_late = 1 THEN 'seller'
              WHEN late = 1 AND dispatch_late = 0 THEN 'carrier'
              WHEN late = 1 THEN 'unknown'
              WHEN dispatch_late = 1 THEN 'absorbed'
              ELSE 'on_time' END AS cause,
         CASE WHEN late = 1 AND dispatch_late IS NOT NULL
              THEN least(delivery_delay, greatest(dispatch_delay, 0)) END AS seller_days
  FROM el2"""),
    ("lines", "SELECT *, delivery_delay - seller_days AS carrier_days FROM el3"),
]

DIMS = [
    ("geo", """
  SELECT n.n_nationkey, n.n_name, r.r_name
  FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"""),
    ("sellers", f"""
  SELECT CAST(s_suppkey * 14 + slot AS BIGINT) AS seller_id,
         {_dirty('n_name', 'r_name', 's_suppkey')} AS city_raw, r_name AS state
  FROM (SELECT s.s_suppkey, g.n_name, g.r_name, unnest(range(14)) AS slot
        FROM supplier s JOIN geo g ON g.n_nationkey = s.s_nationkey)"""),
    ("customers", f"""
  SELECT c.c_custkey AS customer_id, {_dirty('g.n_name', 'g.r_name', 'c.c_custkey')} AS city_raw,
         g.r_name AS state
  FROM customer c JOIN geo g ON g.n_nationkey = c.c_nationkey"""),
    ("products", """
  SELECT *, CAST(length AS DOUBLE) * CAST(width AS DOUBLE) * CAST(height AS DOUBLE) AS volume
  FROM (SELECT p_partkey AS product_id, p_type AS category,
               CASE WHEN p_partkey % 17 <> 5 THEN CAST(p_size AS DOUBLE) + (p_partkey % 4) / 4.0::DOUBLE END AS weight,
               CASE WHEN p_partkey % 50 = 7 THEN 2000 ELSE p_size END AS length,
               CASE WHEN p_partkey % 50 = 7 THEN 2000 ELSE 1 + p_partkey % 5 END AS width,
               CASE WHEN p_partkey % 19 = 3 THEN NULL WHEN p_partkey % 50 = 7 THEN 2000
                    ELSE 1 + p_partkey % 3 END AS height
        FROM part)"""),
    ("cities", f"""
  SELECT {_key('city')} AS city_key, city, state
  FROM (SELECT n_name AS city, r_name AS state FROM geo
        UNION ALL SELECT 'Cidade de ' || r_name, r_name FROM region)"""),
    ("lookup", """
  SELECT city_key, state, min(city) AS city FROM cities
  WHERE city_key IS NOT NULL GROUP BY city_key, state"""),
]

SELLER_MONTH = [
    ("sm", """
  SELECT seller_id, m_idx, count(*) AS lines, count(DISTINCT order_id) AS orders,
         sum(price) AS revenue, count(late) AS delivered,
         count(*) FILTER (WHERE late = 1) AS late,
         count(*) FILTER (WHERE cause = 'seller') AS seller_late,
         count(*) FILTER (WHERE cause = 'carrier') AS carrier_late,
         count(dispatch_late) AS dispatch_known,
         count(*) FILTER (WHERE dispatch_late = 1) AS dispatch_late,
         CAST(sum(delivery_delay) AS BIGINT) AS delay_sum,
         CAST(sum(CASE WHEN late = 1 THEN delivery_delay END) AS BIGINT) AS late_delay_sum
  FROM lines GROUP BY seller_id, m_idx"""),
    ("sagg", """
  SELECT seller_id, min(m_idx) AS first_m, max(m_idx) AS last_m, count(*) AS active_months,
         CAST(sum(orders) AS BIGINT) AS orders, sum(revenue) AS revenue,
         CAST(sum(delivered) AS BIGINT) AS delivered, CAST(sum(late) AS BIGINT) AS late,
         CAST(sum(seller_late) AS BIGINT) AS seller_late,
         CAST(sum(dispatch_known) AS BIGINT) AS dispatch_known,
         CAST(sum(dispatch_late) AS BIGINT) AS dispatch_late,
         CAST(sum(delay_sum) AS BIGINT) AS delay_sum,
         CAST(sum(late_delay_sum) AS BIGINT) AS late_delay_sum
  FROM sm GROUP BY seller_id"""),
    ("profile", f"""
  SELECT a.*, CAST(a.last_m - a.first_m + 1 AS INTEGER) AS tenure,
         {_div('a.late', 'a.delivered')} AS late_rate,
         f.delivered AS first_delivered, f.late AS first_late, f.revenue AS first_revenue
  FROM sagg a JOIN sm f ON f.seller_id = a.seller_id AND f.m_idx = a.first_m"""),
    ("cohorts", f"""
  SELECT seller_id, first_m, {_month('first_m')} AS first_month,
         first_delivered AS delivered, first_late AS late,
         {_div('first_late', 'first_delivered')} AS rate,
         CASE WHEN first_delivered = 0 THEN 'unrated'
              WHEN {_div('first_late', 'first_delivered')} <= 0.0 THEN 'excellent'
              WHEN {_div('first_late', 'first_delivered')} >= 0.5 THEN 'severe'
              ELSE 'normal' END AS label,
         CAST(first_revenue AS DOUBLE) AS first_revenue
  FROM profile"""),
]

RFM = [
    ("rfm_base", """
  SELECT p.seller_id, CAST(t.data_last - p.last_m AS INTEGER) AS recency, p.orders AS frequency,
         p.revenue AS monetary, t.total, p.delivered, p.late AS late_lines
  FROM profile p, (SELECT max(last_m) AS data_last, sum(revenue) AS total FROM profile) t"""),
    ("rfm", f"""
  SELECT seller_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
         {_div('monetary', 'total')} AS revenue_share,
         CAST(ntile(5) OVER (ORDER BY recency DESC, seller_id) AS INTEGER) AS r_score,
         CAST(ntile(5) OVER (ORDER BY frequency, seller_id) AS INTEGER) AS f_score,
         CAST(ntile(5) OVER (ORDER BY monetary, seller_id) AS INTEGER) AS m_score,
         delivered, late_lines, {_div('late_lines', 'delivered')} AS late_rate
  FROM rfm_base"""),
]

LOCATED_SELLERS = [("loc", _located("sellers", "seller_id"))]
CUSTOMER_PLACE = [("cloc", _located("customers", "customer_id"))]


def _party(key: str) -> list[tuple[str, str]]:
    return [("pp", f"""
  SELECT {key}, count(late) AS delivered, count(*) FILTER (WHERE late = 1) AS late,
         count(*) FILTER (WHERE cause = 'seller') AS seller_late,
         count(*) FILTER (WHERE cause = 'carrier') AS carrier_late
  FROM lines GROUP BY {key}""")]


_REGION_MEASURES = """CAST(sum(pp.delivered) AS BIGINT) AS delivered_lines,
         CAST(sum(pp.late) AS BIGINT) AS late_lines,
         CAST(sum(pp.seller_late) AS BIGINT) AS seller_late,
         CAST(sum(pp.carrier_late) AS BIGINT) AS carrier_late"""

_REGION_RATES = f"""{_div('late_lines', 'delivered_lines')} AS late_rate,
       {_div('seller_late', 'delivered_lines')} AS seller_rate,
       {_div('carrier_late', 'delivered_lines')} AS carrier_rate,
       CASE WHEN late_lines = 0 THEN 'none' WHEN seller_late > carrier_late THEN 'seller'
            WHEN carrier_late > seller_late THEN 'carrier' ELSE 'tie' END AS bottleneck"""

BLAME = [
    ("sg", """
  SELECT l.seller_id,
         count(*) FILTER (WHERE l.late = 1) AS late,
         count(*) FILTER (WHERE l.cause = 'seller') AS seller_late,
         CAST(sum(p.weight) AS DOUBLE) / NULLIF(count(p.weight), 0) AS avg_weight,
         sum(p.volume) / NULLIF(count(p.volume), 0) AS avg_volume,
         CAST(sum(l.ship_days) AS DOUBLE) / NULLIF(count(l.ship_days), 0) AS avg_ship_days
  FROM lines l LEFT JOIN products p ON p.product_id = l.product_id
  GROUP BY l.seller_id
  HAVING count(*) FILTER (WHERE l.late = 1) >= 1"""),
    ("shares", f"""
  SELECT seller_id, late, seller_late, {_div('seller_late', 'late')} AS blame_share,
         avg_weight, avg_volume, avg_ship_days
  FROM sg"""),
    ("ranked", """
  SELECT *, CAST(ntile(10) OVER (ORDER BY blame_share, seller_id) AS INTEGER) AS decile
  FROM shares"""),
]

CATEGORY_BLAME = [
    ("cg", """
  SELECT p.category,
         count(*) FILTER (WHERE l.late = 1) AS late,
         count(*) FILTER (WHERE l.cause = 'seller') AS seller_late,
         CAST(sum(p.weight) AS DOUBLE) / NULLIF(count(p.weight), 0) AS avg_weight,
         sum(p.volume) / NULLIF(count(p.volume), 0) AS avg_volume,
         CAST(sum(l.ship_days) AS DOUBLE) / NULLIF(count(l.ship_days), 0) AS avg_ship_days
  FROM lines l LEFT JOIN products p ON p.product_id = l.product_id
  GROUP BY p.category
  HAVING count(*) FILTER (WHERE l.late = 1) >= 1"""),
    ("ranked", f"""
  SELECT *, {_div('seller_late', 'late')} AS blame_share,
         CAST(ntile(4) OVER (ORDER BY {_div('seller_late', 'late')}, category) AS INTEGER) AS decile
  FROM cg"""),
]

_DECILE_SELECT = f"""
SELECT decile, count(*) AS members, min(blame_share) AS min_share, max(blame_share) AS max_share,
       CAST(sum(late) AS BIGINT) AS late_lines, CAST(sum(seller_late) AS BIGINT) AS seller_late_lines,
       round(avg(avg_weight), 6) AS avg_weight, round(avg(avg_volume), 6) AS avg_volume,
       round(avg(avg_ship_days), 6) AS avg_ship_days,
       {_div('sum(seller_late)', 'sum(late)')} AS pooled_share
FROM ranked GROUP BY decile"""

_BUCKET = ("CASE WHEN tenure <= 1 THEN '1' WHEN tenure <= 6 THEN '2-6' "
           "WHEN tenure < 13 THEN '7-12' ELSE '13+' END")

RETENTION = [
    ("coh", "SELECT seller_id, first_m, label FROM cohorts"),
    ("sizes", "SELECT label, count(*) AS cohort_size FROM coh GROUP BY label"),
    ("data_last", "SELECT max(m_idx) AS last_m FROM lines"),
    ("act", """
  SELECT c.label, sm.m_idx - c.first_m AS k, count(*) AS active
  FROM sm JOIN coh c ON c.seller_id = sm.seller_id GROUP BY c.label, sm.m_idx - c.first_m"""),
]


def _retention_select(keys: str) -> str:
    return f"""
, keys AS ({keys})
, obs AS (
  SELECT g.label, g.k, count(c.seller_id) AS observable
  FROM keys g LEFT JOIN coh c
    ON c.label = g.label AND c.first_m + g.k <= (SELECT last_m FROM data_last)
  GROUP BY g.label, g.k)
SELECT g.label, CAST(g.k AS INTEGER) AS k, s.cohort_size, o.observable,
       CAST(coalesce(a.active, 0) AS BIGINT) AS active,
       {_div('coalesce(a.active, 0)', 's.cohort_size')} AS retention,
       {_div('coalesce(a.active, 0)', 'o.observable')} AS retention_observable
FROM keys g
JOIN sizes s ON s.label = g.label
JOIN obs o ON o.label = g.label AND o.k = g.k
LEFT JOIN act a ON a.label = g.label AND a.k = g.k"""


def _with(ctes: list[tuple[str, str]], select: str) -> str:
    body = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{select.strip()}"


PROFILE = BASE + SELLER_MONTH

ORACLE_SQL: dict[str, str] = {
    "delay_attribution": _with(BASE, """
SELECT cause, count(*) AS lines, count(DISTINCT seller_id) AS sellers,
       CAST(sum(price) AS DOUBLE) AS revenue,
       CAST(sum(delivery_delay) AS BIGINT) AS delay_days,
       CAST(sum(seller_days) AS BIGINT) AS seller_days,
       CAST(sum(carrier_days) AS BIGINT) AS carrier_days
FROM lines GROUP BY cause"""),

    "delay_attribution_lines": _with(BASE, """
SELECT order_id, line_no, product_id, seller_id, dispatch_delay, delivery_delay, late,
       dispatch_late, ship_days, cause, seller_days, carrier_days
FROM lines"""),

    "late_revenue_monthly": _with(BASE + [
        ("per_order", """
  SELECT order_id, m_idx, sum(price) AS revenue,
         sum(CASE WHEN late = 1 THEN price END) AS late_revenue, max(late) AS any_late
  FROM lines GROUP BY order_id, m_idx"""),
        ("monthly", """
  SELECT m_idx, sum(revenue) AS revenue, coalesce(sum(late_revenue), 0) AS late_revenue,
         count(*) AS orders, count(*) FILTER (WHERE any_late = 1) AS late_orders
  FROM per_order GROUP BY m_idx""")], f"""
SELECT {_month('m_idx')} AS month, CAST(revenue AS DOUBLE) AS revenue,
       CAST(late_revenue AS DOUBLE) AS late_revenue, orders, late_orders,
       {_div('late_orders', 'orders')} AS late_order_share,
       {_div('late_revenue', 'revenue')} AS late_revenue_share,
       CASE WHEN lag(m_idx) OVER (ORDER BY m_idx) = m_idx - 1
            THEN {_div('revenue', 'lag(revenue) OVER (ORDER BY m_idx)')} - 1 END AS revenue_growth
FROM monthly"""),

    "seller_month": _with(PROFILE, """
SELECT seller_id, m_idx, lines, orders, CAST(revenue AS DOUBLE) AS revenue, delivered, late,
       seller_late, carrier_late, dispatch_known, dispatch_late, delay_sum, late_delay_sum
FROM sm"""),

    "rfm_scores": _with(PROFILE + RFM, "SELECT * FROM rfm"),

    "black_sellers_rfm": _with(PROFILE + RFM, """
SELECT * FROM rfm WHERE m_score >= 5 AND late_lines >= 3 AND late_rate >= 0.3"""),

    "city_cleanse": _with(DIMS + LOCATED_SELLERS, "SELECT seller_id, city_raw, state, city_key, city FROM loc"),

    "city_unmatched": _with(DIMS, f"""
SELECT c.city_raw, c.city_key, c.state, count(*) AS rows
FROM (SELECT *, {_key('city_raw')} AS full_key, {_key('city_raw', 'state')} AS city_key FROM customers) c
WHERE NOT EXISTS (SELECT 1 FROM lookup k WHERE k.city_key IN (c.full_key, c.city_key) AND k.state = c.state)
GROUP BY c.city_raw, c.city_key, c.state"""),

    "regional_bottlenecks": _with(BASE + DIMS + LOCATED_SELLERS + _party("seller_id") + [
        ("g", f"""
  SELECT loc.state, loc.city, {_REGION_MEASURES}
  FROM pp LEFT JOIN loc ON loc.seller_id = pp.seller_id
  GROUP BY loc.state, loc.city""")], f"""
SELECT state, city, delivered_lines, late_lines, seller_late, carrier_late, {_REGION_RATES}
FROM g"""),

    "regional_bottlenecks_rollup": _with(BASE + DIMS + LOCATED_SELLERS + _party("seller_id") + [
        ("g", f"""
  SELECT loc.state, loc.city, {_REGION_MEASURES},
         CAST(grouping(loc.state, loc.city) AS INTEGER) AS level_id
  FROM pp LEFT JOIN loc ON loc.seller_id = pp.seller_id
  GROUP BY ROLLUP (loc.state, loc.city)""")], f"""
SELECT state, city, delivered_lines, late_lines, seller_late, carrier_late, level_id, {_REGION_RATES}
FROM g"""),

    "regional_bottlenecks_customer": _with(BASE + DIMS + _party("customer_id") + CUSTOMER_PLACE + [
        ("g", f"""
  SELECT cloc.state, {_REGION_MEASURES}
  FROM pp LEFT JOIN cloc ON cloc.customer_id = pp.customer_id
  GROUP BY cloc.state""")], f"""
SELECT state, delivered_lines, late_lines, seller_late, carrier_late, {_REGION_RATES}
FROM g"""),

    "seller_blame_shares": _with(BASE + DIMS + BLAME, "SELECT * FROM ranked"),

    "seller_blame_deciles": _with(BASE + DIMS + BLAME, _DECILE_SELECT),

    "category_blame_deciles": _with(BASE + DIMS + CATEGORY_BLAME, _DECILE_SELECT),

    "spec_delay_correlation": _with(BASE + DIMS + BLAME, """
SELECT round(corr(blame_share, avg_weight), 6) AS share_weight,
       round(corr(blame_share, avg_volume), 6) AS share_volume,
       round(corr(avg_weight, avg_ship_days), 6) AS weight_dispatch,
       round(corr(blame_share, avg_ship_days), 6) AS share_dispatch,
       count(*) AS grains
FROM shares"""),

    "tenure_vs_delay": _with(PROFILE, f"""
SELECT {_BUCKET} AS bucket, count(*) AS sellers, CAST(sum(delivered) AS BIGINT) AS lines,
       {_div('sum(delay_sum)', 'sum(delivered)')} AS avg_delay_all,
       {_div('sum(late_delay_sum)', 'sum(late)')} AS avg_delay_late,
       {_div('sum(late)', 'sum(delivered)')} AS late_rate
FROM profile GROUP BY {_BUCKET}"""),

    "tenure_gap": _with(PROFILE + [
        ("t", f"""
  SELECT {_div('sum(delay_sum) FILTER (WHERE tenure <= 1)', 'sum(delivered) FILTER (WHERE tenure <= 1)')} AS one_off_all,
         {_div('sum(delay_sum) FILTER (WHERE tenure >= 13)', 'sum(delivered) FILTER (WHERE tenure >= 13)')} AS long_all,
         {_div('sum(late_delay_sum) FILTER (WHERE tenure <= 1)', 'sum(late) FILTER (WHERE tenure <= 1)')} AS one_off_late,
         {_div('sum(late_delay_sum) FILTER (WHERE tenure >= 13)', 'sum(late) FILTER (WHERE tenure >= 13)')} AS long_late
  FROM profile""")], """
SELECT one_off_all, long_all, one_off_late, long_late,
       one_off_all - long_all AS gap_all, one_off_late - long_late AS gap_late
FROM t"""),

    "first_month_cohorts": _with(PROFILE, """
SELECT seller_id, first_month, delivered, late, rate, label, first_revenue FROM cohorts"""),

    "cohort_retention": _with(PROFILE + RETENTION, _retention_select(
        "SELECT s.label, t.k FROM sizes s, (SELECT range AS k FROM range(0, 25)) t")),

    "cohort_retention_active": _with(PROFILE + RETENTION, _retention_select(
        "SELECT label, k FROM act")),

    "seller_penalty_ranking": _with(PROFILE + [
        ("b", f"""
  SELECT seller_id, revenue, dispatch_known AS dispatch_lines,
         {_div('dispatch_late', 'dispatch_known')} AS dispatch_late_rate
  FROM profile"""),
        ("p", """
  SELECT *, CASE WHEN dispatch_lines >= 5 AND dispatch_late_rate >= 0.4 THEN 1 ELSE 0 END AS penalized
  FROM b"""),
        ("r", """
  SELECT *, row_number() OVER (ORDER BY revenue DESC, seller_id) AS base_rank,
         row_number() OVER (ORDER BY penalized, revenue DESC, seller_id) AS adjusted_rank
  FROM p""")], """
SELECT seller_id, CAST(revenue AS DOUBLE) AS revenue, dispatch_lines, dispatch_late_rate,
       CAST(penalized AS INTEGER) AS penalized, base_rank, adjusted_rank,
       adjusted_rank - base_rank AS rank_change
FROM r"""),

    "fulfilment_priority_groups": _with(BASE + DIMS + [
        ("g", """
  SELECT p.category,
         CASE WHEN p.weight IS NULL THEN 'unknown' WHEN p.weight >= 35 THEN 'bulky'
              ELSE 'regular' END AS size_band,
         count(l.late) AS delivered, count(*) FILTER (WHERE l.late = 1) AS late,
         count(*) FILTER (WHERE l.cause = 'seller') AS seller_late
  FROM lines l LEFT JOIN products p ON p.product_id = l.product_id
  GROUP BY 1, 2"""),
        ("s", f"""
  SELECT *, {_div('seller_late', 'late')} AS seller_share, {_div('late', 'delivered')} AS late_rate
  FROM g""")], """
SELECT category, size_band, delivered, late, seller_late, seller_share, late_rate,
       CAST(CASE WHEN size_band = 'bulky' AND seller_share >= 0.5
                  AND seller_share > coalesce(max(CASE WHEN size_band = 'regular' THEN seller_share END)
                                              OVER (PARTITION BY category), -1.0)
                 THEN 1 ELSE 0 END AS INTEGER) AS priority
FROM s"""),

    "new_seller_watchlist": _with(PROFILE, """
SELECT seller_id, first_month, delivered, late, rate, first_revenue
FROM cohorts WHERE label = 'severe' AND delivered >= 2"""),

    "good_seller_badge": _with(PROFILE, """
SELECT seller_id, tenure, delivered, late, late_rate, CAST(revenue AS DOUBLE) AS revenue
FROM profile WHERE tenure >= 13 AND late_rate <= 0.05"""),
}

ORACLE_SQL["black_sellers_caused"] = _with(
    PROFILE + [(n, q.replace("p.late AS late_lines", "p.seller_late AS late_lines")) for n, q in RFM],
    "SELECT * FROM rfm WHERE m_score >= 5 AND late_lines >= 3 AND late_rate >= 0.3")

ORACLE_SQL["regional_bottlenecks_customer_city"] = _with(
    BASE + DIMS + _party("customer_id") + CUSTOMER_PLACE + [("g", f"""
  SELECT cloc.state, cloc.city, {_REGION_MEASURES}
  FROM pp LEFT JOIN cloc ON cloc.customer_id = pp.customer_id
  GROUP BY cloc.state, cloc.city""")], f"""
SELECT state, city, delivered_lines, late_lines, seller_late, carrier_late, {_REGION_RATES} FROM g""")

ORACLE_SQL["regional_bottlenecks_customer_rollup"] = _with(
    BASE + DIMS + _party("customer_id") + CUSTOMER_PLACE + [("g", f"""
  SELECT cloc.state, cloc.city, {_REGION_MEASURES},
         CAST(grouping(cloc.state, cloc.city) AS INTEGER) AS level_id
  FROM pp LEFT JOIN cloc ON cloc.customer_id = pp.customer_id
  GROUP BY ROLLUP (cloc.state, cloc.city)""")], f"""
SELECT state, city, delivered_lines, late_lines, seller_late, carrier_late, level_id, {_REGION_RATES} FROM g""")

ORACLE_SQL["seller_blame_deciles_min5"] = _with(
    BASE + DIMS + [(n, q.replace("late = 1) >= 1", "late = 1) >= 5")) for n, q in BLAME], _DECILE_SELECT)

_ACTIVE_BUCKET = _BUCKET.replace("tenure", "active_months")

ORACLE_SQL["tenure_vs_delay_active"] = _with(PROFILE, f"""
SELECT {_ACTIVE_BUCKET} AS bucket, count(*) AS sellers, CAST(sum(delivered) AS BIGINT) AS lines,
       {_div('sum(delay_sum)', 'sum(delivered)')} AS avg_delay_all,
       {_div('sum(late_delay_sum)', 'sum(late)')} AS avg_delay_late,
       {_div('sum(late)', 'sum(delivered)')} AS late_rate
FROM profile GROUP BY {_ACTIVE_BUCKET}""")

ORACLE_SQL["signup_month_cohorts"] = _with(PROFILE + [
    ("signups", """
  SELECT s.s_suppkey * 14 + x.lane * 7 + t.place AS seller_id, CAST(1995 * 12 + t.k0 AS INTEGER) AS first_m
  FROM supplier s, (SELECT unnest([0, 1]) AS lane) x, tiles t
  WHERE t.turn = (s.s_suppkey + 3 * x.lane) % 7"""),
    ("m", f"""
  SELECT u.seller_id, u.first_m, coalesce(sm.delivered, 0) AS delivered, coalesce(sm.late, 0) AS late,
         {_div('sm.late', 'sm.delivered')} AS rate, coalesce(CAST(sm.revenue AS DOUBLE), 0.0) AS first_revenue
  FROM signups u LEFT JOIN sm ON sm.seller_id = u.seller_id AND sm.m_idx = u.first_m""")], f"""
SELECT CAST(seller_id AS BIGINT) AS seller_id, {_month('first_m')} AS first_month, delivered, late, rate,
       CASE WHEN rate IS NULL THEN 'unrated' WHEN rate <= 0.0 THEN 'excellent'
            WHEN rate >= 0.5 THEN 'severe' ELSE 'normal' END AS label, first_revenue
FROM m""")

# Later by the clock instead of by the calendar day.
ORACLE_SQL["delay_attribution_seconds"] = (
    ORACLE_SQL["delay_attribution"]
    .replace("CASE WHEN delivery_delay IS NULL THEN NULL WHEN delivery_delay > 0 THEN 1",
             "CASE WHEN delivery_delay IS NULL THEN NULL WHEN delivered_at > estimated_at THEN 1")
    .replace("CASE WHEN dispatch_delay IS NULL THEN NULL WHEN dispatch_delay > 0 THEN 1",
             "CASE WHEN dispatch_delay IS NULL THEN NULL WHEN shipped_at > ship_limit_at THEN 1"))

ORACLE_SQL["fulfilment_priority_groups_volume"] = ORACLE_SQL["fulfilment_priority_groups"].replace(
    "CASE WHEN p.weight IS NULL THEN 'unknown' WHEN p.weight >= 35 THEN 'bulky'",
    "CASE WHEN p.weight >= 35 OR p.volume >= 400 THEN 'bulky'\n"
    "              WHEN p.weight IS NULL AND p.volume IS NULL THEN 'unknown'")

# The streaming replay's final state is the batch cohort table.
ORACLE_SQL["first_month_cohorts_stream"] = ORACLE_SQL["first_month_cohorts"]

# Retention one year after the first sale.
ORACLE_SQL["cohort_long_term_retention"] = (
    "SELECT * FROM (\n" + ORACLE_SQL["cohort_retention"] + "\n) WHERE k = 12")

# Misspelled cities: every unmatched key against every city of its state.
_SPELLED = [
    ("missing", "SELECT DISTINCT city_key, state FROM cloc WHERE city IS NULL AND city_key IS NOT NULL"),
    ("near", """
  SELECT m.city_key, m.state, k.city, levenshtein(m.city_key, k.city_key) AS d,
         least(length(m.city_key), length(k.city_key)) AS len
  FROM missing m JOIN lookup k ON k.state = m.state"""),
    ("allowed", """
  SELECT *, min(d) OVER (PARTITION BY city_key, state) AS best FROM near
  WHERE d <= CASE WHEN len >= 6 THEN 2 WHEN len >= 3 THEN 1 ELSE 0 END"""),
    ("repaired", """
  SELECT city_key, state, best, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(city) END AS city
  FROM allowed WHERE d = best GROUP BY city_key, state, best"""),
    ("floc", """
  SELECT c.customer_id, c.city_raw, c.state, c.city_key, coalesce(c.city, r.city) AS city,
         CAST(CASE WHEN c.city IS NOT NULL THEN 0 ELSE r.best END AS INTEGER) AS distance,
         CASE WHEN c.city IS NOT NULL THEN 1 ELSE coalesce(r.candidates, 0) END AS candidates
  FROM cloc c LEFT JOIN repaired r ON c.city IS NULL AND r.city_key = c.city_key AND r.state = c.state"""),
]

ORACLE_SQL["city_matched_fuzzy"] = _with(DIMS + CUSTOMER_PLACE + _SPELLED, """
SELECT customer_id, city_raw, state, city_key, city, distance, CAST(candidates AS BIGINT) AS candidates FROM floc""")

ORACLE_SQL["regional_bottlenecks_fuzzy"] = _with(
    BASE + DIMS + _party("customer_id") + CUSTOMER_PLACE + _SPELLED + [("g", f"""
  SELECT floc.state, floc.city, {_REGION_MEASURES}
  FROM pp LEFT JOIN floc ON floc.customer_id = pp.customer_id
  GROUP BY floc.state, floc.city""")], f"""
SELECT state, city, delivered_lines, late_lines, seller_late, carrier_late, {_REGION_RATES} FROM g""")

# Runs of late lines by plain windows over each seller.
_STREAKS = [
    ("placed", """
  SELECT seller_id, late,
         row_number() OVER w AS place,
         row_number() OVER w - sum(late) OVER (w ROWS UNBOUNDED PRECEDING) AS island
  FROM lines WHERE late IS NOT NULL
  WINDOW w AS (PARTITION BY seller_id ORDER BY ordered_at, order_id, line_no, product_id, late)"""),
    ("islands", """
  SELECT seller_id, island, sum(late) AS run, count(*) AS n, max(place) AS last FROM placed GROUP BY seller_id, island"""),
    ("streaks", """
  SELECT seller_id, CAST(sum(n) AS BIGINT) AS delivered, CAST(sum(run) AS BIGINT) AS late,
         CAST(max(run) AS BIGINT) AS longest_streak, CAST(arg_max(run, last) AS BIGINT) AS current_streak,
         count(*) FILTER (WHERE run >= 3) AS streaks
  FROM islands GROUP BY seller_id"""),
]

ORACLE_SQL["seller_late_streaks"] = _with(BASE + _STREAKS, "SELECT * FROM streaks")

ORACLE_SQL["black_sellers_streaks"] = _with(PROFILE + RFM + _STREAKS, """
SELECT r.seller_id, r.monetary, r.revenue_share, r.delivered, r.late_lines, r.late_rate,
       s.longest_streak, s.current_streak, s.streaks
FROM rfm r JOIN streaks s ON s.seller_id = r.seller_id
WHERE r.m_score >= 5 AND s.longest_streak >= 3 AND s.streaks >= 1""")

# Survival: the risk sets by a self-join, the product as a sum of logarithms.
_LIVES = [
    ("lives", """
  SELECT p.seller_id, c.label, p.last_m - p.first_m AS k, (SELECT max(last_m) FROM profile) - p.last_m >= 3 AS stopped
  FROM profile p JOIN cohorts c ON c.seller_id = p.seller_id"""),
    ("ends", """
  SELECT label, k, count(*) FILTER (WHERE stopped) AS stopped, count(*) FILTER (WHERE NOT stopped) AS censored
  FROM lives GROUP BY label, k"""),
    ("risk", """
  SELECT e.label, e.k, e.stopped, e.censored, count(*) AS at_risk
  FROM ends e JOIN lives l ON l.label = e.label AND l.k >= e.k GROUP BY e.label, e.k, e.stopped, e.censored"""),
]

ORACLE_SQL["cohort_survival"] = _with(PROFILE + _LIVES + [
    ("cum", """
  SELECT a.label, a.k, a.at_risk, a.stopped, a.censored,
         bool_or(b.stopped = b.at_risk) AS gone,
         sum(CASE WHEN b.stopped < b.at_risk THEN ln(1 - b.stopped / CAST(b.at_risk AS DOUBLE)) END) AS logs,
         sum(CASE WHEN b.stopped < b.at_risk
                  THEN b.stopped / (CAST(b.at_risk AS DOUBLE) * (b.at_risk - b.stopped)) END) AS g
  FROM risk a JOIN risk b ON b.label = a.label AND b.k <= a.k
  GROUP BY a.label, a.k, a.at_risk, a.stopped, a.censored"""),
    ("est", """
  SELECT *, CASE WHEN gone THEN 0.0::DOUBLE ELSE exp(logs) END AS s,
         CASE WHEN NOT gone THEN exp(logs) * sqrt(g) END AS e FROM cum""")], """
SELECT label, CAST(k AS INTEGER) AS k, at_risk, stopped, censored, round(s, 9) AS survival, round(e, 9) AS std_err,
       CASE WHEN e IS NOT NULL THEN round(greatest(0.0::DOUBLE, s - 1.96::DOUBLE * e), 9) ELSE 0.0::DOUBLE END AS low,
       CASE WHEN e IS NOT NULL THEN round(least(1.0::DOUBLE, s + 1.96::DOUBLE * e), 9) ELSE 1.0::DOUBLE END AS high
FROM est""")

ORACLE_SQL["cohort_logrank"] = _with(PROFILE + _LIVES + [
    ("two", "SELECT * FROM lives WHERE label IN ('excellent', 'severe')"),
    ("months", "SELECT DISTINCT k FROM two"),
    ("sets", """
  SELECT m.k, CAST(count(*) FILTER (WHERE t.label = 'excellent') AS DOUBLE) AS n0,
         CAST(count(*) FILTER (WHERE t.label = 'severe') AS DOUBLE) AS n1,
         count(*) FILTER (WHERE t.label = 'excellent' AND t.k = m.k AND t.stopped) AS d0,
         count(*) FILTER (WHERE t.label = 'severe' AND t.k = m.k AND t.stopped) AS d1
  FROM months m JOIN two t ON t.k >= m.k GROUP BY m.k"""),
    ("sums", """
  SELECT CAST(sum(d0) AS BIGINT) AS o0, CAST(sum(d1) AS BIGINT) AS o1, sum((d0 + d1) * n0 / (n0 + n1)) AS e0,
         sum((d0 + d1) * n1 / (n0 + n1)) AS e1,
         sum(CASE WHEN n0 + n1 > 1 THEN (d0 + d1) * (n0 / (n0 + n1)) * (n1 / (n0 + n1)) * (n0 + n1 - d0 - d1)
                                        / (n0 + n1 - 1) ELSE 0 END) AS v
  FROM sets"""),
    ("test", "SELECT *, (o0 - e0) * (o0 - e0) / nullif(v, 0) AS chi FROM sums"),
    ("x", "SELECT *, sqrt(chi) / sqrt(2.0::DOUBLE) AS z, 1 / (1 + 0.3275911::DOUBLE * sqrt(chi) / sqrt(2.0::DOUBLE)) AS t FROM test")], """
SELECT o0 AS first_stopped, round(e0, 6) AS first_expected, o1 AS second_stopped, round(e1, 6) AS second_expected,
       round(v, 6) AS variance, round(chi, 6) AS chi_square,
       round((0.254829592::DOUBLE * t - 0.284496736::DOUBLE * t ** 2 + 1.421413741::DOUBLE * t ** 3
              - 1.453152027::DOUBLE * t ** 4 + 1.061405429::DOUBLE * t ** 5) * exp(-z * z), 6) AS p_value
FROM x""")


def _mix(x: str) -> str:
    return f"xor({x} >> 16, {x}) * 73244475 % 4294967296"


_REPLICATES = 200
_LIMITS = "[" + ", ".join(str(v) for v in poisson_limits()) + "]"

ORACLE_SQL["tenure_gap_interval"] = _with(PROFILE + [
    ("words", """
  SELECT *, CAST('0x' || substr(md5(CAST(seller_id AS VARCHAR)), 1, 8) AS BIGINT) AS word
  FROM profile WHERE tenure <= 1 OR tenure >= 13"""),
    ("r0", f"""
  SELECT w.*, r.range AS replicate, (word + r.range * 165902235) % 4294967296 AS x
  FROM words w, range(1, {_REPLICATES + 1}) r"""),
    ("r1", f"SELECT * REPLACE ({_mix('x')} AS x) FROM r0"),
    ("r2", f"SELECT * REPLACE ({_mix('x')} AS x) FROM r1"),
    ("drawn", f"""
  SELECT *, len(list_filter({_LIMITS}, lambda v: xor(x >> 16, x) >= v)) AS w FROM r2"""),
    ("reps", f"""
  SELECT replicate,
         {_div('sum(delay_sum * w) FILTER (WHERE tenure <= 1)', 'sum(delivered * w) FILTER (WHERE tenure <= 1)')}
         - {_div('sum(delay_sum * w) FILTER (WHERE tenure >= 13)', 'sum(delivered * w) FILTER (WHERE tenure >= 13)')} AS a,
         {_div('sum(late_delay_sum * w) FILTER (WHERE tenure <= 1)', 'sum(late * w) FILTER (WHERE tenure <= 1)')}
         - {_div('sum(late_delay_sum * w) FILTER (WHERE tenure >= 13)', 'sum(late * w) FILTER (WHERE tenure >= 13)')} AS l
  FROM drawn GROUP BY replicate""")], """
SELECT round(quantile_cont(a, 0.025), 9) AS gap_all_low, round(quantile_cont(a, 0.975), 9) AS gap_all_high,
       round(stddev_samp(a), 9) AS gap_all_se, count(a) AS gap_all_replicates,
       round(quantile_cont(l, 0.025), 9) AS gap_late_low, round(quantile_cont(l, 0.975), 9) AS gap_late_high,
       round(stddev_samp(l), 9) AS gap_late_se, count(l) AS gap_late_replicates
FROM reps""")

_TREND = [
    ("series", """
  SELECT m.measure, m.month, m.y, CAST(substr(m.month, 1, 4) AS INTEGER) * 12 + CAST(substr(m.month, 6, 2) AS INTEGER) AS t
  FROM (SELECT 'late_order_share' AS measure, month, late_order_share AS y FROM monthly_out
        UNION ALL SELECT 'late_revenue_share', month, late_revenue_share FROM monthly_out) m WHERE y IS NOT NULL"""),
    ("pairs", """
  SELECT a.measure, sign(b.y - a.y) AS s, (b.y - a.y) / (b.t - a.t) AS slope
  FROM series a JOIN series b ON a.measure = b.measure AND a.t < b.t"""),
    ("kendall", "SELECT measure, CAST(sum(s) AS BIGINT) AS s, quantile_cont(slope, 0.5) AS slope FROM pairs GROUP BY measure"),
    ("ties", """
  SELECT measure, CAST(sum(c) AS BIGINT) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tied
  FROM (SELECT measure, y, count(*) AS c FROM series GROUP BY measure, y) GROUP BY measure"""),
    ("cusums", """
  SELECT a.measure, a.t, round(abs(sum(b.y - m.mean)), 9) AS c
  FROM series a JOIN series b ON b.measure = a.measure AND b.t <= a.t
  JOIN (SELECT measure, avg(y) AS mean FROM series GROUP BY measure) m ON m.measure = a.measure GROUP BY a.measure, a.t"""),
    ("breaks", "SELECT DISTINCT measure, first_value(t) OVER (PARTITION BY measure ORDER BY c DESC, t) AS at FROM cusums"),
    ("sides", """
  SELECT s.measure, min(s.month) FILTER (WHERE s.t > b.at) AS change_month,
         avg(s.y) FILTER (WHERE s.t > b.at) - avg(s.y) FILTER (WHERE s.t <= b.at) AS shift
  FROM series s JOIN breaks b ON b.measure = s.measure GROUP BY s.measure"""),
    ("scored", """
  SELECT t.measure, t.n, k.s, k.slope, d.change_month, d.shift,
         (k.s - sign(k.s)) / sqrt(CAST((t.n * (t.n - 1) * (2 * t.n + 5) - t.tied) AS DOUBLE) / 18) AS z
  FROM ties t JOIN kendall k ON k.measure = t.measure JOIN sides d ON d.measure = t.measure"""),
    ("tail", "SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS q FROM scored"),
]

ORACLE_SQL["late_revenue_trend"] = (
    "WITH monthly_out AS (\n" + ORACLE_SQL["late_revenue_monthly"] + "\n),\n"
    + ",\n".join(f"{name} AS ({sql}\n)" for name, sql in _TREND) + """
SELECT measure, n AS months, s AS kendall_s, round(z, 9) AS z,
       round((0.254829592::DOUBLE * q - 0.284496736::DOUBLE * q ** 2 + 1.421413741::DOUBLE * q ** 3
              - 1.453152027::DOUBLE * q ** 4 + 1.061405429::DOUBLE * q ** 5) * exp(-x * x), 6) AS p_value,
       round(slope, 9) AS slope, change_month, round(shift, 9) AS shift
FROM tail""")

ORACLE_SQL["seller_blame_deciles_shrunk"] = _with(BASE + DIMS + BLAME[:2] + [
    ("moments", """
  SELECT round(sum(seller_late) / CAST(sum(late) AS DOUBLE), 6) AS prior_mean, count(*) AS g, CAST(sum(late) AS DOUBLE) AS n,
         CAST(sum(late * late) AS DOUBLE) AS nn FROM shares"""),
    ("prior", """
  SELECT m.prior_mean, round(1 / least(0.999::DOUBLE, greatest(1e-4::DOUBLE, coalesce(
           (sum(s.late * (s.blame_share - m.prior_mean) ** 2) - m.prior_mean * (1 - m.prior_mean) * (m.g - 1))
           / nullif(m.prior_mean * (1 - m.prior_mean) * (m.n - m.nn / m.n - (m.g - 1)), 0), 1e-4::DOUBLE))) - 1, 4) AS prior_lines
  FROM shares s, moments m GROUP BY m.prior_mean, m.g, m.n, m.nn"""),
    ("post", """
  SELECT s.*, p.*, round((s.seller_late + p.prior_lines * p.prior_mean) / (s.late + p.prior_lines), 6) AS posterior
  FROM shares s, prior p"""),
    ("ranked", "SELECT *, CAST(ntile(10) OVER (ORDER BY posterior, seller_id) AS INTEGER) AS decile FROM post"),
    ("rows", f"""
  SELECT decile, count(*) AS members, min(posterior) AS min_posterior, max(posterior) AS max_posterior,
         CAST(sum(late) AS BIGINT) AS late_lines, CAST(sum(seller_late) AS BIGINT) AS seller_late_lines,
         round(avg(avg_weight), 6) AS avg_weight, round(avg(avg_volume), 6) AS avg_volume,
         round(avg(avg_ship_days), 6) AS avg_ship_days, max(prior_mean) AS prior_mean, max(prior_lines) AS prior_lines,
         {_div('sum(seller_late)', 'sum(late)')} AS pooled_share
  FROM ranked GROUP BY decile""")], """
SELECT *, CAST(coalesce(lag(max_posterior) OVER (ORDER BY decile) = min_posterior, FALSE) AS INTEGER) AS tied_below FROM rows""")

ORACLE_SQL["orders_by_region"] = _with(BASE + DIMS, f"""
SELECT s.state, CASE WHEN l.m_idx IS NOT NULL THEN {_month('l.m_idx')} END AS month,
       CAST(grouping(s.state, l.m_idx) AS INTEGER) AS level_id, count(DISTINCT l.order_id) AS orders
FROM lines l LEFT JOIN sellers s ON s.seller_id = l.seller_id GROUP BY ROLLUP (s.state, l.m_idx)""")

ORACLE_SQL["tenure_gap_matched"] = _with(PROFILE + DIMS + [
    ("percat", """
  SELECT l.seller_id, p.category, count(*) AS n FROM lines l LEFT JOIN products p ON p.product_id = l.product_id
  GROUP BY l.seller_id, p.category"""),
    ("maincat", """
  SELECT seller_id, category FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY n DESC, category) AS r FROM percat)
  WHERE r = 1"""),
    ("ends", """
  SELECT p.*, c.category, s.state, length(CAST(CAST(floor(p.revenue / p.active_months) AS BIGINT) AS VARCHAR)) AS digits
  FROM profile p JOIN maincat c ON c.seller_id = p.seller_id JOIN sellers s ON s.seller_id = p.seller_id
  WHERE p.tenure <= 1 OR p.tenure >= 13"""),
    ("strata", f"""
  SELECT state, category, digits, count(*) FILTER (WHERE tenure <= 1) AS n1, count(*) FILTER (WHERE tenure >= 13) AS n2,
         {_div('sum(delay_sum) FILTER (WHERE tenure <= 1)', 'sum(delivered) FILTER (WHERE tenure <= 1)')}
         - {_div('sum(delay_sum) FILTER (WHERE tenure >= 13)', 'sum(delivered) FILTER (WHERE tenure >= 13)')} AS g,
         {_div('sum(late_delay_sum) FILTER (WHERE tenure <= 1)', 'sum(late) FILTER (WHERE tenure <= 1)')}
         - {_div('sum(late_delay_sum) FILTER (WHERE tenure >= 13)', 'sum(late) FILTER (WHERE tenure >= 13)')} AS gl
  FROM ends GROUP BY state, category, digits""")], f"""
SELECT count(*) FILTER (WHERE n1 > 0 AND n2 > 0) AS strata, count(*) FILTER (WHERE n1 = 0 OR n2 = 0) AS unmatched_strata,
       CAST(coalesce(sum(n1) FILTER (WHERE n1 > 0 AND n2 > 0), 0) AS BIGINT) AS one_off,
       CAST(coalesce(sum(n2) FILTER (WHERE n1 > 0 AND n2 > 0), 0) AS BIGINT) AS long,
       round(sum(g * n2) / nullif(sum(n2) FILTER (WHERE g IS NOT NULL), 0), 9) AS gap_all,
       round(sum(gl * n2) / nullif(sum(n2) FILTER (WHERE gl IS NOT NULL), 0), 9) AS gap_late,
       {_div('coalesce(sum(n1) FILTER (WHERE n2 = 0), 0)', 'sum(n1)')} AS unmatched_one_off,
       {_div('coalesce(sum(n2) FILTER (WHERE n1 = 0), 0)', 'sum(n2)')} AS unmatched_long
FROM strata""")

# every pair of grains is compared; middle ranks from rank() and the size of the tie
ORACLE_SQL["spec_delay_rank_correlation"] = _with(BASE + DIMS + BLAME + [
    ("xy", """
  SELECT seller_id, pair, round(x, 6) AS x, round(y, 6) AS y FROM (
    SELECT seller_id, 'share_weight' AS pair, blame_share AS x, avg_weight AS y FROM shares
    UNION ALL SELECT seller_id, 'share_volume', blame_share, avg_volume FROM shares
    UNION ALL SELECT seller_id, 'weight_dispatch', avg_weight, avg_ship_days FROM shares
    UNION ALL SELECT seller_id, 'share_dispatch', blame_share, avg_ship_days FROM shares)
  WHERE x IS NOT NULL AND y IS NOT NULL"""),
    ("mid", """
  SELECT *, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry
  FROM xy"""),
    ("rho", "SELECT pair, count(*) AS n, corr(rx, ry) AS rho, min(x) < max(x) AND min(y) < max(y) AS varied FROM mid GROUP BY pair"),
    ("tau", """
  SELECT a.pair, count(*) FILTER (WHERE (a.x - b.x) * (a.y - b.y) < 0) AS less,
         count(*) FILTER (WHERE (a.x - b.x) * (a.y - b.y) > 0) AS more,
         count(*) FILTER (WHERE a.x <> b.x) AS nx, count(*) FILTER (WHERE a.y <> b.y) AS ny
  FROM xy a JOIN xy b ON a.pair = b.pair AND a.seller_id < b.seller_id GROUP BY a.pair""")], """
SELECT rho.pair, rho.n AS rows, coalesce(tau.less, 0) AS discordant, CASE WHEN rho.varied THEN round(rho.rho, 6) END AS spearman,
       round((tau.more - tau.less) / nullif(sqrt(CAST(tau.nx AS DOUBLE)) * sqrt(CAST(tau.ny AS DOUBLE)), 0), 6) AS kendall
FROM rho LEFT JOIN tau ON tau.pair = rho.pair""")

_LANE_ROUNDS = 40


def _fit() -> list[tuple[str, str]]:
    """Lanes and a fixed number of rounds written out: more than the fit needs to settle."""
    ctes = [
        ("lanes0", """
  SELECT s.state AS origin, c.state AS destination, count(*) AS lines, CAST(sum(l.delivery_delay) AS BIGINT) AS delay_sum
  FROM lines l JOIN sellers s ON s.seller_id = l.seller_id JOIN customers c ON c.customer_id = l.customer_id
  WHERE l.delivery_delay IS NOT NULL AND s.state IS NOT NULL AND c.state IS NOT NULL GROUP BY s.state, c.state"""),
        ("lanes", f"SELECT *, {_div('sum(delay_sum) OVER ()', 'sum(lines) OVER ()')} AS mean FROM lanes0"),
        ("d0", "SELECT DISTINCT destination, CAST(0 AS DOUBLE) AS d FROM lanes"),
    ]
    for i in range(1, _LANE_ROUNDS + 1):
        ctes += [
            (f"o{i}", f"""
  SELECT a.origin, sum(delay_sum - lines * (mean + d)) / sum(lines) AS o
  FROM lanes a JOIN d{i - 1} b ON b.destination = a.destination GROUP BY a.origin"""),
            (f"d{i}", f"""
  SELECT a.destination, sum(delay_sum - lines * (mean + o)) / sum(lines) AS d
  FROM lanes a JOIN o{i} b ON b.origin = a.origin GROUP BY a.destination""")]
    return ctes


def _side(name: str, value: str) -> str:
    return f"""
SELECT '{name}' AS side, a.{name} AS region, CAST(sum(lines) AS BIGINT) AS lines,
       round({_div('sum(delay_sum)', 'sum(lines)')}, 4) AS mean_delay,
       round(any_value(b.{value}) - (SELECT sum(y.{value} * x.lines) / sum(x.lines) FROM lanes x
                                     JOIN {value}{_LANE_ROUNDS} y ON y.{name} = x.{name}), 4) AS effect
FROM lanes a JOIN {value}{_LANE_ROUNDS} b ON b.{name} = a.{name} GROUP BY a.{name}"""


ORACLE_SQL["lane_effects"] = _with(BASE + DIMS + _fit(), _side("origin", "o") + "\nUNION ALL" + _side("destination", "d"))

ORACLE_SQL["lane_excess"] = _with(BASE + DIMS + _fit(), f"""
SELECT a.origin, a.destination, a.lines, round(CAST(delay_sum AS DOUBLE) / lines, 4) AS mean_delay,
       round(mean + o + d, 4) AS expected, round(CAST(delay_sum AS DOUBLE) / lines - (mean + o + d), 4) AS excess
FROM lanes a JOIN o{_LANE_ROUNDS} p ON p.origin = a.origin JOIN d{_LANE_ROUNDS} q ON q.destination = a.destination""")
