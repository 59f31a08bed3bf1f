"""DuckDB twins of the registered queries (the correctness oracle).

The derived views of FIXTURES.md are written once here as CTEs, following
the same rules as ``basketry.sources.views``.
"""

from __future__ import annotations

import re

def R(x: str, n: int) -> str:
    """Round a double the way Spark does: half-up on its decimal text."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,20)), {n}) AS DOUBLE)"


CAT = """CASE {c} WHEN 'ECONOMY' THEN 'wellness' WHEN 'PROMO' THEN 'smart home'
  WHEN 'LARGE' THEN 'commuter' WHEN 'MEDIUM' THEN 'travel' WHEN 'STANDARD' THEN 'productivity'
  WHEN 'SMALL' THEN 'sleep' END"""

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

BASE = {
    "sales": f"""
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line, o.o_custkey AS customer_id,
         l.l_partkey AS product_id, p.p_name AS product_name, {CAT.format(c='p.p_type')} AS category,
         CAST(trunc(l.l_quantity) AS INTEGER) AS quantity, p.p_retailprice AS price,
         l.l_extendedprice AS revenue, l.l_discount AS discount, o.o_orderdate AS created_at
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "views": f"""
  SELECT e.event_id, 'product_view' AS event_type, e.user_id AS customer_id, e.k AS product_id,
         p.p_name AS product_name, {CAT.format(c='p.p_type')} AS category,
         CAST(floor(e.value) AS INTEGER) AS dwell_seconds, e.ts AS event_time, e.ts AS created_at
  FROM (SELECT *, {K} AS k FROM events WHERE event_type IN ('view', 'click')) e
  LEFT JOIN part p ON e.k = p.p_partkey""",
    "stream_events": f"""
  SELECT CAST(e.event_id AS VARCHAR) AS event_id, e.event_type, CAST(e.user_id AS VARCHAR) AS customer_id,
         CAST(e.k AS VARCHAR) AS product_id, p.p_name AS product_name, {CAT.format(c='p.p_type')} AS category,
         1 AS quantity, e.value AS revenue, e.ts AS event_time, e.event_id AS seq
  FROM (SELECT *, {K} AS k FROM events) e JOIN part p ON e.k = p.p_partkey""",
    "raw_events": f"""
  SELECT CASE WHEN event_id % 97 = 0 THEN '   ' ELSE ' EVT-' || event_id || ' ' END AS event_id,
         CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN NULL ELSE ' Cust-' || user_id END AS customer_id,
         ' SKU-' || {K} || ' ' AS product_id,
         ' ' || upper(event_type) AS event_type,
         CASE WHEN event_id % 41 = 0 THEN 'bad-timestamp' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS event_time,
         CASE WHEN event_id % 31 = 0 THEN -1 WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 5 AS INTEGER) END AS quantity,
         CASE WHEN event_id % 37 = 0 THEN -10.0 WHEN event_id % 11 = 0 THEN NULL ELSE value END AS price,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(25 + user_id % 24 AS DOUBLE) END AS lat,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(-125 + (7 * user_id) % 60 AS DOUBLE) END AS lon
  FROM events""",
    "norm_events": f"""
  SELECT *, (event_id <> '' AND customer_id <> '' AND event_type IN ('cart', 'click', 'purchase', 'view')
             AND event_time IS NOT NULL AND quantity >= 0 AND price0 >= 0) AS is_valid,
         {R('price0', 2)} AS price,
         {R("CASE WHEN event_type = 'purchase' THEN quantity * price0 ELSE 0.0 END", 2)} AS revenue,
         CASE WHEN lat IS NULL OR lon IS NULL THEN 'Unknown' WHEN lon <= -105 THEN 'West'
              WHEN lon <= -87 THEN 'Midwest' WHEN lat < 37 THEN 'South' ELSE 'Northeast' END AS region
  FROM (SELECT lower(regexp_replace(coalesce(event_id, ''), '^\\s+|\\s+$', '', 'g')) AS event_id,
               lower(regexp_replace(coalesce(customer_id, ''), '^\\s+|\\s+$', '', 'g')) AS customer_id,
               lower(regexp_replace(coalesce(product_id, ''), '^\\s+|\\s+$', '', 'g')) AS product_id,
               lower(regexp_replace(coalesce(event_type, ''), '^\\s+|\\s+$', '', 'g')) AS event_type,
               try_cast(replace(trim(event_time), 'Z', '') AS TIMESTAMP) AS event_time,
               coalesce(quantity, 0) AS quantity, coalesce(price, 0.0) AS price0, lat, lon
        FROM raw_events) n""",
    "clean_events": "SELECT * EXCLUDE (is_valid, price0) FROM norm_events WHERE is_valid",
    "reviews": """
  SELECT doc_id AS review_id, doc_id % 200 AS product_id, doc_id % 150 AS customer_id,
         CAST(1 + doc_id % 5 AS INTEGER) AS rating, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents""",
    "users": """
  SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'customer' END AS role,
         c_custkey AS customer_key,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS created_at
  FROM customer""",
    "catalog": f"""
  SELECT p_partkey AS product_id, p_partkey AS ordinal, p_name || ' #' || p_partkey AS product,
         list_distinct([{CAT.format(c='p_type')}, split_part(p_name, ' ', 1)]) AS categories,
         list_distinct([split_part(p_name, ' ', 2), lower(p_brand),
                                split_part({CAT.format(c='p_type')}, ' ', 1)]) AS keywords,
         round(0.50 + 0.01 * (p_partkey % 25), 2) AS base_score
  FROM part""",
    "products": f"""
  SELECT p_partkey AS id, p_name AS name, {CAT.format(c='p_type')} AS category, p_retailprice AS price,
         CASE WHEN p_partkey % 9 = 0 THEN false WHEN p_partkey % 13 = 0 THEN NULL ELSE true END AS active
  FROM part""",
    "features": f"""
  SELECT c.c_custkey AS customer_id,
         CAST(coalesce(floor(epoch(TIMESTAMP '2001-08-02 00:00:00' - s.last_at) / 86400), 90) AS BIGINT) AS recency_days,
         CAST(CASE WHEN c.c_custkey % 2 = 0 THEN coalesce(s.orders, 0) ELSE coalesce(s.orders, 0) // 3 END AS BIGINT) AS frequency,
         {R('CAST(coalesce(s.revenue, 0) AS DOUBLE) / 100', 2)} AS monetary_value,
         {R('10 * coalesce(s.avg_discount, 0.0)', 4)} AS discount_sensitivity,
         least(coalesce(v.views, 0) / 12, 1.0) AS engagement_depth
  FROM customer c
  LEFT JOIN (SELECT customer_id, max(created_at) AS last_at, count(DISTINCT order_id) AS orders,
                    sum(CAST(revenue AS DECIMAL(18,2))) AS revenue,
                    CAST(sum(CAST(discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_discount
             FROM sales GROUP BY customer_id) s ON c.c_custkey = s.customer_id
  LEFT JOIN (SELECT customer_id, count(*) AS views FROM views GROUP BY customer_id) v ON c.c_custkey = v.customer_id""",
}

# dependencies among the base views, in definition order
ORDER = ["sales", "views", "stream_events", "raw_events", "norm_events", "clean_events", "reviews",
         "users", "catalog", "products", "features"]
DEPENDS = {"norm_events": ["raw_events"], "clean_events": ["norm_events"], "features": ["sales", "views"]}


def with_views(needed: list[str], body: str) -> str:
    closure: set[str] = set()

    def add(name):
        if name in closure:
            return
        for dep in DEPENDS.get(name, []):
            add(dep)
        closure.add(name)

    for n in needed:
        add(n)
    ctes = [f"{n} AS ({BASE[n]})" for n in ORDER if n in closure]
    return "WITH " + ",\n".join(ctes) + "\n" + body


ISO = ("CASE WHEN {t} IS NULL THEN NULL WHEN epoch_us({t}) % 1000000 = 0 "
       "THEN strftime({t}, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%fZ') END")

ORACLE: dict[str, str] = {}

ORACLE["clean_events"] = with_views(["clean_events"], f"""
SELECT event_id, customer_id, product_id, event_type, {ISO.format(t='event_time')} AS event_time,
       quantity, price, revenue, lat, lon, region FROM clean_events""")

ORACLE["event_type_counts"] = with_views(["clean_events"], """
SELECT event_type, count(*) AS event_count FROM clean_events GROUP BY event_type""")

ORACLE["region_revenue"] = with_views(["clean_events"], """
SELECT region, count(*) AS event_count,
       CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM clean_events GROUP BY region""")

ORACLE["clean_totals"] = with_views(["norm_events"], """
SELECT count(*) AS input_count, count(*) FILTER (WHERE is_valid) AS clean_count,
       count(*) - count(*) FILTER (WHERE is_valid) AS dropped_count FROM norm_events""")

# customer behaviour: encounter order = orders newest-first, then views newest-first
BEHAVIOR_CTES = """
o_rows AS (
  SELECT customer_id, category, product_id, revenue, created_at,
         row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC, line,
                            product_id, quantity, revenue) AS pos
  FROM sales),
v_rows AS (
  SELECT customer_id, category,
         1000000000 + row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, event_id DESC) AS pos
  FROM views),
cat_counts AS (
  SELECT customer_id, category, count(*) AS n, min(pos) AS seen FROM (
    SELECT customer_id, category, pos FROM o_rows UNION ALL SELECT customer_id, category, pos FROM v_rows)
  WHERE category IS NOT NULL AND category <> '' GROUP BY customer_id, category),
cat_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, seen) AS rk FROM cat_counts),
cat_top AS (
  SELECT customer_id, string_agg(category || ':' || n, ',' ORDER BY rk) AS preferred_categories,
         max(CASE WHEN rk = 1 THEN category END) AS top_category,
         list(category ORDER BY rk) AS recent_categories
  FROM cat_ranked WHERE rk <= 3 GROUP BY customer_id),
prod_top AS (
  SELECT customer_id, string_agg(CAST(product_id AS VARCHAR) || ':' || n, ',' ORDER BY rk) AS top_products
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, seen) AS rk
        FROM (SELECT customer_id, product_id, count(*) AS n, min(pos) AS seen FROM o_rows
              WHERE product_id IS NOT NULL GROUP BY customer_id, product_id))
  WHERE rk <= 3 GROUP BY customer_id),
o_agg AS (
  SELECT customer_id, count(*) AS orders, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS rev,
         max(created_at) AS last_at FROM sales GROUP BY customer_id),
v_agg AS (SELECT customer_id, count(*) AS browse_events FROM views GROUP BY customer_id),
behavior AS (
  SELECT coalesce(o.customer_id, v.customer_id) AS customer_id,
         CAST(coalesce(o.orders, 0) AS BIGINT) AS orders,
         CAST(coalesce(v.browse_events, 0) AS BIGINT) AS browse_events,
         CAST(coalesce(o.orders, 0) AS BIGINT) AS purchase_frequency,
         coalesce(o.rev, 0.0) AS monetary_value,
         CAST(CASE WHEN o.last_at IS NULL THEN 90
              ELSE greatest(0, floor(epoch(TIMESTAMP '2001-08-02 00:00:00' - o.last_at) / 86400)) END AS BIGINT) AS recency_days,
         coalesce(c.preferred_categories, '') AS preferred_categories,
         coalesce(p.top_products, '') AS top_products,
         c.top_category
  FROM o_agg o FULL OUTER JOIN v_agg v ON o.customer_id = v.customer_id
  LEFT JOIN cat_top c ON c.customer_id = coalesce(o.customer_id, v.customer_id)
  LEFT JOIN prod_top p ON p.customer_id = coalesce(o.customer_id, v.customer_id)),
behavior_seg AS (
  SELECT *, CASE WHEN orders >= 5 AND recency_days <= 30 THEN 'loyal_active_buyer'
                 WHEN top_category IS NOT NULL THEN top_category || '_affinity'
                 WHEN recency_days >= 90 THEN 'winback_risk' ELSE 'emerging_customer' END AS behavior_segment
  FROM behavior)"""


def with_behavior(body: str, extra: list[str] | None = None) -> str:
    return with_views(["sales", "views"] + (extra or []), "").rstrip() + "," + BEHAVIOR_CTES + "\n" + body


ORACLE["customer_behavior"] = with_behavior("""
SELECT customer_id, orders, browse_events, purchase_frequency, monetary_value, recency_days,
       preferred_categories, top_products, behavior_segment FROM behavior_seg""")

ORACLE["behavior_features"] = with_behavior("""
SELECT customer_id, recency_days, purchase_frequency AS frequency, monetary_value,
       least((browse_events + orders) / 12, 1.0) AS engagement_depth FROM behavior_seg""")

ORACLE["order_features"] = with_views(["sales"], """
, per_cat AS (
  SELECT customer_id, category, count(*) AS n,
         min(epoch_us(created_at) * 1e0) AS first_t
  FROM sales WHERE category IS NOT NULL AND category <> '' GROUP BY customer_id, category),
first_rows AS (
  SELECT customer_id, category, n,
         row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, first_key) AS rk
  FROM (SELECT s.customer_id, s.category, c.n,
               min([epoch_us(s.created_at), s.order_id, s.line, s.product_id, s.quantity, s.revenue]) AS first_key
        FROM sales s JOIN per_cat c ON s.customer_id = c.customer_id AND s.category = c.category
        GROUP BY s.customer_id, s.category, c.n)),
tot AS (SELECT customer_id, count(*) AS frequency, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS rev,
               max(created_at) AS last_at FROM sales GROUP BY customer_id)
SELECT t.customer_id,
       CAST(greatest(0, floor(epoch(TIMESTAMP '2001-08-02 00:00:00' - t.last_at) / 86400)) AS BIGINT) AS recency_days,
       CAST(t.frequency AS BIGINT) AS frequency, t.rev AS monetary_value,
       coalesce(f.category, 'unknown') AS preferred_category,
       least(t.frequency / 12, 1.0) AS engagement_depth
FROM tot t LEFT JOIN (SELECT * FROM first_rows WHERE rk = 1) f ON t.customer_id = f.customer_id""")


def churn_sql(src: str, key: str = "customer_id") -> str:
    """M1 over a relation with recency_days, frequency, monetary_value,
    discount_sensitivity, engagement_depth (nullable)."""
    p = R("greatest(0.02, least(cr + cf + cm + cd + ce, 0.96))", 3)
    return f"""
SELECT {key}, prob AS probability, {R('prob * 100', 1)} AS percent,
       CASE WHEN prob >= 0.65 THEN 'high' WHEN prob >= 0.35 THEN 'medium' ELSE 'low' END AS risk_band,
       CASE WHEN prob >= 0.65 THEN 'Trigger win-back offer and human review.'
            WHEN prob >= 0.35 THEN 'Send personalized retention offer.'
            ELSE 'Maintain normal personalized recommendations.' END AS recommended_action,
       {R('cr', 3)} AS c_recency_days, {R('cf', 3)} AS c_frequency, {R('cm', 3)} AS c_monetary_value,
       {R('cd', 3)} AS c_discount_sensitivity, {R('ce', 3)} AS c_engagement_depth
FROM (SELECT *, {p} AS prob FROM (SELECT *,
        least(coalesce(CAST(recency_days AS DOUBLE), 30.0) / 120, 1.0) * 0.42 AS cr,
        greatest(0.0, 1 - least(coalesce(CAST(frequency AS DOUBLE), 1.0) / 12, 1.0)) * 0.24 AS cf,
        greatest(0.0, 1 - least(coalesce(CAST(monetary_value AS DOUBLE), 0.0) / 20000, 1.0)) * 0.12 AS cm,
        least(coalesce(CAST(discount_sensitivity AS DOUBLE), 0.35), 1.0) * 0.14 AS cd,
        greatest(0.0, 1 - least(coalesce(CAST(engagement_depth AS DOUBLE), 0.5), 1.0)) * 0.08 AS ce
      FROM {src}))"""


RFM = """CASE WHEN coalesce(monetary_value, 0.0) >= 10000 AND coalesce(frequency, 1) >= 8 AND coalesce(recency_days, 30) <= 30 THEN 'high_ltv_active'
     WHEN coalesce(recency_days, 30) > 90 THEN 'winback_risk'
     WHEN coalesce(frequency, 1) >= 5 THEN 'loyal_growth' ELSE 'emerging' END"""

ORACLE["churn_scores"] = with_views(["features"], churn_sql("features"))

ORACLE["rfm_segments"] = with_views(["features"], f"SELECT customer_id, {RFM} AS segment FROM features")

ORACLE["customer_churn"] = with_behavior(f"""
, churn_in AS (
  SELECT b.customer_id, CAST(b.recency_days AS DOUBLE) AS recency_days,
         coalesce(nullif(CAST(b.purchase_frequency AS DOUBLE), 0.0), CAST(f.frequency AS DOUBLE), 1.0) AS frequency,
         coalesce(nullif(b.monetary_value, 0.0), f.monetary_value, 0.0) AS monetary_value,
         f.discount_sensitivity AS discount_sensitivity,
         least((b.browse_events + b.orders) / 12, 1.0) AS engagement_depth
  FROM behavior_seg b LEFT JOIN features f ON b.customer_id = f.customer_id)
SELECT i.*, s.* EXCLUDE (customer_id) FROM churn_in i JOIN ({churn_sql('churn_in')}) s ON i.customer_id = s.customer_id""",
    extra=["features"])

FEATURE_LOOKUP = """
, stored AS (
  SELECT customer_id, recency_days, purchase_frequency AS frequency, monetary_value,
         least((browse_events + orders) / 12, 1.0) AS engagement_depth
  FROM behavior_seg),
lookup AS (
  SELECT customer_id, recency_days, frequency, monetary_value, engagement_depth,
         NULL::DOUBLE AS discount_sensitivity, 'mongodb' AS source FROM stored
  UNION ALL
  SELECT customer_id, recency_days, frequency, monetary_value, engagement_depth, discount_sensitivity, 'redis'
  FROM features WHERE customer_id NOT IN (SELECT customer_id FROM stored))"""

ORACLE["feature_lookup"] = with_behavior(FEATURE_LOOKUP + "\nSELECT * FROM lookup", extra=["features"])
ORACLE["feature_store_segments"] = with_behavior(
    FEATURE_LOOKUP + f"\nSELECT customer_id, {RFM} AS segment, source FROM lookup", extra=["features"])


# ---- baskets ------------------------------------------------------------------
BASKETS = """
, baskets AS (SELECT DISTINCT customer_id AS basket, product_id AS product FROM sales
              WHERE customer_id IS NOT NULL AND product_id IS NOT NULL),
pairs AS (SELECT a.basket, a.product AS "left", b.product AS "right"
          FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.product < b.product)"""

ORACLE["basket_product_counts"] = with_views(["sales"], BASKETS + """
SELECT product, count(*) AS baskets FROM baskets GROUP BY product""")

ORACLE["frequent_pairs"] = with_views(["sales"], BASKETS + """
SELECT "left", "right", count(*) AS pair_count FROM pairs GROUP BY 1, 2 HAVING count(*) >= 8""")

ORACLE["basket_pairs"] = with_views(["sales", "products"], BASKETS + f""",
seen AS (SELECT customer_id AS basket,
                min([-epoch_us(created_at), -order_id, line, product_id, quantity, revenue]) AS basket_seen
         FROM sales GROUP BY customer_id),
total AS (SELECT count(DISTINCT basket) AS total FROM baskets),
pc AS (SELECT product, count(*) AS n FROM baskets GROUP BY product),
top AS (SELECT p."left", p."right", count(*) AS pair_count, min(s.basket_seen) AS first_seen
        FROM pairs p JOIN seen s ON p.basket = s.basket GROUP BY 1, 2
        ORDER BY pair_count DESC, first_seen, "left", "right" LIMIT 10),
ranked AS (SELECT *, row_number() OVER (ORDER BY pair_count DESC, first_seen, "left", "right") AS rank FROM top)
SELECT r.rank, r."left", r."right", CAST(r.pair_count AS BIGINT) AS basket_count,
       {R('r.pair_count / t.total', 3)} AS support,
       {R('r.pair_count / greatest(l.n, 1)', 3)} AS confidence,
       {R("CASE WHEN (l.n / t.total) * (rr.n / t.total) <> 0 THEN (r.pair_count / t.total) / ((l.n / t.total) * (rr.n / t.total)) ELSE 0.0 END", 3)} AS lift,
       CAST(t.total AS BIGINT) AS total_baskets,
       coalesce(pl.name, CAST(r."left" AS VARCHAR)) AS left_name,
       coalesce(pr.name, CAST(r."right" AS VARCHAR)) AS right_name
FROM ranked r CROSS JOIN total t
LEFT JOIN pc l ON l.product = r."left" LEFT JOIN pc rr ON rr.product = r."right"
LEFT JOIN products pl ON pl.id = r."left" LEFT JOIN products pr ON pr.id = r."right\"""")

# ---- forecasting --------------------------------------------------------------
ORACLE["demand_forecast"] = with_views(["sales", "products"], f"""
, daily AS (SELECT product_id, CAST(created_at AS DATE) AS day, CAST(sum(coalesce(quantity, 1)) AS BIGINT) AS quantity
            FROM sales WHERE product_id IS NOT NULL GROUP BY 1, 2),
d AS (SELECT *, greatest(quantity, 0) AS q, row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS rn FROM daily),
st AS (SELECT product_id, count(*) AS history_points,
              count(*) FILTER (WHERE rn <= 7) AS n, avg(q) FILTER (WHERE rn <= 7) AS avg_q,
              arg_max(q, day) FILTER (WHERE rn <= 7) AS newest, arg_min(q, day) FILTER (WHERE rn <= 7) AS oldest
       FROM d GROUP BY product_id),
tr AS (SELECT *, CASE WHEN n > 1 THEN (newest - oldest) / (n - 1) ELSE 0.0 END AS trend FROM st)
SELECT tr.product_id, tr.history_points, {R('avg_q', 2)} AS daily_average_units, {R('trend', 2)} AS trend_units,
       CAST(r.period AS INTEGER) AS period, {R('greatest(0.0, avg_q + trend * r.period)', 2)} AS predicted_units,
       coalesce(p.name, CAST(tr.product_id AS VARCHAR)) AS product
FROM tr CROSS JOIN range(1, 8) r(period) LEFT JOIN products p ON p.id = tr.product_id""")

SERIES = """
, daily AS (SELECT customer_id AS series_id, CAST(created_at AS DATE) AS day,
                   CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS value FROM sales GROUP BY 1, 2),
tail AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS rn FROM daily),
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM tail),
series AS (SELECT series_id, day, n - rn + 1 AS t, value FROM sized WHERE n >= 3)"""

ORACLE["revenue_forecast"] = with_views(["sales"], SERIES + f""",
s AS (SELECT series_id, count(*) AS points,
             CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean,
             arg_max(value, t) AS last, arg_min(value, t) AS first FROM series GROUP BY series_id),
s2 AS (SELECT *, CASE WHEN points > 1 THEN (last - first) / (points - 1) ELSE 0.0 END AS trend FROM s)
SELECT series_id, points, {R('greatest(0.0, last + trend)', 2)} AS prediction,
       {R('greatest(0.55, least(1 - abs(trend) / greatest(mean, 1.0), 0.93))', 3)} AS confidence FROM s2""")

ORACLE["weighted_revenue_forecast"] = with_views(["sales"], SERIES + f""",
s AS (SELECT series_id, count(*) AS points,
             CAST(sum(CAST(value AS DECIMAL(18,2)) * t) AS DOUBLE) / sum(t) AS wavg,
             max(CASE WHEN t = points_n THEN value END) AS last, max(CASE WHEN t = points_n - 1 THEN value END) AS prev
      FROM (SELECT *, max(t) OVER (PARTITION BY series_id) AS points_n FROM series) GROUP BY series_id)
SELECT series_id, points, {R('greatest(0.0, wavg + (last - prev) * 0.35)', 2)} AS prediction,
       {R('greatest(0.58, least(1 - abs(last - prev) / greatest(wavg, 1.0), 0.91))', 3)} AS confidence FROM s""")

def seasonal_sql(frequency: str, periods: int) -> str:
    ends = {"D": "CAST(created_at AS DATE)", "W": "CAST(CAST(created_at AS DATE) + CAST((7 - dayofweek(created_at)) % 7 AS INTEGER) AS DATE)",
            "M": "last_day(CAST(created_at AS DATE))"}[frequency]
    step = {"D": "date_diff('day', DATE '1970-01-04', {d})", "W": "date_diff('day', DATE '1970-01-04', {d}) // 7", "M": "year({d}) * 12 + month({d})"}[frequency]
    later = {"D": "CAST(d1 + CAST(h AS INTEGER) AS DATE)", "W": "CAST(d1 + CAST(7 * h AS INTEGER) AS DATE)",
             "M": "last_day(CAST(date_trunc('month', d1) + to_months(CAST(h AS INTEGER)) AS DATE))"}[frequency]
    season = "dayofweek({d})" if frequency == "D" else "1"
    return with_views(["sales"], f"""
, hist AS (SELECT product_id AS series_id, {ends} AS ds, sum(CAST(revenue AS DECIMAL(18,2))) AS value FROM sales GROUP BY 1, 2),
pts AS (SELECT series_id, ds, {season.format(d='ds')} AS season, CAST({step.format(d='ds')} AS HUGEINT) AS x, CAST(value * 100 AS HUGEINT) AS y FROM hist),
own AS (SELECT *, CAST(n * xx - x * x AS DOUBLE) / n AS sxx, CAST(n * xy - x * y AS DOUBLE) / n AS sxy, CAST(n * yy - y * y AS DOUBLE) / n AS syy
        FROM (SELECT series_id, season, max(ds) AS d1, CAST(count(*) AS HUGEINT) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy
              FROM pts GROUP BY 1, 2)),
one AS (SELECT series_id, max(d1) AS d1, count(*) AS seasons, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy,
               sum(sxx) AS s1, sum(sxy) AS s2, sum(syy) AS s3 FROM own GROUP BY 1 HAVING sum(n) >= 3),
fit AS (SELECT *, s1 > 0 AS split, CASE WHEN s1 > 0 THEN s1 ELSE CAST(n * xx - x * x AS DOUBLE) / n END AS sxx,
               CASE WHEN s1 > 0 THEN s2 ELSE CAST(n * xy - x * y AS DOUBLE) / n END AS sxy,
               CASE WHEN s1 > 0 THEN s3 ELSE CAST(n * yy - y * y AS DOUBLE) / n END AS syy FROM one),
sloped AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0.0 END AS slope, n - (CASE WHEN split THEN seasons ELSE 1 END) - 1 AS rest FROM fit),
done AS (SELECT *, CASE WHEN rest > 0 THEN sqrt(greatest(0.0, syy - slope * sxy) / rest) ELSE 0.0 END AS sigma,
                (CAST(y AS DOUBLE) - slope * CAST(x AS DOUBLE)) / n AS mean_level FROM sloped),
steps AS (SELECT d.*, {later} AS ds FROM done d CROSS JOIN range(1, {periods + 1}) r(h)),
yh AS (SELECT s.*, ((CASE WHEN s.split THEN coalesce(CAST(o.y AS DOUBLE) / o.n - s.slope * (CAST(o.x AS DOUBLE) / o.n), s.mean_level) ELSE s.mean_level END)
                    + s.slope * ({step.format(d='s.ds')})) / 100 AS yhat
       FROM steps s LEFT JOIN own o ON o.series_id = s.series_id AND o.season = {season.format(d='s.ds')})
SELECT series_id, CAST(n AS BIGINT) AS history_points, CAST(ds AS VARCHAR) AS ds, {R('yhat', 2)} AS yhat,
       {R('yhat - 1.2816 * sigma / 100', 2)} AS yhat_lower, {R('yhat + 1.2816 * sigma / 100', 2)} AS yhat_upper FROM yh""")


ORACLE["seasonal_forecast"] = seasonal_sql("D", 7)
ORACLE["seasonal_forecast_weekly"] = seasonal_sql("W", 4)
ORACLE["seasonal_forecast_monthly"] = seasonal_sql("M", 3)


# ---- recommendations ------------------------------------------------------------
SEGTEXT = """CASE {c} WHEN 'HOUSEHOLD' THEN 'Premium home accounts' WHEN 'MACHINERY' THEN 'Productivity teams'
  WHEN 'BUILDING' THEN 'Urban commuter cohort' WHEN 'AUTOMOBILE' THEN 'Dormant winback wellness'
  WHEN 'FURNITURE' THEN 'Active shopper' END"""

SEGFIT = """(CASE WHEN ns LIKE '%wellness%' AND list_has_any(categories, ['wellness', 'fitness', 'sleep']) THEN 1.0
      WHEN ns LIKE '%commuter%' AND list_has_any(categories, ['commuter', 'travel']) THEN 1.0
      WHEN ns LIKE '%home%' AND list_contains(categories, 'smart home') THEN 1.0
      WHEN ns LIKE '%productivity%' AND list_contains(categories, 'productivity') THEN 1.0
      WHEN ns LIKE '%active shopper%' THEN 0.5 ELSE 0.0 END)"""

def rec_sql(cust: str, prefix: str = "") -> str:
    return f"""
{prefix}sc1 AS (
  SELECT cu.customer_id, cu.segment, cu.recent_categories, ca.ordinal, ca.product_id, ca.product, ca.categories,
         ca.keywords, ca.base_score, replace(lower(cu.segment), '_', ' ') AS ns,
         list_distinct(list_filter(list_transform(coalesce(cu.recent_categories, []), lambda c: replace(lower(c), '_', ' ')),
                                   lambda c: c IS NOT NULL AND c <> '')) AS rc
  FROM {cust} cu CROSS JOIN catalog ca),
sc2 AS (SELECT *, list_intersect(rc, categories) AS matched,
               list_distinct(list_filter(string_split_regex(ns, '\\s+'), lambda w: w <> '')) AS tokens FROM sc1),
sc3 AS (SELECT *, base_score * 0.22 AS b, len(matched) / greatest(len(categories), 1) * 0.34 AS cc,
               {SEGFIT} * 0.24 AS sc,
               len(list_intersect(tokens, keywords)) / greatest(len(keywords), 1) * 0.12 AS kc,
               CASE WHEN ns LIKE '%winback%' AND list_contains(categories, 'sleep') THEN 0.08 ELSE 0.0 END AS wc
        FROM sc2),
sc4 AS (SELECT *, {R('least(b + cc + sc + kc + wc, 0.99)', 3)} AS score,
               list_min(CASE WHEN len(matched) > 0 THEN matched ELSE categories END) AS category FROM sc3),
recs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, ordinal) AS rank FROM sc4)
  WHERE rank <= 3)"""


RECS = rec_sql("cust", prefix=f"""
, cust AS (
  SELECT c.c_custkey AS customer_id, {SEGTEXT.format(c='c.c_mktsegment')} AS segment, t.recent_categories
  FROM customer c LEFT JOIN cat_top t ON t.customer_id = c.c_custkey),
""")

ORACLE["recommendations"] = with_behavior(RECS + f"""
SELECT customer_id, rank, product_id, product, category, score, {R('b', 3)} AS base_product_fit,
       {R('cc', 3)} AS recent_category_match, {R('sc', 3)} AS segment_fit, {R('kc', 3)} AS keyword_match,
       {R('wc', 3)} AS winback_sleep_boost FROM recs""", extra=["catalog"])

RECS_ASSUMED = rec_sql("cust", prefix=f"""
, cust AS (
  SELECT c.c_custkey AS customer_id, {SEGTEXT.format(c='c.c_mktsegment')} AS segment,
         CASE WHEN coalesce(len(t.recent_categories), 0) = 0 THEN ['wellness', 'smart home'] ELSE t.recent_categories END AS recent_categories
  FROM customer c LEFT JOIN cat_top t ON t.customer_id = c.c_custkey),
""")

ATTRIB = RECS_ASSUMED + f""",
feat AS (SELECT f.*, ch.probability AS churn_risk FROM features f JOIN ({churn_sql('features')}) ch
         ON f.customer_id = ch.customer_id),
top1 AS (SELECT r.*, {R('r.cc', 3)} AS rcm, {R('r.sc', 3)} AS sfit, {R('r.kc', 3)} AS kwm, {R('r.b', 3)} AS bpf,
                greatest(0.0, least(r.score, 1.0)) AS s01,
                lower(replace(coalesce(r.category, ''), '_', ' ')) AS pcat,
                greatest(0.0, least(coalesce(CAST(f.engagement_depth AS DOUBLE), 0.0), 1.0)) AS bundle,
                coalesce(CAST(f.frequency AS DOUBLE), 0.0) AS freq_raw,
                greatest(0.0, least(coalesce(CAST(f.discount_sensitivity AS DOUBLE), 0.0), 1.0)) AS disc,
                greatest(0.0, least(CASE WHEN coalesce(f.churn_risk, 0.0) > 1 THEN f.churn_risk / 100
                                         ELSE coalesce(f.churn_risk, 0.0) END, 1.0)) AS churn
         FROM recs r LEFT JOIN feat f ON r.customer_id = f.customer_id WHERE r.rank = 1),
items AS (
  SELECT customer_id, product, 0 AS ord, 'Recommendation score' AS name, {R('s01 * 0.24', 3)} AS impact,
         CAST({R('s01', 3)} AS VARCHAR) AS value FROM top1
  UNION ALL SELECT customer_id, product, 1, 'Recent category match', rcm,
         CASE WHEN pcat <> '' THEN pcat ELSE 'unknown' END FROM top1
  UNION ALL SELECT customer_id, product, 2, 'Bundle affinity', {R('bundle * 0.16', 3)}, CAST({R('bundle', 3)} AS VARCHAR) FROM top1
  UNION ALL SELECT customer_id, product, 3, 'Purchase frequency', {R('greatest(0.0, least(freq_raw / 10, 1.0)) * 0.12', 3)},
         CAST(freq_raw AS VARCHAR) FROM top1
  UNION ALL SELECT customer_id, product, 4, 'Segment fit', sfit, segment FROM top1
  UNION ALL SELECT customer_id, product, 5, 'Product keyword match', kwm, CAST(kwm AS VARCHAR) FROM top1
  UNION ALL SELECT customer_id, product, 6, 'Base product fit', bpf, CAST(bpf AS VARCHAR) FROM top1
  UNION ALL SELECT customer_id, product, 7, 'Discount sensitivity', {R('disc * -0.12', 3)}, CAST({R('disc', 3)} AS VARCHAR) FROM top1
  UNION ALL SELECT customer_id, product, 8, 'Churn risk', {R('churn * -0.14', 3)}, CAST({R('churn', 3)} AS VARCHAR) FROM top1),
attrib AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(impact) DESC, ord) AS position FROM items)"""

ORACLE["recommendation_attributions"] = with_behavior(ATTRIB + """
SELECT customer_id, product, position, name, impact, value FROM attrib""", extra=["catalog", "features"])

PLAIN_RECS = rec_sql("plain_cust", prefix=f""",
plain_cust AS (
  SELECT c.c_custkey AS customer_id, {SEGTEXT.format(c='c.c_mktsegment')} AS segment, t.recent_categories
  FROM customer c LEFT JOIN cat_top t ON t.customer_id = c.c_custkey),
""")
for _name in ("sc1", "sc2", "sc3", "sc4", "recs"):
    PLAIN_RECS = re.sub(rf"\b{_name}\b", f"plain_{_name}", PLAIN_RECS)

ORACLE["recommendation_insight"] = with_behavior(ATTRIB + PLAIN_RECS + f"""
SELECT r.customer_id, r.rank, r.product_id, r.score,
       a.product || ' is recommended primarily because ' || lower(a.name) || ' contributed '
         || printf('%+.2f', {R('a.impact', 2)}) || '. Positive values increase recommendation confidence; negative values reduce it.' AS explanation,
       a.name AS strongest_feature, a.impact AS strongest_impact
FROM plain_recs r LEFT JOIN (SELECT * FROM attrib WHERE position = 1) a ON r.customer_id = a.customer_id""",
    extra=["catalog", "features"])


# ---- reviews ------------------------------------------------------------------
POS = ["great", "love", "excellent", "fast", "easy", "useful", "quality", "perfect", "recommend", "happy",
       "the", "and", "is"]
NEG = ["bad", "slow", "broken", "poor", "return", "expensive", "late", "hard", "issue", "problem",
       "of", "to", "a"]


def _sql_list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


SCORED = f"""
, toks AS (SELECT *, list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''),
                                    lambda w: lower(trim(w, '.,!?;:()[]{{}}"''')) ) AS w FROM reviews),
hits AS (SELECT *, list_filter(w, lambda x: list_contains({_sql_list(POS)}, x)) AS pos,
                   list_filter(w, lambda x: list_contains({_sql_list(NEG)}, x)) AS neg FROM toks),
scored AS (SELECT *, {R('greatest(-1.0, least(1.0, CAST(len(pos) - len(neg) AS DOUBLE) / greatest(sqrt(len(w)), 1.0)))', 3)} AS score
           FROM hits),
labeled AS (SELECT *, CASE WHEN score > 0.12 THEN 'positive' WHEN score < -0.12 THEN 'negative' ELSE 'neutral' END AS label
            FROM scored)"""

ORACLE["review_sentiment"] = with_views(["reviews"], SCORED + """
SELECT review_id, product_id, score, label, array_to_string(pos, ' ') AS positive_terms,
       array_to_string(neg, ' ') AS negative_terms FROM labeled""")

ORACLE["review_mix"] = with_views(["reviews"], SCORED + f""",
grain AS (SELECT 'each' AS level, product_id, label, count(*) AS review_count FROM labeled GROUP BY 2, 3
          UNION ALL SELECT 'overall', NULL, label, count(*) FROM labeled GROUP BY label)
SELECT level, product_id, label, CAST(review_count AS BIGINT) AS review_count,
       {R('review_count / greatest(sum(review_count) OVER (PARTITION BY level, product_id), 1)', 3)} AS share FROM grain""")

ORACLE["recent_reviews"] = with_views(["reviews", "products"], SCORED + f"""
SELECT l.review_id, l.product_id, coalesce(p.name, CAST(l.product_id AS VARCHAR)) AS product, l.rating, l.score, l.label,
       {ISO.format(t='l.created_at')} AS created_at
FROM (SELECT * FROM labeled ORDER BY created_at DESC, review_id DESC LIMIT 20) l
LEFT JOIN products p ON p.id = l.product_id""")


# ---- accounts -----------------------------------------------------------------
EMAIL_CID = ("'cust-' || CASE WHEN regexp_replace(regexp_replace(lower(split_part(email, '@', 1)), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g') <> '' "
             "THEN regexp_replace(regexp_replace(lower(split_part(email, '@', 1)), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g') "
             "ELSE substr(sha256(email), 1, 8) END")

ORACLE["customer_accounts"] = with_views(["users"], f"""
SELECT email, role, customer_key, {ISO.format(t='created_at')} AS created_at FROM users WHERE role = 'customer'""")

ACCOUNT_RECS = rec_sql("ocust", prefix="""
, ocust AS (
  SELECT DISTINCT category AS customer_id,
         CASE WHEN category = 'wellness' THEN 'High-LTV wellness buyer' ELSE 'Active shopper' END AS segment,
         [category] AS recent_categories
  FROM sales),
""")

ORACLE["account_profiles"] = with_views(["users", "sales", "catalog"], ACCOUNT_RECS + f""",
top AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC, line,
                                         product_id, quantity, revenue) AS rn FROM sales),
t12 AS (SELECT * FROM top WHERE rn <= 12),
firstcat AS (SELECT customer_id, category, min(rn) AS r FROM t12 WHERE category IS NOT NULL AND category <> ''
             GROUP BY 1, 2),
cats AS (SELECT customer_id, list(category ORDER BY r) AS cats FROM firstcat GROUP BY 1),
hist AS (SELECT customer_id, string_agg(CAST({R('coalesce(revenue, 0.0)', 2)} AS VARCHAR), ',' ORDER BY rn DESC) AS h
         FROM t12 WHERE rn <= 6 AND coalesce(revenue, 0.0) > 0 GROUP BY 1),
cnt AS (SELECT customer_id, count(*) AS order_count FROM t12 GROUP BY 1),
prof AS (SELECT c.customer_id, c.order_count, k.cats, h.h,
                CASE WHEN c.order_count >= 5 THEN 'Loyal repeat buyer'
                     WHEN list_contains(k.cats, 'wellness') THEN 'Wellness shopper'
                     WHEN list_contains(k.cats, 'commuter') THEN 'Commuter shopper'
                     WHEN list_contains(k.cats, 'smart home') THEN 'Smart home shopper' ELSE 'Active shopper' END AS segment
         FROM cnt c LEFT JOIN cats k ON c.customer_id = k.customer_id LEFT JOIN hist h ON c.customer_id = h.customer_id)
SELECT CAST(u.customer_key AS VARCHAR) AS id,
       array_to_string(list_transform(string_split(replace(replace(replace(split_part(u.email, '@', 1), '.', ' '), '-', ' '), '_', ' '), ' '),
                                      lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label,
       u.email, {EMAIL_CID.replace('email', 'u.email')} AS email_customer_id,
       coalesce(p.segment, 'Registered customer') AS segment,
       coalesce(array_to_string(p.cats[1:4], ','), '') AS recent_categories,
       coalesce(p.h, '') AS revenue_history,
       CAST(coalesce(p.order_count, 0) AS BIGINT) AS recent_order_count,
       coalesce((SELECT string_agg(CAST(r.product_id AS VARCHAR), ',' ORDER BY r.rank) FROM recs r JOIN top t
                 ON t.rn = 1 AND r.customer_id IS NOT DISTINCT FROM t.category AND r.product_id IS DISTINCT FROM t.product_id
                 WHERE t.customer_id = u.customer_key), '') AS latest_recommendations
FROM users u LEFT JOIN prof p ON p.customer_id = u.customer_key WHERE u.role = 'customer'""")


# ---- graph --------------------------------------------------------------------
ORDER_CHURN = R("""greatest(0.02, least(0.0 + 0.0 + greatest(0.0, 1 - least(1.0 / 12, 1.0)) * 0.24
   + greatest(0.0, 1 - least(CAST(revenue AS DOUBLE) / 20000, 1.0)) * 0.12 + least(0.3, 1.0) * 0.14
   + greatest(0.0, 1 - least(0.35, 1.0)) * 0.08, 0.96))""", 3)

ORACLE["purchase_edges"] = with_views(["sales"], f"""
SELECT customer_id, target, relationship, order_id, target_name, category, quantity, revenue, event_time, churn_percent
FROM (SELECT customer_id, product_id AS target, 'PURCHASED' AS relationship, order_id, product_name AS target_name,
             category, quantity, revenue, {ISO.format(t='created_at')} AS event_time,
             {R(ORDER_CHURN + ' * 100', 1)} AS churn_percent,
             row_number() OVER (PARTITION BY customer_id, product_id, order_id
                                ORDER BY created_at DESC, line DESC, quantity DESC, revenue DESC) AS rn
      FROM sales WHERE product_id IS NOT NULL) WHERE rn = 1""")

ORACLE["view_edges"] = with_views(["views"], f"""
SELECT customer_id, target, relationship, target_name, category, dwell_seconds, event_time, view_count
FROM (SELECT customer_id, product_id AS target, 'VIEWED' AS relationship, product_name AS target_name, category,
             dwell_seconds, {ISO.format(t='created_at')} AS event_time,
             CAST(count(*) OVER (PARTITION BY customer_id, product_id) AS BIGINT) AS view_count,
             row_number() OVER (PARTITION BY customer_id, product_id ORDER BY created_at DESC, event_id DESC) AS rn
      FROM views WHERE product_id IS NOT NULL) WHERE rn = 1""")

GRAPH = """
, o_pos AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC, line,
                                          product_id, quantity, revenue) AS pos FROM sales WHERE product_id IS NOT NULL),
v_pos AS (SELECT *, 1000000000 + row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, event_id DESC) AS pos
          FROM views WHERE product_id IS NOT NULL),
gcat AS (SELECT customer_id, category, count(*) AS n, min(pos) AS seen FROM (
           SELECT customer_id, category, pos FROM o_pos UNION ALL SELECT customer_id, category, pos FROM v_pos)
         GROUP BY 1, 2),
prefs AS (SELECT customer_id, rk AS rank, category, lower(replace('category-' || category, ' ', '-')) AS target, n AS weight
          FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, seen) AS rk FROM gcat)
          WHERE rk <= 3 AND category IS NOT NULL AND category <> ''),
edges AS (
  SELECT customer_id, 'PURCHASED' AS type, CAST(product_id AS VARCHAR) AS target, CAST(revenue AS DOUBLE) AS weight,
         0 AS kind, pos AS ord FROM o_pos
  UNION ALL SELECT customer_id, 'VIEWED', CAST(product_id AS VARCHAR), CAST(dwell_seconds AS DOUBLE), 1, pos FROM v_pos
  UNION ALL SELECT customer_id, 'PREFERS', target, CAST(weight AS DOUBLE), 2, rank FROM prefs),
stored AS (
  SELECT customer_id, product_id AS target, product_name AS target_name, category FROM sales WHERE product_id IS NOT NULL
  UNION ALL SELECT customer_id, product_id, product_name, category FROM views WHERE product_id IS NOT NULL),
pnodes AS (
  SELECT customer_id, node_id, arg_min(name, k) AS name, arg_min(category, k) AS category FROM (
    SELECT customer_id, CAST(product_id AS VARCHAR) AS node_id, product_name AS name, category, pos AS k FROM o_pos
    UNION ALL SELECT customer_id, CAST(product_id AS VARCHAR), product_name, category, pos FROM v_pos
    UNION ALL SELECT s.customer_id, CAST(s.target AS VARCHAR), s.target_name, s.category, 3000000000
    FROM stored s WHERE NOT EXISTS (SELECT 1 FROM o_pos o WHERE o.customer_id = s.customer_id AND o.product_id = s.target)
                    AND NOT EXISTS (SELECT 1 FROM v_pos v WHERE v.customer_id = s.customer_id AND v.product_id = s.target))
  GROUP BY 1, 2),
nodes AS (
  SELECT customer_id, node_id, split_part(coalesce(name, node_id), ' ', 1) AS label, 'product' AS kind, category FROM pnodes
  UNION ALL SELECT customer_id, target, split_part(category, ' ', 1), 'segment', NULL FROM prefs p
    WHERE NOT EXISTS (SELECT 1 FROM pnodes n WHERE n.customer_id = p.customer_id AND n.node_id = p.target)
  UNION ALL SELECT DISTINCT customer_id, CAST(customer_id AS VARCHAR), split_part(CAST(customer_id AS VARCHAR), ' ', 1),
    'customer', NULL FROM (SELECT customer_id FROM pnodes UNION ALL SELECT customer_id FROM prefs))"""

ORACLE["graph_nodes"] = with_views(["sales", "views"], GRAPH + """
SELECT customer_id, node_id, label, kind, category FROM nodes""")

ORACLE["graph_edges"] = with_views(["sales", "views"], GRAPH + """
SELECT e.customer_id, e.target, e.source, e.edge_ordinal, e.edge_id, e.type, e.weight,
       split_part(e.source, ' ', 1) AS source_label, 'customer' AS source_kind, t.label AS target_label, e.target_kind
FROM (SELECT customer_id, CAST(customer_id AS VARCHAR) AS source, target, type, weight,
             CASE WHEN type = 'PREFERS' THEN 'segment' ELSE 'product' END AS target_kind,
             rn - 1 AS edge_ordinal, 'edge-' || CAST(rn - 1 AS VARCHAR) AS edge_id
      FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY kind, ord) AS rn FROM edges)) e
LEFT JOIN nodes t ON t.customer_id = e.customer_id AND t.node_id = e.target AND t.kind = e.target_kind""")

SUMMARY = """,
summ AS (
  SELECT coalesce(r.customer_id, c.customer_id) AS customer_id,
         CAST(coalesce(oe.n, 0) + coalesce(ve.n, 0) + coalesce(c.n, 0) AS BIGINT) AS relationship_count,
         coalesce(r.revenue, 0.0) AS revenue, CAST(coalesce(r.orders, 0) AS BIGINT) AS orders, c.top_category
  FROM (SELECT customer_id, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders
        FROM sales GROUP BY 1) r
  FULL OUTER JOIN (SELECT customer_id, count(*) AS n, max(CASE WHEN rank = 1 THEN category END) AS top_category
                   FROM prefs GROUP BY 1) c ON r.customer_id = c.customer_id
  LEFT JOIN (SELECT customer_id, count(*) AS n FROM o_pos GROUP BY 1) oe ON oe.customer_id = coalesce(r.customer_id, c.customer_id)
  LEFT JOIN (SELECT customer_id, count(*) AS n FROM v_pos GROUP BY 1) ve ON ve.customer_id = coalesce(r.customer_id, c.customer_id))"""

ORACLE["relationship_summary"] = with_views(["sales", "views"], GRAPH + SUMMARY + """
SELECT * FROM summ""")

ORACLE["graph_source"] = with_views(["sales", "views"], GRAPH + SUMMARY + """,
snaps AS (SELECT c_custkey AS customer_id, 'mongodb_seed_snapshot' AS snapshot_source,
                 CAST(c_nationkey AS BIGINT) AS snapshot_edges FROM customer)
SELECT coalesce(s.customer_id, n.customer_id) AS customer_id,
       CASE WHEN coalesce(s.relationship_count, 0) > 0 THEN 'mongodb_graph'
            WHEN n.snapshot_source IS NOT NULL THEN n.snapshot_source ELSE 'empty' END AS source,
       CAST(CASE WHEN coalesce(s.relationship_count, 0) > 0 THEN s.relationship_count
            WHEN n.snapshot_source IS NOT NULL THEN n.snapshot_edges ELSE 0 END AS BIGINT) AS relationship_count
FROM summ s FULL OUTER JOIN snaps n ON s.customer_id = n.customer_id""")


def _title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({x}, '-', ' '), ' '), "
            "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


ORACLE["customer_profiles"] = with_views(["sales", "views", "features"], GRAPH + SUMMARY + f""",
feat AS (SELECT f.customer_id, f.monetary_value AS f_monetary,
                ch.probability AS f_churn
         FROM features f JOIN ({churn_sql('features')}) ch ON f.customer_id = ch.customer_id),
lastev AS (
  SELECT coalesce(o.customer_id, v.customer_id) AS customer_id,
         CASE WHEN o.p IS NOT NULL THEN 'Purchased ' || o.p WHEN v.p IS NOT NULL THEN 'Viewed ' || v.p END AS last_event
  FROM (SELECT customer_id, arg_min(coalesce(product_name, 'product'), pos) AS p FROM o_pos GROUP BY 1) o
  FULL OUTER JOIN (SELECT customer_id, arg_min(coalesce(product_name, 'product'), pos) AS p FROM v_pos GROUP BY 1) v
  ON o.customer_id = v.customer_id),
prof AS (
  SELECT s.*, {_title_sql('CAST(s.customer_id AS VARCHAR)')} AS name, l.last_event, f.f_monetary, f.f_churn,
         f.customer_id IS NOT NULL AS has_features,
         coalesce(nullif(s.revenue, 0.0), f.f_monetary) AS ltv_value
  FROM summ s LEFT JOIN lastev l ON s.customer_id = l.customer_id LEFT JOIN feat f ON s.customer_id = f.customer_id)
SELECT customer_id, name,
       coalesce(nullif(array_to_string(list_transform(list_filter(string_split(replace(name, '-', ' '), ' '), lambda w: w <> '')[1:2],
                                                      lambda w: upper(substr(w, 1, 1))), ''), ''), 'C') AS initials,
       CASE WHEN orders >= 5 THEN 'Loyal active buyer' WHEN top_category IS NOT NULL THEN top_category || ' affinity'
            ELSE 'Emerging customer' END AS segment,
       CASE WHEN ltv_value IS NULL THEN '$0' ELSE '$' || format('{{:,.0f}}', round_even(ltv_value, 0)) END AS ltv,
       CASE WHEN f_churn IS NOT NULL THEN
              printf('%.1f', {R('CASE WHEN f_churn <= 1 THEN f_churn * 100 ELSE f_churn END', 1)}) || '%'
            WHEN has_features THEN 'Calculated' ELSE 'Unknown' END AS churn_risk,
       coalesce(last_event, 'No recent activity') AS last_event, relationship_count
FROM prof""")


# ---- live insights --------------------------------------------------------------
NORM_STREAM = f"""
, norm AS (
  SELECT coalesce(CAST(event_id AS VARCHAR), 'unknown') AS event_id,
         lower(trim(coalesce(event_type, 'unknown'))) AS event_type,
         CASE WHEN trim(coalesce(customer_id, 'unknown')) = '' THEN 'unknown' ELSE trim(coalesce(customer_id, 'unknown')) END AS customer_id,
         product_id, coalesce(nullif(product_name, ''), nullif(product_id, ''), 'unknown') AS product_name,
         lower(trim(coalesce(category, 'unknown'))) AS category, quantity,
         coalesce(revenue, 0.0) AS raw_revenue, {R('coalesce(revenue, 0.0)', 2)} AS revenue, event_time,
         'stream' AS source, seq
  FROM stream_events),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY category ORDER BY event_time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category_count,
         sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY event_time, seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS customer_purchases
  FROM norm),
ins AS (
  SELECT event_id, event_time, seq, 0 AS insight_ordinal, 'purchase_detected' AS kind, 'Purchase event detected' AS title,
         customer_id || ' bought ' || product_name || ' for $' || printf('%.2f', revenue) || '.' AS detail, 'info' AS severity
  FROM counted WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, event_time, seq, 1, 'high_value_order', 'High-value order',
         product_name || ' generated $' || printf('%.2f', revenue) || ' in one order.', 'positive' FROM counted WHERE revenue >= 100
  UNION ALL SELECT event_id, event_time, seq, 2, 'category_momentum', 'Category momentum',
         category || ' has ' || CAST(category_count AS VARCHAR) || ' recent events.', 'positive' FROM counted WHERE category_count >= 3
  UNION ALL SELECT event_id, event_time, seq, 3, 'repeat_buyer', 'Repeat buyer activity',
         customer_id || ' has ' || CAST(customer_purchases AS VARCHAR) || ' recent purchases.', 'positive'
  FROM counted WHERE customer_purchases >= 2)"""

ORACLE["stream_insights"] = with_views(["stream_events"], NORM_STREAM + """
SELECT event_id, insight_ordinal, kind, title, detail, severity FROM ins""")

ORACLE["insight_kind_counts"] = with_views(["stream_events"], NORM_STREAM + """
SELECT kind, count(*) AS insights FROM ins GROUP BY kind""")

ORACLE["replay_totals"] = with_views(["stream_events"], NORM_STREAM + """
SELECT (SELECT count(*) FROM counted) AS processed, CAST((SELECT count(*) FROM ins) AS BIGINT) AS insights_created""")

ORACLE["live_top_categories"] = with_views(["stream_events"], NORM_STREAM + """
SELECT category, events, rank FROM (
  SELECT category, count(*) AS events, row_number() OVER (ORDER BY count(*) DESC, min((event_time, seq))) AS rank
  FROM norm GROUP BY category) WHERE rank <= 5""")

ORACLE["live_revenue_by_category"] = with_views(["stream_events"], NORM_STREAM + """
SELECT category, CAST(sum(CAST(raw_revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM norm
WHERE event_type = 'purchase' GROUP BY category""")

ORACLE["live_customer_purchases"] = with_views(["stream_events"], NORM_STREAM + """
SELECT customer_id, count(*) AS purchases FROM norm WHERE event_type = 'purchase' GROUP BY customer_id""")

ORACLE["recent_stream_events"] = with_views(["stream_events"], NORM_STREAM + f"""
SELECT event_id, event_type, customer_id, product_name, category, quantity, revenue,
       {ISO.format(t='event_time')} AS event_time, source
FROM norm ORDER BY event_time DESC, seq DESC LIMIT 30""")

ORACLE["recent_insights"] = with_views(["stream_events"], NORM_STREAM + """
SELECT event_id, insight_ordinal, kind, detail FROM ins ORDER BY event_time DESC, seq DESC, insight_ordinal DESC LIMIT 30""")


# ---- screening ------------------------------------------------------------------
_PII = [("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
        ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
        ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
        ("card", r"\b(?:\d[ -]*?){13,16}\b")]
_SENS = " OR ".join(f"contains(lower(q), '{t}')" for t in
                    ("export customer emails", "show raw pii", "ignore rbac", "bypass policy", "leak prompt"))
_CASES = "\n".join(f"WHEN regexp_matches(q, '{p}') THEN 'Blocked possible {n} in prompt'" for n, p in _PII)
_CHK = "\n".join(f"WHEN regexp_matches(q, '{p}') THEN 'role_present,prompt_length,pii_block'" for n, p in _PII)

ORACLE["prompt_screening"] = f"""
SELECT doc_id, role, reason = 'Allowed' AS allowed, reason, checks FROM (
  SELECT doc_id, role,
         CASE {_CASES}
              WHEN {_SENS} THEN 'Blocked sensitive data or policy bypass request'
              WHEN role NOT IN ('marketing_analyst', 'admin') THEN 'Role is not authorized for copilot tools'
              ELSE 'Allowed' END AS reason,
         CASE {_CHK}
              WHEN {_SENS} THEN 'role_present,prompt_length,pii_block,sensitive_intent'
              ELSE 'role_present,prompt_length,pii_block,sensitive_intent,tool_rbac' END AS checks
  FROM (SELECT doc_id, coalesce(text, '') AS q,
               ['marketing_analyst', 'admin', 'viewer'][CAST(doc_id % 3 + 1 AS INTEGER)] AS role FROM documents))"""

ORACLE["question_routing"] = """
SELECT conv_id, turn, role, array_to_string(req, ',') AS requested,
       array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE allowed[1:3] END, ',') AS authorized
FROM (SELECT *, list_filter(req, lambda i: list_contains(allowed, i)) AS kept FROM (
  SELECT conv_id, turn, role,
         list_filter([CASE WHEN contains(lower(text), 'with') OR contains(lower(text), 'from') THEN 'a' END,
                      CASE WHEN contains(lower(text), 'for') OR contains(lower(text), 'are') THEN 'b' END,
                      CASE WHEN contains(lower(text), 'this') THEN 'c' END], lambda x: x IS NOT NULL) AS req,
         CASE role WHEN 'admin' THEN ['a', 'b', 'c'] WHEN 'marketing_analyst' THEN ['b', 'c'] ELSE []::VARCHAR[] END AS allowed
  FROM (SELECT conv_id, turn, text,
               CASE conv_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'marketing_analyst' ELSE 'viewer' END AS role
        FROM conversations WHERE role = 'user')))"""


# ---- streaming ------------------------------------------------------------------
ORACLE["streaming_insights"] = ORACLE["stream_insights"]
ORACLE["streaming_insights_keyed_state"] = ORACLE["stream_insights"]
ORACLE["streaming_clean_events"] = ORACLE["clean_events"]

ORACLE["streaming_hourly_revenue"] = with_views(["stream_events"], """
SELECT CAST(ws AS VARCHAR) AS window_start, event_type,
       CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS events
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, event_time) AS ws FROM stream_events)
GROUP BY ws, event_type""")

ORACLE["live_snapshot"] = with_views(["stream_events"], NORM_STREAM + """,
cats AS (SELECT category, count(*) AS events, min([epoch_us(event_time), seq]) AS first FROM norm GROUP BY category),
ranked AS (SELECT *, row_number() OVER (ORDER BY events DESC, first) AS rank FROM cats)
SELECT 'events_seen' AS section, CAST(NULL AS BIGINT) AS position, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM norm
UNION ALL SELECT 'top_categories', rank, category, CAST(events AS DOUBLE) FROM ranked WHERE rank <= 5
UNION ALL SELECT 'revenue_by_category', NULL, category, CAST(sum(CAST(raw_revenue AS DECIMAL(18,2))) AS DOUBLE)
  FROM norm WHERE event_type = 'purchase' GROUP BY category
UNION ALL SELECT 'customer_purchases', NULL, customer_id, CAST(count(*) AS DOUBLE) FROM norm WHERE event_type = 'purchase' GROUP BY customer_id
UNION ALL SELECT 'recent_events', position, event_id, revenue
  FROM (SELECT *, row_number() OVER (ORDER BY event_time DESC, seq DESC) AS position FROM norm) WHERE position <= 30
UNION ALL SELECT 'recent_insights', position, event_id || ':' || kind, NULL
  FROM (SELECT *, row_number() OVER (ORDER BY event_time DESC, seq DESC, insight_ordinal DESC) AS position FROM ins) WHERE position <= 30""")

ORACLE["topic_decode"] = with_views(["stream_events"], """
, enc AS (
  SELECT t.topic, e.*, 'ok' AS state
  FROM stream_events e CROSS JOIN (VALUES ('ecommerce'), ('purchase')) t(topic)
  WHERE t.topic = 'ecommerce' OR e.event_type = 'purchase')
SELECT CASE WHEN state = 'bad' THEN 'mqtt-' || CAST(seq AS VARCHAR) ELSE event_id END AS event_id,
       CASE WHEN state = 'bad' THEN 'unparseable' ELSE event_type END AS event_type,
       CASE WHEN state = 'bad' THEN NULL ELSE customer_id END AS customer_id,
       CASE WHEN state = 'bad' THEN NULL ELSE category END AS category,
       CASE WHEN state = 'bad' THEN NULL ELSE revenue END AS revenue,
       CASE WHEN state = 'bad' THEN substr('{"event_id":"' || event_id || '","event_type":"', 1, 20) END AS raw,
       'emqx:' || topic AS source, seq AS "offset"
FROM enc""")


# ---- shop jobs ------------------------------------------------------------------
REQUESTS = """
, requests AS (
  SELECT CAST(order_id AS VARCHAR) || '-' || CAST(line AS VARCHAR) || '-' || CAST(product_id AS VARCHAR) AS request_id,
         customer_id, CASE WHEN order_id % 97 = 0 THEN product_id + 1000000 ELSE product_id END AS product_id,
         quantity, created_at AS event_time
  FROM sales)"""

ORACLE["order_events"] = with_views(["sales", "products"], REQUESTS + f"""
SELECT r.request_id, r.customer_id, r.product_id, p.name AS product_name, p.category, r.quantity,
       {R('p.price * r.quantity', 2)} AS revenue
FROM requests r JOIN products p ON r.product_id = p.id""")

ORACLE["rejected_order_requests"] = with_views(["sales", "products"], REQUESTS + """
SELECT r.request_id, r.customer_id, r.product_id FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.id = r.product_id)""")

ORACLE["order_request_validation"] = with_views(["sales"], REQUESTS + """
SELECT request_id, len(reasons) = 0 AS is_valid, array_to_string(reasons, ',') AS reasons FROM (
  SELECT request_id, list_filter([
           CASE WHEN NOT coalesce(length('c' || customer_id) BETWEEN 3 AND 80, false) THEN 'customer_id_length' END,
           CASE WHEN product_id IS NULL THEN 'product_id_missing' END,
           CASE WHEN NOT coalesce(quantity BETWEEN 1 AND 10, false) THEN 'quantity_range' END], lambda x: x IS NOT NULL) AS reasons
  FROM requests)""")

ORACLE["browse_event_build"] = with_views(["products"], f"""
SELECT CAST(e.event_id AS VARCHAR) AS request_id, e.user_id AS customer_id, {K} * 23 AS product_id,
       p.name AS product_name, p.category,
       coalesce(CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST(floor(e.value) AS INTEGER) END, 8) AS dwell_seconds
FROM events e LEFT JOIN products p ON p.id = {K.replace('props', 'e.props')} * 23
WHERE e.event_type = 'view'""")

ORACLE["order_scoring"] = with_views(["sales", "catalog"], rec_sql("ocust", prefix=f"""
, ocust AS (
  SELECT DISTINCT category AS customer_id,
         CASE WHEN category = 'wellness' THEN 'High-LTV wellness buyer' ELSE 'Active shopper' END AS segment,
         [category] AS recent_categories
  FROM sales),
""") + f"""
SELECT s.order_id, s.line, s.customer_id, s.product_id,
       CASE WHEN s.category = 'wellness' THEN 'High-LTV wellness buyer' ELSE 'Active shopper' END AS segment,
       coalesce((SELECT string_agg(CAST(r.product_id AS VARCHAR), ',' ORDER BY r.rank) FROM recs r
                 WHERE r.customer_id IS NOT DISTINCT FROM s.category AND r.product_id IS DISTINCT FROM s.product_id), '') AS recommended,
       {R(ORDER_CHURN + ' * 100', 1)} AS churn_percent
FROM sales s""")

ORACLE["order_repair"] = with_views(["sales"], """
SELECT order_id, line,
       coalesce(CASE WHEN order_id % 3 = 0 THEN NULL ELSE revenue END, CASE WHEN order_id % 5 = 0 THEN NULL ELSE revenue END, 0.0) AS revenue,
       coalesce(CASE WHEN order_id % 7 = 0 THEN NULL ELSE price END, CASE WHEN order_id % 11 = 0 THEN NULL ELSE price END, 0.0) AS price
FROM sales""")

ORACLE["product_first_listing"] = with_views(["sales"], f"""
SELECT product_id AS id,
       arg_min(product_name, [epoch_us(created_at), order_id, line, quantity, revenue]) AS name,
       arg_min({R('revenue / quantity', 2)}, [epoch_us(created_at), order_id, line, quantity, revenue]) AS unit_price,
       arg_min(order_id, [epoch_us(created_at), order_id, line, quantity, revenue]) AS first_order,
       arg_max(order_id, [epoch_us(created_at), order_id, line, quantity, revenue]) AS last_order
FROM sales GROUP BY product_id""")

ORACLE["duplicate_order_lines"] = with_views(["sales"], """
SELECT order_id, line, count(*) AS "rows" FROM sales GROUP BY 1, 2 HAVING count(*) > 1""")

ORACLE["unique_order_lines"] = with_views(["sales"], """
SELECT order_id, line, product_id, CASE WHEN rn = 1 THEN 'accepted' ELSE 'rejected' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line ORDER BY product_id, quantity, revenue) AS rn FROM sales)""")

ORACLE["table_row_counts"] = with_views(["sales", "views", "reviews"], """
SELECT 'orders' AS table_name, count(*) AS row_count FROM sales
UNION ALL SELECT 'browse_events', count(*) FROM views
UNION ALL SELECT 'product_reviews', count(*) FROM reviews""")

ORACLE["stored_orders"] = with_views(["sales"], """
SELECT 'orders' AS table_name, count(*) AS n, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM sales
UNION ALL SELECT 'ecommerce_events', count(*), CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) FROM sales""")

ORACLE["feature_json_roundtrip"] = with_views(["features"], "SELECT * FROM features")

ORACLE["scalar_features"] = with_views(["features"], """
SELECT customer_id,
       CASE WHEN customer_id % 2 = 1 THEN 'frequency,monetary_value,note,recency_days'
            ELSE 'frequency,monetary_value,recency_days' END AS kept_keys,
       CAST(frequency AS VARCHAR) AS frequency
FROM features""")

ORACLE["region_heat"] = with_views(["clean_events"], f"""
, rr AS (SELECT region, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM clean_events GROUP BY region)
SELECT region, revenue, {R('CASE WHEN max(revenue) OVER () > 0 THEN revenue / max(revenue) OVER () ELSE 0.0 END', 3)} AS heat,
       region = (SELECT region FROM rr ORDER BY revenue DESC, region LIMIT 1) AS is_top
FROM rr""")

ORACLE["hourly_revenue"] = with_views(["stream_events"], """
SELECT CAST(date_trunc('hour', event_time) AS VARCHAR) AS hour,
       CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS purchases
FROM stream_events WHERE event_type = 'purchase' GROUP BY 1""")

ORACLE["daily_kpis"] = with_views(["stream_events"], f"""
, pc AS (SELECT CAST(event_time AS DATE) AS day, customer_id, bool_or(event_type = 'purchase') AS bought,
                sum(CASE WHEN event_type = 'purchase' THEN CAST(revenue AS DECIMAL(18,2)) END) AS rev
         FROM stream_events GROUP BY 1, 2),
d AS (SELECT day, CAST(coalesce(sum(rev), 0) AS DOUBLE) AS revenue, count(*) AS active_customers,
             count(*) FILTER (WHERE bought) AS purchasers FROM pc GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, revenue, active_customers, purchasers,
       {R('purchasers / active_customers', 4)} AS conversion,
       {R('revenue - lag(revenue) OVER (ORDER BY day)', 2)} AS revenue_change,
       {R('CASE WHEN lag(revenue) OVER (ORDER BY day) > 0 THEN (revenue - lag(revenue) OVER (ORDER BY day)) / lag(revenue) OVER (ORDER BY day) * 100 END', 1)} AS revenue_change_pct
FROM d""")

ORACLE["revenue_history_forecast"] = with_views(["sales"], SERIES + f""",
s AS (SELECT series_id, count(*) AS points, arg_max(value, t) AS last, arg_min(value, t) AS first FROM series GROUP BY series_id)
SELECT series_id, t AS ordinal, CAST(day AS VARCHAR) AS label, value, 'actual' AS kind FROM series
UNION ALL
SELECT series_id, points + 1, 'Next', {R('greatest(0.0, last + CASE WHEN points > 1 THEN (last - first) / (points - 1) ELSE 0.0 END)', 2)},
       'forecast' FROM s""")


# ---- snapshot and centroids -------------------------------------------------------
ORACLE["customer_snapshot"] = with_behavior(f"""
, churn_in AS (
  SELECT b.customer_id, CAST(b.recency_days AS DOUBLE) AS recency_days,
         coalesce(nullif(CAST(b.purchase_frequency AS DOUBLE), 0.0), CAST(f.frequency AS DOUBLE), 1.0) AS frequency,
         coalesce(nullif(b.monetary_value, 0.0), f.monetary_value, 0.0) AS monetary_value,
         f.discount_sensitivity AS discount_sensitivity,
         least((b.browse_events + b.orders) / 12, 1.0) AS engagement_depth
  FROM behavior_seg b LEFT JOIN features f ON b.customer_id = f.customer_id),
churn AS ({churn_sql('churn_in')})""" + GRAPH.replace("\n, o_pos", ",\no_pos", 1) + SUMMARY + f"""
SELECT f.customer_id, f.frequency AS feature_frequency, f.monetary_value AS feature_monetary, {RFM.replace('monetary_value', 'f.monetary_value').replace('frequency', 'f.frequency').replace('recency_days', 'f.recency_days')} AS segment,
       b.orders, b.browse_events, b.monetary_value, b.recency_days, b.behavior_segment,
       c.probability, c.risk_band, s.relationship_count
FROM features f LEFT JOIN behavior_seg b ON b.customer_id = f.customer_id
LEFT JOIN churn c ON c.customer_id = f.customer_id LEFT JOIN summ s ON s.customer_id = f.customer_id""", extra=["features"])

def kmeans_ctes(k: int, rounds: int, recency: str = "recency_days", monetary: str = "monetary_value") -> str:
    """Farthest-first seeding and Lloyd rounds, written out; ends with ``assigned``."""
    zs, fs = ("z0", "z1", "z2"), ("recency_days", "frequency", "monetary_value")
    dist = lambda c: " + ".join(f"(p.z{j} - {c}_{j}) * (p.z{j} - {c}_{j})" for j in range(3))
    near = "CASE " + " ".join(f"WHEN " + " AND ".join(f"d{i} <= d{o}" for o in range(k) if o != i) + f" THEN {i}" for i in range(k)) + " END"
    out = [f"feat AS MATERIALIZED (SELECT customer_id, CAST({recency} AS DOUBLE) AS recency_days, CAST(frequency AS DOUBLE) AS frequency, CAST({monetary} AS DOUBLE) AS monetary_value FROM features)",
           "clean AS MATERIALIZED (SELECT * FROM feat WHERE recency_days IS NOT NULL AND frequency IS NOT NULL AND monetary_value IS NOT NULL)",
           "mean AS MATERIALIZED (SELECT count(*) AS n, " + ", ".join(f"CAST(sum(CAST({f} AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS m{j}" for j, f in enumerate(fs)) + " FROM clean)",
           "dev AS MATERIALIZED (SELECT " + ", ".join(f"CAST(sum(CAST(({f} - m{j}) * ({f} - m{j}) AS DECIMAL(38,6))) AS DOUBLE) / max(n) AS v{j}" for j, f in enumerate(fs)) + " FROM clean, mean)",
           "pts AS MATERIALIZED (SELECT c.*, " + ", ".join(f"({f} - m{j}) / (CASE WHEN v{j} = 0 THEN 1.0 ELSE sqrt(v{j}) END) AS z{j}" for j, f in enumerate(fs)) + " FROM clean c, mean, dev)",
           "s0 AS MATERIALIZED (SELECT z0 AS c0_0, z1 AS c0_1, z2 AS c0_2 FROM pts p ORDER BY z0 * z0 + z1 * z1 + z2 * z2, customer_id LIMIT 1)"]
    for i in range(1, k):
        far = f"least({', '.join(dist(f's.c{o}') for o in range(i))})" if i > 1 else dist("s.c0")
        out.append(f"s{i} AS MATERIALIZED (SELECT s.*, p.z0 AS c{i}_0, p.z1 AS c{i}_1, p.z2 AS c{i}_2 FROM pts p, s{i - 1} s ORDER BY {far} DESC, p.customer_id LIMIT 1)")
    last = f"s{k - 1}"
    for r in range(rounds + 1):
        ds = ", ".join(dist(f"s.c{i}") + f" AS d{i}" for i in range(k))
        out.append(f"a{r} AS MATERIALIZED (SELECT *, {near} AS cluster FROM (SELECT p.*, {ds} FROM pts p, {last} s))")
        if r < rounds:
            moved = ", ".join(f"coalesce(CAST(sum(CASE WHEN a.cluster = {i} THEN CAST(a.z{j} AS DECIMAL(38,12)) END) AS DOUBLE) / count(CASE WHEN a.cluster = {i} THEN 1 END), max(s.c{i}_{j})) AS c{i}_{j}"
                              for i in range(k) for j in range(3))
            out.append(f"r{r} AS MATERIALIZED (SELECT {moved} FROM a{r} a, {last} s)")
            last = f"r{r}"
    out.append(f"assigned AS (SELECT customer_id, {', '.join(fs)}, CAST(cluster AS INTEGER) AS cluster FROM a{rounds})")
    return ",\n" + ",\n".join(out)


LABELLED = """
SELECT cluster, count(*) AS members, avg(recency_days) AS ar, avg(frequency) AS af, avg(monetary_value) AS am,
       CASE WHEN avg(monetary_value) >= 12000 AND avg(frequency) >= 7 AND avg(recency_days) <= 30 THEN 'high_ltv_active'
            WHEN avg(recency_days) >= 90 THEN 'winback_risk' WHEN avg(frequency) >= 5 THEN 'loyal_growth'
            ELSE 'emerging' END AS label
FROM assigned GROUP BY cluster"""
PROFILES = f"""
SELECT cluster, members, {R('ar', 1)} AS avg_recency, {R('af', 1)} AS avg_frequency, {R('am', 1)} AS avg_monetary, label FROM ({LABELLED})"""
SEGMENTS = f""",
named AS ({LABELLED}),
rules AS (SELECT customer_id, {RFM} AS rule_segment FROM feat)
SELECT r.customer_id, a.cluster, n.label AS kmeans_segment, r.rule_segment, coalesce(n.label, r.rule_segment) AS segment
FROM rules r LEFT JOIN assigned a ON a.customer_id = r.customer_id LEFT JOIN named n ON n.cluster = a.cluster"""

ORACLE["kmeans_segments"] = with_views(["features"], kmeans_ctes(4, 10) + SEGMENTS)
ORACLE["kmeans_segments_fallback"] = with_views(["features"], kmeans_ctes(
    4, 10, "CASE WHEN customer_id % 7 <> 0 THEN recency_days END", "CASE WHEN customer_id % 11 <> 0 THEN monetary_value END") + SEGMENTS)
ORACLE["kmeans_cluster_profiles"] = with_views(["features"], kmeans_ctes(4, 10) + PROFILES)
ORACLE["nearest_centroid"] = with_views(["features"], kmeans_ctes(4, 10) + "\nSELECT customer_id, cluster FROM assigned")
ORACLE["centroid_cluster_labels"] = with_views(["features"], kmeans_ctes(3, 10) + PROFILES)


# ---- jobs with several outputs --------------------------------------------------
ORACLE["order_pipeline_events"] = with_views(["sales"], f"""
SELECT 'evt-' || order_id || '-' || line || '-' || product_id AS event_id, 'purchase' AS event_type, order_id, customer_id, product_id, product_name, category,
       quantity, price, {R('price * quantity', 2)} AS revenue, {ISO.format(t='created_at')} AS event_time FROM sales""")
ORACLE["order_pipeline_edges"] = ORACLE["purchase_edges"]
ORACLE["order_pipeline_orders"] = ORACLE["order_scoring"]
ORACLE["snapshot_customers"] = ORACLE["customer_snapshot"]
ORACLE["snapshot_baskets"] = ORACLE["basket_pairs"]
ORACLE["snapshot_demand"] = ORACLE["demand_forecast"]
ORACLE["snapshot_reviews"] = ORACLE["recent_reviews"]


# ---- stored tables: what one pass over all batches gives --------------------------
ORACLE["stored_purchase_edges"] = ORACLE["purchase_edges"]
ORACLE["stored_view_edges"] = ORACLE["view_edges"]
ORACLE["stored_first_listing"] = with_views(["sales"], f"""
SELECT product_id AS id, min(product_name) AS name, {ISO.format(t='min(created_at)')} AS created_at, {ISO.format(t='max(created_at)')} AS updated_at
FROM sales GROUP BY product_id""")


# ---- scans ----------------------------------------------------------------------
ORACLE["order_scan"] = with_views(["sales"], f"""
SELECT order_id, line, customer_id, product_id, quantity, revenue, {ISO.format(t='created_at')} AS created_at FROM sales""")
ORACLE["browse_scan"] = with_views(["views"], """
SELECT event_id, customer_id, product_id, product_name, category, dwell_seconds FROM views""")
ORACLE["review_scan"] = with_views(["reviews"], "SELECT review_id, product_id, customer_id, rating FROM reviews")
ORACLE["catalog_scan"] = with_views(["products"], """
SELECT id, name, category, price, active FROM products WHERE coalesce(active, true)""")
ORACLE["latest_activity"] = with_views(["sales"], f"""
SELECT customer_id, {ISO.format(t='max(created_at)')} AS last_activity FROM sales GROUP BY customer_id""")
ORACLE["daily_product_quantity"] = with_views(["sales"], """
SELECT product_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, CAST(sum(coalesce(quantity, 1)) AS BIGINT) AS quantity
FROM sales WHERE product_id IS NOT NULL GROUP BY 1, 2""")

ORACLE["segment_category_match"] = with_behavior(f"""
, cust AS (
  SELECT c.c_custkey AS customer_id, {SEGTEXT.format(c='c.c_mktsegment')} AS segment,
         coalesce(t.recent_categories[1], '') AS category
  FROM customer c LEFT JOIN cat_top t ON t.customer_id = c.c_custkey)
SELECT customer_id, segment, category,
       CASE WHEN category = '' THEN 0.0
            WHEN contains(replace(lower(segment), '_', ' '), category) THEN 1.0
            WHEN contains(replace(lower(segment), '_', ' '), 'wellness') AND category IN ('wellness', 'sleep') THEN 1.0
            WHEN contains(replace(lower(segment), '_', ' '), 'home') AND category = 'smart home' THEN 1.0
            WHEN contains(replace(lower(segment), '_', ' '), 'commuter') AND category IN ('commuter', 'travel') THEN 1.0
            ELSE 0.0 END::DOUBLE AS match
FROM cust""")

ORACLE["review_validation"] = with_views(["reviews"], """
SELECT review_id, len(reasons) = 0 AS is_valid, array_to_string(reasons, ',') AS reasons FROM (
  SELECT review_id, list_filter([
           CASE WHEN NOT coalesce(length('cust-' || CAST(customer_id AS VARCHAR)) BETWEEN 3 AND 80, false) THEN 'customer_id_length' END,
           CASE WHEN NOT coalesce(rating BETWEEN 1 AND 5, false) THEN 'rating_range' END,
           CASE WHEN NOT coalesce(length(text) BETWEEN 3 AND 1000, false) THEN 'text_length' END], lambda x: x IS NOT NULL) AS reasons
  FROM reviews)""")

ORACLE["browse_validation"] = with_views(["views"], """
SELECT event_id, len(reasons) = 0 AS is_valid, array_to_string(reasons, ',') AS reasons FROM (
  SELECT event_id, list_filter([
           CASE WHEN NOT coalesce(length(CAST(customer_id AS VARCHAR)) BETWEEN 3 AND 80, false) THEN 'customer_id_length' END,
           CASE WHEN NOT coalesce(dwell_seconds BETWEEN 0 AND 3600, false) THEN 'dwell_range' END], lambda x: x IS NOT NULL) AS reasons
  FROM views)""")

ORACLE["latest_orders"] = with_views(["sales"], """
SELECT customer_id, order_id, line, product_id, quantity, revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC, line, product_id,
                                quantity, revenue) AS rn FROM sales) WHERE rn = 1""")

ORACLE["basket_pairs_pruned"] = ORACLE["basket_pairs"]
