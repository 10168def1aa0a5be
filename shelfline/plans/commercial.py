"""Queries on categories, customers, prices and promotions."""

from pyspark.sql import functions as F

from ..functions.store import is_stored, known, once, stored
from ..operators import category as C
from ..operators import pricing as P
from ..operators import promo as M
from ..operators import segments as S
from ..operators import switching as W_
from ..operators.features import category_map
from .base import register
from .shopping import CATS, R, WEEK

KPI = f"""kw AS (SELECT DISTINCT {WEEK} AS w FROM tx ORDER BY 1 DESC LIMIT 9), ke AS (SELECT max(w) AS last, min(w) AS first FROM kw),
kpi0 AS (SELECT category, {R} AS revenue, count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers, sum(CASE WHEN {WEEK} < last AND {WEEK} >= first THEN price * quantity ELSE 0 END) AS prior FROM tx, ke GROUP BY 1),
kpi AS (SELECT category, revenue, transactions, customers, transactions / (SELECT count(DISTINCT transaction_id) FROM tx) AS penetration, revenue / transactions AS aov, revenue / sum(revenue) OVER () AS revenue_share, CASE WHEN prior <> 0 THEN (revenue - prior) / prior * 100 ELSE 0 END AS growth_pct FROM kpi0)"""
register("category_kpis", C.category_kpis, f"WITH {KPI} SELECT * FROM kpi", "revenue:2 penetration aov:5 revenue_share growth_pct:4")
register("category_scorecard", C.category_scorecard, f"""WITH {KPI} SELECT category, revenue, revenue_share, transactions, customers, aov, growth_pct,
CASE WHEN revenue_share >= 0.2 AND growth_pct > 0 THEN 'growth' WHEN revenue_share >= 0.2 THEN 'parity' WHEN growth_pct > 15 THEN 'traffic_driver' ELSE 'niche' END AS role, CASE WHEN growth_pct > 10 THEN 'green' WHEN growth_pct < -10 THEN 'red' ELSE 'amber' END AS rag FROM kpi""", "revenue:2 revenue_share aov:5 growth_pct:4")
register("category_trend", C.category_trend, f"""WITH t AS (SELECT *, {WEEK} AS period FROM tx), n AS (SELECT period, count(DISTINCT transaction_id) AS n FROM t GROUP BY 1)
SELECT category, period, {R} AS revenue, count(DISTINCT transaction_id) / any_value(n) AS basket_penetration FROM t JOIN n USING (period) GROUP BY 1, 2""", "revenue:2 basket_penetration")
register("assortment_efficiency", C.assortment_efficiency, f"""WITH o AS (SELECT category, count(DISTINCT stockcode) / (SELECT count(DISTINCT stockcode) FROM tx) AS sku_share, {R} / (SELECT {R} FROM tx) AS revenue_share, {R} AS total_revenue FROM tx GROUP BY 1)
SELECT *, revenue_share / sku_share AS efficiency_index, CASE WHEN revenue_share / sku_share > 1.1 THEN 'efficient' WHEN revenue_share / sku_share < 0.9 THEN 'under_efficient' ELSE 'balanced' END AS efficiency_label FROM o""", "sku_share revenue_share total_revenue:2 efficiency_index")
MS = f"""o AS (SELECT category, {R} AS total_revenue, count(DISTINCT transaction_id) / (SELECT count(DISTINCT transaction_id) FROM tx) AS basket_penetration, count(DISTINCT stockcode) / (SELECT count(DISTINCT stockcode) FROM tx) AS sku_share, {R} / (SELECT {R} FROM tx) AS revenue_share FROM tx GROUP BY 1),
r AS (SELECT category, count(*) FILTER (n > 1) / count(*) AS repeat_purchase_rate FROM (SELECT category, customer_id, count(DISTINCT transaction_id) AS n FROM tx GROUP BY 1, 2) GROUP BY 1),
y AS (SELECT category, year(date_trunc('week', date) + INTERVAL 6 DAY) AS y, {R} AS r FROM tx GROUP BY 1, 2), g AS (SELECT category, (r - b) / b * 100 AS revenue_yoy_growth FROM (SELECT *, lag(r) OVER w AS b, row_number() OVER (PARTITION BY category ORDER BY y DESC) AS k FROM y WINDOW w AS (PARTITION BY category ORDER BY y)) WHERE k = 1),
ms AS (SELECT category, total_revenue, revenue_yoy_growth, basket_penetration, repeat_purchase_rate, sku_share, revenue_share FROM o JOIN r USING (category) JOIN g USING (category))"""
register("manager_scorecard", C.manager_scorecard, f"WITH {MS} SELECT * FROM ms", "total_revenue:2 revenue_yoy_growth:4 basket_penetration repeat_purchase_rate sku_share revenue_share")
register("growth_matrix", C.growth_matrix, f"""WITH {MS}, md AS (SELECT quantile_cont(revenue_share, 0.5) AS s, quantile_cont(revenue_yoy_growth, 0.5) AS g FROM ms)
SELECT category, revenue_share, revenue_yoy_growth AS growth_pct, total_revenue, CASE WHEN revenue_share >= s AND revenue_yoy_growth >= g THEN 'star' WHEN revenue_share >= s THEN 'cash_cow' WHEN revenue_yoy_growth >= g THEN 'question_mark' ELSE 'dog' END AS quadrant FROM ms, md""", "revenue_share growth_pct:4 total_revenue:2")

DAYS = "date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE))"
RFM = f"""rfm AS (SELECT customer_id, max(date) AS last_purchase, min(date) AS first_purchase, count(DISTINCT transaction_id) AS frequency, {R} AS monetary, avg(price * quantity) AS avg_order_value, max(price * quantity) AS max_order_value, sum(quantity) AS n_items,
  count(DISTINCT stockcode) AS n_unique_products, count(DISTINCT category) AS n_unique_categories, avg(price) AS avg_price_paid, stddev_samp(price * quantity) AS std_order_value,
  CAST(date_diff('day', CAST(max(date) AS DATE), (SELECT CAST(max(date) AS DATE) FROM tx)) + 1 AS INTEGER) AS recency_days, CAST({DAYS} AS INTEGER) AS customer_lifetime_days FROM tx GROUP BY 1)"""
register("rfm_features", S.rfm_features, f"""WITH {RFM} SELECT *, CASE WHEN frequency > 1 THEN customer_lifetime_days / (frequency - 1) ELSE customer_lifetime_days END AS purchase_interval, n_items / frequency AS items_per_order,
monetary / n_items AS revenue_per_item, coalesce(std_order_value, 0) / avg_order_value AS order_value_cv FROM rfm""", "monetary:2 avg_order_value:5 max_order_value:2 n_items:2 avg_price_paid:5 std_order_value:4 purchase_interval items_per_order revenue_per_item:5 order_value_cv")
QUART = lambda c: f"CASE WHEN row_number() OVER (ORDER BY {c}, customer_id) <= 1 + (count(*) OVER () - 1) * 0.25 THEN 1 WHEN row_number() OVER (ORDER BY {c}, customer_id) <= 1 + (count(*) OVER () - 1) * 0.5 THEN 2 WHEN row_number() OVER (ORDER BY {c}, customer_id) <= 1 + (count(*) OVER () - 1) * 0.75 THEN 3 ELSE 4 END"
NAMED = " ".join(f"WHEN rfm_score = '{c}' THEN '{name}'" for c, name in S.RFM_NAMES.items())
SEG = f"""{RFM}, sc AS (SELECT customer_id, recency_days, frequency, round(monetary, 2) AS monetary, 5 - {QUART('recency_days')} AS recency_score, {QUART('frequency')} AS frequency_score, {QUART('monetary')} AS monetary_score FROM rfm),
seg AS (SELECT *, CASE {NAMED} ELSE 'Other' END AS segment FROM (SELECT *, concat(recency_score, frequency_score, monetary_score) AS rfm_score FROM sc))"""
register("rfm_segments", lambda tx: S.rfm_segments(S.rfm_features(tx)), f"WITH {SEG} SELECT * FROM seg", "monetary:2")
register("behavioral_features", S.behavioral_features, f"""SELECT customer_id, CAST({DAYS} + 1 AS INTEGER) AS days_active, count(DISTINCT transaction_id) AS purchase_frequency, {DAYS} / greatest(count(DISTINCT date) - 1, 1) AS avg_days_between, {R} AS total_revenue,
avg(price * quantity) AS avg_order_value, coalesce(stddev_samp(price * quantity), 0) AS revenue_std, count(DISTINCT stockcode) AS n_products, count(DISTINCT category) AS n_categories, avg(quantity) AS avg_basket_size, max(quantity) AS max_basket_size, avg(price) AS avg_price,
coalesce(stddev_samp(price) / avg(price), 0) AS price_cv, avg(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END) AS weekend_ratio FROM tx GROUP BY 1""", "avg_days_between total_revenue:2 avg_order_value:5 revenue_std:4 avg_basket_size avg_price:5 price_cv weekend_ratio")
register("value_segments", S.value_segments, f"""WITH c AS (SELECT max(date) - INTERVAL 90 DAY AS cut FROM tx),
f AS (SELECT customer_id, CAST(date_diff('day', CAST(max(date) FILTER (date < cut) AS DATE), CAST(any_value(cut) AS DATE)) AS INTEGER) AS recency, count(DISTINCT transaction_id) FILTER (date < cut) AS frequency, {R} FILTER (date < cut) AS monetary, avg(price * quantity) FILTER (date < cut) AS avg_order,
  count(DISTINCT stockcode) FILTER (date < cut) AS n_products, CAST(date_diff('day', CAST(min(date) FILTER (date < cut) AS DATE), CAST(max(date) FILTER (date < cut) AS DATE)) + 1 AS INTEGER) AS lifetime_days, coalesce({R} FILTER (date >= cut), 0) AS future_revenue FROM tx, c GROUP BY 1),
v AS (SELECT *, monetary / (lifetime_days / 365) * greatest(0, least(1, 1 - recency / (lifetime_days + recency))) * 2 AS predicted_clv FROM f WHERE frequency > 0), q AS (SELECT quantile_cont(predicted_clv, 0.8) AS a, quantile_cont(predicted_clv, 0.6) AS b FROM v)
SELECT v.*, CASE WHEN predicted_clv > a AND recency < 30 AND frequency > 1 THEN 'VIP' WHEN predicted_clv > b AND recency < 60 AND frequency > 1 THEN 'High Potential' WHEN frequency > 5 AND recency < 90 THEN 'Loyal' WHEN frequency = 1 AND recency < 30 THEN 'New' WHEN recency > 180 THEN 'Churned' ELSE 'Regular' END AS value_segment FROM v, q""", "monetary:2 avg_order:5 future_revenue:2 predicted_clv:3")
register("kaplan_meier", S.kaplan_meier, """WITH c AS (SELECT max(date) - INTERVAL 365 DAY AS cut FROM tx),
o AS (SELECT customer_id, date_diff('day', CAST(min(date) FILTER (date < cut) AS DATE), CAST(max(date) FILTER (date < cut) AS DATE)) AS duration, max(CASE WHEN date >= cut THEN 1 ELSE 0 END) AS event FROM tx, c GROUP BY 1),
t AS (SELECT duration, sum(event) AS d, count(*) AS c FROM o WHERE duration IS NOT NULL GROUP BY 1), n AS (SELECT *, sum(c) OVER (ORDER BY duration DESC) AS n FROM t)
SELECT CAST(duration AS INTEGER) AS timeline, CASE WHEN max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER w, 0)) END AS survival_prob FROM n WINDOW w AS (ORDER BY duration)""", "survival_prob")
segs = lambda tx: once(tx, "segs", lambda: S.rfm_segments(S.rfm_features(tx)).select("customer_id", "segment"))
register("segment_value_metrics", lambda tx: S.segment_value_metrics(segs(tx), tx), f"""WITH {SEG}, o AS (SELECT customer_id, {R} AS r, count(DISTINCT transaction_id) AS t FROM tx GROUP BY 1),
g AS (SELECT segment, count(*) AS n_customers, sum(r) AS revenue, CAST(sum(t) AS BIGINT) AS transactions FROM seg JOIN o USING (customer_id) GROUP BY 1)
SELECT *, n_customers / sum(n_customers) OVER () AS customer_share, revenue / sum(revenue) OVER () AS revenue_share, revenue / n_customers AS revenue_per_customer, transactions / n_customers AS transactions_per_customer, (revenue / sum(revenue) OVER ()) / (n_customers / sum(n_customers) OVER ()) AS concentration_index FROM g""", "revenue:2 customer_share revenue_share revenue_per_customer:4 transactions_per_customer concentration_index")
register("segment_concentration", lambda tx: S.segment_concentration(segs(tx), tx), f"""WITH {SEG}, o AS (SELECT segment, customer_id, {R} AS r FROM tx JOIN seg USING (customer_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY r, customer_id) AS i FROM o)
SELECT segment, count(*) AS n_customers, 2 * sum(i * r) / (count(*) * sum(r)) - (count(*) + 1) / count(*) AS gini, avg(r) AS mean_revenue, quantile_cont(r, 0.5) AS median_revenue, stddev_samp(r) AS std_revenue FROM k GROUP BY 1""", "gini mean_revenue:4 median_revenue:4 std_revenue:3")
register("purchase_streak", S.purchase_streak, """WITH d AS (SELECT customer_id, CAST(date AS DATE) AS d, count(*) AS n FROM tx GROUP BY 1, 2), r AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER (PARTITION BY customer_id ORDER BY d), d) <= 1 THEN 0 ELSE 1 END AS o FROM d),
g AS (SELECT *, sum(o) OVER (PARTITION BY customer_id ORDER BY d) AS run FROM r) SELECT customer_id, CAST(max(n) AS BIGINT) AS streak FROM (SELECT customer_id, run, sum(n) AS n FROM g GROUP BY 1, 2) GROUP BY 1""")

EL = f"""wp AS (SELECT stockcode, {WEEK} AS week, avg(price) AS p, sum(quantity) AS q FROM tx GROUP BY 1, 2),
e0 AS (SELECT stockcode, count(*) AS n_obs, stddev_samp(p) / avg(p) AS price_cv, count(DISTINCT p) AS k, regr_slope(ln(q), ln(p)) AS elasticity, regr_intercept(ln(q), ln(p)) AS intercept, regr_r2(ln(q), ln(p)) AS r_squared, regr_sxx(ln(q), ln(p)) AS sxx, regr_syy(ln(q), ln(p)) AS syy FROM wp WHERE p > 0 AND q > 0 GROUP BY 1),
e1 AS (SELECT *, sqrt(greatest(0, 1 - r_squared) * syy / ((n_obs - 2) * sxx)) AS std_error FROM e0 WHERE n_obs >= 10 AND price_cv >= 0.05 AND k >= 3),
e AS (SELECT stockcode, elasticity, intercept, r_squared, std_error, n_obs, price_cv, elasticity - 1.96 * std_error AS ci_lower, elasticity + 1.96 * std_error AS ci_upper FROM e1)"""
ED = "elasticity intercept:5 r_squared std_error price_cv ci_lower ci_upper"
register("own_price_elasticity", P.own_price_elasticity, f"WITH {EL} SELECT * FROM e", ED)
register("elasticity_confidence", lambda tx: P.elasticity_confidence(P.own_price_elasticity(tx)), f"""WITH {EL} SELECT *, CASE WHEN (ci_upper - ci_lower) / greatest(abs(elasticity), 1e-9) <= 2 THEN 'high' WHEN (ci_upper - ci_lower) / greatest(abs(elasticity), 1e-9) <= 4 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN abs(elasticity) > 1 THEN 'elastic' WHEN abs(elasticity) < 1 THEN 'inelastic' ELSE 'unit' END AS demand FROM e""", ED)
register("shrunk_elasticity", P.shrunk_elasticity, f"""WITH {EL}, {CATS}, b AS (SELECT stockcode, category, elasticity, avg(elasticity) OVER (PARTITION BY category) AS category_mean, coalesce(var_samp(elasticity) OVER (PARTITION BY category), 0) AS bt, std_error * std_error AS wi FROM e JOIN cm USING (stockcode))
SELECT stockcode, category, elasticity, category_mean, wi / (bt + wi) AS category_weight, (wi * category_mean + bt * elasticity) / (bt + wi) AS shrunk FROM b""", "elasticity category_mean category_weight shrunk")
Z = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"
KVI = f"""{EL}, {CATS}, pm AS (SELECT stockcode, {R} AS total_revenue, count(DISTINCT customer_id) AS customers, count(DISTINCT transaction_id) / (SELECT count(DISTINCT transaction_id) FROM tx) AS basket_penetration FROM tx GROUP BY 1),
kf AS (SELECT stockcode, category, total_revenue, basket_penetration, customers, total_revenue / customers AS rpc, abs(elasticity) AS abs_elasticity FROM pm JOIN cm USING (stockcode) LEFT JOIN e USING (stockcode)),
kg AS (SELECT *, coalesce(abs_elasticity, (SELECT coalesce(quantile_cont(abs_elasticity, 0.5), 0.5) FROM kf)) AS ae FROM kf),
kz AS (SELECT *, 0.30 * {Z('basket_penetration')} + 0.25 * {Z('total_revenue')} + 0.15 * {Z('ae')} + 0.10 * {Z('customers')} + 0.20 * {Z('rpc')} AS z FROM kg),
kvi AS (SELECT stockcode, category, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) AS kvi_score, total_revenue, basket_penetration, basket_penetration AS trip_incidence, abs_elasticity, CASE WHEN abs_elasticity IS NULL THEN 'unavailable' ELSE 'estimated' END AS elasticity_status FROM kz)"""
KD = "kvi_score total_revenue:2 basket_penetration trip_incidence abs_elasticity"
kvi = lambda tx: once(tx, "kvi", lambda: P.kvi_scores(tx, P.own_price_elasticity(tx)))
MID = "(SELECT quantile_cont(kvi_score, 0.5) FROM kvi)"
CUT = lambda u, a, b, c, d: f"CASE WHEN abs_elasticity IS NULL THEN '{u}' WHEN kvi_score >= {MID} AND abs_elasticity >= 1 THEN '{a}' WHEN kvi_score >= {MID} THEN '{b}' WHEN abs_elasticity >= 1 THEN '{c}' ELSE '{d}' END"
register("kvi_scores", kvi, f"WITH {KVI} SELECT * FROM kvi", KD)
register("elasticity_quadrant", lambda tx: P.elasticity_quadrant(kvi(tx)), f"WITH {KVI} SELECT *, {CUT('unknown', 'advocate', 'protect', 'promote', 'defer')} AS quadrant FROM kvi", KD)
register("pricing_decision_matrix", lambda tx: P.decision_matrix(kvi(tx)), f"WITH {KVI} SELECT *, {CUT('insufficient_evidence', 'invest', 'protect', 'price_lever', 'review')} AS decision FROM kvi", KD)
UP = f"up AS (SELECT stockcode, category, avg(CAST(size AS DOUBLE)) AS pack_size, {R} / sum(quantity) / avg(CAST(size AS DOUBLE)) AS price_per_unit FROM tx GROUP BY 1, 2)"
register("price_curve_violations", lambda tx: P.price_curve_violations(P.unit_prices(tx)), f"""WITH {UP}, l AS (SELECT category, lead(stockcode) OVER w AS larger_pack, lead(pack_size) OVER w AS larger_size, lead(price_per_unit) OVER w AS larger_price_per_unit, stockcode AS smaller_pack, pack_size AS smaller_size, price_per_unit AS smaller_price_per_unit
FROM up WINDOW w AS (PARTITION BY category ORDER BY pack_size, stockcode)) SELECT *, (smaller_price_per_unit / larger_price_per_unit - 1) * 100 AS violation_pct FROM l WHERE smaller_price_per_unit > larger_price_per_unit * 1.05""", "larger_size larger_price_per_unit:5 smaller_size smaller_price_per_unit:5 violation_pct:4")
register("price_tiers", P.price_tiers, """WITH m AS (SELECT stockcode, quantile_cont(price, 0.5) AS median_price FROM tx GROUP BY 1), q AS (SELECT quantile_cont(median_price, 1/3) AS a, quantile_cont(median_price, 2/3) AS b FROM m)
SELECT stockcode, median_price, CASE WHEN median_price <= a THEN 'Budget' WHEN median_price <= b THEN 'Mainstream' ELSE 'Premium' END AS price_tier FROM m, q""", "median_price:5")

# Promotion queries take 100 x (1 - discount) as the price; a drop of 3 % from the product's usual price is one.
DROP = 0.03
PX = "px AS (SELECT * REPLACE (100 * (1 - discount) AS price) FROM tx)"
PR = f"""{PX}, bp AS (SELECT stockcode, quantile_cont(price, 0.9) AS base FROM px GROUP BY 1), fl AS (SELECT px.*, CAST(date AS DATE) AS d, (base - price) / base AS drop_pct, (base - price) / base >= {DROP} AS is_promo FROM px JOIN bp USING (stockcode)),
pd AS (SELECT DISTINCT stockcode, d FROM fl WHERE is_promo), pg AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER (PARTITION BY stockcode ORDER BY d), d) <= 1 THEN 0 ELSE 1 END AS o FROM pd),
pi AS (SELECT *, sum(o) OVER (PARTITION BY stockcode ORDER BY d) AS run FROM pg), pp AS (SELECT stockcode, run, min(d) AS start_date, max(d) AS end_date, CAST(date_diff('day', min(d), max(d)) + 1 AS INTEGER) AS duration_days FROM pi GROUP BY 1, 2 HAVING date_diff('day', min(d), max(d)) + 1 BETWEEN 3 AND 60),
mk AS (SELECT px.*, EXISTS (SELECT 1 FROM pp WHERE pp.stockcode = px.stockcode AND CAST(px.date AS DATE) BETWEEN start_date AND end_date) AS is_promo FROM px)"""
plain = lambda tx: tx.withColumn("price", 100 * (1 - F.col("discount"))).drop("product", "brand", "size", "discount")
# queries of many parts read the lines from a table that they write first
prices = lambda tx: once(tx, "prices", lambda: plain(tx), (lambda df: df) if is_stored(tx) else stored)
found = lambda tx: once(tx, "found", lambda: M.detect_promotions(prices(tx) if known(tx, "prices") else plain(tx), DROP))
# most parts want the days of promotions and not their sales
periods = lambda tx: found(tx) if known(tx, "found") else once(tx, "periods", lambda: M.promo_periods(prices(tx) if known(tx, "prices") else plain(tx), DROP))
register("detect_promotions", lambda tx: M.detect_promotions(plain(tx), DROP), f"""WITH {PR}, own AS (SELECT fl.stockcode, run, avg(drop_pct) * 100 AS avg_discount_pct, {R} AS promo_revenue, sum(quantity) AS promo_qty, count(DISTINCT transaction_id) AS promo_orders, count(DISTINCT customer_id) AS promo_customers, avg(price) AS avg_promo_price FROM fl JOIN pi ON fl.stockcode = pi.stockcode AND fl.d = pi.d WHERE is_promo GROUP BY 1, 2),
b AS (SELECT stockcode, {R} AS baseline_revenue, sum(quantity) AS baseline_qty, count(DISTINCT transaction_id) AS baseline_orders, count(DISTINCT customer_id) AS baseline_customers, avg(price) AS avg_baseline_price FROM fl WHERE NOT is_promo GROUP BY 1), n AS (SELECT count(DISTINCT date) AS n FROM fl WHERE NOT is_promo)
SELECT stockcode, start_date, end_date, duration_days, avg_discount_pct, promo_revenue, promo_qty, promo_orders, promo_customers, avg_promo_price, baseline_revenue, baseline_qty, baseline_orders, baseline_customers, avg_baseline_price,
promo_qty / duration_days / (baseline_qty / n) - 1 AS qty_lift, promo_revenue / duration_days / (baseline_revenue / n) - 1 AS revenue_lift FROM pp JOIN own USING (stockcode, run) JOIN b USING (stockcode), n""", "avg_discount_pct promo_revenue:2 promo_qty:2 avg_promo_price:5 baseline_revenue:2 baseline_qty:2 avg_baseline_price:5 qty_lift revenue_lift")
register("promo_lines", lambda tx: M.mark_promo_lines(plain(tx), found(tx)).groupBy("stockcode", "is_promo").agg(F.count("*").alias("lines")), f"WITH {PR} SELECT stockcode, is_promo, count(*) AS lines FROM mk GROUP BY 1, 2")
register("promo_timeline", lambda tx: M.promo_timeline(plain(tx), found(tx)), f"""WITH {PR} SELECT category, {WEEK} AS period, coalesce({R} FILTER (is_promo), 0) AS promo_revenue, coalesce({R} FILTER (NOT is_promo), 0) AS base_revenue, count(DISTINCT stockcode) FILTER (is_promo) AS promo_skus FROM mk GROUP BY 1, 2""", "promo_revenue:2 base_revenue:2")
register("promo_timing_weekday", lambda tx: M.promo_timing(plain(tx), found(tx)), f"""WITH {PR}, g AS (SELECT CAST(isodow(date) - 1 AS INTEGER) AS weekday, coalesce({R} FILTER (is_promo), 0) AS promo_revenue, coalesce({R} FILTER (NOT is_promo), 0) AS base_revenue FROM mk GROUP BY 1) SELECT *, promo_revenue / base_revenue AS uplift_ratio FROM g""", "promo_revenue:2 base_revenue:2 uplift_ratio")
register("promo_timing_month", lambda tx: M.promo_timing(plain(tx), found(tx), "month"), f"""WITH {PR}, g AS (SELECT CAST(month(date) AS INTEGER) AS month, coalesce({R} FILTER (is_promo), 0) AS promo_revenue, coalesce({R} FILTER (NOT is_promo), 0) AS base_revenue FROM mk GROUP BY 1) SELECT *, promo_revenue / base_revenue AS uplift_ratio FROM g""", "promo_revenue:2 base_revenue:2 uplift_ratio")
LIFTS = ", ".join(f"CASE WHEN control_{c} > 0 THEN (treated_{c} / control_{c} - 1) * 100 ELSE 0 END AS lift_{c}_pct" for c in ("revenue", "qty", "orders"))
register("promo_pre_post", lambda tx: M.pre_post_comparison(plain(tx), found(tx)), f"""WITH {PR}, j AS (SELECT pp.stockcode, start_date, end_date, px.price, px.quantity, px.transaction_id, CAST(date AS DATE) >= start_date AS treated FROM pp JOIN px ON px.stockcode = pp.stockcode AND CAST(date AS DATE) BETWEEN start_date - duration_days AND end_date),
g AS (SELECT stockcode, start_date, end_date, coalesce({R} FILTER (treated), 0) AS treated_revenue, coalesce({R} FILTER (NOT treated), 0) AS control_revenue, coalesce(sum(quantity) FILTER (treated), 0) AS treated_qty, coalesce(sum(quantity) FILTER (NOT treated), 0) AS control_qty, count(DISTINCT transaction_id) FILTER (treated) AS treated_orders, count(DISTINCT transaction_id) FILTER (NOT treated) AS control_orders FROM j GROUP BY 1, 2, 3)
SELECT *, {LIFTS} FROM g""", "treated_revenue:2 control_revenue:2 treated_qty:2 control_qty:2 lift_revenue_pct:4 lift_qty_pct:4 lift_orders_pct:4")
register("promo_cannibalization", lambda tx: M.cannibalization(prices(tx), found(tx)), f"""WITH {PR}, {CATS.replace('FROM tx', 'FROM px')}, j AS (SELECT pp.stockcode AS promo_product, start_date, px.stockcode AS peer_product, px.category, price * quantity AS r, transaction_id, CAST(date AS DATE) >= start_date AS now
FROM pp JOIN cm ON cm.stockcode = pp.stockcode JOIN px ON px.category = cm.category AND px.stockcode <> pp.stockcode AND CAST(date AS DATE) BETWEEN start_date - duration_days AND end_date),
g AS (SELECT promo_product, start_date, peer_product, category, coalesce(sum(r) FILTER (now), 0) AS promo_revenue, coalesce(sum(r) FILTER (NOT now), 0) AS base_revenue, count(DISTINCT transaction_id) FILTER (now) AS promo_orders, count(DISTINCT transaction_id) FILTER (NOT now) AS base_orders FROM j GROUP BY 1, 2, 3, 4)
SELECT *, greatest(0, base_revenue - promo_revenue) AS cannibalized_revenue, least(1, greatest(0, base_revenue - promo_revenue) / base_revenue) AS cannibalization_index FROM g WHERE base_revenue >= 1""", "promo_revenue:2 base_revenue:2 cannibalized_revenue:2 cannibalization_index")

BASE = f"wk AS (SELECT category, {WEEK} AS w, {R} AS r, sum(quantity) AS u, count(DISTINCT transaction_id) AS t FROM tx GROUP BY 1, 2), lk AS (SELECT *, (r / lag(r) OVER (PARTITION BY category ORDER BY w) - 1) * 100 AS growth, row_number() OVER (PARTITION BY category ORDER BY w DESC) AS k FROM wk)"
register("category_baselines", C.category_baselines, f"WITH {BASE} SELECT category, avg(r) AS baseline_revenue, avg(u) AS baseline_units, avg(t) AS baseline_orders, count(*) AS n_weeks FROM lk WHERE k <= 12 GROUP BY 1", "baseline_revenue:4 baseline_units baseline_orders")
register("scenario_grid", C.scenario_grid, f"""WITH {BASE}, b AS (SELECT category, avg(r) AS baseline_revenue, avg(growth) AS m, stddev_samp(growth) AS s FROM lk WHERE k <= 12 GROUP BY 1 HAVING count(*) >= 12),
c AS (SELECT category, baseline_revenue, unnest(['base', 'optimistic', 'pessimistic']) AS scenario, unnest([m, m + s * 0.1, m - s * 0.1]) AS g FROM b), d AS (SELECT category, baseline_revenue, scenario, greatest(-15, least(15, g)) AS weekly_growth_pct FROM c)
SELECT *, baseline_revenue * (1 + weekly_growth_pct / 100) ^ 13 AS projected_revenue FROM d""", "baseline_revenue:4 weekly_growth_pct projected_revenue:2")


def _events(tx):
    return tx.sparkSession.sql("SELECT DATE '1996-03-01' AS start_date, DATE '1996-03-20' AS end_date UNION ALL SELECT DATE '1997-07-01', DATE '1997-07-15'")


register("event_slices", lambda tx: W_.event_slices(tx, _events(tx)).groupBy("phase", "category").agg(F.count("*").alias("lines")), """WITH e AS (SELECT * FROM (VALUES (DATE '1996-03-01', DATE '1996-03-20'), (DATE '1997-07-01', DATE '1997-07-15')) v(a, b)),
s AS (SELECT 'pre' AS phase, a - 30 AS x, a - 1 AS y FROM e UNION ALL SELECT 'event', a, b FROM e UNION ALL SELECT 'post', b + 1, b + 30 FROM e)
SELECT phase, category, count(*) AS lines FROM tx JOIN s ON CAST(date AS DATE) BETWEEN x AND y GROUP BY 1, 2""")
register("switching_by_phase", lambda tx: W_.switching_by_phase(tx, _events(tx), category_map(tx), min_transactions=2), None)
