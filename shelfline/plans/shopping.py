"""Queries on baskets, products, cohorts, affinity and switching."""

from pyspark.sql import functions as F

from ..operators import affinity as A
from ..operators import basket as B
from ..operators import cohort as C
from ..operators import features as X
from ..operators import performance as P
from ..operators import switching as S
from .base import register

R = "sum(price * quantity)"
FACTS = f"sum(quantity) AS units, {R} AS revenue, count(DISTINCT transaction_id) AS n_transactions, count(DISTINCT customer_id) AS n_customers"
ISO = "CAST(isoyear(date) * 100 + weekofyear(date) AS INTEGER)"
WEEK = "CAST(date_trunc('week', date) AS DATE)"
MONTH = "CAST(date_trunc('month', date) AS DATE)"

register("basket_penetration", B.basket_penetration, f"""
SELECT stockcode, count(DISTINCT transaction_id) AS basket_count, count(DISTINCT transaction_id) / (SELECT count(DISTINCT transaction_id) FROM tx) AS penetration,
  {R} / (SELECT {R} FROM tx) AS revenue_share FROM tx GROUP BY stockcode""", "penetration revenue_share")
register("basket_penetration_over_time", B.penetration_over_time, f"""
SELECT {WEEK} AS period, count(DISTINCT transaction_id) AS n_baskets, sum(quantity) / count(DISTINCT transaction_id) AS avg_basket_size, {R} / count(DISTINCT transaction_id) AS avg_basket_value
FROM tx GROUP BY 1""", "avg_basket_size avg_basket_value:5")
register("basket_composition", B.basket_composition, """
WITH s AS (SELECT transaction_id, count(DISTINCT stockcode) AS basket_size FROM tx GROUP BY 1)
SELECT basket_size, count(*) AS n_baskets, count(*) / (SELECT count(*) FROM s) AS pct FROM s GROUP BY 1""", "pct")
register("customer_entropy", B.customer_entropy, """
WITH c AS (SELECT customer_id, stockcode, count(*) AS n FROM tx GROUP BY 1, 2), t AS (SELECT customer_id, sum(n) AS total FROM c GROUP BY 1),
e AS (SELECT customer_id, count(*) AS n_distinct_products, -sum(n / total * ln(n / total)) AS entropy FROM c JOIN t USING (customer_id) GROUP BY 1),
b AS (SELECT customer_id, count(DISTINCT transaction_id) AS n_purchases FROM tx GROUP BY 1)
SELECT customer_id, n_distinct_products, n_purchases, entropy, CASE WHEN n_distinct_products > 1 THEN least(1, greatest(0, entropy / ln(n_distinct_products))) ELSE 0 END AS normalized_entropy
FROM e JOIN b USING (customer_id)""", "entropy normalized_entropy")
register("basket_size_variation", B.basket_size_variation, """
WITH p AS (SELECT DISTINCT transaction_id, stockcode FROM tx), s AS (SELECT transaction_id, count(*) AS size FROM p GROUP BY 1)
SELECT stockcode, avg(size) AS mean_ipt, stddev_pop(size) AS std_ipt, stddev_pop(size) / avg(size) AS cv_ipt, count(*) AS n_transactions FROM p JOIN s USING (transaction_id) GROUP BY 1""", "mean_ipt std_ipt cv_ipt")
register("revenue_control_chart", B.revenue_control_chart, f"""
WITH s AS (SELECT {WEEK} AS period, {R} AS revenue FROM tx GROUP BY 1),
c AS (SELECT *, CASE WHEN count(*) OVER w >= 4 THEN avg(revenue) OVER w END AS center, CASE WHEN count(*) OVER w >= 4 THEN stddev_samp(revenue) OVER w END AS sd
  FROM s WINDOW w AS (ORDER BY period ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, center + 2 * sd AS ucl, center - 2 * sd AS lcl, sign(revenue - center) AS side FROM c),
g AS (SELECT *, sum(CASE WHEN side = lagged THEN 0 ELSE 1 END) OVER (ORDER BY period) AS run FROM (SELECT *, lag(side) OVER (ORDER BY period) AS lagged FROM l)),
f AS (SELECT *, coalesce(revenue > ucl OR revenue < lcl, false) AS lim, count(*) OVER (PARTITION BY run) >= 7 AND coalesce(side <> 0, false) AS inrun FROM g)
SELECT period, revenue, center, ucl, lcl, lim OR inrun AS anomaly, CASE WHEN lim THEN 'limit' WHEN inrun THEN 'run' ELSE '' END AS rule FROM f""", "revenue:2 center:4 ucl:4 lcl:4")
BM = f"SELECT transaction_id, sum(quantity) AS basket_units, count(DISTINCT stockcode) AS basket_lines, count(DISTINCT stockcode) AS basket_distinct_skus, {R} AS basket_revenue FROM tx GROUP BY 1"
register("basket_metrics", B.basket_metrics, BM, "basket_units basket_revenue:2")
register("basket_summary", B.basket_summary, f"""
WITH m AS ({BM}), l AS (UNPIVOT (SELECT CAST(basket_units AS DOUBLE) AS basket_units, CAST(basket_lines AS DOUBLE) AS basket_lines, CAST(basket_distinct_skus AS DOUBLE) AS basket_distinct_skus, basket_revenue FROM m)
  ON basket_units, basket_lines, basket_distinct_skus, basket_revenue INTO NAME metric VALUE x)
SELECT metric, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS min, max(x) AS max FROM l GROUP BY 1""", "mean:5 median:5 std:4 min:2 max:2")

register("product_metrics", P.product_metrics, f"""
SELECT stockcode, {R} AS revenue, sum(quantity) AS units, count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers, {R} / sum(quantity) AS avg_price,
  count(DISTINCT transaction_id) / (SELECT count(DISTINCT transaction_id) FROM tx) AS penetration FROM tx GROUP BY 1""", "revenue:2 units:2 avg_price penetration")
ABC = f"""a AS (SELECT stockcode, {R} AS revenue FROM tx GROUP BY 1), abc AS (SELECT *, CASE WHEN cumulative_share <= 0.7 THEN 'A' WHEN cumulative_share <= 0.9 THEN 'B' ELSE 'C' END AS abc_class
  FROM (SELECT *, least(1, sum(revenue) OVER (ORDER BY revenue DESC, stockcode ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER ()) AS cumulative_share FROM a))"""
register("abc_analysis", P.abc_analysis, f"WITH {ABC} SELECT * FROM abc", "revenue:2 cumulative_share")
XYZ = f"""w AS (SELECT stockcode, {WEEK} AS p, sum(quantity) AS u, {R} AS r FROM tx GROUP BY 1, 2), ps AS (SELECT p, row_number() OVER (ORDER BY p) AS place FROM (SELECT DISTINCT p FROM w)),
k AS (SELECT DISTINCT stockcode FROM w), grid AS (SELECT k.stockcode, ps.place, coalesce(w.u, 0) AS u, coalesce(w.r, 0) AS r FROM k CROSS JOIN ps LEFT JOIN w ON w.stockcode = k.stockcode AND w.p = ps.p),
own AS (SELECT stockcode, sum(r) AS revenue, sum(u) AS units, stddev_pop(u) / avg(u) AS cv, max(CASE WHEN u > 0 THEN place END) - min(CASE WHEN u > 0 THEN place END) + 1 AS n_periods, count(*) FILTER (u > 0) AS nonzero_periods FROM grid GROUP BY 1),
xyz AS (SELECT *, (n_periods - nonzero_periods) / n_periods AS zero_demand_rate,
  CASE WHEN n_periods < 8 THEN 'Insufficient History' WHEN n_periods / nonzero_periods >= 1.32 AND cv >= 0.49 THEN 'Lumpy' WHEN n_periods / nonzero_periods >= 1.32 THEN 'Intermittent' WHEN cv >= 0.49 THEN 'Seasonal' ELSE 'Regular' END AS demand_profile,
  CASE WHEN n_periods < 8 THEN 'Z' WHEN cv <= 0.10 THEN 'X' WHEN cv <= 0.25 THEN 'Y' ELSE 'Z' END AS xyz_class FROM own)"""
register("xyz_analysis", P.xyz_analysis, f"WITH {XYZ} SELECT * FROM xyz", "revenue:2 units:2 cv zero_demand_rate")
LIFE = f"""e AS (SELECT max(p) AS recent, min(p) AS prior FROM (SELECT DISTINCT {WEEK} AS p FROM tx ORDER BY 1 DESC LIMIT 2)),
lr AS (SELECT stockcode, sum(CASE WHEN {WEEK} = recent THEN price * quantity ELSE 0 END) AS recent_revenue, sum(CASE WHEN {WEEK} = prior THEN price * quantity ELSE 0 END) AS prior_revenue FROM tx, e WHERE {WEEK} IN (recent, prior) GROUP BY 1),
life AS (SELECT *, CASE WHEN growth_pct > 25 THEN 'growth' WHEN growth_pct < -25 THEN 'decline' ELSE 'mature' END AS stage
  FROM (SELECT *, CASE WHEN prior_revenue > 0 THEN (recent_revenue - prior_revenue) * 100 / prior_revenue WHEN recent_revenue > 0 THEN 100 ELSE 0 END AS growth_pct FROM lr))"""
register("lifecycle_stage", P.lifecycle_stage, f"WITH {LIFE} SELECT * FROM life", "recent_revenue:2 prior_revenue:2 growth_pct:4")
VEL = "SELECT stockcode, sum(quantity) AS units, count(DISTINCT date) AS active_days, sum(quantity) / count(DISTINCT date) AS velocity FROM tx GROUP BY 1"
register("velocity", P.velocity, VEL, "units:2 velocity")
REP = "SELECT stockcode, count(*) AS n_customers, count(*) FILTER (n > 1) AS repeat_customers, count(*) FILTER (n > 1) / count(*) AS repeat_rate FROM (SELECT stockcode, customer_id, count(*) AS n FROM tx GROUP BY 1, 2) GROUP BY 1"
register("repeat_rate", P.repeat_rate, REP, "repeat_rate")
register("time_to_second_purchase", P.time_to_second_purchase, """
WITH r AS (SELECT stockcode, customer_id, date, row_number() OVER (PARTITION BY stockcode, customer_id ORDER BY date) AS k FROM tx),
d AS (SELECT a.stockcode, date_diff('day', CAST(a.date AS DATE), CAST(b.date AS DATE)) AS days FROM r a JOIN r b ON a.stockcode = b.stockcode AND a.customer_id = b.customer_id AND a.k = 1 AND b.k = 2)
SELECT stockcode, count(*) AS n_second_purchasers, quantile_cont(days, 0.5) AS median_days_to_second, avg(days) AS mean_days_to_second FROM d GROUP BY 1""", "median_days_to_second mean_days_to_second")
register("sku_rationalization", P.sku_rationalization, f"""
WITH {ABC}, {XYZ}, v AS ({VEL}), rr AS ({REP})
SELECT stockcode, abc.revenue, abc_class, xyz_class, velocity, repeat_rate,
  CASE WHEN demand_profile = 'Insufficient History' THEN 'review' WHEN abc_class = 'A' AND xyz_class IN ('X', 'Y') THEN 'keep' WHEN abc_class = 'C' AND xyz_class = 'Z' THEN 'delist_candidate' ELSE 'review' END AS action
FROM abc JOIN xyz USING (stockcode) JOIN v USING (stockcode) JOIN rr USING (stockcode)""", "revenue:2 velocity repeat_rate")

FIRST = f"f AS (SELECT customer_id, min({MONTH}) AS cohort FROM tx GROUP BY 1), cp AS (SELECT customer_id, {MONTH} AS period, {R} AS revenue FROM tx GROUP BY 1, 2), j AS (SELECT *, CAST(date_diff('month', cohort, period) AS INTEGER) AS period_index FROM cp JOIN f USING (customer_id))"
RET = f"{FIRST}, ret AS (SELECT *, retained / cohort_size AS retention_rate FROM (SELECT cohort, period_index, count(*) AS retained, max(CASE WHEN period_index = 0 THEN count(*) END) OVER (PARTITION BY cohort) AS cohort_size FROM j GROUP BY 1, 2))"
register("cohort_retention", C.cohorts, f"WITH {RET} SELECT * FROM ret", "retention_rate")
register("cohort_sizes", C.cohort_sizes, f"WITH {FIRST} SELECT cohort, count(DISTINCT customer_id) AS n_customers, count(DISTINCT transaction_id) AS n_transactions, {R} AS revenue FROM tx JOIN f USING (customer_id) GROUP BY 1", "revenue:2")
register("period_over_period", C.period_over_period, f"""
WITH p AS (SELECT {WEEK} AS period, {R} AS revenue, count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers, {R} / count(DISTINCT transaction_id) AS aov FROM tx GROUP BY 1)
SELECT *, (revenue / lag(revenue) OVER (ORDER BY period) - 1) * 100 AS revenue_growth, (aov / lag(aov) OVER (ORDER BY period) - 1) * 100 AS aov_growth FROM p""", "revenue:2 aov:5 revenue_growth:4 aov_growth:4")
register("year_over_year", C.year_over_year, f"""
WITH g AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(weekofyear(date) AS INTEGER) AS week, {R} AS revenue, count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers, {R} / count(DISTINCT transaction_id) AS aov FROM tx GROUP BY 1, 2),
m AS (SELECT max(year) AS last FROM g)
SELECT a.*, b.revenue AS prior_revenue, b.aov AS prior_aov, (a.revenue - b.revenue) / b.revenue * 100 AS revenue_yoy_growth, (a.aov - b.aov) / b.aov * 100 AS aov_yoy_growth
FROM g a JOIN m ON a.year = m.last LEFT JOIN g b ON b.year = m.last - 1 AND b.week = a.week""", "revenue:2 aov:5 prior_revenue:2 prior_aov:5 revenue_yoy_growth:4 aov_yoy_growth:4")
register("cohort_ltv_curve", C.cohort_ltv_curve, f"""
WITH {FIRST}, g AS (SELECT cohort, period_index, sum(revenue) AS r, count(*) AS n FROM j GROUP BY 1, 2)
SELECT cohort, period_index, sum(r) OVER w AS cumulative_revenue, sum(r) OVER w / max(CASE WHEN period_index = 0 THEN n END) OVER (PARTITION BY cohort) AS ltv_per_customer
FROM g WINDOW w AS (PARTITION BY cohort ORDER BY period_index ROWS UNBOUNDED PRECEDING)""", "cumulative_revenue:2 ltv_per_customer:5")
register("cohort_decay_rate", C.cohort_decay_rate, f"WITH {RET} SELECT cohort, -regr_slope(ln(greatest(retention_rate, 1e-6)), period_index) AS decay_rate FROM ret WHERE period_index > 0 GROUP BY 1 HAVING count(*) >= 2", "decay_rate")

register("dim_product", X.dim_product, f"""
SELECT stockcode, stockcode AS product, arg_min(category, (date, category)) AS category, arg_min(brand, (date, brand)) AS brand, {R} AS total_revenue, count(DISTINCT transaction_id) AS n_orders, count(*) AS n_line_items,
  count(DISTINCT customer_id) AS n_customers, sum(quantity) AS units, avg(price) AS avg_price, min(date) AS first_date, max(date) AS last_date FROM tx GROUP BY 1""", "total_revenue:2 units:2 avg_price")
register("product_lookup", X.product_lookup, "SELECT stockcode, stockcode AS product, arg_min(category, (date, category)) AS category, arg_min(brand, (date, brand)) AS brand, arg_min(size, (date, size)) AS size FROM tx GROUP BY 1")
register("fact_product_day", X.fact_product_day, f"SELECT stockcode, CAST(date AS DATE) AS date, {FACTS} FROM tx GROUP BY 1, 2", "units:2 revenue:2")
register("fact_product_week", X.fact_product_week, f"SELECT stockcode, {ISO} AS iso_week, {FACTS} FROM tx GROUP BY 1, 2", "units:2 revenue:2")
register("weekly_product_panel", X.weekly_product_panel, f"SELECT stockcode, {ISO} AS iso_week, {FACTS}, avg(price) AS avg_price, count(DISTINCT date) AS active_days FROM tx GROUP BY 1, 2", "units:2 revenue:2 avg_price")
register("weekly_units_by_category", lambda tx: X.weekly_agg(tx, ["category"], "quantity"), f"SELECT category, {ISO} AS iso_week, sum(quantity) AS quantity FROM tx GROUP BY 1, 2", "quantity:2")
register("fact_basket", X.fact_basket, f"""
SELECT transaction_id, arg_min(customer_id, (date, customer_id)) AS customer_id, min(date) AS date, sum(quantity) AS basket_size, count(DISTINCT stockcode) AS n_products, {R} AS basket_revenue,
  CAST(isoyear(min(date)) * 100 + weekofyear(min(date)) AS INTEGER) AS iso_week FROM tx GROUP BY 1""", "basket_size:2 basket_revenue:2")
register("fact_customer", X.fact_customer, f"""
SELECT customer_id, count(DISTINCT transaction_id) AS n_orders, count(*) AS n_line_items, count(DISTINCT stockcode) AS n_products, {R} AS total_revenue, min(date) AS first_date, max(date) AS last_date,
  CAST(date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) + 1 AS INTEGER) AS active_days, {R} / count(DISTINCT transaction_id) AS avg_order_value FROM tx GROUP BY 1""", "total_revenue:2 avg_order_value:5")
register("fact_customer_product", X.fact_customer_product, f"SELECT customer_id, stockcode, sum(quantity) AS units, {R} AS revenue, count(DISTINCT transaction_id) AS n_transactions FROM tx GROUP BY 1, 2", "units:2 revenue:2")
register("customer_sequence", X.customer_sequence, f"""
WITH days AS (SELECT DISTINCT customer_id, CAST(date AS DATE) AS d FROM tx),
l AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER (PARTITION BY customer_id ORDER BY d), d) <= 7 THEN 0 ELSE 1 END AS new FROM days),
q AS (SELECT customer_id, d, sum(new) OVER (PARTITION BY customer_id ORDER BY d) AS sequence_id FROM l), s AS (SELECT tx.*, q.d, sequence_id FROM tx JOIN q ON tx.customer_id = q.customer_id AND CAST(tx.date AS DATE) = q.d)
SELECT customer_id, CAST(sequence_id AS BIGINT) AS sequence_id, min(d) AS start_date, max(d) AS end_date, count(DISTINCT transaction_id) AS n_transactions, count(DISTINCT stockcode) AS n_products, {R} AS revenue,
  CAST(date_diff('day', min(d), max(d)) + 1 AS INTEGER) AS sequence_length_days FROM s GROUP BY 1, 2""", "revenue:2")

ITEMS = "i AS (SELECT DISTINCT transaction_id, stockcode FROM tx), n AS (SELECT stockcode, count(*) AS n FROM i GROUP BY 1), nn AS (SELECT count(DISTINCT transaction_id) AS n FROM tx)"
PAIRS = f"{ITEMS}, p AS (SELECT x.stockcode AS a, y.stockcode AS b, count(*) AS n_ab FROM i x JOIN i y ON x.transaction_id = y.transaction_id AND x.stockcode <> y.stockcode GROUP BY 1, 2), pc AS (SELECT a, b, n_ab, na.n AS n_a, nb.n AS n_b, nn.n AS n FROM p JOIN n na ON na.stockcode = a JOIN n nb ON nb.stockcode = b, nn)"
LIFT = f"{PAIRS}, lift AS (SELECT a AS anchor, b AS addon, n_ab / n AS support, n_ab / n_a AS confidence, n_ab * n / (n_a * n_b) AS lift, n_ab AS cooccurrence FROM pc)"
PHI = f"{PAIRS}, phi AS (SELECT a, b, n_ab, (CAST(n_ab AS DOUBLE) * n - CAST(n_a AS DOUBLE) * n_b) / sqrt(CAST(n_a AS DOUBLE) * (n - n_a) * n_b * (n - n_b)) AS affinity FROM pc WHERE a < b AND n_ab >= 5)"
register("addon_lift", A.lift_table, f"WITH {LIFT} SELECT * FROM lift", "support confidence lift")
MOST = "(SELECT stockcode FROM n ORDER BY n DESC, stockcode LIMIT 1)"
top_item = lambda tx: A.basket_items(tx).groupBy("stockcode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stockcode").first()[0]
register("addon_recommendations", lambda tx: A.addon_recommendations(tx, top_item(tx), min_lift=0.9), f"WITH {LIFT} SELECT * FROM lift WHERE anchor = {MOST} AND lift >= 0.9 ORDER BY lift DESC, support DESC, addon LIMIT 10", "support confidence lift")
register("addon_by_category", lambda tx: A.addon_by_category(tx, "ECONOMY", min_lift=0.5), f"""WITH {LIFT}, c AS (SELECT DISTINCT stockcode FROM tx WHERE category = 'ECONOMY')
SELECT * FROM lift WHERE anchor IN (SELECT * FROM c) AND addon NOT IN (SELECT * FROM c) AND lift >= 0.5 ORDER BY lift DESC, support DESC, anchor, addon LIMIT 10""", "support confidence lift")
register("anchor_addon_matrix", A.anchor_addon_matrix, f"WITH {LIFT}, t AS (SELECT anchor, count(*) AS n FROM lift GROUP BY 1 ORDER BY n DESC, anchor LIMIT 20) SELECT anchor, addon, lift FROM lift JOIN t USING (anchor)", "lift")
register("cooccurrence", A.cooccurrence, f"WITH {PAIRS} SELECT a, b, n_ab AS baskets FROM pc")
register("affinity", A.affinity, f"WITH {PHI} SELECT * FROM phi", "affinity")
register("top_affinity_pairs", A.top_affinity_pairs, f"WITH {PHI} SELECT * FROM phi WHERE affinity >= 0 ORDER BY affinity DESC, a, b LIMIT 20", "affinity")
register("product_affinity_profile", lambda tx: A.product_affinity_profile(tx, top_item(tx)), f"WITH {PHI} SELECT CASE WHEN a = {MOST} THEN b ELSE a END AS partner, n_ab, affinity FROM phi WHERE a = {MOST} OR b = {MOST} ORDER BY affinity DESC, partner LIMIT 10", "affinity")
CUST = "ci AS (SELECT DISTINCT customer_id, stockcode FROM tx), cn AS (SELECT stockcode, count(*) AS n FROM ci GROUP BY 1 HAVING count(*) >= 2), ct AS (SELECT count(DISTINCT customer_id) AS n FROM ci SEMI JOIN cn USING (stockcode)), cpair AS (SELECT x.stockcode AS a, y.stockcode AS b, count(*) AS n_ab FROM ci x JOIN ci y ON x.customer_id = y.customer_id AND x.stockcode < y.stockcode GROUP BY 1, 2), cc AS (SELECT a, b, n_ab, na.n AS n_a, nb.n AS n_b, ct.n AS n FROM cpair JOIN cn na ON na.stockcode = a JOIN cn nb ON nb.stockcode = b, ct)"
register("similarity_jaccard", lambda tx: A.similarity(tx, "jaccard"), f"WITH {CUST} SELECT a, b, n_ab / (n_a + n_b - n_ab) AS similarity FROM cc WHERE n_ab >= 5", "similarity")
register("similarity_cosine", lambda tx: A.similarity(tx, "cosine"), f"WITH {CUST} SELECT a, b, n_ab / sqrt(CAST(n_a AS DOUBLE) * n_b) AS similarity FROM cc", "similarity")
register("similarity_pmi", lambda tx: A.similarity(tx, "pmi"), f"WITH {CUST} SELECT a, b, CASE WHEN n_ab = n THEN 1 ELSE greatest(0, least(1, ln(n_ab * n / (n_a * n_b)) / -ln(n_ab / n))) END AS similarity FROM cc WHERE n_ab >= 5", "similarity")

SEQ = """b AS (SELECT customer_id, transaction_id, min(date) AS date, list_sort(list(DISTINCT stockcode)) AS products FROM tx GROUP BY 1, 2),
s0 AS (SELECT *, lag(products) OVER w AS prev_products, lag(date) OVER w AS prev_date FROM b WINDOW w AS (PARTITION BY customer_id ORDER BY date, transaction_id)),
s1 AS (SELECT *, floor((epoch(date) - epoch(prev_date)) / 86400) AS gap FROM s0 WHERE prev_products IS NOT NULL)"""
SW = f"""{SEQ}, s2 AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS k FROM s1 WHERE gap <= 90),
mv AS (SELECT from_product, unnest(products) AS to_product FROM (SELECT unnest(prev_products) AS from_product, products FROM s2 WHERE k >= 2)),
sw AS (SELECT from_product, to_product, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY from_product) AS pct FROM mv WHERE from_product <> to_product GROUP BY 1, 2)"""
register("switching_matrix", S.switching_matrix, f"WITH {SW} SELECT * FROM sw", "pct")
CATS = "cm AS (SELECT stockcode, arg_min(category, (date, category)) AS category FROM tx GROUP BY 1)"
register("category_switching", lambda tx: S.category_switching(tx, X.category_map(tx)), f"""WITH {SW}, {CATS}
SELECT x.category AS from_category, y.category AS to_category, CAST(sum(count) AS BIGINT) AS count, count(*) AS product_pairs, sum(count) / sum(sum(count)) OVER () AS pct
FROM sw JOIN cm x ON x.stockcode = from_product JOIN cm y ON y.stockcode = to_product GROUP BY 1, 2""", "pct")
register("top_switching_paths", S.top_switching_paths, f"WITH {SW} SELECT * FROM sw ORDER BY count DESC, from_product, to_product LIMIT 20", "pct")
register("loyalty_metrics", S.loyalty_metrics, f"""WITH {SEQ}, ch AS (SELECT customer_id, count(*) AS c FROM s1 WHERE gap <= 90 AND products <> prev_products GROUP BY 1),
o AS (SELECT customer_id, count(*) AS n_transactions, avg(len(products)) AS avg_basket_size FROM b GROUP BY 1),
r AS (SELECT customer_id, count(*) FILTER (n > 1) / count(*) AS repeat_purchase_rate, count(*) AS n_distinct_products FROM (SELECT customer_id, stockcode, count(*) AS n FROM tx GROUP BY 1, 2) GROUP BY 1)
SELECT customer_id, n_transactions, avg_basket_size, repeat_purchase_rate, n_distinct_products, coalesce(c, 0) AS switching_count, CASE WHEN n_transactions > 1 THEN least(1, coalesce(c, 0) / (n_transactions - 1)) ELSE 0 END AS switching_rate
FROM o JOIN r USING (customer_id) LEFT JOIN ch USING (customer_id)""", "avg_basket_size repeat_purchase_rate switching_rate")
register("switch_in_out_rates", lambda tx: S.in_out_rates(S.switching_matrix(tx), tx), f"""WITH {SW}, c AS (SELECT stockcode, count(DISTINCT customer_id) AS c FROM tx GROUP BY 1),
o AS (SELECT from_product AS stockcode, count(*) AS n_switchers_out FROM sw GROUP BY 1), i AS (SELECT to_product AS stockcode, count(*) AS n_switchers_in FROM sw GROUP BY 1)
SELECT stockcode, coalesce(n_switchers_out, 0) / c AS switch_out_rate, coalesce(n_switchers_in, 0) / c AS switch_in_rate, coalesce(n_switchers_in, 0) / c - coalesce(n_switchers_out, 0) / c AS net_rate,
  coalesce(n_switchers_out, 0) AS n_switchers_out, coalesce(n_switchers_in, 0) AS n_switchers_in FROM c LEFT JOIN o USING (stockcode) LEFT JOIN i USING (stockcode)""", "switch_out_rate switch_in_rate net_rate")
DT = f"{SW}, rv AS (SELECT stockcode, {R} AS r, {R} / sum({R}) OVER () AS s FROM tx GROUP BY 1), dt AS (SELECT from_product, to_product, pct AS switch_rate, s AS revenue_share_from, pct * s AS observed_switching_transference, pct * r AS observed_switching_transfer_revenue FROM sw JOIN rv ON stockcode = from_product)"
register("demand_transference", S.demand_transference, f"WITH {DT} SELECT * FROM dt", "switch_rate revenue_share_from observed_switching_transference observed_switching_transfer_revenue:2")
register("substitutable_demand", lambda tx: S.substitutable_demand(S.demand_transference(tx), tx), f"WITH {DT}, g AS (SELECT from_product, sum(observed_switching_transfer_revenue) AS t FROM dt GROUP BY 1) SELECT stockcode, least(1, coalesce(t / r, 0)) AS sdp FROM rv LEFT JOIN g ON from_product = stockcode", "sdp")
register("recovery_hhi", lambda tx: S.recovery_hhi(S.demand_transference(tx)), f"""WITH {DT}, h AS (SELECT *, count / sum(count) OVER (PARTITION BY from_product) AS s FROM sw)
SELECT from_product, sum(s * s) AS recovery_hhi, count(*) AS n_substitutes, arg_min(to_product, (-count, to_product)) AS top_substitute, max(s) AS top_share FROM h GROUP BY 1""", "recovery_hhi top_share")
SMALL = f"(SELECT stockcode FROM tx GROUP BY 1 ORDER BY {R}, stockcode LIMIT 10)"
small = lambda tx: tx.groupBy("stockcode").agg(F.sum(F.col("price") * F.col("quantity")).alias("r")).orderBy("r", "stockcode").limit(10).select("stockcode")
register("delist_impact", lambda tx: S.delist_impact(tx, S.demand_transference(tx), small(tx)), f"""WITH {DT}, g AS (SELECT from_product, sum(observed_switching_transfer_revenue) AS t FROM dt GROUP BY 1)
SELECT stockcode, r AS product_revenue, coalesce(t, 0) AS estimated_revenue_recovered, coalesce(t, 0) - r AS net_revenue_impact, coalesce(t, 0) / r AS recovery_rate FROM rv LEFT JOIN g ON from_product = stockcode WHERE stockcode IN {SMALL}""", "product_revenue:2 estimated_revenue_recovered:2 net_revenue_impact:2 recovery_rate")
register("node_delist_impact", lambda tx: S.node_delist_impact(tx, S.demand_transference(tx), X.category_map(tx).select("stockcode", F.col("category").alias("node_id"))), f"""WITH {DT}, {CATS},
f AS (SELECT x.category AS node_id, sum(CASE WHEN x.category = y.category THEN observed_switching_transfer_revenue ELSE 0 END) AS internal_recovery, sum(CASE WHEN x.category <> y.category THEN observed_switching_transfer_revenue ELSE 0 END) AS external_leakage
  FROM dt JOIN cm x ON x.stockcode = from_product JOIN cm y ON y.stockcode = to_product GROUP BY 1)
SELECT category AS node_id, count(*) AS n_products, sum(r) AS total_node_revenue, coalesce(any_value(internal_recovery), 0) AS internal_recovery, coalesce(any_value(external_leakage), 0) AS external_leakage, coalesce(any_value(internal_recovery), 0) / sum(r) AS node_sdp
FROM cm JOIN rv USING (stockcode) LEFT JOIN f ON node_id = category GROUP BY 1""", "total_node_revenue:2 internal_recovery:2 external_leakage:2 node_sdp")
