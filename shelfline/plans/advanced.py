"""Queries on rules, networks, chains, assortments, data quality, attributes, insights, models and events."""

import uuid

from pyspark.sql import functions as F

from ..functions.store import shared_dir
from ..operators import affinity as A
from ..operators import assortment as T
from ..operators import attributes as X
from ..operators import clv as V
from ..operators import features as D
from ..operators import insights as I
from ..operators import loops as L
from ..operators import models as N
from ..operators import quality as Q
from ..operators import rules as U
from ..operators import switching as S
from ..streaming import events as E
from .base import register
from .shopping import ABC, CATS, DT, ITEMS, LIFE, LIFT, PAIRS, PHI, R, WEEK, XYZ

SUPPORT, CONFIDENCE = 0.002, 0.03


def mined(tx, max_len=2):
    sets, n = U.frequent_itemsets(tx, SUPPORT, max_len)
    return U.generate_rules(sets, n, CONFIDENCE)


def named(rules):
    return rules.withColumns({"antecedents": F.array_join("antecedents", "|"), "consequents": F.array_join("consequents", "|")})


RULES = f"""{PAIRS}, ru AS (SELECT a AS antecedents, b AS consequents, n_a / n AS antecedent_support, n_b / n AS consequent_support, n_ab / n AS support, n_ab / n_a AS confidence, n_ab * n / (n_a * n_b) AS lift, n_ab / n - (n_a / n) * (n_b / n) AS leverage FROM pc WHERE n_ab >= {SUPPORT} * n),
rules AS (SELECT *, (1 - consequent_support) / (1 - confidence) AS conviction, leverage / greatest(support * (1 - antecedent_support), antecedent_support * (consequent_support - support)) AS zhangs_metric FROM ru WHERE confidence >= {CONFIDENCE})"""
RD = "antecedent_support consequent_support support confidence lift leverage conviction zhangs_metric"
register("association_rules", lambda tx: named(mined(tx)), f"WITH {RULES} SELECT * FROM rules", RD)
register("association_rules_filtered", lambda tx: named(U.filter_rules(mined(tx), min_support=0.003, min_lift=0.5)), f"WITH {RULES} SELECT * FROM rules WHERE support >= 0.003 AND lift >= 0.5 AND lift <= 100", RD)
register("association_rule_text", lambda tx: U.rules_to_table(mined(tx)).select("rule", "lift"), f"WITH {RULES} SELECT antecedents || ' -> ' || consequents AS rule, lift FROM rules", "lift")
register("frequent_itemsets", lambda tx: U.frequent_itemsets(tx, 0.0005, 3)[0].select(F.array_join("items", "|").alias("items"), "freq"), f"""WITH {ITEMS},
one AS (SELECT stockcode AS items, n.n AS freq, 1 AS k FROM n), two AS (SELECT x.stockcode || '|' || y.stockcode AS items, count(*) AS freq FROM i x JOIN i y ON x.transaction_id = y.transaction_id AND x.stockcode < y.stockcode GROUP BY 1),
three AS (SELECT x.stockcode || '|' || y.stockcode || '|' || z.stockcode AS items, count(*) AS freq FROM i x JOIN i y ON x.transaction_id = y.transaction_id AND x.stockcode < y.stockcode JOIN i z ON x.transaction_id = z.transaction_id AND y.stockcode < z.stockcode GROUP BY 1)
SELECT items, freq FROM (SELECT items, freq FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) s, nn WHERE freq >= ceil(0.0005 * nn.n)""")
register("redundant_rules", lambda tx: named(U.flag_redundant(U.generate_rules(*U.frequent_itemsets(tx, 0.0005, 3), 0.01))).select("antecedents", "consequents", "is_redundant"), None)
register("rule_lift_interval", lambda tx: named(U.lift_interval(tx, mined(tx).where("lift > 0.8"), 50)), None)
register("false_discovery_rate", lambda tx: U.benjamini_hochberg(A.lift_table(tx).where("anchor < addon").select(F.concat_ws("|", "anchor", "addon").alias("pair"), F.exp(-F.col("lift") * F.col("cooccurrence") / 100).alias("p_value")), "pair", "p_value"), f"""WITH {LIFT}, pv AS (SELECT anchor || '|' || addon AS pair, exp(-lift * cooccurrence / 100) AS p_value FROM lift WHERE anchor < addon),
r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, pair) AS q FROM pv) SELECT pair, p_value, least(1, min(q) OVER (ORDER BY p_value, pair ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM r""", "p_value:9 q_value:9")


def graph(tx):
    return A.affinity(tx, 5).where("affinity > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("affinity").alias("weight"))


def chain(tx):
    return S.switching_matrix(tx).select(F.col("from_product").alias("src"), F.col("to_product").alias("dst"), F.col("pct").alias("p"))


register("co_purchase_network", lambda tx: L.pagerank(graph(tx)), None)
register("switching_network", lambda tx: L.pagerank(S.switching_matrix(tx).select(F.col("from_product").alias("src"), F.col("to_product").alias("dst"), F.col("count").alias("weight")), directed=True), None)
register("communities", lambda tx: L.label_propagation(graph(tx)), None)
register("community_modularity", lambda tx: L.modularity(graph(tx), D.category_map(tx).select(F.col("stockcode").alias("node"), F.col("category").alias("community"))), f"""WITH {PHI}, {CATS}, e AS (SELECT affinity AS w, x.category AS ca, y.category AS cb FROM phi JOIN cm x ON x.stockcode = a JOIN cm y ON y.stockcode = b WHERE affinity > 0),
m AS (SELECT sum(w) AS m, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS inside FROM e), d AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY 1)
SELECT any_value(inside) / any_value(m) - sum(d * d) / (4 * any_value(m) * any_value(m)) AS modularity, count(*) AS n_communities FROM d, m""", "modularity")
register("markov_steady_state", lambda tx: L.steady_state(chain(tx)), None)
register("markov_substitution", lambda tx: L.markov_substitution(chain(tx)), None)

KEEP = f"ks AS (SELECT stockcode, row_number() OVER (ORDER BY {R} DESC, stockcode) AS k FROM tx GROUP BY 1)"


def scenarios(tx):
    top = tx.groupBy("stockcode").agg(F.sum(F.col("price") * F.col("quantity")).alias("r"))
    ranked = top.withColumn("k", F.expr("row_number() OVER (ORDER BY r DESC, stockcode)"))
    return ranked.select("stockcode", F.explode(F.filter(F.array(F.lit(10), F.lit(30), F.lit(50)), lambda s: s >= F.col("k"))).alias("scenario_id"))


register("assortment_scenarios", lambda tx: T.evaluate_assortments(scenarios(tx), tx, S.demand_transference(tx)), f"""WITH {DT}, {KEEP}, sc AS (SELECT unnest([10, 30, 50]) AS scenario_id), o AS (SELECT stockcode, {R} AS r, min(category) AS c FROM tx GROUP BY 1), ev AS (SELECT scenario_id, o.*, k <= scenario_id AS kept FROM o JOIN ks USING (stockcode), sc),
ba AS (SELECT scenario_id, count(*) FILTER (kept) AS n_skus, count(DISTINCT c) FILTER (kept) AS n_categories, sum(r) FILTER (kept) AS kept_revenue, coalesce(sum(r) FILTER (NOT kept), 0) AS lost_revenue, sum(r) AS total FROM ev GROUP BY 1),
rc AS (SELECT x.scenario_id, sum(observed_switching_transfer_revenue) AS rec FROM dt JOIN ev x ON x.stockcode = from_product AND NOT x.kept JOIN ev y ON y.stockcode = to_product AND y.kept AND y.scenario_id = x.scenario_id GROUP BY 1)
SELECT scenario_id, n_skus, n_categories, kept_revenue, lost_revenue, coalesce(rec, 0) AS recovered_revenue, lost_revenue - coalesce(rec, 0) AS unmet_revenue, (kept_revenue + coalesce(rec, 0)) / total AS coverage FROM ba LEFT JOIN rc USING (scenario_id)""", "kept_revenue:2 lost_revenue:2 recovered_revenue:2 unmet_revenue:2 coverage")
GREEDY = f"{DT}, o AS (SELECT stockcode, {R} AS revenue, min(category) AS category FROM tx GROUP BY 1), it AS (SELECT to_product AS stockcode, sum(observed_switching_transfer_revenue) AS rec FROM dt GROUP BY 1)"
register("assortment_greedy", lambda tx: T.greedy_assortment(tx, S.demand_transference(tx)), f"""WITH {GREEDY}, s AS (SELECT stockcode, category, revenue, coalesce(rec, 0) AS recovery, revenue + 0.30 * coalesce(rec, 0) AS score FROM o LEFT JOIN it USING (stockcode)),
f AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, stockcode) = 1 AS fl FROM s), k AS (SELECT CAST(row_number() OVER (ORDER BY fl DESC, score DESC, stockcode) AS INTEGER) AS rank, stockcode, category, revenue, recovery, score FROM f) SELECT * FROM k WHERE rank <= 30""", "revenue:2 recovery:2 score:2")
register("delist_table", lambda tx: T.delist_table(tx, S.demand_transference(tx)), f"""WITH {DT}, k AS (SELECT *, row_number() OVER (PARTITION BY from_product ORDER BY observed_switching_transfer_revenue DESC, to_product) AS k FROM dt),
g AS (SELECT from_product, sum(observed_switching_transfer_revenue) AS e, string_agg(to_product, ',' ORDER BY k) FILTER (k <= 3) AS substitutes, count(*) AS c FROM k GROUP BY 1),
t AS (SELECT stockcode, r AS revenue_at_risk, coalesce(e, 0) AS estimated_recovery, coalesce(substitutes, '') AS substitutes, coalesce(c, 0) AS n_substitutes, least(1, coalesce(e, 0) / r) AS recovery_rate FROM rv LEFT JOIN g ON from_product = stockcode),
l AS (SELECT *, CASE WHEN n_substitutes = 0 THEN 1 WHEN n_substitutes < 3 THEN 2 WHEN recovery_rate < 0.5 THEN 3 WHEN recovery_rate < 0.8 THEN 4 ELSE 5 END AS evidence_level FROM t) SELECT *, CASE WHEN evidence_level >= 4 THEN 'DELIST' ELSE 'KEEP' END AS recommendation FROM l""", "revenue_at_risk:2 estimated_recovery:2 recovery_rate")

register("data_summary", Q.data_summary, f"SELECT count(*) AS n_lines, count(DISTINCT transaction_id) AS n_transactions, count(DISTINCT customer_id) AS n_customers, count(DISTINCT stockcode) AS n_products, {R} AS total_revenue, sum(quantity) / count(DISTINCT transaction_id) AS avg_basket_size, {R} / count(DISTINCT transaction_id) AS avg_basket_value, min(date) AS first_date, max(date) AS last_date FROM tx", "total_revenue:2 avg_basket_size avg_basket_value:5")
register("capabilities", Q.capabilities, """WITH p AS (SELECT stockcode, stddev_samp(price) / avg(price) AS cv, count(DISTINCT price) AS k FROM tx GROUP BY 1)
SELECT max(cv) >= 0.05 AS has_price_variation, max(k) >= 3 AS has_distinct_prices, (SELECT count(DISTINCT transaction_id) >= 100 FROM tx) AS enough_baskets, (SELECT count(DISTINCT customer_id) >= 50 FROM tx) AS enough_customers, (SELECT count(*) >= 1000 FROM tx) AS enough_lines,
true AS has_category, true AS has_brand, true AS has_size, false AS has_flavor, false AS has_variant, false AS has_promo_flag, false AS has_cost, false AS has_is_online, false AS has_channel, true AS has_customer_id FROM p""")
register("quality_report", Q.quality_report, """WITH p AS (SELECT count(*) AS n_products, count(*) FILTER (n < 50) AS low_frequency_products FROM (SELECT stockcode, count(DISTINCT transaction_id) AS n FROM tx GROUP BY 1)), s AS (SELECT transaction_id, sum(quantity) AS s FROM tx GROUP BY 1), e AS (SELECT quantile_cont(s, 0.99) AS edge FROM s),
b AS (SELECT count(*) AS n_baskets, count(*) FILTER (s > edge) AS outlier_baskets, max(edge) AS basket_size_limit FROM s, e), l AS (SELECT CAST(sum(k) AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS incomplete_lines, CAST(sum(k - 1) AS BIGINT) AS duplicate_lines FROM (SELECT count(*) AS k FROM tx GROUP BY date, transaction_id, stockcode, customer_id, price, quantity))
SELECT *, 0.25 * least(1, n_lines / 1000) + 0.25 * (1 - low_frequency_products / n_products) + 0.15 * (1 - outlier_baskets / n_baskets) + 0.15 + 0.10 * (1 - duplicate_lines / n_lines) + 0.10 AS quality_score FROM p, b, l""", "basket_size_limit quality_score")
register("filter_by_quality", lambda tx: Q.filter_by_quality(tx).groupBy("stockcode").agg(F.count("*").alias("lines")), """WITH rare AS (SELECT stockcode FROM tx GROUP BY 1 HAVING count(DISTINCT transaction_id) < 50), s AS (SELECT transaction_id, sum(quantity) AS s FROM tx GROUP BY 1), big AS (SELECT transaction_id FROM s WHERE s > (SELECT quantile_cont(s, 0.99) FROM s))
SELECT stockcode, count(*) AS lines FROM tx WHERE stockcode NOT IN (SELECT * FROM rare) AND transaction_id NOT IN (SELECT * FROM big) GROUP BY 1""")
register("contract_check", lambda tx: Q.check_contract(tx, ["date", "price"], {"price > 0": F.col("price") > 0, "quantity < 40": F.col("quantity") < 40, "discount <= 0.05": F.col("discount") <= 0.05}), "SELECT unnest(['price > 0', 'quantity < 40', 'discount <= 0.05']) AS rule, unnest([count(*) FILTER (NOT price > 0), count(*) FILTER (NOT quantity < 40), count(*) FILTER (NOT discount <= 0.05)]) AS violations FROM tx")

THIRD = lambda v, a, b, c, t: f"CASE WHEN {v} <= (SELECT quantile_cont({v}, 1/3) FROM {t}) THEN '{a}' WHEN {v} <= (SELECT quantile_cont({v}, 2/3) FROM {t}) THEN '{b}' ELSE '{c}' END"
register("velocity_tier", X.velocity_tier, f"WITH m AS (SELECT stockcode, sum(quantity) / count(DISTINCT date_trunc('month', date)) AS units_per_month FROM tx GROUP BY 1) SELECT *, {THIRD('units_per_month', 'Slow-Moving', 'Medium', 'Fast-Moving', 'm')} AS velocity_tier FROM m", "units_per_month")
DEPTH = f"p AS (SELECT DISTINCT transaction_id, stockcode FROM tx), z AS (SELECT transaction_id, count(*) AS k FROM p GROUP BY 1), bd AS (SELECT stockcode, avg(k) AS basket_depth FROM p JOIN z USING (transaction_id) GROUP BY 1), bt AS (SELECT *, {THIRD('basket_depth', 'Top-Up', 'Regular', 'Stock-Up', 'bd')} AS mission_tier FROM bd)"
register("basket_tier", X.basket_tier, f"WITH {DEPTH} SELECT * FROM bt", "basket_depth")
register("basket_missions", X.basket_missions, f"WITH {DEPTH}, n AS (SELECT transaction_id, mission_tier, count(*) AS n FROM p JOIN bt USING (stockcode) GROUP BY 1, 2) SELECT transaction_id, arg_min(mission_tier, (-n, mission_tier)) AS mission FROM n GROUP BY 1")
register("seasonality_class", X.seasonality_class, """WITH ms AS (SELECT DISTINCT date_trunc('month', date) AS m FROM tx), k AS (SELECT DISTINCT stockcode FROM tx), u AS (SELECT stockcode, date_trunc('month', date) AS m, sum(quantity) AS u FROM tx GROUP BY 1, 2),
g AS (SELECT stockcode, stddev_samp(coalesce(u, 0)) / avg(coalesce(u, 0)) AS monthly_cv, count(u) / count(*) AS activity FROM k CROSS JOIN ms LEFT JOIN u USING (stockcode, m) GROUP BY 1)
SELECT *, CASE WHEN activity < 0.3 THEN 'Sporadic' WHEN monthly_cv >= 0.35 THEN 'Seasonal' ELSE 'Steady' END AS seasonality FROM g""", "monthly_cv activity")


def groups(tx):
    return D.category_map(tx).select("stockcode", F.col("category").alias("group"))


def tiers(tx):
    return X.velocity_tier(tx).join(X.basket_tier(tx), "stockcode").join(D.product_lookup(tx).select("stockcode", "brand"), "stockcode")


register("split_quality", lambda tx: X.split_quality(groups(tx), tiers(tx), ["velocity_tier", "mission_tier", "brand"]), f"""WITH {CATS}, {DEPTH}, m AS (SELECT stockcode, sum(quantity) / count(DISTINCT date_trunc('month', date)) AS upm FROM tx GROUP BY 1), vt AS (SELECT stockcode, {THIRD('upm', 'S', 'M', 'F', 'm')} AS v FROM m), br AS (SELECT stockcode, arg_min(brand, (date, brand)) AS v FROM tx GROUP BY 1),
l AS (SELECT 'velocity_tier' AS attribute, v AS value, category AS grp FROM vt JOIN cm USING (stockcode) UNION ALL SELECT 'mission_tier', mission_tier, category FROM bt JOIN cm USING (stockcode) UNION ALL SELECT 'brand', v, category FROM br JOIN cm USING (stockcode)),
c AS (SELECT attribute, value, grp, count(*) AS n FROM l GROUP BY 1, 2, 3), j AS (SELECT *, sum(n) OVER (PARTITION BY attribute, value) AS nv, sum(n) OVER (PARTITION BY attribute, grp) AS ng, sum(n) OVER (PARTITION BY attribute) AS t FROM c),
b AS (SELECT attribute, sum((ng / t) ^ 2) AS b FROM (SELECT DISTINCT attribute, grp, ng, t FROM j) GROUP BY 1)
SELECT attribute, sum(n / t * log2(n * t / (nv * ng))) AS mutual_information, sum(n * n / (nv * t)) - any_value(b) AS gini_gain FROM j JOIN b USING (attribute) GROUP BY 1""", "mutual_information gini_gain")
register("grouping_agreement", lambda tx: X.agreement(groups(tx), X.velocity_tier(tx).select("stockcode", F.col("velocity_tier").alias("group"))), f"""WITH {CATS}, m AS (SELECT stockcode, sum(quantity) / count(DISTINCT date_trunc('month', date)) AS upm FROM tx GROUP BY 1), j AS (SELECT category AS x, {THIRD('upm', 'S', 'M', 'F', 'm')} AS y FROM m JOIN cm USING (stockcode)),
c AS (SELECT count(*) AS n FROM j GROUP BY x, y), xs AS (SELECT count(*) AS n FROM j GROUP BY x), ys AS (SELECT count(*) AS n FROM j GROUP BY y), t AS (SELECT count(*) AS t FROM j),
a AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM xs) AS i, (SELECT sum(n * (n - 1) / 2) FROM ys) AS jj, t, (SELECT -sum(n / t * ln(n / t)) FROM xs) AS hx, (SELECT -sum(n / t * ln(n / t)) FROM ys) AS hy, (SELECT -sum(n / t * ln(n / t)) FROM c) AS hxy FROM t)
SELECT (ij - i * jj / (t * (t - 1) / 2)) / ((i + jj) / 2 - i * jj / (t * (t - 1) / 2)) AS ari, 2 * (hx + hy - hxy) / (hx + hy) AS nmi FROM a""", "ari nmi")

RC = f"rc AS (SELECT {WEEK} AS week, {R} AS revenue, count(DISTINCT customer_id) AS customers, count(DISTINCT transaction_id) / count(DISTINCT customer_id) AS frequency, sum(quantity) / count(DISTINCT transaction_id) AS basket_size, {R} / sum(quantity) AS unit_price FROM tx GROUP BY 1)"
register("revenue_components", I.revenue_components, f"WITH {RC} SELECT * FROM rc", "revenue:2 frequency basket_size unit_price:5")
LAST = ", ".join(f"ln({c}) - ln(lag({c}) OVER (ORDER BY week)) AS {c}" for c in ("revenue", "customers", "frequency", "basket_size", "unit_price"))
register("growth_attribution", I.growth_attribution, f"""WITH {RC}, d AS (SELECT week, {LAST} FROM rc ORDER BY week DESC LIMIT 1) SELECT unnest(['customers', 'frequency', 'basket_size', 'unit_price']) AS component, unnest([customers, frequency, basket_size, unit_price]) AS log_change, unnest([customers / revenue, frequency / revenue, basket_size / revenue, unit_price / revenue]) AS share FROM d""", "log_change share")
register("concentration", I.concentration, f"WITH o AS (SELECT stockcode, {R} / (SELECT {R} FROM tx) AS s FROM tx GROUP BY 1), k AS (SELECT s, row_number() OVER (ORDER BY s DESC, stockcode) AS k FROM o) SELECT sum(s) FILTER (k <= 10) AS top_share, sum(s * s) AS hhi FROM k", "top_share hhi")
PEN = "pen AS (SELECT stockcode, count(DISTINCT transaction_id) / (SELECT count(DISTINCT transaction_id) FROM tx) AS penetration FROM tx GROUP BY 1)"
register("basket_insights", I.basket_insights, f"""WITH {PEN}, lo AS (SELECT * FROM pen WHERE penetration < 0.05 ORDER BY penetration, stockcode LIMIT 5), hi AS (SELECT * FROM pen WHERE penetration >= 0.5 ORDER BY penetration DESC, stockcode LIMIT 5)
SELECT 'basket' AS area, 'low_penetration' AS kind, stockcode AS subject, 'Few baskets hold this product' AS text, penetration AS value, 'info' AS severity FROM lo UNION ALL SELECT 'basket', 'high_penetration', stockcode, 'Most baskets hold this product', penetration, 'info' FROM hi""", "value")
register("product_insights", I.product_insights, f"""WITH {ABC}, {XYZ}, {LIFE}, r AS (SELECT stockcode, abc.revenue, abc_class, xyz_class, demand_profile FROM abc JOIN xyz USING (stockcode))
SELECT 'product' AS area, 'delist' AS kind, stockcode AS subject, 'Little revenue and erratic demand' AS text, revenue AS value, 'warning' AS severity FROM r WHERE abc_class = 'C' AND xyz_class = 'Z' AND demand_profile <> 'Insufficient History'
UNION ALL SELECT 'product', 'volatile', stockcode, 'A seller with erratic demand', revenue, 'warning' FROM r WHERE xyz_class = 'Z' AND abc_class = 'A' UNION ALL SELECT 'product', 'decline', stockcode, 'Revenue fell by more than a quarter in a week', growth_pct, 'warning' FROM life WHERE stage = 'decline'""", "value:4")
register("overview_insights", I.overview_insights, None)
register("decision_center", I.decision_center, None)
register("cross_sell_opportunities", lambda tx: I.cross_sell_opportunities(A.lift_table(tx), tx, 0.9, 5), f"WITH {LIFT}, o AS (SELECT stockcode, {R} AS r FROM tx GROUP BY 1) SELECT anchor, addon, lift, cooccurrence, 0.01 * (lift - 1) * r AS impact FROM lift JOIN o ON stockcode = addon WHERE lift >= 0.9 AND cooccurrence >= 5 ORDER BY impact DESC, anchor, addon LIMIT 10", "lift impact:2")
register("clv_bg_nbd", V.predict_clv, None)
register("purchase_summary", V.purchase_summary, f"""WITH d AS (SELECT customer_id, CAST(date AS DATE) AS d, {R} AS r FROM tx GROUP BY 1, 2), o AS (SELECT customer_id, min(d) AS a, max(d) AS b, count(*) AS n, sum(r) AS s, arg_min(r, d) AS f FROM d GROUP BY 1)
SELECT customer_id, n - 1 AS frequency, CAST(date_diff('day', a, b) AS INTEGER) AS recency, CAST(date_diff('day', a, (SELECT max(d) FROM d)) AS INTEGER) AS T, CASE WHEN n > 1 THEN (s - f) / (n - 1) ELSE 0 END AS monetary_value FROM o""", "monetary_value:3")
register("retention_opportunities", lambda tx: I.retention_opportunities(V.predict_clv(tx)), None)
register("behavioral_segments", N.behavioral_segments, None)
register("choice_model", lambda tx: N.train_choice_model(N.choice_features(tx, 365))[1], None)


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


register("event_windows", None, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n_events, sum(value) AS value FROM events GROUP BY 1, 2", "value:3", source=lambda s, d: E.windowed_events(_events(s, d)).drop("n_users"))
register("event_sessions", None, """WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 7 DAY THEN 0 ELSE 1 END AS o FROM events), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 7 DAY AS "end", count(*) AS n_events, sum(value) AS value FROM g GROUP BY user_id, k""", "value:3", source=lambda s, d: E.sessions(_events(s, d)))


def _totals(spark, sf_dir):
    """The stream over the events table, run to its end, and the last totals it wrote."""
    folder = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    E.run_to_parquet(E.running_totals(stream), f"{folder}/out", f"{folder}/checkpoint")
    return E.latest_totals(spark.read.schema(E.TOTALS).parquet(f"{folder}/out"))


register("event_running_totals", None, "SELECT user_id, count(*) AS n_events, coalesce(sum(value), 0) AS value, CAST(max(ts) AS TIMESTAMP) AS last_ts FROM events GROUP BY 1", "value:3", source=_totals)
register("event_control_limits", None, """WITH w AS (SELECT event_type, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS s, sum(value) AS v FROM events, range(7) r(k) GROUP BY 1, 2),
l AS (SELECT event_type, avg(v) AS centre, avg(v) - 3 * coalesce(stddev_samp(v), 0) AS lower, avg(v) + 3 * coalesce(stddev_samp(v), 0) AS upper FROM w GROUP BY 1)
SELECT event_type, CAST(s AS TIMESTAMP) AS window_start, v AS value, centre, lower, upper, round(v, 6) < round(lower, 6) OR round(v, 6) > round(upper, 6) AS outside FROM w JOIN l USING (event_type)""", "value:3 centre:3 lower:3 upper:3",
  source=lambda s, d: E.outside_limits(_events(s, d), E.control_limits(_events(s, d))))
