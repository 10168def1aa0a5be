"""Queries on decision tables, promotion and price economics, segments and general table operations."""

from pyspark.sql import functions as F

from ..functions.store import once
from ..operators import affinity as A
from ..operators import attributes as X
from ..operators import boards as B
from ..operators import category as C
from ..operators import cohort as H
from ..operators import insights as I
from ..operators import performance as P
from ..operators import pricing as Z
from ..operators import promo as M
from ..operators import relational as L
from ..operators import segments as G
from ..operators import switching as S
from .advanced import DEPTH, KEEP, RC, RULES, mined
from .base import register
from .commercial import EL, KPI, KVI, MS, PR, SEG, found, kvi, periods, prices, segs
from .shopping import ABC, CATS, DT, FIRST, LIFE, PHI, R, REP, RET, SW, VEL, WEEK, XYZ

MED = lambda c, q=0.5: f"quantile_cont({c}, {q}) OVER ()"


def four(x: str, y: str, both: str, only_x: str, only_y: str, neither: str) -> str:
    return f"CASE WHEN {x} AND {y} THEN '{both}' WHEN {x} THEN '{only_x}' WHEN {y} THEN '{only_y}' ELSE '{neither}' END"


def of(cte: str, select: str) -> str:
    """A table of its own, so that names of its parts stay inside."""
    return f"(WITH {cte} {select})"


# overview and categories

register("overview_kpis", B.overview_kpis, f"""
WITH wk AS (SELECT {WEEK} AS w, {R} AS r FROM tx GROUP BY 1 ORDER BY 1 DESC LIMIT 2), g AS (SELECT arg_max(r, w) / arg_min(r, w) - 1 AS g FROM wk),
c AS (SELECT sum(r) AS top FROM (SELECT {R} AS r FROM tx GROUP BY category ORDER BY 1 DESC LIMIT 5)),
t AS (SELECT {R} AS category_revenue, count(DISTINCT customer_id) AS customer_reach FROM tx)
SELECT category_revenue, g AS revenue_growth, customer_reach, category_revenue * least(top / category_revenue * 0.3, 0.2) AS revenue_at_risk,
  category_revenue * abs(g) * 0.4 AS opportunity_value FROM t, g, c""", "category_revenue:2 revenue_growth revenue_at_risk:2 opportunity_value:2")
OWN = lambda key: f"SELECT {key}, {R} AS revenue, count(DISTINCT customer_id) AS customers FROM tx GROUP BY 1"
UNIT = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
register("category_importance", B.category_importance, f"""
WITH m AS ({OWN('category')}), q AS (SELECT *, revenue / customers AS revenue_per_customer, customers / sum(customers) OVER () * 100 AS reach_pct FROM m)
SELECT *, {UNIT('revenue_per_customer')} AS revenue_score, {UNIT('reach_pct')} AS reach_score,
  {four(f'revenue_per_customer >= {MED("revenue_per_customer")}', f'reach_pct >= {MED("reach_pct")}', 'Grow', 'Defend', 'Build', 'Review')} AS quadrant FROM q""",
  "revenue:2 revenue_per_customer:4 reach_pct revenue_score reach_score")
DRIVERS = ("customers", "frequency", "basket_size", "unit_price")
register("revenue_drivers", lambda tx: B.revenue_drivers(I.revenue_components(tx)), f"""
WITH {RC}, l AS (SELECT week, {', '.join(f'{c}, lag({c}) OVER (ORDER BY week) AS p_{c}' for c in ('revenue', *DRIVERS))} FROM rc ORDER BY week DESC LIMIT 1),
s AS (SELECT *, {' + '.join(f'ln({c} / p_{c})' for c in DRIVERS)} AS total FROM l)
SELECT week, revenue / p_revenue - 1 AS revenue_change, {', '.join(f'ln({c} / p_{c}) / total AS {c}_share' for c in DRIVERS)}, greatest(0, p_customers - customers) AS lost_customers FROM s""",
  "revenue_change customers_share:4 frequency_share:4 basket_size_share:4 unit_price_share:4")
register("growth_reach_matrix", lambda tx: B.growth_reach(C.category_kpis(tx)), f"""
WITH {KPI}, g AS (SELECT category, revenue, growth_pct, customers / sum(customers) OVER () * 100 AS reach_pct FROM kpi)
SELECT *, {four(f'growth_pct >= {MED("growth_pct")}', f'reach_pct >= {MED("reach_pct")}', 'Growth Engines', 'Emerging Opportunities', 'Critical Risks', 'Draggers')} AS quadrant FROM g""",
  "revenue:2 growth_pct:4 reach_pct")
register("decision_priorities", B.decision_priorities, f"""
WITH m AS (SELECT category, {R} AS revenue, count(DISTINCT customer_id) AS customers, count(DISTINCT stockcode) AS n_products FROM tx GROUP BY 1),
d AS (SELECT *, revenue * 0.5 + customers * 10 + n_products * 50 AS decision_priority,
  CASE WHEN revenue > {MED('revenue')} * 2 AND customers > {MED('customers')} THEN 'Invest' WHEN revenue > {MED('revenue')} AND customers <= {MED('customers')} THEN 'Protect'
  WHEN revenue <= {MED('revenue')} * 0.5 THEN 'Review' ELSE 'Monitor' END AS decision FROM m)
SELECT *, row_number() OVER (ORDER BY decision_priority DESC, category) AS rank FROM d""", "revenue:2 decision_priority:2")
REACH = "SELECT category, customers, customers / sum(customers) OVER () AS reach FROM kpi"
register("category_reach", lambda tx: B.category_reach(C.category_kpis(tx)), f"WITH {KPI} {REACH}", "reach")
PARTS = {"trend": "g * 0.40", "seasonality": "g * 0.25", "promo": "g * 0.20", "cannibalization": "CASE WHEN revenue_share > 0.1 THEN g * -0.15 ELSE 0 END", "new_customers": "g * reach * 0.30"}
register("growth_bridge", lambda tx: B.growth_bridge(C.manager_scorecard(tx), C.category_kpis(tx)), f"""
WITH s AS {of(MS, 'SELECT category, revenue_yoy_growth AS g, revenue_share FROM ms')}, k AS {of(KPI, REACH)},
p AS (SELECT category, g, {', '.join(f'{e} AS {n}' for n, e in PARTS.items())} FROM s JOIN k USING (category)), t AS (SELECT *, {' + '.join(PARTS)} AS total FROM p)
SELECT category, g AS total_growth, {', '.join(f'CASE WHEN total <> 0 THEN {n} * g / total ELSE 0 END AS {n}' for n in PARTS)} FROM t""",
  "total_growth:4 trend:4 seasonality:4 promo:4 cannibalization:4 new_customers:4")
register("opportunity_map", lambda tx: B.opportunity_map(C.manager_scorecard(tx)), f"WITH {MS} SELECT category, revenue_share, revenue_yoy_growth, revenue_share * abs(revenue_yoy_growth) / 100 AS opportunity_score FROM ms",
  "revenue_share revenue_yoy_growth:4 opportunity_score")
SMALL = "revenue_yoy_growth > 0 AND revenue_share < 0.2"
register("category_kpi_row", lambda tx: B.category_kpi_row(C.manager_scorecard(tx)), f"""
WITH {MS} SELECT sum(total_revenue) AS total_revenue, avg(revenue_yoy_growth) AS mean_growth, coalesce(sum(total_revenue) FILTER (revenue_yoy_growth < 0), 0) AS revenue_at_risk,
  coalesce(sum(total_revenue) FILTER ({SMALL}) * avg(revenue_yoy_growth) FILTER ({SMALL}) / 100, 0) AS opportunity_value FROM ms""",
  "total_revenue:2 mean_growth:4 revenue_at_risk:2 opportunity_value:2")
register("category_trajectory", B.category_trajectory, f"""
WITH w AS (SELECT category, {WEEK} AS week, {R} AS revenue FROM tx GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY week) AS i FROM w),
l AS (SELECT category, regr_slope(revenue, i) AS s, regr_intercept(revenue, i) AS b FROM i GROUP BY 1)
SELECT category, week, revenue, b + s * i AS trend, avg(revenue) OVER (PARTITION BY category, month(week)) AS month_mean FROM i JOIN l USING (category)""", "revenue:2 trend:3 month_mean:3")
CARD = f"""{KPI}, sc AS (SELECT *, CASE WHEN revenue_share >= 0.2 AND growth_pct > 0 THEN 'growth' WHEN revenue_share >= 0.2 THEN 'parity' WHEN growth_pct > 15 THEN 'traffic_driver' ELSE 'niche' END AS role FROM kpi),
st AS (SELECT category, role, revenue_share, growth_pct, CASE WHEN growth_pct < 0 AND revenue_share >= {MED('revenue_share')} THEN 'High' WHEN growth_pct > 0 AND revenue_share < {MED('revenue_share')} THEN 'Medium' ELSE 'Low' END AS priority,
  CASE WHEN growth_pct < 0 AND revenue_share >= {MED('revenue_share')} THEN 'Defend' WHEN growth_pct < 0 THEN 'Review' WHEN revenue_share >= {MED('revenue_share')} THEN 'Invest' ELSE 'Build' END AS action FROM sc)"""
strategic = lambda tx: B.strategic_table(C.category_scorecard(tx))
register("strategic_table", strategic, f"WITH {CARD} SELECT * FROM st", "revenue_share growth_pct:4")
register("action_plan", lambda tx: B.action_plan(strategic(tx)), f"""
WITH {CARD}, k AS (SELECT category, priority, action, revenue_share * greatest(0, -growth_pct) / 100 AS risk_score FROM st ORDER BY 4 DESC, 1 LIMIT 5)
SELECT *, CAST(unnest([30, 60, 90]) AS INTEGER) AS day, unnest(['diagnose', 'test', 'roll out']) AS step FROM k""", "risk_score")

# rules and pairs

RV = f"{RULES}, rr AS (SELECT stockcode, {R} AS r FROM tx GROUP BY 1), rx AS (SELECT antecedents, consequents, support, lift, r AS antecedent_revenue, greatest(lift - 1, 0) * r * support AS incremental_value FROM rules JOIN rr ON stockcode = antecedents)"
RQ = f"{RV}, rq AS (SELECT *, {four(f'lift >= {MED("lift")}', f'incremental_value >= {MED("incremental_value")}', 'scale', 'optimize', 'rethink', 'stop')} AS quadrant FROM rx)"
values = lambda tx: B.rule_values(mined(tx), tx)
text = lambda t: t.withColumns({c: F.array_join(c, "|") for c in ("antecedents", "consequents")})
register("rule_opportunities", lambda tx: text(values(tx)), f"WITH {RQ} SELECT * FROM rq", "support lift antecedent_revenue:2 incremental_value:4")
register("top_basket_missions", lambda tx: text(values(tx)).orderBy(F.desc("incremental_value"), "antecedents", "consequents").limit(20).drop("quadrant"),
  f"WITH {RV} SELECT * FROM rx ORDER BY incremental_value DESC, antecedents, consequents LIMIT 20", "support lift antecedent_revenue:2 incremental_value:4")
register("cross_sell_matrix", lambda tx: B.cross_sell_matrix(values(tx)), f"""
WITH {RV} SELECT antecedents AS anchor, consequents AS addon, lift AS max_lift, support AS total_support, antecedent_revenue * support * (lift - 1) AS expected_value FROM rx""",
  "max_lift total_support expected_value:3")
PHI1 = PHI.replace("n_ab >= 5", "n_ab >= 1")
STRONG = "SELECT stockcode, max(v) AS affinity_intensity FROM (SELECT a AS stockcode, abs(affinity) AS v FROM phi UNION ALL SELECT b, abs(affinity) FROM phi) GROUP BY 1"
pairs = lambda tx: A.affinity(tx, min_cooccurrence=1)
register("affinity_quadrants", lambda tx: B.affinity_quadrants(pairs(tx), tx), f"""
WITH {PHI1}, st AS ({STRONG}), rv AS (SELECT stockcode, {R} AS revenue FROM tx GROUP BY 1), md AS (SELECT quantile_cont(affinity, 0.5) AS m FROM phi)
SELECT stockcode, affinity_intensity, revenue, {four('affinity_intensity > m', f'revenue > {MED("revenue")}', 'basket_anchors', 'niche', 'growth_attachments', 'low_priority')} AS quadrant FROM st JOIN rv USING (stockcode), md""",
  "affinity_intensity revenue:2")
register("co_purchase_manager", lambda tx: B.co_purchase_manager(pairs(tx), tx, P.lifecycle_stage(tx), Z.own_price_elasticity(tx)), f"""
WITH st AS {of(PHI1, STRONG)}, lg AS {of(LIFE, 'SELECT stockcode, growth_pct FROM life')}, el AS {of(EL, 'SELECT stockcode, elasticity FROM e')},
o AS ({OWN('stockcode')}), j AS (SELECT stockcode, revenue, customers, coalesce(affinity_intensity, 0) AS affinity_intensity, coalesce(growth_pct, 0) AS g, coalesce(elasticity, 0) AS e, {MED('revenue')} AS m
  FROM o LEFT JOIN st USING (stockcode) LEFT JOIN lg USING (stockcode) LEFT JOIN el USING (stockcode))
SELECT stockcode, affinity_intensity, revenue, greatest(0, revenue - m) AS incremental_revenue, least(customers / (SELECT count(DISTINCT transaction_id) FROM tx), 1) AS basket_penetration,
  CASE WHEN affinity_intensity > 0.3 AND revenue > m THEN 'Anchor - Maintain & Expand' WHEN revenue > m AND g > 0 THEN 'Growth - Invest' WHEN affinity_intensity > 0.3 AND e < -1 THEN 'Protect - Retain'
  WHEN g < 0 THEN 'Prune - Phase Out' ELSE 'Review - Test' END AS recommendation FROM j""", "affinity_intensity revenue:2 incremental_revenue:2 basket_penetration")
register("basket_network", lambda tx: B.basket_network(A.affinity(tx), tx), f"""
WITH {PHI}, rv AS (SELECT stockcode, {R} AS r FROM tx GROUP BY 1) SELECT a, b, n_ab, affinity, x.r AS revenue_a, y.r AS revenue_b FROM phi JOIN rv x ON x.stockcode = a JOIN rv y ON y.stockcode = b""",
  "affinity revenue_a:2 revenue_b:2")
register("mission_shares", lambda tx: B.mission_shares(X.basket_missions(tx), tx), f"""
WITH {DEPTH}, mi AS (SELECT transaction_id, arg_min(mission_tier, (-n, mission_tier)) AS mission FROM (SELECT transaction_id, mission_tier, count(*) AS n FROM p JOIN bt USING (stockcode) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT mission, count(*) AS lines, {R} AS revenue FROM tx JOIN mi USING (transaction_id) GROUP BY 1)
SELECT *, lines / sum(lines) OVER () AS line_share, revenue / sum(revenue) OVER () AS revenue_share FROM g""", "revenue:2 line_share revenue_share")

# switching

register("switching_status", lambda tx: B.switching_status(S.switching_matrix(tx), tx), f"""
WITH {SW}, o AS (SELECT stockcode, count(*) AS n_observations, count(DISTINCT customer_id) AS n_customers FROM tx GROUP BY 1),
e2 AS (SELECT from_product AS stockcode, to_product AS o, count FROM sw UNION ALL SELECT to_product, from_product, count FROM sw), n2 AS (SELECT stockcode, count(DISTINCT o) AS n_switchers, CAST(sum(count) AS BIGINT) AS n_transitions FROM e2 GROUP BY 1),
j AS (SELECT stockcode, n_observations, n_customers, coalesce(n_switchers, 0) AS n_switchers, coalesce(n_transitions, 0) AS n_transitions FROM o LEFT JOIN n2 USING (stockcode))
SELECT *, CASE WHEN n_observations < 3 THEN 'insufficient_observations' WHEN n_customers < 10 THEN 'insufficient_customers' WHEN n_transitions = 0 THEN 'no_switching_observed' WHEN n_transitions < 5 THEN 'insufficient_transitions' ELSE 'estimated' END AS switching_status FROM j""")
register("net_switching", lambda tx: B.net_switching(S.demand_transference(tx)), f"""
WITH {DT}, o AS (SELECT from_product AS stockcode, sum(observed_switching_transfer_revenue) AS outflow FROM dt GROUP BY 1), i AS (SELECT to_product AS stockcode, sum(observed_switching_transfer_revenue) AS inflow FROM dt GROUP BY 1)
SELECT stockcode, coalesce(outflow, 0) AS outflow, coalesce(inflow, 0) AS inflow, coalesce(inflow, 0) - coalesce(outflow, 0) AS net FROM o FULL JOIN i USING (stockcode)""", "outflow:2 inflow:2 net:2")
register("switching_summary", lambda tx: B.switching_summary(S.switching_matrix(tx)), f"""
WITH {SW} SELECT CAST(sum(count) AS BIGINT) AS n_switches, count(*) AS n_pairs, (SELECT count(*) FROM (SELECT from_product FROM sw UNION SELECT to_product FROM sw)) AS n_products, max(count) / sum(count) AS largest_share FROM sw""", "largest_share")
SDP = f"{DT}, gs AS (SELECT from_product, sum(observed_switching_transfer_revenue) AS t FROM dt GROUP BY 1), sdp AS (SELECT stockcode, r AS revenue, round(least(1, coalesce(t / r, 0)), 9) AS sdp FROM rv LEFT JOIN gs ON from_product = stockcode)"
sdp = lambda tx: S.substitutable_demand(S.demand_transference(tx), tx)
register("revenue_risk_matrix", lambda tx: B.revenue_risk(sdp(tx), tx), f"""
WITH {SDP} SELECT stockcode, revenue, sdp, {four(f'revenue >= {MED("revenue")}', f'sdp >= {MED("sdp")}', 'safe', 'protect', 'investigate', 'unique')} AS quadrant FROM sdp""", "revenue:2 sdp")
HV = f"hc AS (SELECT customer_id, round({R}, 2) AS r FROM tx GROUP BY 1), hv AS (SELECT * FROM tx WHERE customer_id IN (SELECT customer_id FROM hc WHERE r >= (SELECT quantile_cont(r, 0.8) FROM hc)))"
register("high_value_switching", lambda tx: S.switching_matrix(B.high_value_lines(tx), min_transactions=2), f"WITH {HV}, {SW.replace('FROM tx', 'FROM hv').replace('k >= 2', 'k >= 1')} SELECT * FROM sw", "pct")
every = lambda tx: tx.select("stockcode").distinct()
register("switching_flows", lambda tx: B.switching_flows(S.demand_transference(tx), S.delist_impact(tx, S.demand_transference(tx), every(tx))), f"""
WITH {DT}, gs AS (SELECT from_product, sum(observed_switching_transfer_revenue) AS t FROM dt GROUP BY 1),
im AS (SELECT stockcode, r, coalesce(t, 0) AS t FROM rv LEFT JOIN gs ON from_product = stockcode ORDER BY round(coalesce(t, 0) - r, 2), stockcode LIMIT 15)
SELECT from_product, to_product, observed_switching_transfer_revenue AS revenue FROM dt WHERE from_product IN (SELECT stockcode FROM im) UNION ALL SELECT stockcode, 'lost', greatest(0, r - t) FROM im""", "revenue:2")
register("switching_manager", lambda tx: B.switching_manager(S.in_out_rates(S.switching_matrix(tx), tx), S.recovery_hhi(S.demand_transference(tx)), sdp(tx)), f"""
WITH {SDP}, c AS (SELECT stockcode, count(DISTINCT customer_id) AS c FROM tx GROUP BY 1), o AS (SELECT from_product AS stockcode, count(*) AS n FROM sw GROUP BY 1),
h AS (SELECT from_product AS stockcode, arg_min(to_product, (-count, to_product)) AS top_substitute, max(count) / sum(count) AS top_share FROM sw GROUP BY 1)
SELECT stockcode, coalesce(n, 0) / c AS switch_out_rate, top_substitute, sdp AS recovery, 1 - sdp AS uniqueness, CASE WHEN 1 - sdp >= 0.5 THEN 'keep' WHEN top_share >= 0.5 THEN 'delist_candidate' ELSE 'review' END AS advice
FROM sdp JOIN c USING (stockcode) LEFT JOIN o USING (stockcode) LEFT JOIN h USING (stockcode)""", "switch_out_rate recovery uniqueness")

# cohorts and products

register("cohort_value_curve", lambda tx: B.cohort_value(H.cohort_ltv_curve(tx), H.cohorts(tx)), f"""
WITH {RET}, g AS (SELECT cohort, period_index, sum(revenue) AS r FROM j GROUP BY 1, 2)
SELECT g.cohort, g.period_index, sum(r) OVER (PARTITION BY g.cohort ORDER BY g.period_index) AS cumulative_revenue, retained, sum(r) OVER (PARTITION BY g.cohort ORDER BY g.period_index) / retained AS revenue_per_retained
FROM g JOIN ret ON ret.cohort = g.cohort AND ret.period_index = g.period_index""", "cumulative_revenue:2 revenue_per_retained:4")
GRID = f"""ce AS (SELECT * FROM (VALUES {', '.join(f"('{c[0]}', '{c[1]}', '{a}')" for c, a in B.CELLS.items())}) v(abc_class, xyz_class, action)),
ab AS {of(ABC, 'SELECT * FROM abc')}, xy AS {of(XYZ, 'SELECT stockcode, xyz_class FROM xyz')}, gg AS (SELECT abc_class, xyz_class, count(*) AS n_products, sum(revenue) AS revenue FROM ab JOIN xy USING (stockcode) GROUP BY 1, 2),
grid AS (SELECT abc_class, xyz_class, action, coalesce(n_products, 0) AS n_products, coalesce(revenue, 0) AS revenue FROM ce LEFT JOIN gg USING (abc_class, xyz_class))"""
grid = lambda tx: B.class_grid(P.abc_analysis(tx), P.xyz_analysis(tx))
register("class_grid", grid, f"WITH {GRID} SELECT * FROM grid", "revenue:2")
register("class_counts", lambda tx: B.class_counts(grid(tx)), f"""
WITH {GRID} SELECT abc_class, {', '.join(f"CAST(sum(n_products) FILTER (xyz_class = '{x}') AS BIGINT) AS {x}" for x in 'XYZ')} FROM grid GROUP BY 1""")
register("velocity_repeat", lambda tx: B.velocity_repeat(P.velocity(tx), P.repeat_rate(tx), tx), f"""
WITH v AS ({VEL}), p AS ({REP}), o AS ({OWN('stockcode')})
SELECT stockcode, velocity, repeat_rate, revenue, CASE WHEN revenue > {MED('revenue')} THEN 'High' ELSE 'Low' END AS revenue_level FROM v JOIN p USING (stockcode) JOIN o USING (stockcode)""", "velocity repeat_rate revenue:2")

# assortments

register("coverage_curve", B.coverage_curve, f"""
WITH o AS (SELECT stockcode, {R} AS revenue FROM tx GROUP BY 1), c AS (SELECT *, row_number() OVER w AS n_products, sum(revenue) OVER w / sum(revenue) OVER () AS coverage FROM o WINDOW w AS (ORDER BY revenue DESC, stockcode ROWS UNBOUNDED PRECEDING))
SELECT *, coverage >= 0.8 AS enough FROM c""", "revenue:2 coverage")
kept = lambda tx: tx.groupBy("stockcode").agg(F.sum(F.col("price") * F.col("quantity")).alias("r")).orderBy(F.desc("r"), "stockcode").limit(30).select("stockcode")
RISK = f"""{KEEP}, rs AS (SELECT from_product AS stockcode, sum(observed_switching_transfer_revenue) AS revenue_at_risk, coalesce(sum(observed_switching_transfer_revenue) FILTER (k <= 30), 0) AS recovery FROM dt JOIN ks ON ks.stockcode = to_product GROUP BY 1),
cr AS (SELECT stockcode, r AS revenue, coalesce(revenue_at_risk, 0) AS revenue_at_risk, coalesce(recovery, 0) AS recovery, CASE WHEN revenue_at_risk > 0 THEN recovery / revenue_at_risk ELSE 1 END AS coverage FROM rv LEFT JOIN rs USING (stockcode))"""
risk = lambda tx: B.coverage_risk(tx, S.demand_transference(tx), kept(tx))
register("coverage_risk", risk, f"WITH {DT}, {RISK} SELECT * FROM cr", "revenue:2 revenue_at_risk:2 recovery:2 coverage")
PORT = f"""{SDP}, {RISK}, ct AS (SELECT stockcode, count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM tx) AS reach FROM tx GROUP BY 1),
po AS (SELECT stockcode, sdp.revenue / sum(sdp.revenue) OVER () AS revenue_share, round(1 - sdp, 9) AS uniqueness, reach, coverage AS substitute_coverage FROM sdp JOIN cr USING (stockcode) JOIN ct USING (stockcode))"""
portfolio = lambda tx: B.portfolio_matrix(tx, sdp(tx), risk(tx))
register("portfolio_matrix", portfolio, f"""
WITH {PORT} SELECT *, {four(f'revenue_share >= {MED("revenue_share")}', f'uniqueness >= {MED("uniqueness")}', 'core', 'replaceable_seller', 'niche', 'tail')} AS quadrant FROM po""", "revenue_share uniqueness reach substitute_coverage")
KV = f"kv AS {of(KVI, 'SELECT stockcode, kvi_score, round(total_revenue, 2) AS total_revenue FROM kvi')}"
scores = lambda tx: kvi(tx).withColumn("total_revenue", F.round("total_revenue", 2))
register("assortment_decisions", lambda tx: B.assortment_decisions(portfolio(tx), scores(tx), kept(tx)), f"""
WITH {PORT}, {KV} SELECT stockcode, total_revenue, reach, uniqueness, kvi_score, CASE WHEN kvi_score >= 0.6 OR (total_revenue > {MED('total_revenue', 0.8)} AND uniqueness >= 0.7) THEN 'Keep'
WHEN reach >= 0.15 AND k > 30 AND uniqueness < 0.4 THEN 'Add' WHEN total_revenue >= 0.3 AND total_revenue <= {MED('total_revenue', 0.7)} THEN 'Review' ELSE 'Delist' END AS decision
FROM po JOIN kv USING (stockcode) JOIN ks USING (stockcode)""", "reach uniqueness kvi_score")
register("delist_waterfall", lambda tx: B.delist_waterfall(tx, kvi(tx), kept(tx), portfolio(tx)), f"""
WITH {PORT}, {KV}, j AS (SELECT stockcode, r, k, kvi_score, reach, uniqueness, row_number() OVER (PARTITION BY lower(trim(stockcode)) ORDER BY r DESC, stockcode) > 1 AS again, r <= {MED('r', 0.25)} AND k > 30 AS weak
  FROM rv JOIN ks USING (stockcode) JOIN kv USING (stockcode) JOIN po USING (stockcode)),
s AS (SELECT 0 AS step, 'total' AS name, r, true AS c FROM j UNION ALL SELECT 1, 'duplicates', r, again FROM j UNION ALL SELECT 2, 'tail', r, weak AND kvi_score < 0.6 FROM j UNION ALL SELECT 3, 'protected', r, weak AND kvi_score >= 0.6 FROM j
  UNION ALL SELECT 4, 'white_space', r, reach >= 0.15 AND k > 30 AND uniqueness < 0.6 FROM j)
SELECT CAST(step AS INTEGER) AS step, name, count(*) FILTER (c) AS n_products, coalesce(sum(r) FILTER (c), 0) AS revenue FROM s GROUP BY 1, 2""", "revenue:2")

# prices

CONF = f"""{EL}, cf AS (SELECT *, CASE WHEN (ci_upper - ci_lower) / greatest(abs(elasticity), 1e-9) <= 2 THEN 'high' WHEN (ci_upper - ci_lower) / greatest(abs(elasticity), 1e-9) <= 4 THEN 'medium' ELSE 'low' END AS confidence FROM e),
sq AS (SELECT stockcode, count(*) AS n_obs, stddev_samp(p) / avg(p) AS price_cv, count(DISTINCT p) AS k, count(*) FILTER (p = 0 OR q = 0) AS z, avg(p) AS base_price, avg(q) AS base_qty FROM wp GROUP BY 1),
es AS (SELECT stockcode, CASE WHEN sq.n_obs < 10 THEN 'insufficient_observations' WHEN z > 0 THEN 'unavailable' WHEN k < 3 THEN 'insufficient_price_points' WHEN sq.price_cv < 0.05 THEN 'insufficient_variation'
  WHEN elasticity IS NULL THEN 'unavailable' WHEN confidence = 'low' THEN 'weak' ELSE 'estimated' END AS elasticity_status, sq.n_obs, sq.price_cv, elasticity, r_squared, confidence FROM sq LEFT JOIN cf USING (stockcode)),
us AS (SELECT stockcode, elasticity, base_price, base_qty FROM es JOIN sq USING (stockcode) WHERE confidence IN ('high', 'medium') AND elasticity_status IN ('estimated', 'weak'))"""


def status(tx):
    return Z.elasticity_status(tx, Z.elasticity_confidence(Z.own_price_elasticity(tx)))


register("elasticity_status", status, f"WITH {CONF} SELECT * FROM es", "price_cv elasticity r_squared")
register("robust_elasticity", Z.robust_elasticity, f"""
WITH {EL}, x AS (SELECT stockcode, ln(p) AS x, ln(q) AS y FROM wp WHERE p > 0 AND q > 0), m AS (SELECT stockcode, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM x GROUP BY 1),
r AS (SELECT stockcode, elasticity, n_obs, sxx, x - mx AS dx, (y - intercept - elasticity * x) / (1 - (1 / n_obs + (x - mx) * (x - mx) / sxx)) AS r FROM x JOIN m USING (stockcode) JOIN e USING (stockcode)),
g AS (SELECT stockcode, any_value(elasticity) AS elasticity, any_value(n_obs) AS n_obs, sqrt(sum(dx * dx * r * r)) / any_value(sxx) AS robust_error FROM r GROUP BY 1)
SELECT *, elasticity - 1.96 * robust_error AS ci_lower, elasticity + 1.96 * robust_error AS ci_upper FROM g""", "elasticity:5 robust_error:5 ci_lower:5 ci_upper:5")
BEST = f"SELECT stockcode FROM tx GROUP BY 1 ORDER BY {R} DESC, stockcode LIMIT 12"


def best_pairs(tx):
    best = tx.groupBy("stockcode").agg(F.sum(F.col("price") * F.col("quantity")).alias("r")).orderBy(F.desc("r"), "stockcode").limit(12).select("stockcode")
    return best.select(F.col("stockcode").alias("a")).join(best.select(F.col("stockcode").alias("b")), F.col("a") != F.col("b"))


register("cross_price_elasticity", lambda tx: Z.cross_price_elasticity(tx, best_pairs(tx)), f"""
WITH {EL}, bs AS ({BEST}), w AS (SELECT stockcode, week, p, ln(p) AS x, ln(q) AS y FROM wp WHERE p > 0 AND q > 0 AND stockcode IN (SELECT stockcode FROM bs)),
t AS (SELECT a.stockcode AS a, b.stockcode AS b, a.p AS pa, b.p AS pb, a.x AS xa, b.x AS xb, a.y AS ya FROM w a JOIN w b ON a.week = b.week AND a.stockcode <> b.stockcode),
g AS (SELECT a, b, count(*) AS n_obs, stddev_samp(pa) / avg(pa) AS va, stddev_samp(pb) / avg(pb) AS vb, count(DISTINCT pa) AS ka, count(DISTINCT pb) AS kb, regr_sxx(ya, xa) AS saa, regr_sxx(ya, xb) AS sbb, regr_sxy(xa, xb) AS sab, regr_sxy(ya, xa) AS sya, regr_sxy(ya, xb) AS syb, regr_syy(ya, xa) AS syy FROM t GROUP BY 1, 2),
h AS (SELECT *, saa * sbb - sab * sab AS det, (sya * sbb - syb * sab) / (saa * sbb - sab * sab) AS own_elasticity, (syb * saa - sya * sab) / (saa * sbb - sab * sab) AS cross_elasticity FROM g WHERE n_obs >= 10 AND va >= 0.05 AND vb >= 0.05 AND ka >= 3 AND kb >= 3)
SELECT a, b, n_obs, own_elasticity, cross_elasticity, sqrt(greatest(0, syy - own_elasticity * sya - cross_elasticity * syb) / (n_obs - 3) * saa / det) AS std_error, CASE WHEN cross_elasticity > 0 THEN 'substitutes' ELSE 'complements' END AS relation FROM h WHERE det > 0""",
  "own_elasticity:4 cross_elasticity:4 std_error:4")
register("pricing_scorecard", lambda tx: Z.pricing_scorecard(status(tx), kvi(tx)), f"""
WITH es AS {of(CONF, 'SELECT * FROM es')}, kv AS {of(KVI, 'SELECT stockcode, total_revenue AS r FROM kvi')}
SELECT count(*) AS n_products, count(*) FILTER (elasticity_status = 'estimated') AS n_estimated, count(*) FILTER (elasticity_status = 'weak') AS n_weak, count(*) FILTER (confidence = 'high') AS n_high,
  coalesce(sum(r) FILTER (elasticity_status IN ('estimated', 'weak')), 0) AS covered_revenue, coalesce(sum(r) FILTER (elasticity_status IN ('estimated', 'weak')), 0) / sum(r) AS covered_share FROM es LEFT JOIN kv USING (stockcode)""", "covered_revenue:2 covered_share")
usable = lambda tx: Z.usable_estimates(tx, status(tx))
register("price_simulation", lambda tx: Z.price_simulation(usable(tx)), f"""
WITH {CONF}, c AS (SELECT *, unnest([-0.05, -0.02, 0.02, 0.05]) AS d FROM us), s AS (SELECT *, CAST(d AS DOUBLE) AS change FROM c)
SELECT stockcode, change, base_price * (1 + change) AS price, base_qty * pow(1 + change, elasticity) AS quantity, base_price * (1 + change) * base_qty * pow(1 + change, elasticity) AS revenue,
  (1 + change) * pow(1 + change, elasticity) - 1 AS revenue_change FROM s""", "price:4 quantity:4 revenue:3 revenue_change")
register("price_response_curve", lambda tx: Z.price_response_curve(usable(tx), Z.own_price_elasticity(tx)), f"""
WITH {CONF}, c AS (SELECT us.*, ci_lower, ci_upper, CAST(point AS INTEGER) AS point, -0.2 + point * (0.4 / 99) AS d FROM us JOIN e USING (stockcode), range(0, 100) r(point)), s AS (SELECT *, CAST(d AS DOUBLE) AS change FROM c)
SELECT stockcode, point, base_price * (1 + change) AS price, base_qty * pow(1 + change, elasticity) AS quantity, least(base_qty * pow(1 + change, ci_lower), base_qty * pow(1 + change, ci_upper)) AS quantity_low,
  greatest(base_qty * pow(1 + change, ci_lower), base_qty * pow(1 + change, ci_upper)) AS quantity_high FROM s""", "price:3 quantity:3 quantity_low:3 quantity_high:3")
register("price_ladder", lambda tx: Z.price_ladder(kvi(tx)), f"""
WITH {KVI} SELECT stockcode, category, kvi_score, abs_elasticity, total_revenue, CASE WHEN kvi_score >= {MED('kvi_score', 0.75)} THEN 'Premium' WHEN kvi_score >= {MED('kvi_score')} THEN 'Mid'
WHEN kvi_score >= {MED('kvi_score', 0.25)} AND NOT coalesce(abs_elasticity >= 1, false) THEN 'Value' ELSE 'Entry' END AS tier FROM kvi""", "kvi_score abs_elasticity total_revenue:2")
register("price_promo_matrix", lambda tx: Z.price_promo_matrix(kvi(tx)), f"""
WITH {KVI} SELECT stockcode, kvi_score, abs_elasticity, total_revenue, CASE WHEN kvi_score >= 0.67 THEN 'High' WHEN kvi_score >= 0.33 THEN 'Medium' ELSE 'Low' END AS kvi_status,
{four(f'kvi_score >= {MED("kvi_score")}', f'abs_elasticity >= {MED("abs_elasticity")}', 'Strategic promo', 'Base-price focus', 'Selective promo', 'Margin opportunity')} AS strategy FROM kvi WHERE abs_elasticity IS NOT NULL""",
  "kvi_score abs_elasticity total_revenue:2")
DECIDE = "CASE WHEN abs_elasticity IS NULL THEN 'insufficient_evidence' WHEN kvi_score >= quantile_cont(kvi_score, 0.5) OVER () AND abs_elasticity >= 1 THEN 'invest' WHEN kvi_score >= quantile_cont(kvi_score, 0.5) OVER () THEN 'protect' WHEN abs_elasticity >= 1 THEN 'price_lever' ELSE 'review' END"
register("pricing_manager", lambda tx: Z.pricing_manager(Z.decision_matrix(kvi(tx)), status(tx)), f"""
WITH es AS {of(CONF, 'SELECT * FROM es')}, kd AS {of(KVI, f'SELECT stockcode, kvi_score, total_revenue, {DECIDE} AS decision FROM kvi')}
SELECT stockcode, kvi_score, total_revenue, decision, elasticity_status AS status, elasticity, confidence, n_obs, total_revenue * (0.95 * pow(0.95, elasticity) - 1) AS cut_effect FROM kd FULL JOIN es USING (stockcode)""",
  "kvi_score total_revenue:2 elasticity cut_effect:2")

# promotions

FULL = f"""{PR}, pm AS (SELECT pp.stockcode, start_date, end_date, duration_days, avg(drop_pct) * 100 AS avg_discount_pct, {R} AS promo_revenue, sum(quantity) AS promo_qty FROM pp JOIN pi ON pi.stockcode = pp.stockcode AND pi.run = pp.run
  JOIN fl ON fl.stockcode = pi.stockcode AND fl.d = pi.d AND is_promo GROUP BY 1, 2, 3, 4),
bq AS (SELECT stockcode, {R} AS base_total FROM fl WHERE NOT is_promo GROUP BY 1)"""
SALES = f"""ws AS (SELECT stockcode, {WEEK} AS week, sum(quantity) AS u, {R} AS r, avg(price) AS avg_price FROM px GROUP BY 1, 2),
pw AS (SELECT DISTINCT stockcode, CAST(unnest(generate_series(date_trunc('week', start_date), date_trunc('week', end_date), INTERVAL 7 DAY)) AS DATE) AS week FROM pp),
sl AS (SELECT ws.*, pw.week IS NOT NULL AS is_promo FROM ws LEFT JOIN pw ON pw.stockcode = ws.stockcode AND pw.week = ws.week)"""
FIT = lambda c: f"""l_{c} AS (SELECT stockcode, regr_intercept({c}, i) AS a, regr_slope({c}, i) AS b FROM pl GROUP BY 1), s_{c} AS (SELECT stockcode, y, avg({c} - a - b * i) AS s FROM pl JOIN l_{c} USING (stockcode) GROUP BY 1, 2),
f_{c} AS (SELECT stockcode, week, CASE WHEN many AND NOT is_promo THEN greatest(0, a + b * i + s) END AS fit FROM nn LEFT JOIN l_{c} USING (stockcode) LEFT JOIN s_{c} USING (stockcode, y)),
c_{c} AS (SELECT stockcode, week, coalesce(last_value(fit IGNORE NULLS) OVER (PARTITION BY stockcode ORDER BY week ROWS UNBOUNDED PRECEDING), first_value(fit IGNORE NULLS) OVER (PARTITION BY stockcode ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b_{c} FROM f_{c})"""  # noqa: E731
LINE = f"""{SALES}, nn AS (SELECT *, row_number() OVER w AS i, weekofyear(week) AS y, count(*) OVER (PARTITION BY stockcode) >= 104 AND count(*) FILTER (NOT is_promo) OVER (PARTITION BY stockcode) >= 52 AS many,
  avg(u) OVER (PARTITION BY stockcode ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m_u, avg(r) OVER (PARTITION BY stockcode ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m_r FROM sl WINDOW w AS (PARTITION BY stockcode ORDER BY week)),
pl AS (SELECT * FROM nn WHERE many AND NOT is_promo), {FIT('u')}, {FIT('r')},
bl0 AS (SELECT stockcode, week, u AS actual_units, r AS actual_revenue, avg_price, is_promo, CASE WHEN many THEN b_u ELSE coalesce(m_u, u) END AS baseline_units, CASE WHEN many THEN b_r ELSE coalesce(m_r, r) END AS baseline_revenue FROM nn JOIN c_u USING (stockcode, week) JOIN c_r USING (stockcode, week)),
bl1 AS (SELECT *, CASE WHEN baseline_units > 0 THEN baseline_revenue / baseline_units END AS baseline_price, actual_units - baseline_units AS incremental_units, actual_revenue - baseline_revenue AS incremental_revenue FROM bl0),
bl AS (SELECT *, incremental_units * baseline_price AS incremental_revenue_qty, incremental_revenue - incremental_units * baseline_price AS incremental_revenue_price, CASE WHEN actual_revenue > 0 THEN incremental_revenue / actual_revenue * 100 ELSE 0 END AS incrementality_pct FROM bl1)"""
BD = "actual_units:2 actual_revenue:2 avg_price:4 baseline_units:3 baseline_revenue:2 baseline_price:3 incremental_units:3 incremental_revenue:2 incremental_revenue_qty:2 incremental_revenue_price:2 incrementality_pct:3"
baseline = lambda tx: once(tx, "baseline", lambda: M.promo_baseline(prices(tx), periods(tx)))
register("promo_baseline", baseline, f"WITH {PR}, {LINE} SELECT * FROM bl", BD)
register("promo_calendar", lambda tx: baseline(tx).where("is_promo").select("stockcode", "week", "actual_revenue", "baseline_revenue", "incremental_units"),
  f"WITH {PR}, {LINE} SELECT stockcode, week, actual_revenue, baseline_revenue, incremental_units FROM bl WHERE is_promo", "actual_revenue:2 baseline_revenue:2 incremental_units:3")
HALO = f"""ow AS (SELECT DISTINCT pp.stockcode AS promo_product, start_date, transaction_id, CAST(date AS DATE) >= start_date AS now FROM pp JOIN px ON px.stockcode = pp.stockcode AND CAST(date AS DATE) BETWEEN start_date - 28 AND end_date),
ha AS (SELECT promo_product, start_date, px.stockcode AS halo_product, coalesce({R} FILTER (now), 0) AS halo_revenue, count(DISTINCT px.transaction_id) FILTER (now) AS halo_orders, coalesce({R} FILTER (NOT now), 0) AS base_revenue, count(DISTINCT px.transaction_id) FILTER (NOT now) AS base_orders
  FROM ow JOIN px ON px.transaction_id = ow.transaction_id AND px.stockcode <> promo_product GROUP BY 1, 2, 3)"""
halo = lambda tx: M.halo_effect(prices(tx), found(tx))
register("halo_effect", halo, f"WITH {PR}, {HALO} SELECT *, CASE WHEN base_revenue <> 0 THEN (halo_revenue / base_revenue - 1) * 100 END AS revenue_lift FROM ha", "halo_revenue:2 base_revenue:2 revenue_lift:3")
CANN = f"""{CATS.replace('FROM tx', 'FROM px')}, cj AS (SELECT pp.stockcode AS promo_product, start_date, px.stockcode AS peer, price * quantity AS r, CAST(date AS DATE) >= start_date AS now
  FROM pp JOIN cm ON cm.stockcode = pp.stockcode JOIN px ON px.category = cm.category AND px.stockcode <> pp.stockcode AND CAST(date AS DATE) BETWEEN start_date - duration_days AND end_date),
ca AS (SELECT promo_product, greatest(0, b - a) AS lost FROM (SELECT promo_product, start_date, peer, coalesce(sum(r) FILTER (now), 0) AS a, coalesce(sum(r) FILTER (NOT now), 0) AS b FROM cj GROUP BY 1, 2, 3) WHERE b >= 1)"""
FALL = f"""{LINE}, {HALO}, {CANN}, wf0 AS (SELECT stockcode, sum(baseline_revenue) AS baseline_revenue, sum(actual_revenue) AS actual_revenue, coalesce(sum(incremental_revenue_qty), 0) AS incremental_revenue_qty, coalesce(sum(incremental_revenue_price), 0) AS incremental_revenue_price FROM bl GROUP BY 1),
wf1 AS (SELECT wf0.*, coalesce(h, 0) AS halo_revenue, coalesce(l, 0) AS cannibalization_revenue, incremental_revenue_qty + incremental_revenue_price AS incremental_revenue FROM wf0 LEFT JOIN (SELECT promo_product, sum(halo_revenue) AS h FROM ha GROUP BY 1) x ON x.promo_product = stockcode
  LEFT JOIN (SELECT promo_product, sum(lost) AS l FROM ca GROUP BY 1) z ON z.promo_product = stockcode),
wf AS (SELECT *, incremental_revenue + halo_revenue - cannibalization_revenue AS net_incremental_revenue, CASE WHEN baseline_revenue > 0 THEN (incremental_revenue + halo_revenue - cannibalization_revenue) / baseline_revenue ELSE 0 END AS roi FROM wf1)"""
waterfall = lambda tx: once(tx, "waterfall", lambda: M.promo_waterfall(baseline(tx), M.halo_revenue(prices(tx), periods(tx)), M.cannibalization(prices(tx), periods(tx), orders=False)))
register("promo_waterfall", waterfall, f"WITH {PR}, {FALL} SELECT * FROM wf", "baseline_revenue:2 actual_revenue:2 incremental_revenue_qty:2 incremental_revenue_price:2 halo_revenue:2 cannibalization_revenue:2 incremental_revenue:2 net_incremental_revenue:2 roi:5")
register("promo_scores", lambda tx: M.promo_scores(waterfall(tx)), f"""
WITH {PR}, {FALL}, wr AS (SELECT stockcode, round(incremental_revenue_qty, 6) AS incremental_revenue_qty, round(incremental_revenue_price, 6) AS incremental_revenue_price, round(net_incremental_revenue, 6) AS net_incremental_revenue, round(roi, 6) AS roi FROM wf)
SELECT stockcode, net_incremental_revenue, roi, CASE WHEN abs(incremental_revenue_qty) <= 0.01 * greatest(abs(incremental_revenue_qty), abs(incremental_revenue_price), 1) THEN 'INEFFECTIVE'
WHEN incremental_revenue_qty < 0 OR net_incremental_revenue < -0.5 * (CASE WHEN incremental_revenue_qty <> 0 THEN abs(incremental_revenue_qty) ELSE greatest(abs(incremental_revenue_price), 1) END) THEN 'DESTROYS_VALUE' WHEN roi < 0 THEN 'MIXED' ELSE 'WIN' END AS score FROM wr""",
  "net_incremental_revenue:2 roi:5")
register("promo_effectivity", lambda tx: M.promo_effectivity(waterfall(tx), found(tx)), f"""
WITH {FULL}, {FALL}, so AS (SELECT stockcode, sum(promo_revenue) AS s FROM pm GROUP BY 1), v AS (SELECT stockcode, round(incremental_revenue_qty, 6) AS volume, round(roi * 100, 6) AS roi_pct, coalesce(s, 0) AS promo_revenue FROM wf LEFT JOIN so USING (stockcode))
SELECT *, {four(f'volume >= {MED("volume")}', f'roi_pct >= {MED("roi_pct")}', 'scale', 'optimize', 'rethink', 'stop')} AS quadrant FROM v""", "volume:2 roi_pct:3 promo_revenue:2")
PREPOST = f"""ppj AS (SELECT pp.stockcode, start_date, end_date, price * quantity AS v, CAST(date AS DATE) >= start_date AS now FROM pp JOIN px ON px.stockcode = pp.stockcode AND CAST(date AS DATE) BETWEEN start_date - duration_days AND end_date),
cmp AS (SELECT stockcode, start_date, end_date, coalesce(sum(v) FILTER (now), 0) AS a, coalesce(sum(v) FILTER (NOT now), 0) AS b FROM ppj GROUP BY 1, 2, 3)"""
compared = lambda tx: once(tx, "compared", lambda: M.pre_post_comparison(prices(tx), periods(tx), orders=False))
register("promo_roi", lambda tx: M.promo_roi(compared(tx)), f"""
WITH {PR}, {PREPOST} SELECT stockcode, start_date, end_date, a - b AS incremental_revenue, (a - b) * 0.3 - a * 0.15 AS incremental_profit, a * 0.15 AS promo_cost, CASE WHEN a > 0 THEN ((a - b) * 0.3 - a * 0.15) / (a * 0.15) * 100 ELSE 0 END AS roi_pct FROM cmp""",
  "incremental_revenue:2 incremental_profit:3 promo_cost:3 roi_pct:3")
register("promo_observed", lambda tx: M.promo_observed(compared(tx), waterfall(tx)), f"""
WITH {PR}, {FALL}, {PREPOST}, se AS (SELECT stockcode, avg(CASE WHEN b > 0 THEN (a / b - 1) * 100 ELSE 0 END) AS observed_lift_pct, count(*) AS n_promos FROM cmp GROUP BY 1),
td AS (SELECT stockcode, CASE WHEN baseline_revenue > 0 THEN incremental_revenue / baseline_revenue * 100 ELSE 0 END AS estimated_lift_pct FROM wf)
SELECT stockcode, observed_lift_pct, n_promos, estimated_lift_pct, observed_lift_pct - estimated_lift_pct AS gap_pct FROM se FULL JOIN td USING (stockcode)""", "observed_lift_pct:3 estimated_lift_pct:3 gap_pct:3")
register("discount_response", lambda tx: M.discount_response(found(tx), baseline(tx)), f"""
WITH {FULL}, {LINE}, dp AS (SELECT stockcode, start_date, CAST(floor((avg_discount_pct + 2.5) / 5) * 5 AS INTEGER) AS d, CAST(unnest(generate_series(date_trunc('week', start_date), date_trunc('week', end_date), INTERVAL 7 DAY)) AS DATE) AS week FROM pm),
o AS (SELECT dp.stockcode, start_date, d, sum(incremental_units) AS u FROM dp LEFT JOIN bl ON bl.stockcode = dp.stockcode AND bl.week = dp.week GROUP BY 1, 2, 3), g AS (SELECT d, avg(u) AS m, count(*) AS n FROM o GROUP BY 1)
SELECT CAST(x * 5 AS INTEGER) AS discount_pct, coalesce(m, 0) AS mean_incremental_units, coalesce(n, 0) AS promo_count FROM range(1, 6) r(x) LEFT JOIN g ON d = x * 5""", "mean_incremental_units:3")
register("promo_manager", lambda tx: M.promo_manager(waterfall(tx), found(tx)), f"""
WITH {FULL}, {FALL} SELECT stockcode, incremental_revenue_qty, cannibalization_revenue, roi * 100 AS roi_pct, start_date, end_date, avg_discount_pct, promo_revenue, promo_qty, base_total AS baseline_revenue,
CASE WHEN incremental_revenue_qty > 0 AND roi * 100 >= 50 THEN 'scale' WHEN incremental_revenue_qty > 0 AND roi > 0 THEN 'optimize' WHEN incremental_revenue_qty = 0 AND roi > 0 THEN 'rethink' ELSE 'stop' END AS recommendation
FROM wf JOIN pm USING (stockcode) LEFT JOIN bq USING (stockcode)""", "incremental_revenue_qty:2 cannibalization_revenue:2 roi_pct:3 avg_discount_pct:4 promo_revenue:2 promo_qty:2 baseline_revenue:2")
register("category_cannibalization", lambda tx: M.category_cannibalization(prices(tx), found(tx)), f"""
WITH {PR}, {CATS.replace('FROM tx', 'FROM px')}, pc2 AS (SELECT pp.stockcode, start_date, end_date AS b, category AS promo_category, least(duration_days, 30) AS n FROM pp JOIN cm USING (stockcode)), dy AS (SELECT category, CAST(date AS DATE) AS d, {R} AS r FROM px GROUP BY 1, 2),
o AS (SELECT stockcode, start_date, promo_category, dy.category AS peer_category, coalesce(sum(r) FILTER (d > b - n), 0) AS pr, coalesce(sum(r) FILTER (d <= b - n), 0) AS br FROM pc2 JOIN dy ON dy.category <> promo_category AND d BETWEEN b - CAST(2 * n - 1 AS INTEGER) AND b GROUP BY 1, 2, 3, 4),
g AS (SELECT promo_category, peer_category, count(*) AS n_promos, sum(pr) AS promo_revenue, sum(br) AS base_revenue, sum(greatest(0, br - pr)) AS cannibalized_revenue FROM o WHERE br >= 1 GROUP BY 1, 2)
SELECT *, least(1, cannibalized_revenue / base_revenue) AS cannibalization_index FROM g""", "promo_revenue:2 base_revenue:2 cannibalized_revenue:2 cannibalization_index")
register("promo_panel", lambda tx: M.promo_panel(prices(tx), found(tx)), f"""
WITH {PR}, {SALES} SELECT stockcode, week, is_promo, ln(u) AS log_units, ln(avg_price) AS log_price, lag(ln(u)) OVER (PARTITION BY stockcode ORDER BY week) AS lag_log_units FROM sl""", "log_units log_price lag_log_units")
register("promo_baseline_revenue", lambda tx: M.baseline_revenue(prices(tx), found(tx)), f"WITH {PR}, {SALES} SELECT stockcode, avg(r) AS baseline_weekly_revenue, count(*) AS n_weeks FROM sl WHERE NOT is_promo GROUP BY 1", "baseline_weekly_revenue:3")


def promo_test(tx):
    b = M.promo_baskets(prices(tx), found(tx))
    b = b.select(F.concat_ws("|", "stockcode", "start_date").alias("promo"), "during", F.round("basket_revenue", 2).alias("v"))
    return L.rank_sum_test(b, "promo", "during", "v")


ERFC = " ".join(f"{c} + t * (" for c in L.ERFC[:-1]) + str(L.ERFC[-1]) + ")" * (len(L.ERFC) - 1)
register("promo_rank_test", promo_test, f"""
WITH {PR}, bk AS (SELECT concat_ws('|', pp.stockcode, start_date) AS promo, transaction_id, CAST(date AS DATE) >= start_date AS d, round({R}, 2) AS v FROM pp JOIN px ON px.stockcode = pp.stockcode AND CAST(date AS DATE) BETWEEN start_date - duration_days AND end_date GROUP BY 1, 2, 3),
rk AS (SELECT promo, d, rank() OVER (PARTITION BY promo ORDER BY v) + (count(*) OVER (PARTITION BY promo, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY promo, v) AS c FROM bk),
a AS (SELECT promo, coalesce(sum(r) FILTER (d), 0) AS s, count(*) FILTER (d) AS n1, count(*) FILTER (NOT d) AS n2, count(*) AS n, sum(c * c - 1) AS ties FROM rk GROUP BY 1),
b AS (SELECT promo, n1, n2, n, s - n1 * (n1 + 1) / 2 AS u, CASE WHEN n > 1 THEN sqrt(greatest(0, CAST(n1 AS DOUBLE) * n2 / 12 * (n + 1 - ties / (CAST(n AS DOUBLE) * (n - 1))))) ELSE 0 END AS sd FROM a),
z AS (SELECT *, CASE WHEN sd > 0 THEN greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd ELSE 0 END AS z FROM b), p AS (SELECT *, 1 / (1 + 0.5 * z / sqrt(2)) AS t FROM z)
SELECT promo, n1, n2, u, z, CASE WHEN n1 >= 3 AND n2 >= 3 THEN t * exp(-z * z / 2 + {ERFC}) END AS p_value FROM p""", "u z:5 p_value:5")

# segments

SEGX = f"{SEG}, sx AS (SELECT tx.*, segment FROM tx JOIN seg USING (customer_id))"
ECON = f"ec AS (SELECT segment, count(DISTINCT customer_id) AS customers, count(DISTINCT transaction_id) AS transactions, {R} AS revenue, sum(quantity) AS units FROM sx GROUP BY 1)"
register("segment_sizes", lambda tx: G.segment_sizes(segs(tx), tx), f"WITH {SEGX} SELECT segment, count(DISTINCT customer_id) AS customers, {R} AS monetary FROM sx GROUP BY 1", "monetary:2")
register("segment_economics", lambda tx: G.segment_economics(segs(tx), tx), f"""
WITH {SEGX}, {ECON} SELECT *, transactions / customers AS orders_per_customer, revenue / transactions AS avg_basket_value, revenue / customers AS revenue_per_customer FROM ec""", "revenue:2 units:2 orders_per_customer avg_basket_value:4 revenue_per_customer:4")
register("segment_categories", lambda tx: G.segment_categories(segs(tx), tx), f"""
WITH {SEGX}, g AS (SELECT segment, category, {R} AS revenue, count(DISTINCT customer_id) AS customers FROM sx GROUP BY 1, 2), n AS (SELECT segment, count(DISTINCT customer_id) AS n FROM sx GROUP BY 1)
SELECT segment, category, revenue, customers, revenue / sum(revenue) OVER (PARTITION BY segment) * 100 AS revenue_pct, revenue / sum(revenue) OVER (PARTITION BY segment) / (sum(revenue) OVER (PARTITION BY category) / sum(revenue) OVER ()) AS affinity_index, customers / n * 100 AS penetration_pct FROM g JOIN n USING (segment)""",
  "revenue:2 revenue_pct affinity_index penetration_pct")
HALF = "md AS (SELECT quantile_cont(epoch(date), 0.5) AS m FROM tx)"
GROW = f"""{HALF}, hf AS (SELECT segment, epoch(date) > m AS late, {R} AS revenue, count(DISTINCT customer_id) AS customers, count(DISTINCT transaction_id) AS transactions, avg(price * quantity) AS aov FROM sx, md GROUP BY 1, 2),
gr AS (SELECT a.segment, (b.revenue - a.revenue) / a.revenue * 100 AS revenue_growth_pct, (b.customers - a.customers) / a.customers * 100 AS customer_growth_pct, (b.transactions - a.transactions) / a.transactions * 100 AS frequency_growth_pct, (b.aov - a.aov) / a.aov * 100 AS avg_order_value_growth_pct,
  b.revenue / sum(b.revenue) OVER () * 100 - a.revenue / sum(a.revenue) OVER () * 100 AS segment_share_change_pct FROM hf a JOIN hf b ON a.segment = b.segment AND NOT a.late AND b.late)"""
register("segment_growth", lambda tx: G.segment_growth(segs(tx), tx), f"WITH {SEGX}, {GROW} SELECT * FROM gr", "revenue_growth_pct:4 customer_growth_pct:4 frequency_growth_pct:4 avg_order_value_growth_pct:4 segment_share_change_pct:4")
register("segment_manager", lambda tx: G.segment_manager(G.segment_economics(segs(tx), tx), G.segment_growth(segs(tx), tx)), f"""
WITH {SEGX}, {ECON}, {GROW}, j AS (SELECT segment, revenue, customers, transactions, revenue / customers AS revenue_per_customer, coalesce(revenue_growth_pct, 0) AS revenue_growth_pct, coalesce(customer_growth_pct, 0) AS customer_growth_pct FROM ec LEFT JOIN gr USING (segment))
SELECT *, {four(f'revenue_growth_pct >= {MED("revenue_growth_pct")}', f'revenue_per_customer >= {MED("revenue_per_customer")}', 'Invest', 'Develop', 'Retain', 'Depreciate')} AS quadrant,
{four('revenue_growth_pct >= 0', f'revenue > {MED("revenue")}', 'Invest', 'Build', 'Harvest', 'Hold')} AS action FROM j""", "revenue:2 revenue_per_customer:4 revenue_growth_pct:4 customer_growth_pct:4")
register("segment_engagement", lambda tx: G.segment_engagement(segs(tx), tx), f"""
WITH {SEGX}, en AS (SELECT CAST(max(date) AS DATE) AS e FROM tx), c AS (SELECT segment, customer_id, count(DISTINCT transaction_id) AS f, date_diff('day', CAST(max(date) AS DATE), any_value(e)) AS rc, date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) / greatest(count(DISTINCT CAST(date AS DATE)) - 1, 1) AS b,
  count(DISTINCT date_trunc('week', date)) AS w, count(DISTINCT date_trunc('month', date)) AS m FROM sx, en GROUP BY 1, 2)
SELECT segment, count(*) AS total_customers, avg(f) AS purchase_frequency, avg(rc) AS recency_days, avg(b) AS avg_days_between, avg(w) AS active_weeks, avg(m) AS active_months, count(*) FILTER (rc <= 30) / count(*) * 100 AS active_customer_rate_pct, count(*) FILTER (rc > 90) / count(*) * 100 AS dormancy_rate_pct FROM c GROUP BY 1""",
  "purchase_frequency:5 recency_days:5 avg_days_between:5 active_weeks:5 active_months:5 active_customer_rate_pct:4 dormancy_rate_pct:4")
register("segment_baskets", lambda tx: G.segment_baskets(segs(tx), tx), f"""
WITH {SEGX}, b AS (SELECT segment, customer_id, transaction_id, round({R}, 2) AS v, sum(quantity) AS u, count(DISTINCT stockcode) AS s, count(DISTINCT category) AS c FROM sx GROUP BY 1, 2, 3), m AS (SELECT segment, quantile_cont(v, 0.5) AS m FROM b GROUP BY 1)
SELECT segment, count(*) AS n_baskets, avg(v) AS avg_basket_value, avg(u) AS avg_units_per_basket, avg(s) AS avg_skus_per_basket, avg(c) AS avg_categories_per_basket, count(*) FILTER (v > m) / count(*) * 100 AS large_basket_rate_pct, count(*) FILTER (v < m * 0.5) / count(*) * 100 AS small_basket_rate_pct FROM b JOIN m USING (segment) GROUP BY 1""",
  "avg_basket_value:3 avg_units_per_basket:4 avg_skus_per_basket:5 avg_categories_per_basket:5 large_basket_rate_pct:4 small_basket_rate_pct:4")
register("segment_retention", lambda tx: G.segment_retention(segs(tx), tx), f"""
WITH {SEGX}, {HALF}, c AS (SELECT segment, customer_id, bool_or(epoch(date) > m) AS b, bool_or(epoch(date) <= m) AS a, count(DISTINCT transaction_id) AS n FROM sx, md GROUP BY 1, 2)
SELECT segment, count(*) FILTER (a) AS n_first, count(*) FILTER (a AND b) AS n_kept, count(*) FILTER (n > 1) / count(*) * 100 AS repeat_customer_pct, CASE WHEN count(*) FILTER (a) > 0 THEN count(*) FILTER (a AND b) / count(*) FILTER (a) * 100 ELSE 0 END AS retention_pct FROM c GROUP BY 1""", "repeat_customer_pct:4 retention_pct:4")
register("segment_prices", lambda tx: G.segment_prices(segs(tx), tx), f"""
WITH {SEGX}, us AS (SELECT stockcode, avg(price) AS p FROM tx GROUP BY 1)
SELECT segment, avg(price) AS avg_price, stddev_samp(price) / avg(price) AS price_cv, avg(price / p) AS price_index, count(*) FILTER (price < p) / count(*) * 100 AS below_usual_pct FROM sx JOIN us USING (stockcode) GROUP BY 1""", "avg_price:4 price_cv price_index below_usual_pct:4")

# general table operations

register("revenue_cube", lambda tx: L.revenue_cube(tx, "category", "brand"), f"SELECT category, brand, CAST(grouping(category, brand) AS BIGINT) AS grouping, {R} AS revenue, count(DISTINCT transaction_id) AS orders FROM tx GROUP BY CUBE (category, brand)", "revenue:2")
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
register("weekday_pivot", lambda tx: L.weekday_pivot(tx, "category"), f"SELECT category, {', '.join(f'coalesce({R} FILTER (isodow(date) = {i + 1}), 0) AS {d}' for i, d in enumerate(DAYS))} FROM tx GROUP BY 1", " ".join(f"{d}:2" for d in DAYS))
register("product_metrics_long", lambda tx: L.unpivoted(P.product_metrics(tx), ["stockcode"], ["revenue", "units", "transactions"]), f"""
WITH m AS (SELECT stockcode, {R} AS revenue, sum(quantity) AS units, CAST(count(DISTINCT transaction_id) AS DOUBLE) AS transactions FROM tx GROUP BY 1) SELECT stockcode, metric, value FROM (UNPIVOT m ON revenue, units, transactions INTO NAME metric VALUE value)""", "value:2")
register("filled_prices", L.filled_prices, f"""
WITH t AS (SELECT stockcode, {WEEK} AS week, avg(price) AS price FROM tx GROUP BY 1, 2), s AS (SELECT stockcode, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM t GROUP BY 1)
SELECT s.stockcode, s.week, last_value(price IGNORE NULLS) OVER (PARTITION BY s.stockcode ORDER BY s.week ROWS UNBOUNDED PRECEDING) AS price, price IS NOT NULL AS observed FROM s LEFT JOIN t ON t.stockcode = s.stockcode AND t.week = s.week""", "price:5")
register("customers_of_both", lambda tx: L.customers_of_both(tx, "ECONOMY", "PROMO"), "SELECT customer_id FROM tx WHERE category = 'ECONOMY' INTERSECT SELECT customer_id FROM tx WHERE category = 'PROMO'")
register("customers_of_first_only", lambda tx: L.customers_of_first_only(tx, "ECONOMY", "PROMO"), "SELECT customer_id FROM tx WHERE category = 'ECONOMY' EXCEPT SELECT customer_id FROM tx WHERE category = 'PROMO'")


def prices_before_baskets(tx):
    """The latest mean daily price of the same product before or on each month's first day."""
    daily = tx.groupBy("stockcode", F.to_date("date").alias("day")).agg(F.avg("price").alias("price"))
    firsts = tx.select("stockcode", F.to_date(F.date_trunc("month", "date")).alias("day")).distinct()
    return L.asof_join(firsts, daily, ["stockcode"], "day", ["price"])


register("asof_prices", prices_before_baskets, """
WITH d AS (SELECT stockcode, CAST(date AS DATE) AS day, avg(price) AS price FROM tx GROUP BY 1, 2), f AS (SELECT DISTINCT stockcode, CAST(date_trunc('month', date) AS DATE) AS day FROM tx)
SELECT f.stockcode, f.day, d.price FROM f ASOF LEFT JOIN d ON f.stockcode = d.stockcode AND f.day >= d.day""", "price:5")
register("assortment_portfolio_funnel", lambda tx: portfolio(tx).groupBy("quadrant").agg(F.count("*").alias("n_products"), F.sum("revenue_share").alias("revenue_share")), f"""
WITH {PORT}, q AS (SELECT *, {four(f'revenue_share >= {MED("revenue_share")}', f'uniqueness >= {MED("uniqueness")}', 'core', 'replaceable_seller', 'niche', 'tail')} AS quadrant FROM po)
SELECT quadrant, count(*) AS n_products, sum(revenue_share) AS revenue_share FROM q GROUP BY 1""", "revenue_share")

