"""Queries on decisions: risk, funnel, queue and priorities of all opportunities, strategy of categories, rules between categories, what data is good for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import cut, once, stored
from ..operators import decisions as D
from ..operators import opportunities as O
from ..operators import pricing as Z
from ..operators.features import category_map
from ..sources.lines import star_lines
# queries that those below build on
from . import boards, opportunities, roles  # noqa: F401
from .advanced import RULES, mined
from .base import ORACLE_SQL, QUERIES, register
from .learning import predicted
from .shopping import CATS


def sql(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


def shown(name: str, tx: DataFrame) -> DataFrame:
    """A registered query's rows as they are shown, that is rounded, as its SQL gives them."""
    return QUERIES[name](tx.sparkSession, "", tx)


case = lambda c, names, other: f"CASE {' '.join(f'WHEN {c} = {k!r} THEN {v!r}' for k, v in names.items())} ELSE {other} END"

# over all opportunities and insights; both are made from lines that are read once, and share what they make of them


def signals(spark, sf_dir, *names) -> list[DataFrame]:
    lines = stored(star_lines(spark, sf_dir))
    return [lines, *(cut(QUERIES[n](spark, sf_dir, lines)) for n in names)]


def risk(spark, sf_dir):
    return D.opportunity_risk(signals(spark, sf_dir, "opportunity_list")[1])


def funnel(spark, sf_dir):
    return D.portfolio_funnel(*signals(spark, sf_dir, "opportunity_list", "insight_list")[1:])


def queue(spark, sf_dir):
    tx, listed = signals(spark, sf_dir, "opportunity_list")
    return D.action_queue(listed, category_map(tx), shown("pricing_decision_matrix", tx))


def first(spark, sf_dir):
    return D.priorities(*signals(spark, sf_dir, "opportunity_list", "insight_list")[1:])


L, N = sql("opportunity_list"), sql("insight_list")
register("opportunity_risk", None, f"""
WITH l AS (SELECT *, {case('confidence', D.RISK, 1.0)} AS risk_level, least(1, value / greatest(1, max(value) OVER ())) AS opp_value FROM {L})
SELECT area, source, subject, value, confidence, risk_level, opp_value,
  CASE WHEN opp_value >= 0.5 AND risk_level < 0.5 THEN 'do_now' WHEN opp_value >= 0.5 THEN 'test_first' WHEN risk_level >= 0.5 THEN 'watch' ELSE 'quick_win' END AS quadrant FROM l""", "value:2 risk_level opp_value", source=risk)
register("portfolio_funnel", None, f"""
WITH l AS (SELECT * FROM {L}), i AS (SELECT * FROM {N}),
c AS (SELECT (SELECT count(*) FROM l) AS f, (SELECT count(*) FROM i) AS s, (SELECT count(*) FROM l WHERE confidence = 'high') AS h, (SELECT count(*) FROM (SELECT subject FROM l UNION SELECT subject FROM i)) AS a),
x AS (SELECT 1 AS place, 'signals' AS stage, f + s AS n FROM c UNION ALL SELECT 2, 'analysed', a FROM c UNION ALL SELECT 3, 'evidence_sufficient', h FROM c UNION ALL SELECT 4, 'opportunities', f FROM c
  UNION ALL SELECT 5, 'high_priority', CASE WHEN f > 0 THEN greatest(1, f // 4) ELSE 0 END FROM c)
SELECT x.*, CASE WHEN f + s > 0 THEN least(1, n / (f + s)) ELSE 0 END AS share FROM x, c""", "share", source=funnel)
register("action_queue", None, f"""
WITH {CATS}, j AS (SELECT l.*, cm.category, decision FROM {L} l LEFT JOIN cm ON cm.stockcode = subject LEFT JOIN (SELECT stockcode, decision FROM {sql('pricing_decision_matrix')}) d ON d.stockcode = subject),
p AS (SELECT *, CASE WHEN value > 0 AND confidence = 'high' THEN 'High' WHEN value > 0 AND confidence = 'medium' THEN 'Medium' ELSE 'Low' END AS priority, {case('decision', D.NEXT_STEP, 'source')} AS next_action FROM j)
SELECT row_number() OVER (ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, value DESC, area, subject, source) AS place, priority, subject, category, area, value, confidence, next_action FROM p""", "value:2", source=queue)
register("five_priorities", None, f"""
WITH o AS (SELECT 'opportunity' AS type, area, subject, source, value, value * {case('confidence', D.TRUST, 0.7)} * (1 + (1 - count(*) OVER (PARTITION BY area) / count(*) OVER ()) * 0.2) AS score FROM {L}),
i AS (SELECT 'insight' AS type, area, subject, kind AS source, value, coalesce(value, 0) * 0.5 * 0.7 AS score FROM {N}), t AS (SELECT * FROM o UNION ALL SELECT * FROM i)
SELECT *, row_number() OVER (ORDER BY round(score, 4) DESC, type, area, subject, source) AS place FROM t QUALIFY place <= 5""", "value:2 score:2", source=first)

# categories


def strategy(tx: DataFrame) -> DataFrame:
    tx = stored(tx)
    return D.strategy_scorecard(
        shown("manager_scorecard", tx), shown("category_roles", tx), shown("assortment_efficiency", tx), D.category_reach(tx), shown("pricing_decision_matrix", tx),
        O.product_roi(shown("promo_roi", tx)), shown("switching_status", tx), category_map(tx),
    )


BY = lambda table, value: f"(SELECT category, arg_min(v, (-r, v)) AS v FROM (SELECT category, {value} AS v, round(sum(total_revenue), 2) AS r FROM {table} GROUP BY 1, 2) GROUP BY 1)"
register("strategy_scorecard", strategy, f"""
WITH {CATS}, dm AS (SELECT stockcode, category, decision, total_revenue FROM {sql('pricing_decision_matrix')}), ss AS (SELECT dm.*, switching_status FROM dm JOIN {sql('switching_status')} s USING (stockcode)),
ro AS (SELECT stockcode, CASE WHEN sum(promo_cost) > 0 THEN round(sum(incremental_profit) / sum(promo_cost) * 100, 6) ELSE 0 END AS roi FROM {sql('promo_roi')} GROUP BY 1), pr AS (SELECT category, avg(roi) AS roi FROM ro JOIN cm USING (stockcode) GROUP BY 1),
re AS (SELECT category, count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM tx) AS reach FROM tx GROUP BY 1)
SELECT m.category, coalesce(role, 'Routine') AS role, m.total_revenue AS revenue, coalesce(revenue_yoy_growth, 0) AS growth, coalesce(reach, basket_penetration) * 100 AS customer_reach, coalesce(po.v, 'review') AS price_position, coalesce(pr.roi, 0) AS promo_roi,
  coalesce(efficiency_label, 'balanced') AS assortment_health, coalesce(sw.v, 'unknown') AS switching_risk, repeat_purchase_rate * least(m.total_revenue / 1000, 100) AS customer_value
FROM {sql('manager_scorecard')} m LEFT JOIN {sql('category_roles')} r USING (category) LEFT JOIN {sql('assortment_efficiency')} a USING (category) LEFT JOIN re USING (category) LEFT JOIN pr USING (category)
LEFT JOIN {BY('dm', case('decision', {'invest': 'premium', 'protect': 'stable', 'price_lever': 'competitive'}, "'review'"))} po USING (category)
LEFT JOIN {BY('ss', case('switching_status', {'no_switching_observed': 'low', 'estimated': 'medium', 'insufficient_observations': 'medium'}, "'high'"))} sw USING (category)""", "revenue:2 growth:4 customer_reach:4 promo_roi:3 customer_value:3")


def between_categories(tx: DataFrame) -> DataFrame:
    tx = stored(tx)
    return D.category_rules(mined(tx), tx, cut(category_map(tx)))


register("category_rules", between_categories, f"""
WITH {RULES}, {CATS}, rk AS (SELECT r.*, x.category AS ca, y.category AS cc FROM rules r JOIN cm x ON x.stockcode = antecedents JOIN cm y ON y.stockcode = consequents),
cg AS (SELECT ca AS antecedent_category, cc AS consequent_category, count(*) AS rule_count, avg(support) AS support, avg(confidence) AS confidence, avg(lift) AS lift, max(lift) AS max_lift FROM rk GROUP BY 1, 2),
cb AS (SELECT DISTINCT transaction_id, cm.category AS c FROM tx JOIN cm USING (stockcode)), cn AS (SELECT c, count(*) AS k FROM cb GROUP BY 1), ct AS (SELECT count(DISTINCT transaction_id) AS t FROM cb),
cp AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM cb x JOIN cb y USING (transaction_id) GROUP BY 1, 2)
SELECT cg.*, coalesce(cp.k, 0) * t / (na.k * nc.k) AS avg_lift FROM cg JOIN cn na ON na.c = antecedent_category JOIN cn nc ON nc.c = consequent_category LEFT JOIN cp ON cp.a = antecedent_category AND cp.b = consequent_category, ct""", "support confidence lift avg_lift max_lift")

# insights and opportunities of prices, customers and assortments



def priced(tx: DataFrame) -> DataFrame:
    tx = stored(tx)
    return D.pricing_insights(shown("elasticity_status", tx), shown("kvi_scores", tx), shown("pricing_decision_matrix", tx))


register("pricing_insights", priced, f"""
WITH k AS (SELECT stockcode, total_revenue FROM {sql('kvi_scores')}), s AS (SELECT stockcode, elasticity_status AS e, coalesce(total_revenue, 0) AS r, (SELECT quantile_cont(total_revenue, 0.75) FROM k) AS edge FROM {sql('elasticity_status')} LEFT JOIN k USING (stockcode)),
f AS (SELECT *, e IN ('estimated', 'weak') AS u, e IN ('insufficient_variation', 'insufficient_price_points') AS flat, e NOT IN ('estimated', 'weak') AND r >= edge AS large FROM s),
t AS (SELECT count(*) AS n, count(*) FILTER (u) AS k, coalesce(sum(r) FILTER (u), 0) AS covered, coalesce(sum(r) FILTER (NOT u), 0) AS o, count(*) FILTER (e = 'weak') AS w, sum(r) FILTER (e = 'weak') AS wr, count(*) FILTER (large) AS l, sum(r) FILTER (large) AS lr, count(*) FILTER (flat) AS z, sum(r) FILTER (flat) AS zr FROM f),
x AS (SELECT 'coverage' AS kind, 'products' AS subject, CASE WHEN k / n < 0.5 THEN 'Few products have an elasticity that can be used' ELSE 'Most products have an elasticity that can be used' END AS text, CASE WHEN k / n < 0.5 THEN o ELSE covered END AS value, CASE WHEN k / n < 0.5 THEN 'warning' ELSE 'info' END AS severity FROM t
  UNION ALL SELECT 'weak_estimates', CAST(w AS VARCHAR), 'Revenue under estimates that are not sure', wr, 'info' FROM t WHERE w > 0 UNION ALL SELECT 'large_without_estimate', CAST(l AS VARCHAR), 'Revenue of large sellers without an estimate', lr, 'warning' FROM t WHERE l > 0 AND lr > 0
  UNION ALL SELECT 'flat_prices', CAST(z AS VARCHAR), 'Prices vary too little to learn from', zr, 'info' FROM t WHERE z > 0
  UNION ALL SELECT 'decision', decision, 'Revenue under this decision', sum(total_revenue), 'info' FROM {sql('pricing_decision_matrix')} WHERE decision IN ('invest', 'protect', 'price_lever', 'review') GROUP BY decision)
SELECT 'pricing' AS area, x.* FROM x""", "value:2")
register("customer_insights", lambda tx: D.customer_insights(predicted(tx)), None)
chosen = lambda tx: shown("assortment_greedy", tx)
scored = lambda tx: once(tx, "scenarios", lambda: shown("assortment_scenarios", tx))
BEST = f"""b AS (SELECT *, kept_revenue + recovered_revenue AS expected, CASE WHEN kept_revenue + recovered_revenue + unmet_revenue > 0 THEN 1 - kept_revenue / (kept_revenue + recovered_revenue + unmet_revenue) ELSE 0 END AS cut
  FROM {sql('assortment_scenarios')} ORDER BY round(kept_revenue + recovered_revenue, 4) DESC, scenario_id LIMIT 1)"""
register("assortment_insights", lambda tx: D.assortment_insights(scored(tx), chosen(tx)), f"""
WITH {BEST}, x AS (SELECT 'best_scenario' AS kind, CAST(n_skus AS VARCHAR) AS subject, 'Expected revenue of the best scenario' AS text, expected AS value, 'info' AS severity FROM b
  UNION ALL SELECT CASE WHEN cut > 0.3 THEN 'deep_cut' ELSE 'shallow_cut' END, CAST(n_skus AS VARCHAR), CASE WHEN cut > 0.3 THEN 'A deep cut leaves demand unmet' ELSE 'Most revenue is in what is kept' END, unmet_revenue, CASE WHEN cut > 0.3 THEN 'warning' ELSE 'info' END FROM b
  UNION ALL SELECT 'solution', CAST(count(*) AS VARCHAR), 'Revenue of the chosen solution', sum(revenue), 'info' FROM {sql('assortment_greedy')} HAVING count(*) > 0) SELECT 'assortment' AS area, x.* FROM x""", "value:2")
register("assortment_opportunities", lambda tx: D.assortment_opportunities(scored(tx), chosen(tx)), f"""
WITH {BEST} SELECT 'assortment' AS area, 'scenario' AS source, 'best scenario' AS subject, recovered_revenue AS value, 'medium' AS confidence FROM b
UNION ALL SELECT * FROM (SELECT 'assortment', 'solution', stockcode, revenue, 'medium' FROM {sql('assortment_greedy')} ORDER BY round(revenue, 2) DESC, stockcode LIMIT 10)""", "value:2")

WANT = " UNION ALL ".join(f"SELECT '{a}' AS analysis, {b} AS b, {c} AS c, {p} AS p" for a, (b, c, p) in D.NEEDS.items())
SHORT = lambda b, c, p: f"concat_ws(',', CASE WHEN nb < {b} THEN 'baskets' END, CASE WHEN nc < {c} THEN 'customers' END, CASE WHEN np < {p} THEN 'products' END)"
register("analysis_eligibility", D.eligibility, f"""
WITH n AS (SELECT count(DISTINCT transaction_id) AS nb, count(DISTINCT customer_id) AS nc, count(DISTINCT stockcode) AS np FROM tx)
SELECT analysis, nb >= 100 AND nc >= 50 AND np >= 10 AS is_eligible, {SHORT(100, 50, 10)} AS blocked_by, {SHORT('b', 'c', 'p')} AS low_on, CAST(greatest(100, b) AS INTEGER) AS min_baskets, CAST(greatest(50, c) AS INTEGER) AS min_customers, CAST(greatest(10, p) AS INTEGER) AS min_products FROM n, ({WANT})""")


def reliable(tx: DataFrame) -> DataFrame:
    e = Z.elasticity_confidence(Z.own_price_elasticity(tx))
    return D.by_reliability(e, "medium", "confidence").select("stockcode", "elasticity", "confidence")


register("reliable_elasticities", reliable, f"SELECT stockcode, elasticity, confidence FROM {sql('elasticity_confidence')} WHERE confidence IN ('medium', 'high')", "elasticity")
