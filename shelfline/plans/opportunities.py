"""Queries on insights and opportunities."""

from pyspark.sql import functions as F

from ..functions.store import cut, stored
from ..operators import basket as K
from ..operators import cohort as C
from ..operators import opportunities as O
from ..operators import performance as P
from ..operators import pricing as Z
from ..operators import promo as M
from ..operators import switching as S
from ..sources.lines import star_lines
from .advanced import PEN
from .base import ORACLE_SQL, QUERIES, register
from .boards import FALL, PREPOST, SDP, compared, every, sdp, waterfall
from .commercial import CUT, KVI, PR, kvi, periods, prices
from .shopping import ABC, DT, FIRST, R, REP, RET, VEL, XYZ

SIZE = "sz AS (SELECT cohort, count(*) AS n_customers FROM f GROUP BY 1)"
register("cohort_insights", lambda tx: O.cohort_insights(C.cohort_sizes(tx), C.cohorts(tx)), f"""
WITH {RET}, {SIZE}, l AS (SELECT cohort, n_customers / lag(n_customers) OVER (ORDER BY cohort) - 1 AS c FROM sz ORDER BY cohort DESC LIMIT 1),
x AS (SELECT 'smaller_cohort' AS kind, cohort, 'Fewer new customers than in the period before' AS text, c AS value, 'warning' AS severity FROM l WHERE c < -0.1
  UNION ALL SELECT 'larger_cohort', cohort, 'More new customers than in the period before', c, 'info' FROM l WHERE c > 0.1
  UNION ALL SELECT 'low_retention', cohort, 'Few new customers came back in the next period', retention_rate, 'warning' FROM ret WHERE cohort = (SELECT max(cohort) FROM ret) AND period_index = 1 AND retention_rate < 0.2)
SELECT 'cohort' AS area, kind, CAST(cohort AS VARCHAR) AS subject, text, value, severity FROM x""", "value")
register("cohort_opportunities", lambda tx: O.cohort_opportunities(C.cohort_sizes(tx), C.cohorts(tx)), f"""
WITH {RET}, {SIZE}, jc AS (SELECT ret.cohort, period_index, retention_rate AS rate, n_customers AS n, ret.cohort = (SELECT max(cohort) FROM sz) AND period_index = 1 AS mine FROM ret JOIN sz ON sz.cohort = ret.cohort),
a AS (SELECT 'retention' AS source, cohort, n * rate AS value, 'medium' AS confidence FROM jc WHERE mine AND rate >= 0.6
  UNION ALL SELECT 'size', cohort, n, 'medium' FROM jc WHERE mine AND n >= (SELECT quantile_cont(n_customers, 0.8) FROM sz)),
o AS (SELECT *, row_number() OVER (ORDER BY rate DESC, cohort, period_index) AS place FROM jc WHERE rate >= 0.6 AND cohort NOT IN (SELECT cohort FROM a)),
x AS (SELECT * FROM a UNION ALL SELECT 'retention', cohort, n * rate, 'low' FROM o WHERE place <= 10 - (SELECT count(*) FROM a))
SELECT 'cohort' AS area, source, CAST(cohort AS VARCHAR) AS subject, value, confidence FROM x ORDER BY value DESC, subject, source LIMIT 10""", "value:3")
HIGH, LOW = 0.06, 0.055
PENR = PEN.replace("AS penetration FROM", f"AS penetration, {R} / (SELECT {R} FROM tx) AS revenue_share FROM")
register("basket_opportunities", lambda tx: O.basket_opportunities(K.basket_penetration(tx), HIGH, LOW, top=20), f"""
WITH {PENR}, b AS (SELECT *, quantile_cont(revenue_share, 0.5) OVER () AS mid FROM pen WHERE revenue_share >= 0.01),
s AS (SELECT *, penetration >= {HIGH} AS high, CASE WHEN penetration >= {HIGH} THEN -penetration ELSE penetration END AS far, revenue_share >= mid AS strong FROM b WHERE penetration >= {HIGH} OR penetration < {LOW}),
k AS (SELECT *, strong AND row_number() OVER (PARTITION BY high, strong ORDER BY far, revenue_share DESC, stockcode) <= 10 AS chosen FROM s),
r AS (SELECT *, 20 - count(*) FILTER (chosen) OVER () AS room, count(*) FILTER (high AND NOT chosen) OVER () AS n_high, row_number() OVER (PARTITION BY high, chosen ORDER BY far, stockcode) AS place FROM k)
SELECT 'basket' AS area, CASE WHEN high AND chosen THEN 'traffic_driver' WHEN high THEN 'high_penetration' WHEN chosen THEN 'raise_penetration' ELSE 'low_penetration' END AS source, stockcode AS subject,
  revenue_share * 100 AS value, CASE WHEN chosen THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE chosen OR (high AND place <= room // 2) OR (NOT high AND place <= room - least(room // 2, n_high))""", "value:4")
SKU = f"""{ABC}, {XYZ}, v AS ({VEL}), rr AS ({REP}), sk AS (SELECT stockcode, abc.revenue AS revenue, velocity, repeat_rate, demand_profile <> 'Insufficient History' AND abc_class = 'C' AND xyz_class = 'Z' AS delist,
  velocity > quantile_cont(velocity, 0.5) OVER () AS fast, repeat_rate > quantile_cont(repeat_rate, 0.5) OVER () AS again FROM abc JOIN xyz USING (stockcode) JOIN v USING (stockcode) JOIN rr USING (stockcode))"""
register("product_opportunities", lambda tx: O.product_opportunities(P.sku_rationalization(tx)), f"""
WITH {SKU}, d1 AS (SELECT 'delist' AS source, stockcode, revenue AS value FROM sk WHERE delist ORDER BY revenue DESC, stockcode LIMIT 5),
d2 AS (SELECT 'sticky' AS source, stockcode, revenue * 0.1 AS value FROM sk WHERE fast AND again ORDER BY velocity DESC, repeat_rate DESC, stockcode LIMIT 5),
d3 AS (SELECT 'slow' AS source, stockcode, revenue * 0.05 AS value FROM sk WHERE NOT fast AND NOT again ORDER BY velocity, repeat_rate, stockcode LIMIT 5),
d4 AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3), d5 AS (SELECT stockcode, revenue, row_number() OVER (ORDER BY revenue DESC, stockcode) AS place FROM sk WHERE stockcode NOT IN (SELECT stockcode FROM d4)),
d6 AS (SELECT *, 'medium' AS confidence FROM d4 UNION ALL SELECT 'action', stockcode, revenue * 0.01, 'low' FROM d5 WHERE place <= 10 - (SELECT count(*) FROM d4))
SELECT 'product' AS area, source, stockcode AS subject, value, confidence FROM d6 ORDER BY value DESC, subject, source LIMIT 10""", "value:2")
T = "observed_switching_transfer_revenue"
LEVEL = " ".join(f"WHEN pairs >= {a} AND products >= {b} THEN {n}" for n, a, b in ((5, 50, 20), (4, 30, 15), (3, 20, 10), (2, 10, 5)))
impact = lambda tx: S.delist_impact(tx, S.demand_transference(tx), every(tx))
register("switching_insights", lambda tx: O.switching_insights(S.demand_transference(tx), sdp(tx), impact(tx)), f"""
WITH {SDP}, e AS (SELECT from_product AS p, -{T} AS v FROM dt UNION ALL SELECT to_product, {T} FROM dt), n AS (SELECT p, round(sum(v), 2) AS net FROM e GROUP BY 1),
i AS (SELECT stockcode, round(coalesce(t, 0) - r, 2) AS net FROM rv LEFT JOIN gs ON from_product = stockcode),
g AS (SELECT (SELECT count(*) FROM dt) AS pairs, (SELECT count(*) FROM n) AS products), c AS (SELECT count(*) FILTER (sdp < 0.2) AS u, count(*) FILTER (sdp >= 0.8) AS s FROM sdp),
x AS ((SELECT 'leakage' AS kind, p AS subject, 'Loses most revenue by switching' AS text, -net AS value, 'warning' AS severity FROM n WHERE net < 0 ORDER BY net, p LIMIT 1)
  UNION ALL (SELECT 'growth', p, 'Gains most revenue by switching', net, 'info' FROM n WHERE net > 0 ORDER BY net DESC, p LIMIT 1)
  UNION ALL SELECT 'unique_demand', 'products', 'Demand that no other product would take', u, 'warning' FROM c WHERE u > 0
  UNION ALL SELECT 'substitutable_demand', 'products', 'Demand that other products would take', s, 'info' FROM c WHERE s > 0
  UNION ALL (SELECT 'delist_loss', stockcode, 'Delisting would lose most', -net, 'warning' FROM i WHERE net < 0 ORDER BY net, stockcode LIMIT 1)
  UNION ALL (SELECT 'delist_gain', stockcode, 'Delisting would lose nothing', net, 'info' FROM i WHERE net > 0 ORDER BY net DESC, stockcode LIMIT 1))
SELECT 'switching' AS area, x.*, CAST(CASE {LEVEL} ELSE 1 END AS INTEGER) AS evidence_level FROM x, g""", "value:2")
SCORED = f"""{FALL}, {PREPOST}, wr AS (SELECT stockcode, round(incremental_revenue_qty, 6) AS q, round(incremental_revenue_price, 6) AS p, round(net_incremental_revenue, 6) AS net, round(roi, 6) AS roi FROM wf),
so AS (SELECT stockcode, net, CASE WHEN abs(q) <= 0.01 * greatest(abs(q), abs(p), 1) THEN 'INEFFECTIVE' WHEN q < 0 OR net < -0.5 * (CASE WHEN q <> 0 THEN abs(q) ELSE greatest(abs(p), 1) END) THEN 'DESTROYS_VALUE' WHEN roi < 0 THEN 'MIXED' ELSE 'WIN' END AS score FROM wr),
ro AS (SELECT stockcode, CASE WHEN sum(a) > 0 THEN round(sum((a - b) * 0.3 - a * 0.15) / sum(a * 0.15) * 100, 6) ELSE 0 END AS roi_pct FROM cmp GROUP BY 1)"""
scores = lambda tx: M.promo_scores(waterfall(tx))
returns = lambda tx: O.product_roi(M.promo_roi(compared(tx)))
KINDS = " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in O.SCORES.items())
register("promotion_insights", lambda tx: O.promotion_insights(scores(tx), returns(tx), M.cannibalization(prices(tx), periods(tx), orders=False)), f"""
WITH {PR}, {SCORED}, cx AS (SELECT promo_product, start_date, peer, coalesce(sum(r) FILTER (now), 0) AS a, coalesce(sum(r) FILTER (NOT now), 0) AS b FROM cj GROUP BY 1, 2, 3),
cy AS (SELECT promo_product, peer, round(greatest(0, b - a), 2) AS lost FROM cx WHERE b >= 1 AND (b - a) / b >= 0.5 ORDER BY lost DESC, promo_product, peer LIMIT 1),
x AS (SELECT 'score' AS kind, score AS subject, CASE score {KINDS} END AS text, abs(sum(net)) AS value, 'info' AS severity FROM so GROUP BY score
  UNION ALL (SELECT 'best_return', stockcode, 'Best return of all promotions', net, 'info' FROM so JOIN ro USING (stockcode) WHERE roi_pct >= 50 ORDER BY roi_pct DESC, stockcode LIMIT 1)
  UNION ALL SELECT 'cannibalization', promo_product, 'Takes most from ' || peer, lost, 'warning' FROM cy)
SELECT 'promotion' AS area, x.* FROM x""", "value:2")
register("promotion_opportunities", lambda tx: O.promotion_opportunities(scores(tx), returns(tx)), f"""
WITH {PR}, {SCORED}, j AS (SELECT stockcode, net, score, coalesce(roi_pct, 0) AS roi_pct FROM so LEFT JOIN ro USING (stockcode)),
w AS (SELECT * FROM (SELECT * FROM j WHERE score = 'WIN' ORDER BY roi_pct DESC, stockcode LIMIT 10) WHERE roi_pct >= 50), d AS (SELECT *, row_number() OVER (ORDER BY net, stockcode) AS place FROM j WHERE score = 'DESTROYS_VALUE')
SELECT 'promotion' AS area, 'repeat' AS source, stockcode AS subject, abs(net) AS value, CASE WHEN roi_pct >= 100 THEN 'high' ELSE 'medium' END AS confidence FROM w
UNION ALL SELECT 'promotion', 'stop', stockcode, abs(net), 'medium' FROM d WHERE place <= 10 - (SELECT count(*) FROM w)""", "value:2")
register("pricing_opportunities", lambda tx: O.pricing_opportunities(Z.decision_matrix(kvi(tx))), f"""
WITH {KVI}, d AS (SELECT stockcode, round(total_revenue, 2) AS r, abs_elasticity AS e, {CUT('insufficient_evidence', 'invest', 'protect', 'price_lever', 'review')} AS decision FROM kvi),
k AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY r DESC, stockcode) AS place FROM d WHERE decision IN ('invest', 'protect', 'price_lever'))
SELECT 'pricing' AS area, decision AS source, stockcode AS subject, CASE WHEN decision <> 'price_lever' THEN r WHEN e > 1 THEN greatest(0, r * ((1 + e * 0.05) * 0.95 - 1)) ELSE 0 END AS value, 'medium' AS confidence FROM k WHERE place <= 5""", "value:2")

# all in one table

INSIGHTS = ("basket_insights", "product_insights", "cohort_insights", "switching_insights", "promotion_insights")
FORM = "area, kind, subject, text, value, severity"


def parts(spark, sf_dir, names, form, lines=None):
    """Tables of queries over the same lines, which are read once, or stored before; a table is a few rows."""
    lines = stored(star_lines(spark, sf_dir)) if lines is None else lines
    return [cut(QUERIES[n](spark, sf_dir, lines).selectExpr(*form.split(", "))) for n in names]


register("insight_list", None, " UNION ALL ".join(f"SELECT {FORM} FROM ({ORACLE_SQL[n]})" for n in INSIGHTS), "value:2",
  source=lambda s, d, tx=None: O.together(parts(s, d, INSIGHTS, FORM, tx)))
OPPORTUNITIES = ("cohort_opportunities", "basket_opportunities", "product_opportunities", "promotion_opportunities", "pricing_opportunities")
ADDON = {"area": "'cross_sell'", "source": "'addon'", "subject": "addon", "value": "impact", "confidence": "'medium'"}
LISTED = " UNION ALL ".join([*(f"SELECT {', '.join(ADDON)} FROM ({ORACLE_SQL[n]})" for n in OPPORTUNITIES), f"SELECT {', '.join(f'{e} AS {c}' for c, e in ADDON.items())} FROM ({ORACLE_SQL['cross_sell_opportunities']})"])


def listed(spark, sf_dir, lines=None):
    *tables, addons = parts(spark, sf_dir, [*OPPORTUNITIES, "cross_sell_opportunities"], "*", lines)
    return O.ranked_list([*tables, addons.select(*[F.expr(e).alias(c) for c, e in ADDON.items()])])


register("opportunity_list", None, f"SELECT *, row_number() OVER (ORDER BY value DESC, area, subject, source) AS rank FROM ({LISTED})", "value:2", source=listed)
