"""Queries on how sure switching is and what it offers, on segments over time, and on product profiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import once, stored
from ..operators import boards as B
from ..operators import intervals as I
from ..operators import models as N
from ..operators import pricing as Z
from ..operators import profiles as O
from ..operators import segments as G
from ..operators import switching as S
from .base import ORACLE_SQL, register
from .boards import HV, SDP, every, sdp
from .commercial import EL, SEG, found, segs
from .shopping import ABC, LIFE, R, REP, SW, VEL, XYZ

DRAWS = 50
register("switching_intervals", lambda tx: I.switching_intervals(tx, DRAWS), None, "estimate ci_lower ci_upper std_error")
register("transference_intervals", lambda tx: I.transference_intervals(tx, 10, DRAWS), None, "estimate ci_lower ci_upper std_error")
register("switching_estimates", lambda tx: I.switching_intervals(tx, 1).select("from_product", "to_product", "estimate"), f"WITH {SW} SELECT from_product, to_product, pct AS estimate FROM sw", "estimate")

strength = lambda tx: once(tx, "strength", lambda: S.substitution_strength(S.demand_transference(tx), sdp(tx), tx))
SUB = f"""{SDP}, su0 AS (SELECT from_product, to_product, switch_rate, observed_switching_transfer_revenue AS revenue_at_risk, round(switch_rate, 9) AS sr, round(observed_switching_transfer_revenue / r, 9) AS sh, round(sdp, 9) AS sd
  FROM dt JOIN rv ON rv.stockcode = from_product JOIN sdp ON sdp.stockcode = from_product),
su1 AS (SELECT *, CASE WHEN sr >= 0.3 AND sh >= 0.1 THEN 'strong' WHEN sr >= 0.15 AND sh >= 0.05 THEN 'moderate' ELSE 'weak' END AS substitution_strength FROM su0),
sub AS (SELECT from_product, to_product, switch_rate, revenue_at_risk, substitution_strength,
  CASE WHEN substitution_strength <> 'weak' AND sh >= 0.1 THEN 'substitution' WHEN substitution_strength = 'weak' AND sd >= 0.8 THEN 'movement' WHEN sh < 0.05 AND sd < 0.2 THEN 'loyalty' ELSE 'insufficient_evidence' END AS classification,
  CASE WHEN substitution_strength = 'strong' AND sh >= 0.15 THEN 'high' WHEN substitution_strength = 'moderate' AND sh >= 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM su1)"""
register("substitution_strength", strength, f"WITH {SUB} SELECT * FROM sub", "switch_rate revenue_at_risk:2")
HIGH = f"(WITH {HV}, {SW.replace('FROM tx', 'FROM hv').replace('k >= 2', 'k >= 1')} SELECT from_product, to_product, count AS hv FROM sw)"


def opportunities(tx: DataFrame) -> DataFrame:
    impact = S.delist_impact(tx, S.demand_transference(tx), every(tx))
    return S.switching_opportunities(strength(tx), S.switching_matrix(B.high_value_lines(tx), min_transactions=2), impact, 20)


register("switching_opportunities", opportunities, f"""
WITH {SUB}, i AS (SELECT stockcode AS from_product, round(coalesce(t, 0) - r, 6) AS net FROM rv LEFT JOIN (SELECT from_product AS stockcode, sum(observed_switching_transfer_revenue) AS t FROM dt GROUP BY 1) USING (stockcode)),
j AS (SELECT sub.*, coalesce(hv, 0) AS high_value_switches, net FROM sub LEFT JOIN {HIGH} USING (from_product, to_product) LEFT JOIN i USING (from_product)),
k AS (SELECT *, CASE WHEN classification = 'substitution' AND substitution_strength <> 'weak' AND high_value_switches > 0 THEN 'protect' WHEN classification = 'substitution' AND substitution_strength <> 'weak' THEN 'consolidate'
  WHEN classification = 'movement' THEN 'steal_share' WHEN classification <> 'loyalty' AND net > 0 THEN 'delist_candidate' ELSE 'protect' END AS opportunity_type FROM j)
SELECT from_product, to_product, opportunity_type, revenue_at_risk, high_value_switches, confidence FROM k
ORDER BY CASE opportunity_type WHEN 'protect' THEN 0 WHEN 'steal_share' THEN 2 WHEN 'consolidate' THEN 3 ELSE 4 END, round(revenue_at_risk, 4) DESC, from_product, to_product LIMIT 20""", "revenue_at_risk:2")


def migration(tx: DataFrame) -> DataFrame:
    one, two = G.halves(tx)
    named = lambda t: G.rfm_segments(G.rfm_features(t)).select("customer_id", "segment")
    return G.segment_migration(named(one), named(two))


HALF = "(SELECT quantile_cont(epoch(date), 0.5) FROM tx)"
OF = lambda side: f"(WITH hx AS (SELECT * FROM tx WHERE epoch(date) {side} {HALF}), {SEG.replace('FROM tx', 'FROM hx')} SELECT customer_id, segment FROM seg)"
register("segment_migration", migration, f"""
WITH n AS (SELECT a.segment AS segment_from, b.segment AS segment_to, count(*) AS customers FROM {OF('<=')} a JOIN {OF('>')} b USING (customer_id) GROUP BY 1, 2), m AS (SELECT *, sum(customers) OVER (PARTITION BY segment_from) AS n FROM n)
SELECT segment_from, segment_to, customers, customers / n AS share, CASE WHEN segment_from = segment_to THEN customers / n ELSE 0 END AS retention_rate FROM m WHERE n >= 5""", "share retention_rate")
TRAITS = ["purchase_frequency", "total_revenue", "avg_order_value", "n_products", "avg_basket_size", "weekend_ratio"]
BEHAVE = """bh AS (SELECT customer_id, count(DISTINCT transaction_id) AS purchase_frequency, sum(price * quantity) AS total_revenue, avg(price * quantity) AS avg_order_value, count(DISTINCT stockcode) AS n_products, avg(quantity) AS avg_basket_size,
  avg(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END) AS weekend_ratio FROM tx GROUP BY 1), sb AS (SELECT segment, bh.* FROM seg JOIN bh USING (customer_id))"""
LONG = " UNION ALL ".join(f"SELECT segment, '{c}' AS metric, CAST(avg({c}) AS DOUBLE) AS mean FROM sb GROUP BY 1" for c in TRAITS)
register("segment_radar", lambda tx: G.segment_radar(segs(tx), G.behavioral_features(tx), TRAITS), f"""
WITH {SEG}, {BEHAVE}, l AS ({LONG}) SELECT segment, metric, mean, CASE WHEN max(mean) OVER w - min(mean) OVER w > 1e-12 THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) ELSE 0.5 END AS scaled FROM l WINDOW w AS (PARTITION BY metric)""", "mean:3 scaled")
FAR = " + ".join(f"abs(avg({c}) - any_value(m_{c})) / any_value(s_{c})" for c in TRAITS)
register("segment_distinctiveness", lambda tx: G.segment_distinctiveness(segs(tx), G.behavioral_features(tx), TRAITS), f"""
WITH {SEG}, {BEHAVE}, u AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in TRAITS)} FROM sb) SELECT segment, count(*) AS n_customers, ({FAR}) / {len(TRAITS)} AS distinctiveness FROM sb, u GROUP BY 1""", "distinctiveness")
register("cluster_stability", lambda tx: N.cluster_stability(G.behavioral_features(tx), N.BEHAVIOUR, 4, resamples=3), None, "ari")

BASE = f"""{ABC}, {XYZ}, {LIFE}, v AS ({VEL}), rr AS ({REP}), rc0 AS (SELECT stockcode, least(1, count(DISTINCT customer_id) / (SELECT count(DISTINCT transaction_id) FROM tx)) AS customer_reach FROM tx GROUP BY 1),
prof AS (SELECT stockcode, abc.revenue AS revenue, abc_class AS abc, coalesce(xyz_class, 'Z') AS xyz, coalesce(demand_profile, 'Insufficient History') AS demand_profile, coalesce(stage, 'mature') AS lifecycle, coalesce(growth_pct, 0) AS growth,
  velocity, repeat_rate, customer_reach, CASE WHEN demand_profile = 'Insufficient History' THEN 'review' WHEN abc_class = 'A' AND xyz_class IN ('X', 'Y') THEN 'keep' WHEN abc_class = 'C' AND coalesce(xyz_class, 'Z') = 'Z' THEN 'delist_candidate' ELSE 'review' END AS assortment_action
  FROM abc LEFT JOIN xyz USING (stockcode) LEFT JOIN life USING (stockcode) LEFT JOIN v USING (stockcode) LEFT JOIN rr USING (stockcode) LEFT JOIN rc0 USING (stockcode))"""
PD = "revenue:2 growth:4 velocity repeat_rate customer_reach"
base = lambda tx: once(tx, "profiles", lambda: O.base_profiles(tx))
register("product_profiles", base, f"WITH {BASE} SELECT * FROM prof", PD)
EXT = f"""WITH {BASE}, el AS (WITH {EL} SELECT stockcode, elasticity FROM e), pl AS (SELECT stockcode, avg(revenue_lift) AS promo_effectiveness FROM ({ORACLE_SQL['detect_promotions']}) GROUP BY 1)
SELECT prof.*, coalesce(elasticity, 0) AS elasticity, coalesce(promo_effectiveness, 0) AS promo_effectiveness, coalesce(switching_status, 'unknown') AS switching_risk
FROM prof LEFT JOIN el USING (stockcode) LEFT JOIN pl USING (stockcode) LEFT JOIN (SELECT stockcode, switching_status FROM ({ORACLE_SQL['switching_status']})) USING (stockcode)"""


def extended(tx: DataFrame) -> DataFrame:
    # the parts read the lines many times, so the lines are joined once
    tx = once(tx, "profile_lines", lambda: tx, stored)
    return O.extended_profiles(base(tx), Z.own_price_elasticity(tx), found(tx), B.switching_status(S.switching_matrix(tx), tx))


register("product_profiles_extended", extended, EXT, f"{PD} elasticity:4 promo_effectiveness:4")
register("product_profile", lambda tx: O.profile(extended(tx), "blue ring"), f"SELECT * FROM ({EXT}) WHERE stockcode = 'blue ring'", f"{PD} elasticity:4 promo_effectiveness:4")
register("profile_actions", lambda tx: base(tx).groupBy("lifecycle", "assortment_action").agg(F.count("*").alias("n_products"), F.sum("revenue").alias("revenue")), f"WITH {BASE} SELECT lifecycle, assortment_action, count(*) AS n_products, {R.replace('price * quantity', 'revenue')} AS revenue FROM prof GROUP BY 1, 2", "revenue:2")
