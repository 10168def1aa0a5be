"""Queries on effects of promotions and prices."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import once
from ..operators import causal as C
from ..operators import promo as M
from ..operators.features import category_map
from .base import register
from .boards import SALES
from .commercial import PR, found, prices
from .shopping import CATS, R, WEEK

panel = lambda tx: once(tx, "panel", lambda: M.promo_panel(prices(tx), found(tx)))
PANEL = f"{PR}, {SALES}, pn AS (SELECT stockcode, week, is_promo, ln(u) AS y, ln(avg_price) AS x FROM sl WHERE u > 0 AND avg_price > 0)"
register("promo_two_way_effect", lambda tx: C.two_way_effect(panel(tx)), None, "effect:5 std_error:5 price_effect:4")
register("promo_event_study", lambda tx: C.event_study(panel(tx), found(tx)), None, "coefficient:5 std_error:5 p_value:5 pretrend_p_value:5")
register("promo_cross_effects", lambda tx: C.cross_effects(panel(tx), category_map(tx)), f"""
WITH {PANEL}, {CATS}, pc AS (SELECT pn.*, category FROM pn JOIN cm USING (stockcode)),
pr2 AS (SELECT DISTINCT a.stockcode AS a, b.stockcode AS b FROM pc a JOIN pc b ON a.category = b.category AND a.week = b.week AND a.is_promo AND a.stockcode <> b.stockcode),
w AS (SELECT a, b, y, x, CASE WHEN EXISTS (SELECT 1 FROM pc q WHERE q.stockcode = a AND q.week = p.week AND q.is_promo) THEN 1.0 ELSE 0.0 END AS d FROM pr2 JOIN pc p ON p.stockcode = b),
s AS (SELECT a, b, count(*) AS n, sum(d) AS m, regr_sxx(d, d) AS dd, regr_sxx(x, x) AS sp, regr_sxy(d, x) AS dp, regr_sxy(d, y) AS dy, regr_sxy(x, y) AS py, regr_sxx(y, y) AS sy FROM w GROUP BY 1, 2 HAVING count(*) >= 4 AND sum(d) < count(*)),
e AS (SELECT *, dd * sp - dp * dp AS det FROM s WHERE dd * sp - dp * dp > 1e-9),
f AS (SELECT *, (dy * sp - py * dp) / det AS effect, (py * dd - dy * dp) / det AS price FROM e)
SELECT a AS promo_product, b AS peer_product, effect, sqrt(greatest(0, sy - effect * dy - price * py) / (n - 3) * sp / det) AS std_error,
  CASE WHEN greatest(0, sy - effect * dy - price * py) > 0 THEN effect / sqrt(greatest(0, sy - effect * dy - price * py) / (n - 3) * sp / det) END AS t_value,
  n AS n_obs, CASE WHEN effect > 0 THEN 'halo' ELSE 'cannibalization' END AS effect_type FROM f WHERE n > 3""", "effect:4 std_error:4 t_value:3")
register("instrument_elasticity", lambda tx: C.instrument_elasticity(tx, F.col("discount") + 0.01), f"""
WITH w AS (SELECT stockcode, {WEEK} AS week, avg(price) AS p, sum(quantity) AS q, avg(discount + 0.01) AS z FROM tx GROUP BY 1, 2),
g AS (SELECT stockcode, count(*) AS n_obs, stddev_samp(p) / avg(p) AS pv, stddev_samp(z) / avg(z) AS zv, regr_sxx(ln(p), ln(p)) AS xx, regr_sxx(ln(q), ln(q)) AS yy, regr_sxx(ln(z), ln(z)) AS zz,
  regr_sxy(ln(p), ln(z)) AS zx, regr_sxy(ln(q), ln(z)) AS zy, regr_sxy(ln(q), ln(p)) AS xy FROM w WHERE p > 0 AND q > 0 AND z > 0 GROUP BY 1),
h AS (SELECT *, zy / zx AS e, zx * zx / (zz * xx) AS r2 FROM g WHERE n_obs >= 10 AND pv >= 0.05 AND zv >= 0.05 AND abs(zx) > 1e-9)
SELECT stockcode, e AS elasticity, sqrt(greatest(0, yy - 2 * e * xy + e * e * xx) / (n_obs - 2) * zz / (zx * zx)) AS std_error, r2 * (n_obs - 2) / (1 - r2) AS first_stage_f, r2 * (n_obs - 2) / (1 - r2) < 10 AS weak_instrument, n_obs FROM h""",
  "elasticity:3 std_error:3 first_stage_f:4")


def control(tx: DataFrame) -> DataFrame:
    """The brand with most revenue against the others."""
    own = tx.groupBy("brand").agg(F.sum(F.col("price") * F.col("quantity")).alias("r"))
    top = own.orderBy(F.desc("r"), "brand").limit(1).select("brand")
    return C.synthetic_control(tx, top, own.select("brand"), unit="brand")[0]


register("synthetic_control", control, None, "effect_log effect_pct pre_rmse ratio:4")
register("promo_effect_waterfall", lambda tx: C.waterfall_with_effect(M.mark_promo_lines(prices(tx), found(tx)), C.two_way_effect(panel(tx))), None, "promo_revenue:2 baseline_revenue:0 incremental_revenue:0 promo_cost:2 incremental_profit:0 roi:4")
register("promo_revenue_marked", lambda tx: M.mark_promo_lines(prices(tx), found(tx)).groupBy("is_promo").agg(F.sum(F.col("price") * F.col("quantity")).alias("revenue")), f"WITH {PR} SELECT is_promo, {R} AS revenue FROM mk GROUP BY 1", "revenue:2")
