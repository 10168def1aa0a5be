"""Queries that learn: embeddings and clusters of products, uplift, survival, boosted key values, tiers, lifetime values around their model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import once
from ..operators import boosted as K
from ..operators import clusters as C
from ..operators import clv as V
from ..operators import embedding as E
from ..operators import features as D
from ..operators import lifetime as L
from ..operators import performance as P
from ..operators import pricing as Z
from ..operators import promo as M
from ..operators import survival as S
from ..operators import uplift as U
from .base import register
from .commercial import found, kvi, prices
from .shopping import CATS

embedded = lambda tx: once(tx, "embedded", lambda: E.product_embeddings(tx))
register("product_embeddings", embedded, None)
register("product_neighbors", lambda tx: E.nearest_products(embedded(tx)), None)

#: Weeks in which the units after a promotion count.
HORIZON = 26


def judged(tx: DataFrame) -> DataFrame:
    return once(tx, "judged", lambda: U.propensity(once(tx, "uplift_rows", lambda: U.uplift_rows(M.mark_promo_lines(prices(tx), found(tx)), HORIZON)), U.FEATURES))


scored = lambda tx: once(tx, "scored", lambda: U.two_models(U.trimmed(judged(tx)), U.FEATURES, trees=10, depth=3, strict=False))
register("uplift_overlap", lambda tx: U.overlap(judged(tx)), None)
register("uplift_curve", lambda tx: U.qini(scored(tx)), None)
register("uplift_metrics", lambda tx: U.qini_metrics(U.qini(scored(tx))), None)
register("uplift_customers", lambda tx: U.customer_uplift(scored(tx)), None)

lives = lambda tx: once(tx, "lives", lambda: S.lifetimes(tx, 365))
register("customer_lifetimes", lives, """WITH c AS (SELECT max(date) - INTERVAL 365 DAY AS cut FROM tx),
g AS (SELECT customer_id, date_diff('day', CAST(min(date) FILTER (date < cut) AS DATE), CAST(max(date) FILTER (date < cut) AS DATE)) AS d, max(CASE WHEN date < cut THEN 0 ELSE 1 END) AS back, count(DISTINCT transaction_id) FILTER (date < cut) AS f,
  sum(price * quantity) FILTER (date < cut) AS m, avg(quantity) FILTER (date < cut) AS avg_items, CAST(count(DISTINCT stockcode) FILTER (date < cut) AS DOUBLE) AS n_products FROM tx, c GROUP BY 1)
SELECT customer_id, CAST(greatest(d, 1) AS DOUBLE) AS duration, CAST(1 - back AS DOUBLE) AS event, ln(1 + f) AS log_frequency, ln(1 + m) AS log_monetary, avg_items, n_products FROM g WHERE f > 0""", "log_frequency log_monetary avg_items:5")


def fitted(tx: DataFrame):
    rows = lives(tx)
    return S.fit_survival(rows, S.FEATURES), rows


def predictions(tx: DataFrame) -> DataFrame:
    model, rows = fitted(tx)
    return S.survival_predictions(rows, model, S.FEATURES)


def diagnostics(tx: DataFrame) -> DataFrame:
    model, rows = fitted(tx)
    return S.survival_diagnostics(model, rows, S.FEATURES)


register("survival_predictions", predictions, None, "expected_lifetime:2 median_lifetime:2 survival_prob:4 hazard")
register("survival_diagnostics", diagnostics, None, "value:4")

clusters = lambda tx: once(tx, "clusters", lambda: C.product_clusters(embedded(tx), 4))
register("product_clusters", clusters, None)
register("cluster_counts", lambda tx: C.cluster_counts(embedded(tx), 6), None, "silhouette")
register("cluster_cohesion", lambda tx: C.group_cohesion(C.embedding_cells(embedded(tx)), clusters(tx).select("stockcode", F.col("cluster").alias("group"))), None, "within_similarity across_similarity")
category_groups = lambda tx: D.category_map(tx).withColumnRenamed("category", "group")
register("category_cohesion", lambda tx: C.group_cohesion(C.customer_cells(tx), category_groups(tx)), f"""
WITH {CATS}, ce AS (SELECT stockcode, customer_id, CAST(count(DISTINCT transaction_id) AS DOUBLE) AS v FROM tx GROUP BY 1, 2),
u AS (SELECT stockcode, category, customer_id, v / sqrt(sum(v * v) OVER (PARTITION BY stockcode)) AS u FROM ce JOIN cm USING (stockcode)),
pr AS (SELECT a.stockcode AS a, b.stockcode AS b, any_value(a.category) AS ca, any_value(b.category) AS cb, sum(a.u * b.u) AS s FROM u a JOIN u b ON a.customer_id = b.customer_id AND a.stockcode <> b.stockcode GROUP BY 1, 2),
n AS (SELECT category, count(*) AS k, (SELECT count(*) FROM cm) AS total FROM cm GROUP BY 1),
g AS (SELECT ca AS category, coalesce(sum(s) FILTER (ca = cb), 0) AS w, coalesce(sum(s) FILTER (ca <> cb), 0) AS x FROM pr GROUP BY 1)
SELECT category AS group, k AS size, CASE WHEN k > 1 THEN w / (k * (k - 1)) ELSE 1 END AS within_similarity, CASE WHEN total > k THEN x / (k * (total - k)) ELSE 0 END AS across_similarity FROM n JOIN g USING (category)""", "within_similarity across_similarity")


def boosted_rows(tx: DataFrame) -> DataFrame:
    spread = Z.weekly_prices(tx).groupBy("stockcode").agg(F.coalesce(F.stddev_samp("p") / F.avg("p"), F.lit(0.0)).alias("price_cv"))
    return once(tx, "boosted_rows", lambda: K.boosted_features(P.product_metrics(tx), kvi(tx), Z.own_price_elasticity(tx), spread))


#: Trees of the registered queries, whose tables have some sixty products.
TREES = 15
out_of_fold = lambda tx: once(tx, "out_of_fold", lambda: K.out_of_fold(boosted_rows(tx), K.FEATURES, trees=TREES))
register("boosted_scores", lambda tx: K.boosted_scores(out_of_fold(tx)), None)
register("boosted_errors", lambda tx: K.boosted_errors(out_of_fold(tx)), None)
register("boosted_importances", lambda tx: K.boosted_importances(boosted_rows(tx), K.FEATURES, trees=TREES), None)


def tiers(tx: DataFrame) -> DataFrame:
    t = boosted_rows(tx).select("stockcode", "basket_penetration", "abs_elasticity").join(Z.unit_prices(tx).select("stockcode", "category", "price_per_unit"), "stockcode")
    return C.tiers_by_category(t, ["price_per_unit", "basket_penetration", "abs_elasticity"], "price_per_unit")


register("price_tiers_by_category", tiers, None)

predicted = lambda tx: once(tx, "predicted", lambda: V.predict_clv(tx))
register("clv_customers", lambda tx: L.clv_customers(tx, predicted(tx)), None)
register("clv_diagnostics", L.clv_diagnostics, None)
#: Draws of the registered query; each is a fit of both models.
CLV_DRAWS = 30
register("clv_intervals", lambda tx: L.clv_intervals(tx, draws=CLV_DRAWS), None)
register("value_independence", L.value_independence, """
WITH p AS (SELECT customer_id, transaction_id, min(date) AS date, sum(price * quantity) AS r FROM tx WHERE price * quantity > 0 GROUP BY 1, 2),
c AS (SELECT customer_id, count(*) AS n, round(avg(r), 6) AS m FROM p GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS rn, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS rm FROM c),
b AS (SELECT corr(n, m) AS p, corr(rn, rm) AS s FROM k HAVING count(*) >= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY date, transaction_id) AS i, count(*) OVER (PARTITION BY customer_id) AS n FROM p),
h AS (SELECT avg(r) FILTER (i > n // 2) / avg(r) FILTER (i <= n // 2) AS q FROM o WHERE n >= 3 GROUP BY customer_id)
SELECT 'gg_freq_value_pearson' AS metric, p AS value FROM b UNION ALL SELECT 'gg_freq_value_spearman', s FROM b
UNION ALL SELECT 'gg_independence_status', CASE WHEN greatest(abs(p), abs(s)) < 0.2 THEN 0 WHEN greatest(abs(p), abs(s)) < 0.4 THEN 1 ELSE 2 END FROM b
UNION ALL SELECT 'gg_value_stationarity_pct', avg(CASE WHEN q BETWEEN 0.5 AND 2 THEN 1 ELSE 0 END) FROM h HAVING count(*) > 0""", "value")
