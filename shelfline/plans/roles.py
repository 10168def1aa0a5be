"""Queries on category roles."""

import math

from pyspark.sql import functions as F

from ..functions.store import once
from ..operators import roles as O
from .base import register
from .shopping import MONTH, R, WEEK

TAIL = f"""CASE WHEN h > 0 THEN greatest(0, 1 - exp((months - 1) / 2.0 * ln(h / 2) - h / 2 - [{', '.join(repr(math.lgamma(k / 2 + 1)) for k in range(1, 12))}][months - 1])
  * list_reduce(list_prepend([1.0, 1.0]::DOUBLE[], list_transform(range(1, CAST(4 * h AS INT) + 201), lambda k: [CAST(k AS DOUBLE), 0.0])), lambda s, k: [s[1] * h / 2 / ((months - 1) / 2.0 + k[1]), s[2] + s[1] * h / 2 / ((months - 1) / 2.0 + k[1])])[2]) ELSE 1 END"""
SEASON = f"""sp0 AS (SELECT min({MONTH}) AS a, max({MONTH}) AS b, count(DISTINCT {MONTH}) AS seen FROM tx), gr AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month, seen, year(b) - year(a) + 1 AS cyc FROM sp0),
un AS (SELECT category, {MONTH} AS month, sum(quantity) AS u FROM tx GROUP BY 1, 2), s0 AS (SELECT category, month, seen, cyc, coalesce(u, 0) AS u FROM (SELECT DISTINCT category FROM tx) CROSS JOIN gr LEFT JOIN un USING (category, month)),
s1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY month) AS DOUBLE) AS i FROM s0),
s2 AS (SELECT *, regr_slope(u, i) OVER w AS sl, regr_intercept(u, i) OVER w AS ic, count(*) OVER w AS n FROM s1 WINDOW w AS (PARTITION BY category)),
s3 AS (SELECT *, round(u - coalesce(sl * i + ic, u), 6) AS r, month(month) AS m FROM s2),
s4 AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY r) + (count(*) OVER (PARTITION BY category, r) - 1) / 2 AS rk, count(*) OVER (PARTITION BY category, r) AS sm FROM s3),
s5 AS (SELECT category, m, count(*) AS k, avg(r) AS mean, sum(rk) AS rks, sum(r) AS s, sum(r * r) AS ss, sum(u) AS u, sum(sm * sm - 1) AS ties, any_value(n) AS n, any_value(cyc) AS cyc, any_value(seen) AS seen FROM s4 GROUP BY 1, 2),
s6 AS (SELECT category, CAST(any_value(n) AS DOUBLE) AS n, any_value(cyc) AS cyc, any_value(seen) AS seen, count(*) AS months, sum(ss) - any_value(n) * pow(sum(s) / any_value(n), 2) AS total, sum(k * mean * mean) - any_value(n) * pow(sum(s) / any_value(n), 2) AS bt,
  max(mean) - min(mean) AS rng, greatest(abs(sum(u) / any_value(n)), 1e-9) AS base, sum(rks * rks / k) AS rr, sum(ties) AS ties FROM s5 GROUP BY 1),
s7 AS (SELECT *, CASE WHEN 1 - ties / (n * n * n - n) > 0 AND months >= 3 THEN (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) END AS h, CASE WHEN total > 1e-9 THEN bt / total ELSE 0 END AS st, cyc >= 2 AND seen >= 8 AS ok FROM s6),
s8 AS (SELECT *, CASE WHEN ok AND h IS NOT NULL THEN {TAIL} ELSE 1 END AS p_value FROM s7),
season AS (SELECT category, CASE WHEN ok THEN rng / base ELSE 0 END AS amplitude, CASE WHEN ok THEN st ELSE 0 END AS strength, p_value, ok AND (p_value < 0.05 OR (cyc <= 2 AND round(st, 9) >= 0.75)) AND months >= 3 AS significant, CAST(CASE WHEN ok OR cyc >= 2 THEN cyc ELSE 0 END AS INTEGER) AS n_cycles FROM s8)"""
SD = "amplitude:5 strength:5 p_value:5"
#: The test tables have six categories of one size: limits that some of them reach.
LIMITS = {"trips": 0.168, "variation": 0.8, "amplitude": 0.24, "strength": 0.14, "attached": 0.55}
ROLES = f"""{SEASON}, dm AS (SELECT transaction_id, arg_min(category, (-r, category)) AS category FROM (SELECT transaction_id, category, round(sum(price * quantity), 2) AS r FROM tx GROUP BY 1, 2) GROUP BY 1),
tr AS (SELECT category, count(*) / (SELECT count(DISTINCT transaction_id) FROM tx) AS g FROM dm GROUP BY 1), cv AS (SELECT category, coalesce(stddev_pop(u) / avg(u), 0) AS demand_cv FROM (SELECT category, {WEEK} AS w, sum(quantity) AS u FROM tx GROUP BY 1, 2) GROUP BY 1),
r0 AS (SELECT category, coalesce(g, 0) AS trip_generation_rate, demand_cv, round(coalesce(g, 0), 9) >= {LIMITS['trips']} AND round(demand_cv, 9) <= {LIMITS['variation']} AS destination FROM cv LEFT JOIN tr USING (category)),
bk AS (SELECT DISTINCT transaction_id, category FROM tx), dt0 AS (SELECT DISTINCT transaction_id FROM bk JOIN r0 USING (category) WHERE destination),
al AS (SELECT category, count(dt0.transaction_id) / count(*) AS a FROM bk JOIN r0 USING (category) LEFT JOIN dt0 USING (transaction_id) WHERE NOT destination GROUP BY 1),
roles AS (SELECT r0.*, coalesce(a, 0) AS attachment_rate, amplitude, strength, p_value, significant, n_cycles,
  CASE WHEN destination THEN 'Destination' WHEN amplitude >= {LIMITS['amplitude']} AND round(strength, 9) >= {LIMITS['strength']} AND significant AND n_cycles >= 2 THEN 'Seasonal'
    WHEN round(trip_generation_rate, 9) < {LIMITS['trips']} AND round(coalesce(a, 0), 9) >= {LIMITS['attached']} THEN 'Convenience' ELSE 'Routine' END AS role FROM r0 JOIN season USING (category) LEFT JOIN al USING (category))"""
roles = lambda tx: once(tx, "roles", lambda: O.category_roles(tx, **LIMITS))
register("category_seasonality", O.seasonality, f"WITH {SEASON} SELECT * FROM season", SD)
register("category_roles", roles, f"WITH {ROLES} SELECT * FROM roles", f"trip_generation_rate demand_cv attachment_rate {SD}")
register("role_retention", lambda tx: O.role_retention(tx, roles(tx)), f"""
WITH {ROLES}, fi AS (SELECT customer_id, min((date, transaction_id)) AS f FROM tx GROUP BY 1), wh AS (SELECT customer_id, CAST(date_trunc('month', f[1]) AS DATE) AS cohort, coalesce(role, 'Unknown') AS role FROM fi JOIN dm ON dm.transaction_id = f[2] LEFT JOIN roles USING (category)),
mo AS (SELECT DISTINCT customer_id, {MONTH} AS period FROM tx), g AS (SELECT role, cohort, CAST(date_diff('month', cohort, period) AS INTEGER) AS period_index, count(*) AS retained FROM mo JOIN wh USING (customer_id) GROUP BY 1, 2, 3),
z AS (SELECT *, max(CASE WHEN period_index = 0 THEN retained END) OVER (PARTITION BY role, cohort) AS cohort_size FROM g)
SELECT *, retained / cohort_size AS retention_rate FROM z WHERE cohort_size >= 5""", "retention_rate")
register("category_role_matrix", lambda tx: O.role_matrix(roles(tx), tx), f"""
WITH {ROLES}, o AS (SELECT category, {R} AS revenue, count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM tx) AS reach FROM tx GROUP BY 1),
j AS (SELECT category, role, trip_generation_rate, attachment_rate, revenue, reach, round(trip_generation_rate, 9) >= round(quantile_cont(trip_generation_rate, 0.5) OVER (), 9) AS t, round(attachment_rate, 9) >= round(quantile_cont(attachment_rate, 0.5) OVER (), 9) AS a FROM roles JOIN o USING (category))
SELECT * EXCLUDE (t, a), CASE WHEN t AND a THEN 'core' WHEN t THEN 'trip_driver' WHEN a THEN 'add_on' ELSE 'peripheral' END AS quadrant FROM j""", "trip_generation_rate attachment_rate revenue:2 reach")
register("role_sizes", lambda tx: roles(tx).groupBy("role").agg(F.count("*").alias("n_categories")), f"WITH {ROLES} SELECT role, count(*) AS n_categories FROM roles GROUP BY 1")
