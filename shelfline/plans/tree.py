"""Queries on the customer decision tree."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import once, stored
from ..operators import affinity as A
from ..operators import attributes as X
from ..operators import tree as T
from .advanced import DEPTH, THIRD, groups, tiers
from .base import register
from .shopping import CATS, CUST

#: Attributes in the order in which ties go.
NAMES = ["velocity_tier", "mission_tier", "seasonality", "brand"]
DEEPEST, LEAST = 2, 3


def catalogue(tx: DataFrame) -> DataFrame:
    return tiers(tx).join(X.seasonality_class(tx).select("stockcode", "seasonality"), "stockcode")


#: The lines of all parts of the tree, read and joined once.
lines = lambda tx: once(tx, "tree_lines", lambda: tx, stored)


def split(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without their similarity, and members; grown once a query."""
    kept: dict[str, DataFrame] = {}

    def build() -> DataFrame:
        nodes, kept["members"] = T.grow_tree(catalogue(lines(tx)), groups(lines(tx)), NAMES, LEAST, DEEPEST)
        return nodes

    nodes = once(tx, "tree_split", build, lambda df: df)
    return nodes, once(tx, "tree_members", lambda: kept["members"], lambda df: df)


def grown(tx: DataFrame) -> DataFrame:
    """Nodes with their similarity."""
    nodes, members = split(tx)
    return once(tx, "tree", lambda: nodes.join(T.within_similarity(members, A.similarity(lines(tx), "jaccard", 1)), "node"))


GIVEN = f"""{CATS}, {DEPTH}, {CUST}, m AS (SELECT stockcode, sum(quantity) / count(DISTINCT date_trunc('month', date)) AS upm FROM tx GROUP BY 1),
vt AS (SELECT stockcode, {THIRD('upm', 'Slow-Moving', 'Medium', 'Fast-Moving', 'm')} AS v FROM m), br AS (SELECT stockcode, arg_min(brand, (date, brand)) AS v FROM tx GROUP BY 1),
ms AS (SELECT DISTINCT date_trunc('month', date) AS m FROM tx), us AS (SELECT stockcode, date_trunc('month', date) AS m, sum(quantity) AS u FROM tx GROUP BY 1, 2),
sg AS (SELECT stockcode, stddev_samp(coalesce(u, 0)) / avg(coalesce(u, 0)) AS cv, count(u) / count(*) AS activity FROM (SELECT DISTINCT stockcode FROM tx) CROSS JOIN ms LEFT JOIN us USING (stockcode, m) GROUP BY 1),
se AS (SELECT stockcode, CASE WHEN activity < 0.3 THEN 'Sporadic' WHEN cv >= 0.35 THEN 'Seasonal' ELSE 'Steady' END AS v FROM sg),
la AS (SELECT 0 AS place, 'velocity_tier' AS attribute, stockcode, v AS value FROM vt UNION ALL SELECT 1, 'mission_tier', stockcode, mission_tier FROM bt
  UNION ALL SELECT 2, 'seasonality', stockcode, v FROM se UNION ALL SELECT 3, 'brand', stockcode, v FROM br),
mem0 AS (SELECT 'all' AS node, CAST(NULL AS VARCHAR) AS parent, '/' AS path, CAST(NULL AS VARCHAR) AS attribute_value, stockcode FROM (SELECT DISTINCT stockcode FROM tx))"""


def _level(k: int) -> str:
    return f"""
c{k} AS (SELECT node, place, attribute, value, category, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY node) AS size FROM mem{k}) JOIN la USING (stockcode) JOIN cm USING (stockcode)
  WHERE size >= {LEAST} AND NOT contains(path, '/' || attribute || '/') GROUP BY ALL),
v{k} AS (SELECT node, place, attribute, value, sum(n) AS nv, sum(n * log2(n)) AS i FROM c{k} GROUP BY ALL),
l{k} AS (SELECT node, place, attribute, count(*) FILTER (nv >= {LEAST}) AS big, sum(nv) AS t, sum(nv * log2(nv) - i) AS rest FROM v{k} GROUP BY ALL),
w{k} AS (SELECT node, place, attribute, sum(n * log2(n)) AS i FROM (SELECT node, place, attribute, category, sum(n) AS n FROM c{k} GROUP BY ALL) GROUP BY ALL),
g{k} AS (SELECT node, place, attribute, round((t * log2(t) - i - rest) / t, 9) AS gain FROM l{k} JOIN w{k} USING (node, place, attribute) WHERE big >= 2),
s{k} AS (SELECT node, attribute, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, place) AS r FROM g{k}) WHERE r = 1 AND gain > 0.01),
mem{k + 1} AS (SELECT * FROM (SELECT node || '/' || attribute || '=' || value AS node, node AS parent, path || attribute || '/' AS path, value AS attribute_value, stockcode
  FROM mem{k} JOIN s{k} USING (node) JOIN la USING (stockcode, attribute)) QUALIFY count(*) OVER (PARTITION BY node) >= {LEAST})"""


TREE = f"""{GIVEN}, {','.join(_level(k) for k in range(DEEPEST))},
mm AS ({' UNION ALL '.join(f'SELECT node, parent, {k} AS depth, attribute_value, stockcode FROM mem{k}' for k in range(DEEPEST + 1))}),
sp AS ({' UNION ALL '.join(f'SELECT * FROM s{k}' for k in range(DEEPEST))}),
sw AS (SELECT x.node, sum(n_ab / (n_a + n_b - n_ab)) AS s FROM cc JOIN mm x ON cc.a = x.stockcode JOIN mm y ON cc.b = y.stockcode AND x.node = y.node GROUP BY 1),
nd AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(attribute_value) AS attribute_value, count(*) AS size FROM mm GROUP BY 1),
tree AS (SELECT nd.*, attribute, gain AS split_score, attribute IS NULL AS is_leaf, CASE WHEN size < 2 THEN 1.0 ELSE least(1, greatest(0, coalesce(s, 0) / (size * (size - 1) / 2))) END AS similarity_within FROM nd LEFT JOIN sp USING (node) LEFT JOIN sw USING (node))"""
ND = "split_score similarity_within"
register("cdt_nodes", lambda tx: T.rules_of(grown(tx)).drop("split_stability"), f"""
WITH {TREE} SELECT *, CASE WHEN is_leaf THEN 'Browse ' || size || ' similar products' ELSE 'Shoppers split by ' || attribute END AS rule FROM tree""", ND)
register("cdt_products", lambda tx: split(tx)[1].join(split(tx)[0].where("is_leaf").select("node"), "node").select("node", "stockcode"), f"WITH {TREE} SELECT node, stockcode FROM mm JOIN (SELECT node FROM tree WHERE is_leaf) USING (node)")
register("cdt_scores", lambda tx: T.tree_scores(grown(tx)), f"""
WITH {TREE} SELECT unnest(['n_nodes', 'n_leaves', 'depth', 'mean_leaf_similarity', 'products_covered']) AS metric,
  unnest([count(*), count(*) FILTER (is_leaf), max(depth), avg(similarity_within) FILTER (is_leaf), sum(size) FILTER (is_leaf)]) AS value FROM tree""", "value")
register("cdt_attribute_importance", lambda tx: T.attribute_importance(split(tx)[0]), f"""
WITH {TREE}, g AS (SELECT attribute, sum(split_score * size) AS importance, count(*) AS n_splits FROM tree WHERE NOT is_leaf GROUP BY 1) SELECT *, importance / sum(importance) OVER () AS share FROM g""", "importance:4 share")
WEAK = 0.002
register("cdt_pruned", lambda tx: T.prune_tree(grown(tx), WEAK).drop("split_stability"), f"""
WITH {TREE}, p1 AS (SELECT parent FROM tree WHERE depth = 2 GROUP BY 1 HAVING bool_and(is_leaf) AND round(sum(similarity_within * size) / sum(size), 9) < {WEAK}),
t1 AS (SELECT * REPLACE (CASE WHEN node IN (SELECT parent FROM p1) THEN NULL ELSE attribute END AS attribute, CASE WHEN node IN (SELECT parent FROM p1) THEN NULL ELSE split_score END AS split_score, is_leaf OR node IN (SELECT parent FROM p1) AS is_leaf)
  FROM tree WHERE parent IS NULL OR parent NOT IN (SELECT parent FROM p1)),
p0 AS (SELECT parent FROM t1 WHERE depth = 1 GROUP BY 1 HAVING bool_and(is_leaf) AND round(sum(similarity_within * size) / sum(size), 9) < {WEAK})
SELECT * REPLACE (CASE WHEN node IN (SELECT parent FROM p0) THEN NULL ELSE attribute END AS attribute, CASE WHEN node IN (SELECT parent FROM p0) THEN NULL ELSE split_score END AS split_score, is_leaf OR node IN (SELECT parent FROM p0) AS is_leaf)
FROM t1 WHERE parent IS NULL OR parent NOT IN (SELECT parent FROM p0)""", ND)
register("cdt_stability", lambda tx: split(tx)[0].where("NOT is_leaf").select("node", "attribute", F.col("split_stability")), None, "split_stability")
