"""Customer decision tree: products split level by level by the attribute that tells most about their group.

All open nodes of a level are scored in one aggregate over node, attribute, value and group, for the products as they
are and for resamples with Poisson weights at once; what reaches a task is a cell, and nothing reaches the driver
but whether anything was split.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import cut

ROOT = "all"
#: A node of fewer products has no resamples.
RESAMPLED = 10
#: Decimals of gains when they are compared.
DIGITS = 9


def unit_hash(seed: int, *keys: str | Column) -> Column:
    """A number from 0 to 1 from a hash of columns."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def poisson_of(u: Column) -> Column:
    """A weight of mean 1 (Poisson, up to 8) from a number of 0 to 1."""
    bounds, term, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += term
        bounds.append(total)
        term /= k + 1
    # the first bound that u stays under ends the search
    found = F.when(u < bounds[0], 0)
    for k, b in enumerate(bounds[1:], 1):
        found = found.when(u < b, k)
    return found.otherwise(len(bounds))


def poisson_weight(seed: int, *keys: str) -> Column:
    """A weight of mean 1 (Poisson, up to 8) from a hash of columns."""
    return poisson_of(unit_hash(seed, *keys))


def long_attributes(attributes: DataFrame, names: list[str]) -> DataFrame:
    """stockcode, place, attribute, value: a row per product and attribute that isn't null."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("attribute"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)])
    return attributes.select("stockcode", F.inline(cells)).where("value IS NOT NULL")


def split_scores(members: DataFrame, long: DataFrame, groups: DataFrame, min_size: int = 3, criterion: str = "entropy", resamples: int = 0, seed: int = 42) -> DataFrame:
    """node, draw, place, attribute, gain of every attribute with two values of min_size products; draw 0 is the products as they are.

    gain: what the attribute's values take off the entropy (bits; the same as mutual information) or Gini impurity of the groups, over
    products with a group. members has node, used (attributes of the path), size and stockcode.
    """
    t = members.join(long, "stockcode").where(~F.array_contains("used", F.col("attribute"))).join(groups.select("stockcode", "group"), "stockcode", "left")
    draws = F.sequence(F.lit(0), F.when(F.col("size") >= RESAMPLED, F.lit(resamples)).otherwise(0))
    t = t.withColumn("draw", F.explode(draws)).withColumn("w", F.when(F.col("draw") == 0, 1).otherwise(poisson_weight(seed, "stockcode", "draw"))).where("w > 0")
    own = ["node", "draw", "place", "attribute"]
    cell = t.groupBy(*own, "value", "group").agg(F.sum("w").alias("n"))
    cell = cell.withColumn("known", F.when(F.col("group").isNotNull(), F.col("n")).otherwise(0))

    def purity(n: Column) -> Column:
        return n * F.log2(F.greatest(n, F.lit(1))) if criterion == "entropy" else n * n

    def impurity(n: Column, inner: Column) -> Column:
        """Of n things times n, from the sum of purities of their groups."""
        return F.when(n > 0, purity(n) - inner).otherwise(0.0) if criterion == "entropy" else F.when(n > 0, n - inner / n).otherwise(0.0)

    value = cell.groupBy(*own, "value").agg(F.sum("n").alias("size"), F.sum("known").alias("known"), F.sum(purity(F.col("known"))).alias("inner"))
    value = value.groupBy(*own).agg(F.count_if(F.col("size") >= min_size).alias("n_values"), F.sum("known").alias("known"), F.sum(impurity(F.col("known"), F.col("inner"))).alias("left"))
    whole = cell.where("known > 0").groupBy(*own, "group").agg(F.sum("known").alias("n")).groupBy(*own).agg(F.sum(purity(F.col("n"))).alias("inner"))
    both = value.where("n_values >= 2 AND known > 0").join(whole, own)
    gain = (impurity(F.col("known"), F.col("inner")) - F.col("left")) / F.col("known")
    return both.select(*own, F.round(gain, DIGITS).alias("gain"))


def best_splits(scores: DataFrame, min_gain: float = 0.01) -> DataFrame:
    """node, attribute, split_score, split_stability: the largest gain over min_gain, ties to the attribute named first.

    Stability is the share of the node's resamples that choose the same attribute, null where there are none.
    """
    best = scores.groupBy("node", "draw").agg(F.max(F.struct("gain", (-F.col("place")).alias("minus"), "attribute")).alias("b")).select("node", "draw", "b.attribute", "b.gain").where(F.col("gain") > min_gain)
    chosen = best.where("draw = 0").select("node", "attribute", F.col("gain").alias("split_score"))
    tried = scores.where("draw > 0").groupBy("node").agg(F.countDistinct("draw").alias("_n"))
    same = best.where("draw > 0").groupBy("node", "attribute").agg(F.count("*").alias("_k"))
    joined = chosen.join(same, ["node", "attribute"], "left").join(tried, "node", "left")
    return joined.select("node", "attribute", "split_score", (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("split_stability"))


def grow_tree(attributes: DataFrame, groups: DataFrame, names: list[str], min_size: int = 3, max_depth: int = 4, criterion: str = "entropy", min_gain: float = 0.01, resamples: int = 30, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Nodes, and members (node, stockcode) of every node, inner ones too.

    A node of min_size products above max_depth is split by best_splits among attributes not used on its path; each value
    of min_size products becomes a child, products of rarer values or without one end there. Repeated products count once,
    null ones not at all. A node's name is its path of attribute=value. Without products both tables are empty.
    """
    attributes = cut(attributes.where("stockcode IS NOT NULL").dropDuplicates(["stockcode"]))
    long = cut(long_attributes(attributes, names))
    groups = cut(groups.where("stockcode IS NOT NULL").groupBy("stockcode").agg(F.min("group").alias("group")))
    root = attributes.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("used"), F.lit(None).cast("string").alias("attribute_value"), "stockcode")
    open_, levels, splits = cut(root), [], []
    for depth in range(max_depth + 1):
        size = open_.groupBy("node").agg(F.count("*").alias("size"))
        open_ = cut(open_.join(size, "node"))
        levels.append(open_.withColumn("depth", F.lit(depth)))
        able = open_.where(F.col("size") >= min_size)
        if depth == max_depth or able.isEmpty():
            break
        split = cut(best_splits(split_scores(able, long, groups, min_size, criterion, resamples, seed), min_gain))
        splits.append(split)
        to = able.join(split.select("node", "attribute"), "node").join(long, ["stockcode", "attribute"])
        name = F.concat("node", F.lit("/"), "attribute", F.lit("="), "value")
        child = to.select(name.alias("node"), F.col("node").alias("parent"), F.array_append("used", F.col("attribute")).alias("used"), F.col("value").alias("attribute_value"), "stockcode")
        large = child.groupBy("node").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size).select("node")
        open_ = cut(child.join(large, "node", "left_semi"))
        if open_.isEmpty():
            break
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    nodes = every.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "attribute_value", "size")])
    if splits:
        how = splits[0]
        for s in splits[1:]:
            how = how.unionByName(s)
    else:
        how = nodes.select("node", F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("double").alias("split_score"), F.lit(None).cast("double").alias("split_stability")).limit(0)
    nodes = nodes.join(how, "node", "left").withColumn("is_leaf", F.col("attribute").isNull())
    return cut(nodes), cut(every.select("node", "stockcode", "size"))


def within_similarity(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, similarity_within: mean similarity of a node's pairs of products, absent pairs as 0, single products as 1; from 0 to 1.

    pairs (a, b, similarity) has each pair once.
    """
    two = pairs.join(members.select("node", F.col("stockcode").alias("a")), "a").join(members.select("node", F.col("stockcode").alias("b")), ["b", "node"])
    sums = two.groupBy("node").agg(F.sum("similarity").alias("_s"))
    n = members.groupBy("node").agg(F.count("*").alias("_n"))
    mean = F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * (F.col("_n") - 1) / 2)
    return n.join(sums, "node", "left").select("node", F.when(F.col("_n") < 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))).alias("similarity_within"))


def rules_of(nodes: DataFrame) -> DataFrame:
    """Nodes with a sentence on the choice made there."""
    leaf = F.concat(F.lit("Browse "), F.col("size").cast("string"), F.lit(" similar products"))
    return nodes.withColumn("rule", F.when(F.col("is_leaf"), leaf).otherwise(F.concat(F.lit("Shoppers split by "), "attribute")))


def prune_tree(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Nodes (with similarity_within) after cutting back: a node whose children are all leaves, with a mean similarity by size below the threshold, becomes a leaf, the deepest first."""
    kept = nodes
    for depth in range(int(nodes.agg(F.max("depth")).first()[0] or 0) - 1, -1, -1):
        kids = kept.where(F.col("depth") == depth + 1).groupBy(F.col("parent").alias("node"))
        weak = kids.agg(F.min("is_leaf").alias("_leaves"), (F.sum(F.col("similarity_within") * F.col("size")) / F.sum("size")).alias("_m")).where(F.col("_leaves") & (F.round("_m", DIGITS) < threshold)).select("node")
        weak = weak.withColumn("_weak", F.lit(True))
        gone = weak.select(F.col("node").alias("parent"), F.lit(True).alias("_gone"))
        t = kept.join(weak, "node", "left").join(gone, "parent", "left").where("_gone IS NULL")
        clear = [F.when(F.col("_weak").isNull(), F.col(c)).alias(c) for c in ("attribute", "split_score", "split_stability")]
        kept = cut(t.select("node", "parent", "depth", "attribute_value", "size", *clear, (F.col("is_leaf") | F.col("_weak").isNotNull()).alias("is_leaf"), "similarity_within"))
    return kept


def tree_scores(nodes: DataFrame) -> DataFrame:
    """metric, value: nodes, leaves, depth, mean similarity of leaves and products in leaves."""
    leaf = F.when(F.col("is_leaf"), F.col("similarity_within"))
    covered = F.sum(F.when(F.col("is_leaf"), F.col("size")).otherwise(0))
    values = {"n_nodes": F.count("*"), "n_leaves": F.count_if("is_leaf"), "depth": F.max("depth"), "mean_leaf_similarity": F.avg(leaf), "products_covered": covered}
    return nodes.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in values.items()]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values])))


def attribute_importance(nodes: DataFrame) -> DataFrame:
    """Attributes by the gain of their splits, weighted by products, with the share of all."""
    g = nodes.where("NOT is_leaf").groupBy("attribute").agg(F.sum(F.col("split_score") * F.col("size")).alias("importance"), F.count("*").alias("n_splits"))
    return g.withColumn("share", F.col("importance") / F.sum("importance").over(W.partitionBy()))
