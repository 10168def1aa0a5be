"""Products bought together: add-ons, co-occurrence and affinity.

Pairs come from a self-join on the basket, which Spark can split where a basket is large; counts per
pair are bounded by the catalogue and not by the lines.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored


def basket_items(tx: DataFrame, top_n: int | None = None) -> DataFrame:
    """Different (transaction_id, stockcode), of the top_n most frequent products (ties by code) if given."""
    items = tx.select("transaction_id", "stockcode").distinct()
    if top_n is None:
        return items
    top = items.groupBy("stockcode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stockcode").limit(top_n).select("stockcode")
    return items.join(top, "stockcode", "left_semi")


def pair_counts(items: DataFrame) -> DataFrame:
    """a < b and the baskets n_ab with both, with the baskets n_a and n_b of each."""
    n = items.groupBy("stockcode").agg(F.count("*").alias("n"))
    pairs = items.select("transaction_id", F.col("stockcode").alias("a")).join(items.select("transaction_id", F.col("stockcode").alias("b")), "transaction_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    return pairs.join(n.select(F.col("stockcode").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("stockcode").alias("b"), F.col("n").alias("n_b")), "b")


def both_ways(pairs: DataFrame) -> DataFrame:
    flip = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_ab", F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"))
    return pairs.select("a", "b", "n_ab", "n_a", "n_b").unionByName(flip)


def _baskets(tx: DataFrame) -> DataFrame:
    return F.broadcast(tx.agg(F.countDistinct("transaction_id").alias("n")))


def lift_table(tx: DataFrame) -> DataFrame:
    """Support, confidence and lift of every ordered pair that shares a basket."""
    p = both_ways(pair_counts(basket_items(tx))).crossJoin(_baskets(tx))
    return p.select(F.col("a").alias("anchor"), F.col("b").alias("addon"), (F.col("n_ab") / F.col("n")).alias("support"), (F.col("n_ab") / F.col("n_a")).alias("confidence"), (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), F.col("n_ab").alias("cooccurrence"))


def addon_recommendations(tx: DataFrame, anchor: str, top_n: int = 10, min_lift: float = 1.2) -> DataFrame:
    """The top add-ons of one product by lift, then support and code."""
    return lift_table(tx).where((F.col("anchor") == anchor) & (F.col("lift") >= min_lift)).orderBy(F.desc("lift"), F.desc("support"), "addon").limit(top_n)


def addon_by_category(tx: DataFrame, category: str, top_n: int = 10, min_lift: float = 1.1) -> DataFrame:
    """The best pairs from a product of the category to one outside it."""
    own = tx.where(F.col("category") == category).select("stockcode").distinct()
    t = lift_table(tx).where(F.col("lift") >= min_lift)
    t = t.join(own.withColumnRenamed("stockcode", "anchor"), "anchor", "left_semi").join(own.withColumnRenamed("stockcode", "addon"), "addon", "left_anti")
    return t.select("anchor", "addon", "support", "confidence", "lift", "cooccurrence").orderBy(F.desc("lift"), F.desc("support"), "anchor", "addon").limit(top_n)


def anchor_addon_matrix(tx: DataFrame, top_n_anchors: int = 20) -> DataFrame:
    """Lift of each pair whose anchor is among those with most partners, in long form."""
    t = lift_table(tx)
    top = t.groupBy("anchor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anchor").limit(top_n_anchors)
    return t.join(top, "anchor", "left_semi").select("anchor", "addon", "lift")


def cooccurrence(tx: DataFrame, top_n: int | None = None) -> DataFrame:
    return both_ways(pair_counts(basket_items(tx, top_n))).select("a", "b", F.col("n_ab").alias("baskets"))


def affinity(tx: DataFrame, min_cooccurrence: int = 5, top_n: int | None = None) -> DataFrame:
    """Phi of each unordered pair that shares at least min_cooccurrence baskets."""
    p = pair_counts(basket_items(tx, top_n)).where(F.col("n_ab") >= min_cooccurrence).crossJoin(_baskets(tx))
    d = lambda c: F.col(c).cast("double")
    top = d("n_ab") * d("n") - d("n_a") * d("n_b")
    low = F.sqrt(d("n_a") * (d("n") - d("n_a")) * d("n_b") * (d("n") - d("n_b")))
    return p.select("a", "b", "n_ab", F.when(low > 0, top / low).otherwise(0.0).alias("affinity"))


def top_affinity_pairs(tx: DataFrame, n: int = 20, min_cooccurrence: int = 5, min_affinity: float = 0.0, top_n: int = 200) -> DataFrame:
    return affinity(tx, min_cooccurrence, top_n).where(F.col("affinity") >= min_affinity).orderBy(F.desc("affinity"), "a", "b").limit(n)


def product_affinity_profile(tx: DataFrame, product: str, n: int = 10) -> DataFrame:
    """The partners of one product by phi."""
    own = affinity(tx).where((F.col("a") == product) | (F.col("b") == product))
    return own.select(F.when(F.col("a") == product, F.col("b")).otherwise(F.col("a")).alias("partner"), "n_ab", "affinity").orderBy(F.desc("affinity"), "partner").limit(n)


def pair_trend(tx: DataFrame, a: str, b: str, period: str = "W") -> DataFrame:
    """Baskets with both products per period."""
    from ..functions.scalar import period_start

    own = tx.where(F.col("stockcode").isin(a, b)).groupBy("transaction_id").agg(F.countDistinct("stockcode").alias("k"), F.min("date").alias("date")).where("k = 2")
    return own.groupBy(period_start("date", period).alias("period")).agg(F.count("*").alias("baskets"))


def similarity(tx: DataFrame, method: str = "jaccard", min_cooccurrence: int = 5, min_support: int = 2, by: str = "customer_id") -> DataFrame:
    """Jaccard, normalised pointwise mutual information or cosine of products over customers (or baskets)."""
    items = tx.select(F.col(by).alias("transaction_id"), "stockcode").distinct()
    keep = items.groupBy("stockcode").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    # counts, pairs and their total all read the items
    items = stored(items.join(keep, "stockcode", "left_semi"))
    n = F.broadcast(items.agg(F.countDistinct("transaction_id").alias("n")))
    p = pair_counts(items).where(F.col("n_ab") >= (1 if method == "cosine" else min_cooccurrence)).crossJoin(n)
    pmi = F.log(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))) / -F.log(F.col("n_ab") / F.col("n"))
    kinds = {"jaccard": F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab")), "cosine": F.col("n_ab") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b")), "pmi": F.when(F.col("n_ab") == F.col("n"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pmi)))}
    return p.select("a", "b", kinds[method].alias("similarity"))
