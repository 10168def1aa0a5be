"""Groups of products: bisecting clusters with a chosen number, how alike a group's products are, and k-means in all categories at once."""

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import cut

#: Names of price tiers from the cheapest.
TIERS = ["Value", "Mainstream", "Premium", "Ultra", "Luxury"]


def _bisected(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    return BisectingKMeans(k=k, seed=seed, distanceMeasure="cosine", minDivisibleClusterSize=2, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors)


def _vectors(embeddings: DataFrame) -> DataFrame:
    """Products with a vector that isn't all zero, once each."""
    one = embeddings.where("stockcode IS NOT NULL AND embedding IS NOT NULL").groupBy("stockcode").agg(F.min("embedding").alias("e"))
    return cut(one.where(F.exists("e", lambda x: x != 0)).select("stockcode", array_to_vector("e").alias("v")))


def product_clusters(embeddings: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """stockcode, cluster: at most k clusters by cosine distance, found by splitting the largest ones in two. Null and zero vectors are left out."""
    return _bisected(_vectors(embeddings), k, seed).select("stockcode", "cluster")


def cluster_counts(embeddings: DataFrame, most: int = 10, seed: int = 42) -> DataFrame:
    """n_clusters, silhouette (cosine) for 2 to `most` clusters, at most one less than the products; the highest is the number to choose.

    One fit for each number. A number that finds fewer than two clusters has no row.
    """
    v = _vectors(embeddings)
    rows = []
    for k in range(2, min(most, v.count() - 1) + 1):
        found = cut(_bisected(v, k, seed))
        if found.select("cluster").distinct().count() >= 2:
            rows.append((k, float(ClusteringEvaluator(featuresCol="v", predictionCol="cluster", distanceMeasure="cosine").evaluate(found))))
    return embeddings.sparkSession.createDataFrame(rows, "n_clusters int, silhouette double")


def group_cohesion(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """group, size, within_similarity, across_similarity: mean cosine of pairs of a group's products, and of its products with the others'.

    cells: stockcode, axis, value, one row for each axis of a product that isn't 0; groups: stockcode, group. No pair is built:
    a sum of unit vectors has a squared length of its size plus twice its pairs' cosines, and its product with the rest is the
    sum over the pairs across. One product has a cosine of 1 within; without others the cosine across is 0. Products
    without a group or a cell are left out.
    """
    length = cells.groupBy("stockcode").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_l")).where("_l > 0")
    known = groups.where("group IS NOT NULL").join(length, "stockcode")
    size = known.groupBy("group").agg(F.count("*").alias("size"))
    unit = cells.join(known, "stockcode").groupBy("group", "axis").agg(F.sum(F.col("value") / F.col("_l")).alias("s"))
    total = unit.groupBy("axis").agg(F.sum("s").alias("t"))
    sums = unit.join(total, "axis").groupBy("group").agg(F.sum(F.col("s") * F.col("s")).alias("own"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("cross"))
    n, others = F.col("size"), F.sum("size").over(W.partitionBy()) - F.col("size")
    t = sums.join(size, "group").withColumn("others", others)
    within = F.when(n > 1, (F.col("own") - n) / (n * (n - 1))).otherwise(1.0)
    across = F.when(F.col("others") > 0, F.col("cross") / (n * F.col("others"))).otherwise(0.0)
    return t.select("group", "size", within.alias("within_similarity"), across.alias("across_similarity"))


def embedding_cells(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("stockcode", F.posexplode("embedding").alias("axis", "value")).where("value <> 0")


def customer_cells(tx: DataFrame) -> DataFrame:
    """Products as vectors over customers: baskets of the customer with the product."""
    return tx.groupBy("stockcode", F.col("customer_id").alias("axis")).agg(F.countDistinct("transaction_id").cast("double").alias("value"))


def tiers_by_category(products: DataFrame, columns: list[str], order: str, k: int = 3, rounds: int = 200) -> DataFrame:
    """products with tier (from 0, by mean of `order`) and tier_label: k-means on standardised columns within each category, for all categories at once.

    A round is one aggregate over the products: each goes to the nearest centre of its category (ties to the lower), and
    centres become means. It starts from centres at even ranks of `order` and ends when no product moves, or raises. Only the number of moves
    reaches the driver. Null values count as 0; a category with fewer than k products has a tier for each. Needs stockcode, category.
    """
    by = W.partitionBy("category")
    z = []
    t = products
    for i, c in enumerate(columns):
        x, sd = F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(by)
        t = t.withColumn(f"_z{i}", F.when(sd > 0, (x - F.avg(x).over(by)) / sd).otherwise(0.0))
        z.append(f"_z{i}")
    place = F.row_number().over(by.orderBy(order, "stockcode")) - 1
    t = cut(t.withColumn("_p", F.array(*z)).withColumn("_g", F.floor(place * F.least(F.lit(k), F.count("*").over(by)) / F.count("*").over(by)).cast("int")).drop(*z))
    for _ in range(rounds):
        mean = F.array(*[F.avg(F.col("_p")[i]) for i in range(len(columns))])
        centres = t.groupBy(F.col("category").alias("_k"), "_g").agg(mean.alias("m")).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_g", "m"))).alias("_c"))
        far = F.transform("_c", lambda c: F.struct(F.aggregate(F.zip_with(c["m"], "_p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["_g"].alias("g")))
        t = cut(t.join(centres, F.col("category").eqNullSafe(F.col("_k"))).withColumns({"_old": F.col("_g"), "_g": F.array_min(far)["g"]}).drop("_c", "_k"))
        if not t.where("_old <> _g").limit(1).count():
            break
        t = t.drop("_old")
    else:
        raise ArithmeticError("tiers do not settle")
    rank = t.groupBy("category", "_g").agg(F.avg(order).alias("_m")).withColumn("tier", (F.row_number().over(by.orderBy("_m", "_g")) - 1).cast("int"))
    rank = rank.select(F.col("category").alias("_c"), F.col("_g").alias("_r"), "tier")
    label = F.coalesce(F.get(F.array(*map(F.lit, TIERS)), F.col("tier")), F.concat(F.lit("Tier "), F.col("tier")))
    out = t.join(rank, F.col("category").eqNullSafe(F.col("_c")) & (F.col("_g") == F.col("_r")))
    return out.drop("_p", "_g", "_old", "_c", "_r").withColumn("tier_label", label)
