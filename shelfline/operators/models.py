"""Segments, tiers and choice models from MLlib."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import revenue
from ..functions.store import cut
from .attributes import agreement
from .segments import behavioral_features
from .tree import poisson_weight


def cluster(features: DataFrame, columns: list[str], k: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """features with `cluster`: k-means or Gaussian mixture on standardised columns."""
    kind = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster") if method == "kmeans" else GaussianMixture(k=k, seed=seed, featuresCol="_z", predictionCol="cluster")
    steps = [VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), kind]
    return Pipeline(stages=steps).fit(features).transform(features).drop("_x")


BEHAVIOUR = ["days_active", "purchase_frequency", "avg_days_between", "total_revenue", "avg_order_value", "n_products", "n_categories", "avg_basket_size", "avg_price", "price_cv", "weekend_ratio"]


def behavioral_segments(tx: DataFrame, k: int = 6, method: str = "kmeans", small: float = 0.01) -> DataFrame:
    """Segments of customers by behaviour, named by rank of mean revenue; those with under `small` of all are Outliers."""
    c = cluster(cut(behavioral_features(tx)), BEHAVIOUR, k, method).drop("_z", "probability")
    g = c.groupBy("cluster").agg(F.avg("total_revenue").alias("m"), F.count("*").alias("n"))
    g = g.select("cluster", F.when(F.col("n") < small * F.sum("n").over(W.partitionBy()), "Outliers").otherwise(F.concat(F.lit("Segment "), F.row_number().over(W.orderBy(F.desc("m"), "cluster")))).alias("segment"))
    return c.join(F.broadcast(g), "cluster").select("customer_id", "cluster", "segment")


def cluster_quality(features: DataFrame, columns: list[str], most: int = 6, seed: int = 42) -> DataFrame:
    """Silhouette of k-means for each k from 2."""
    rows = []
    for k in range(2, most + 1):
        c = cluster(features, columns, k, seed=seed)
        rows.append((k, float(ClusteringEvaluator(featuresCol="_z", predictionCol="cluster").evaluate(c))))
    return features.sparkSession.createDataFrame(rows, "k int, silhouette double")


def choice_features(tx: DataFrame, window_days: int = 30, top_products: int = 50) -> DataFrame:
    """History before the window and the product each customer then buys most (ties to the code that sorts first)."""
    end = F.broadcast(tx.agg((F.max("date") - F.expr(f"INTERVAL {int(window_days)} DAYS")).alias("_cut")))
    t = tx.crossJoin(end)
    top = tx.groupBy("stockcode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stockcode").limit(top_products)
    new = t.where("date >= _cut").join(top, "stockcode", "left_semi").groupBy("customer_id", "stockcode").agg(F.sum("quantity").alias("q"))
    target = new.groupBy("customer_id").agg(F.min(F.struct((-F.col("q")).alias("m"), "stockcode"))["stockcode"].alias("target"))
    old = t.where("date < _cut").groupBy("customer_id").agg(F.countDistinct("transaction_id").cast("double").alias("orders"), F.sum(revenue()).alias("spend"), F.avg("price").alias("mean_price"), F.countDistinct("stockcode").cast("double").alias("products"), F.datediff(F.max("_cut"), F.max("date")).cast("double").alias("recency"))
    return old.join(target, "customer_id")


def train_choice_model(features: DataFrame, depth: int = 4, least: int = 10, seed: int = 42):
    """A fitted tree for the target and a one-row table of accuracy and F1 on a fifth of customers held out by hash."""
    # every pass of the fit reads the features again
    features = cut(features)
    columns = ["orders", "spend", "mean_price", "products", "recency"]
    steps = [StringIndexer(inputCol="target", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=columns, outputCol="features"), DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, seed=seed)]
    held = F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(5)) == 0
    model = Pipeline(stages=steps).fit(features.where(~held))
    scored = model.transform(features.where(held))
    value = lambda m: float(MulticlassClassificationEvaluator(metricName=m).evaluate(scored))
    return model, features.sparkSession.createDataFrame([(value("accuracy"), value("f1"))], "accuracy double, f1 double")


def cluster_stability(features: DataFrame, columns: list[str], k: int, key: str = "customer_id", resamples: int = 5, seed: int = 42) -> DataFrame:
    """draw, ari: agreement (adjusted Rand index) of k-means on resamples with that on all rows, over all rows.

    A resample weighs rows by Poisson weights of their key; its model then places every row. One job per draw, whose number is fixed.
    """
    features = cut(features)
    z = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True)]).fit(features).transform(features).select(F.col(key).alias("stockcode"), "_z")
    z = cut(z)
    group = lambda rows: KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="group", weightCol="_w").fit(rows).transform(z.withColumn("_w", F.lit(1.0))).select("stockcode", "group")
    base = cut(group(z.withColumn("_w", F.lit(1.0))))
    parts = []
    for draw in range(1, resamples + 1):
        drawn = z.withColumn("_w", poisson_weight(seed + draw, "stockcode").cast("double")).where("_w > 0")
        parts.append(agreement(base, group(drawn)).select(F.lit(draw).alias("draw"), "ari"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
