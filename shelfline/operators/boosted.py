"""Key value scores from boosted trees, scored out of fold."""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import cut

#: What the revenue of a product is told from; revenue itself and its shares are no inputs, as they would give the answer away.
FEATURES = ["basket_penetration", "customers", "avg_price", "price_cv", "abs_elasticity", "r_squared"]


def boosted_features(metrics: DataFrame, kvi: DataFrame, elasticity: DataFrame, prices: DataFrame) -> DataFrame:
    """stockcode, category, total_revenue, kvi_score and FEATURES. A missing elasticity counts as the median of the known ones (0.5 without any), other gaps as 0."""
    t = kvi.select("stockcode", "category", "total_revenue", "kvi_score", "basket_penetration", "abs_elasticity")
    t = t.join(metrics.select("stockcode", "customers", "avg_price"), "stockcode").join(prices.select("stockcode", "price_cv"), "stockcode", "left").join(elasticity.select("stockcode", "r_squared"), "stockcode", "left")
    middle = F.broadcast(t.agg(F.coalesce(F.percentile("abs_elasticity", 0.5), F.lit(0.5)).alias("_m")))
    t = t.crossJoin(middle).withColumn("abs_elasticity", F.coalesce("abs_elasticity", "_m")).drop("_m")
    return t.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


def out_of_fold(features: DataFrame, columns: list[str], target: str = "total_revenue", folds: int = 5, trees: int = 40, depth: int = 4, seed: int = 42) -> DataFrame:
    """features with fold and, from models fitted on the other folds, boosted (boosted trees), linear (a line on the heuristic kvi_score) and constant (their mean)."""
    t = cut(features.withColumns({"fold": F.pmod(F.xxhash64("stockcode", F.lit(seed)), F.lit(folds)).cast("int"), "_y": F.col(target).cast("double")}))
    gbt = lambda: Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="boosted", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)])
    line = lambda: Pipeline(stages=[VectorAssembler(inputCols=["kvi_score"], outputCol="_k"), LinearRegression(featuresCol="_k", labelCol="_y", predictionCol="linear")])
    parts = []
    for fold in range(folds):
        rest, held = t.where(F.col("fold") != fold).repartition(1 + folds), t.where(F.col("fold") == fold)
        mean = rest.agg(F.avg("_y")).first()[0]
        if mean is None or held.isEmpty():
            continue
        scored = line().fit(rest).transform(gbt().fit(rest).transform(held)).withColumn("constant", F.lit(float(mean)))
        parts.append(scored.drop("_x", "_k"))
    if not parts:
        return t.withColumns({c: F.lit(None).cast("double") for c in ("boosted", "linear", "constant")}).drop("_y")
    return cut(reduce(DataFrame.unionByName, parts).drop("_y"))


def boosted_scores(scored: DataFrame) -> DataFrame:
    """stockcode, category, fold, predicted_revenue, kvi_score (the prediction from 0 to 1; 0.5 where all are alike)."""
    lo, hi = F.min("boosted").over(W.partitionBy()), F.max("boosted").over(W.partitionBy())
    return scored.select("stockcode", "category", "fold", F.col("boosted").alias("predicted_revenue"), F.when(hi > lo, (F.col("boosted") - lo) / (hi - lo)).otherwise(0.5).alias("kvi_score"))


def boosted_errors(scored: DataFrame, target: str = "total_revenue") -> DataFrame:
    """model, rmse, mae: errors on products that the models were not fitted on."""
    models = ("boosted", "linear", "constant")
    miss = lambda m: F.col(m) - F.col(target)
    one = scored.agg(*[e for m in models for e in (F.sqrt(F.avg(miss(m) * miss(m))).alias(f"{m}_r"), F.avg(F.abs(miss(m))).alias(f"{m}_a"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_r").alias("rmse"), F.col(f"{m}_a").alias("mae")) for m in models])).alias("x")).select("x.*")


def boosted_importances(features: DataFrame, columns: list[str], target: str = "total_revenue", trees: int = 40, depth: int = 4, seed: int = 42) -> DataFrame:
    """feature, importance (adding up to 1) of a model on all products, and permuted: how much its squared error grows when the feature's values change places.

    Values change places along one ring by hash, the same for every feature, so that the correlation with the target goes.
    """
    t = cut(features.withColumn("_y", F.col(target).cast("double")))
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_f", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)]).fit(t)
    gains = model.stages[-1].featureImportances.toArray().tolist()
    ring = W.orderBy(F.xxhash64("stockcode", F.lit(seed)), "stockcode")
    error = lambda d: model.transform(d).agg(F.avg((F.col("_f") - F.col("_y")) * (F.col("_f") - F.col("_y")))).first()[0]
    base = error(t)
    moved = cut(t.withColumns({f"_m{i}": F.coalesce(F.lag(c).over(ring), F.last(c).over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))) for i, c in enumerate(columns)}))
    rows = [(c, float(g), float(error(moved.withColumn(c, F.col(f"_m{i}"))) - base)) for i, (c, g) in enumerate(zip(columns, gains, strict=True))]
    return features.sparkSession.createDataFrame(rows, "feature string, importance double, permuted double")
