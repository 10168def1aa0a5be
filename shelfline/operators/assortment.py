"""Assortments: what a set of products keeps, loses and recovers, and choosing one."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import revenue


def evaluate_assortments(sets: DataFrame, tx: DataFrame, transference: DataFrame) -> DataFrame:
    """Per scenario (scenario_id, stockcode kept): kept and lost revenue, what kept products recover, and coverage."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("r"), F.min("category").alias("c"))
    scenarios = sets.select("scenario_id").distinct()
    every = scenarios.crossJoin(own).join(sets.withColumn("kept", F.lit(True)), ["scenario_id", "stockcode"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    base = every.groupBy("scenario_id").agg(F.count_if("kept").alias("n_skus"), F.sum(F.when(F.col("kept"), F.col("r")).otherwise(0.0)).alias("kept_revenue"), F.sum(F.when(F.col("kept"), 0.0).otherwise(F.col("r"))).alias("lost_revenue"), F.sum("r").alias("total"), F.countDistinct(F.when(F.col("kept"), F.col("c"))).alias("n_categories"))
    gone = every.where("NOT kept").select("scenario_id", F.col("stockcode").alias("from_product"))
    stay = sets.select("scenario_id", F.col("stockcode").alias("to_product"))
    back = transference.join(gone, "from_product").join(stay, ["scenario_id", "to_product"]).groupBy("scenario_id").agg(F.sum("observed_switching_transfer_revenue").alias("recovered_revenue"))
    t = base.join(back, "scenario_id", "left").fillna(0.0, ["recovered_revenue"])
    return t.select("scenario_id", "n_skus", "n_categories", "kept_revenue", "lost_revenue", "recovered_revenue", (F.col("lost_revenue") - F.col("recovered_revenue")).alias("unmet_revenue"), ((F.col("kept_revenue") + F.col("recovered_revenue")) / F.col("total")).alias("coverage"))


def greedy_assortment(tx: DataFrame, transference: DataFrame, max_skus: int = 30, recovery_weight: float = 0.30) -> DataFrame:
    """The best product of every category, then the best of all, by revenue plus a share of what they recover from others."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("revenue"), F.min("category").alias("category"))
    into = transference.groupBy(F.col("to_product").alias("stockcode")).agg(F.sum("observed_switching_transfer_revenue").alias("recovery"))
    t = own.join(into, "stockcode", "left").fillna(0.0, ["recovery"]).withColumn("score", F.col("revenue") + recovery_weight * F.col("recovery"))
    first = F.row_number().over(W.partitionBy("category").orderBy(F.desc("score"), "stockcode")) == 1
    t = t.withColumn("floor", first).withColumn("rank", F.row_number().over(W.orderBy(F.desc("floor"), F.desc("score"), "stockcode")))
    return t.where(F.col("rank") <= max_skus).select("rank", "stockcode", "category", "revenue", "recovery", "score")


def delist_table(tx: DataFrame, transference: DataFrame, top_n: int = 3) -> DataFrame:
    """For every product: revenue at risk, what others would take, its best substitutes, evidence 1 to 5 and advice."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("revenue_at_risk"))
    w = W.partitionBy("from_product").orderBy(F.desc("observed_switching_transfer_revenue"), "to_product")
    ranked = transference.withColumn("k", F.row_number().over(w))
    subs = ranked.groupBy(F.col("from_product").alias("stockcode")).agg(F.sum("observed_switching_transfer_revenue").alias("estimated_recovery"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= top_n, F.struct("k", "to_product")))), lambda x: x["to_product"])).alias("substitutes"), F.count("*").alias("n_substitutes"))
    t = own.join(subs, "stockcode", "left").fillna(0.0, ["estimated_recovery"]).fillna(0, ["n_substitutes"]).fillna("", ["substitutes"])
    rate = F.when(F.col("revenue_at_risk") > 0, F.col("estimated_recovery") / F.col("revenue_at_risk")).otherwise(0.0)
    t = t.withColumn("recovery_rate", F.least(F.lit(1.0), rate))
    level = F.when(F.col("n_substitutes") == 0, 1).when(F.col("n_substitutes") < 3, 2).when(F.col("recovery_rate") < 0.5, 3).when(F.col("recovery_rate") < 0.8, 4).otherwise(5)
    return t.withColumn("evidence_level", level).withColumn("recommendation", F.when((F.col("evidence_level") >= 4), "DELIST").otherwise("KEEP"))
