"""One row per product with what the analyses say of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import performance as P


def base_profiles(tx: DataFrame) -> DataFrame:
    """Revenue, class, demand, stage, growth, velocity, repeat rate, reach (customers over baskets, at most 1) and assortment action."""
    n = F.broadcast(tx.agg(F.countDistinct("transaction_id").alias("_n")))
    reach = tx.groupBy("stockcode").agg(F.countDistinct("customer_id").alias("_c")).crossJoin(n).select("stockcode", F.least(F.lit(1.0), F.col("_c") / F.col("_n")).alias("customer_reach"))
    sku = P.sku_rationalization(tx).select("stockcode", F.col("action").alias("assortment_action"))
    stage = P.lifecycle_stage(tx).select("stockcode", F.col("stage").alias("lifecycle"), F.col("growth_pct").alias("growth"))
    abc = P.abc_analysis(tx).select("stockcode", "revenue", F.col("abc_class").alias("abc"))
    xyz = P.xyz_analysis(tx).select("stockcode", F.col("xyz_class").alias("xyz"), "demand_profile")
    t = abc.join(xyz, "stockcode", "left").join(stage, "stockcode", "left").join(P.velocity(tx).select("stockcode", "velocity"), "stockcode", "left").join(P.repeat_rate(tx).select("stockcode", "repeat_rate"), "stockcode", "left").join(reach, "stockcode", "left").join(sku, "stockcode", "left")
    return t.fillna({"xyz": "Z", "demand_profile": "Insufficient History", "lifecycle": "mature", "growth": 0.0, "velocity": 0.0, "repeat_rate": 0.0, "customer_reach": 0.0, "assortment_action": "review"})


def extended_profiles(base: DataFrame, elasticity: DataFrame, promos: DataFrame, status: DataFrame) -> DataFrame:
    """Base profiles with elasticity, mean revenue lift of promotions and switching status, 0 or `unknown` where there is none."""
    lift = promos.groupBy("stockcode").agg(F.avg("revenue_lift").alias("promo_effectiveness"))
    t = base.join(elasticity.select("stockcode", "elasticity"), "stockcode", "left").join(lift, "stockcode", "left").join(status.select("stockcode", F.col("switching_status").alias("switching_risk")), "stockcode", "left")
    return t.fillna({"elasticity": 0.0, "promo_effectiveness": 0.0, "switching_risk": "unknown"})


def profile(profiles: DataFrame, stockcode: str) -> DataFrame:
    """The row of one product."""
    return profiles.where(F.col("stockcode") == stockcode)
