"""Product performance: metrics, classes, lifecycle, velocity and repeat purchase.

Windows without a partition run over one row per product or per week, after aggregation.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue, safe_divide


def product_metrics(tx: DataFrame) -> DataFrame:
    n = tx.agg(F.countDistinct("transaction_id").alias("_n"))
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("revenue"), F.sum("quantity").alias("units"), F.countDistinct("transaction_id").alias("transactions"), F.countDistinct("customer_id").alias("customers"))
    price = F.when(F.col("units") != 0, F.col("revenue") / F.col("units")).alias("avg_price")
    return own.crossJoin(F.broadcast(n)).select("stockcode", "revenue", "units", "transactions", "customers", price, (F.col("transactions") / F.col("_n")).alias("penetration"))


def abc_analysis(tx: DataFrame, a: float = 0.7, b: float = 0.9) -> DataFrame:
    """Classes by the cumulative share of revenue, best seller first; equal revenues by product code."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("revenue"))
    w = W.orderBy(F.desc("revenue"), "stockcode").rowsBetween(W.unboundedPreceding, 0)
    share = F.least(F.lit(1.0), F.sum("revenue").over(w) / F.sum("revenue").over(W.partitionBy()))
    return own.withColumn("cumulative_share", share).withColumn("abc_class", F.when(F.col("cumulative_share") <= a, "A").when(F.col("cumulative_share") <= b, "B").otherwise("C"))


def demand_profile(cv: Column, span: Column, nonzero: Column, min_periods: int) -> Column:
    return (
        F.when((span < min_periods) | (nonzero == 0), "Insufficient History")
        .when((span / nonzero >= 1.32) & (cv >= 0.49), "Lumpy")
        .when(span / nonzero >= 1.32, "Intermittent")
        .when(cv >= 0.49, "Seasonal")
        .otherwise("Regular")
    )


def xyz_analysis(tx: DataFrame, period: str = "W", x: float = 0.10, y: float = 0.25, min_periods: int = 8) -> DataFrame:
    """Classes by the variation of units over all observed periods, those without a sale as 0.

    The grid of products and periods is never built: sums of units and of their squares over the
    periods with sales, and the number of periods, give the mean and deviation with the zeros.
    """
    sales = tx.groupBy("stockcode", period_start("date", period).alias("p")).agg(F.sum("quantity").alias("u"), F.sum(revenue()).alias("r"))
    periods = sales.select("p").distinct().withColumn("place", F.row_number().over(W.orderBy("p")))
    n = periods.agg(F.count("*").alias("n"))
    own = sales.join(F.broadcast(periods), "p").groupBy("stockcode").agg(
        F.sum("r").alias("revenue"), F.sum("u").alias("units"), F.sum(F.col("u") * F.col("u")).alias("uu"),
        (F.max(F.when(F.col("u") > 0, F.col("place"))) - F.min(F.when(F.col("u") > 0, F.col("place"))) + 1).alias("n_periods"), F.count_if(F.col("u") > 0).alias("nonzero_periods"),
    ).crossJoin(F.broadcast(n))
    mean = F.col("units") / F.col("n")
    cv = F.coalesce(F.when(mean != 0, F.sqrt(F.greatest(F.lit(0.0), F.col("uu") / F.col("n") - mean * mean)) / mean), F.lit(0.0))
    own = own.withColumn("cv", cv).withColumn("n_periods", F.coalesce("n_periods", F.lit(0)))
    zero = F.coalesce(F.when(F.col("n_periods") != 0, (F.col("n_periods") - F.col("nonzero_periods")) / F.col("n_periods")), F.lit(1.0))
    kind = F.when(F.col("n_periods") < min_periods, "Z").when(F.col("cv") <= x, "X").when(F.col("cv") <= y, "Y").otherwise("Z")
    return own.select("stockcode", "revenue", "units", "cv", "n_periods", "nonzero_periods", zero.alias("zero_demand_rate"), demand_profile(F.col("cv"), F.col("n_periods"), F.col("nonzero_periods"), min_periods).alias("demand_profile"), kind.alias("xyz_class"))


def stage_from_growth(growth: Column) -> Column:
    return F.when(growth > 25, "growth").when(growth < -25, "decline").otherwise("mature")


def lifecycle_stage(tx: DataFrame) -> DataFrame:
    """Revenue of the last observed week against the week observed before it, for products sold in either."""
    week = period_start("date", "W")
    last = tx.select(week.alias("p")).distinct().orderBy(F.desc("p")).limit(2)
    ends = last.agg(F.max("p").alias("recent"), F.min("p").alias("prior")).where("recent > prior")
    own = tx.withColumn("p", week).join(F.broadcast(ends), (F.col("p") == F.col("recent")) | (F.col("p") == F.col("prior")))
    own = own.groupBy("stockcode").agg(F.sum(F.when(F.col("p") == F.col("recent"), revenue()).otherwise(0.0)).alias("recent_revenue"), F.sum(F.when(F.col("p") == F.col("prior"), revenue()).otherwise(0.0)).alias("prior_revenue"))
    growth = F.when(F.col("prior_revenue") > 0, (F.col("recent_revenue") - F.col("prior_revenue")) * 100 / F.col("prior_revenue")).when(F.col("recent_revenue") > 0, 100.0).otherwise(0.0)
    return own.withColumn("growth_pct", growth).withColumn("stage", stage_from_growth(F.col("growth_pct")))


def velocity(tx: DataFrame) -> DataFrame:
    """Units per active day."""
    return tx.groupBy("stockcode").agg(F.sum("quantity").alias("units"), F.countDistinct("date").alias("active_days")).withColumn("velocity", F.col("units") / F.col("active_days"))


def repeat_rate(tx: DataFrame) -> DataFrame:
    """Share of a product's customers with more than one line of it."""
    n = tx.groupBy("stockcode", "customer_id").agg(F.count("*").alias("n"))
    return n.groupBy("stockcode").agg(F.count("customer_id").alias("n_customers"), F.count_if((F.col("n") > 1) & F.col("customer_id").isNotNull()).alias("repeat_customers")).withColumn("repeat_rate", safe_divide(F.col("repeat_customers"), F.col("n_customers")))


def time_to_second_purchase(tx: DataFrame) -> DataFrame:
    """Days between a customer's first and second line of a product."""
    # the two smallest dates, without sorting all lines of a pair
    pairs = tx.groupBy("stockcode", "customer_id").agg(F.min("date").alias("d1"), F.count("*").alias("n"))
    later = tx.join(pairs.where("n > 1"), ["stockcode", "customer_id"]).groupBy("stockcode", "customer_id").agg(F.first("d1").alias("d1"), F.count_if(F.col("date") == F.col("d1")).alias("same"), F.min(F.when(F.col("date") > F.col("d1"), F.col("date"))).alias("d2"))
    days = F.when(F.col("same") > 1, 0).otherwise(F.datediff("d2", "d1"))
    return later.withColumn("days", days).groupBy("stockcode").agg(F.count("*").alias("n_second_purchasers"), F.percentile("days", 0.5).alias("median_days_to_second"), F.avg("days").alias("mean_days_to_second"))


def sku_rationalization(tx: DataFrame) -> DataFrame:
    """ABC and XYZ class, velocity and repeat rate with an action per product."""
    parts = [abc_analysis(tx).select("stockcode", "revenue", "abc_class"), xyz_analysis(tx).select("stockcode", "xyz_class", "demand_profile"), velocity(tx).select("stockcode", "velocity"), repeat_rate(tx).select("stockcode", "repeat_rate")]
    t = parts[0]
    for p in parts[1:]:
        t = t.join(p, "stockcode", "full")
    t = t.fillna({"velocity": 0.0, "repeat_rate": 0.0, "xyz_class": "Z", "abc_class": "C"})
    action = (
        F.when(F.col("demand_profile") == "Insufficient History", "review")
        .when((F.col("abc_class") == "A") & F.col("xyz_class").isin("X", "Y"), "keep")
        .when((F.col("abc_class") == "C") & (F.col("xyz_class") == "Z"), "delist_candidate")
        .otherwise("review")
    )
    return t.select("stockcode", "revenue", "abc_class", "xyz_class", "velocity", "repeat_rate", action.alias("action"))
