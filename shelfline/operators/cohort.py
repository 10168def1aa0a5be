"""Cohorts by first purchase, and comparisons of periods."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_index, period_start, revenue


def _with_cohort(tx: DataFrame, period: str) -> DataFrame:
    """Customer-period aggregates with the first period of the customer."""
    own = tx.groupBy("customer_id", period_start("date", period).alias("period")).agg(F.sum(revenue()).alias("revenue"))
    return own.withColumn("cohort", F.min("period").over(W.partitionBy("customer_id"))).withColumn("period_index", period_index(F.col("period"), F.col("cohort"), period))


def cohorts(tx: DataFrame, period: str = "M") -> DataFrame:
    """Customers of each cohort who came back, by periods since the first."""
    own = _with_cohort(tx, period).groupBy("cohort", "period_index").agg(F.count("*").alias("retained"))
    size = F.max(F.when(F.col("period_index") == 0, F.col("retained"))).over(W.partitionBy("cohort"))
    return own.withColumn("cohort_size", size).withColumn("retention_rate", F.col("retained") / F.col("cohort_size"))


def cohort_sizes(tx: DataFrame, period: str = "M") -> DataFrame:
    first = tx.groupBy("customer_id").agg(F.min(period_start("date", period)).alias("cohort"))
    return tx.join(first, "customer_id").groupBy("cohort").agg(F.countDistinct("customer_id").alias("n_customers"), F.countDistinct("transaction_id").alias("n_transactions"), F.sum(revenue()).alias("revenue"))


def period_over_period(tx: DataFrame, period: str = "W") -> DataFrame:
    own = tx.groupBy(period_start("date", period).alias("period")).agg(F.sum(revenue()).alias("revenue"), F.countDistinct("transaction_id").alias("transactions"), F.countDistinct("customer_id").alias("customers"))
    own = own.withColumn("aov", F.col("revenue") / F.col("transactions"))
    w = W.orderBy("period")
    growth = lambda c: (F.col(c) / F.lag(c).over(w) - 1) * 100
    return own.withColumns({"revenue_growth": growth("revenue"), "aov_growth": growth("aov")})


def year_over_year(tx: DataFrame) -> DataFrame:
    """Weeks of the latest year against the same ISO week a year earlier."""
    n = F.countDistinct("transaction_id")
    own = tx.groupBy(F.year("date").alias("year"), F.weekofyear("date").alias("week")).agg(F.sum(revenue()).alias("revenue"), n.alias("transactions"), F.countDistinct("customer_id").alias("customers"), (F.sum(revenue()) / n).alias("aov"))
    last = own.agg(F.max("year").alias("last"))
    own = own.crossJoin(F.broadcast(last))
    prior = own.where("year = last - 1").select("week", F.col("revenue").alias("prior_revenue"), F.col("aov").alias("prior_aov"))
    out = own.where("year = last").drop("last").join(prior, "week", "left")
    pct = lambda a, b: (F.col(a) - F.col(b)) / F.col(b) * 100
    return out.withColumns({"revenue_yoy_growth": pct("revenue", "prior_revenue"), "aov_yoy_growth": pct("aov", "prior_aov")})


def cohort_ltv_curve(tx: DataFrame, period: str = "M") -> DataFrame:
    own = _with_cohort(tx, period).groupBy("cohort", "period_index").agg(F.sum("revenue").alias("r"), F.count("*").alias("n"))
    size = F.max(F.when(F.col("period_index") == 0, F.col("n"))).over(W.partitionBy("cohort"))
    total = F.sum("r").over(W.partitionBy("cohort").orderBy("period_index").rowsBetween(W.unboundedPreceding, 0))
    return own.select("cohort", "period_index", total.alias("cumulative_revenue"), (total / size).alias("ltv_per_customer"))


def cohort_decay_rate(tx: DataFrame, period: str = "M") -> DataFrame:
    """Minus the slope of the log of retention over the period index, from two later periods on."""
    own = cohorts(tx, period).where("period_index > 0")
    slope = F.regr_slope(F.log(F.greatest(F.col("retention_rate"), F.lit(1e-6))), F.col("period_index").cast("double"))
    return own.groupBy("cohort").agg(F.count("*").alias("n"), F.coalesce(-slope, F.lit(0.0)).alias("decay_rate")).where("n >= 2").select("cohort", "decay_rate")
