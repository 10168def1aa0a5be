"""Basket metrics: penetration, composition, variety and control charts."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue, safe_divide


def basket_penetration(tx: DataFrame) -> DataFrame:
    """Per product: baskets that hold it, their share of all baskets, and its share of revenue."""
    total = tx.agg(F.countDistinct("transaction_id").alias("_baskets"), F.sum(revenue()).alias("_revenue"))
    own = tx.groupBy("stockcode").agg(F.countDistinct("transaction_id").alias("basket_count"), F.sum(revenue()).alias("_own"))
    joined = own.crossJoin(F.broadcast(total))  # total is a single row
    return joined.select("stockcode", "basket_count", (F.col("basket_count") / F.col("_baskets")).alias("penetration"), (F.col("_own") / F.col("_revenue")).alias("revenue_share"))


def penetration_over_time(tx: DataFrame, period: str = "W") -> DataFrame:
    """Baskets, mean size and mean value per period."""
    n = F.countDistinct("transaction_id")
    return tx.groupBy(period_start("date", period).alias("period")).agg(n.alias("n_baskets"), (F.sum("quantity") / n).alias("avg_basket_size"), (F.sum(revenue()) / n).alias("avg_basket_value"))


def basket_composition(tx: DataFrame) -> DataFrame:
    """Baskets by number of different products."""
    sizes = tx.groupBy("transaction_id").agg(F.countDistinct("stockcode").alias("basket_size"))
    n = sizes.groupBy("basket_size").agg(F.count("*").alias("n_baskets"))
    return n.withColumn("pct", F.col("n_baskets") / F.sum("n_baskets").over(W.partitionBy()))


def customer_entropy(tx: DataFrame) -> DataFrame:
    """Shannon entropy of each customer's lines over products, and its share of the most possible."""
    lines = tx.groupBy("customer_id", "stockcode").agg(F.count("*").alias("n"))
    # sum p ln p from sums over products, without a window: ln N - sum(n ln n) / N
    mix = lines.groupBy("customer_id").agg(F.count("*").alias("n_distinct_products"), F.sum("n").alias("_n"), F.sum(F.col("n") * F.log("n")).alias("_nlogn"))
    baskets = tx.groupBy("customer_id").agg(F.countDistinct("transaction_id").alias("n_purchases"))
    entropy = F.log("_n") - F.col("_nlogn") / F.col("_n")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), safe_divide(F.col("entropy"), F.log("n_distinct_products"))))
    return mix.join(baskets, "customer_id").withColumn("entropy", entropy).select("customer_id", "n_distinct_products", "n_purchases", "entropy", share.alias("normalized_entropy"))


def basket_size_variation(tx: DataFrame) -> DataFrame:
    """Per product: mean, population deviation and their ratio of the sizes of its baskets."""
    pairs = tx.select("transaction_id", "stockcode").distinct()
    sizes = pairs.groupBy("transaction_id").agg(F.count("*").alias("size"))
    std = F.stddev_pop("size")
    return pairs.join(sizes, "transaction_id").groupBy("stockcode").agg(F.avg("size").alias("mean_ipt"), std.alias("std_ipt"), (std / F.avg("size")).alias("cv_ipt"), F.count("*").alias("n_transactions"))


def control_chart(series: DataFrame, order: str, value: str, window: int = 8, k: float = 2.0, min_periods: int = 4, run_length: int = 7) -> DataFrame:
    """Trailing mean with limits of k deviations; points beyond them, or in a run of run_length on one side, are anomalies.

    One row per period: the windows run over the whole series, which is as long as the calendar, not the lines.
    """
    w = W.orderBy(order).rowsBetween(-(window - 1), 0)
    step = series.select(order, F.col(value).alias("revenue")).withColumns({"center": F.when(F.count("revenue").over(w) >= min_periods, F.avg("revenue").over(w)), "_sd": F.when(F.count("revenue").over(w) >= min_periods, F.stddev_samp("revenue").over(w))})
    step = step.withColumns({"ucl": F.col("center") + k * F.col("_sd"), "lcl": F.col("center") - k * F.col("_sd"), "_side": F.signum(F.col("revenue") - F.col("center"))})
    change = F.when(F.col("_side").eqNullSafe(F.lag("_side").over(W.orderBy(order))) & F.col("_side").isNotNull(), 0).otherwise(1)
    step = step.withColumn("_run", F.sum(change).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    limit = F.coalesce((F.col("revenue") > F.col("ucl")) | (F.col("revenue") < F.col("lcl")), F.lit(False))
    run = (F.count("*").over(W.partitionBy("_run")) >= run_length) & F.coalesce(F.col("_side") != 0, F.lit(False))
    step = step.withColumns({"_limit": limit, "_in": run})
    return step.select(order, "revenue", "center", "ucl", "lcl", (F.col("_limit") | F.col("_in")).alias("anomaly"), F.when(F.col("_limit"), "limit").when(F.col("_in"), "run").otherwise("").alias("rule"))


def revenue_control_chart(tx: DataFrame, period: str = "W") -> DataFrame:
    return control_chart(tx.groupBy(period_start("date", period).alias("period")).agg(F.sum(revenue()).alias("revenue")), "period", "revenue")


def basket_metrics(tx: DataFrame) -> DataFrame:
    """Units, different products and revenue per basket."""
    n = F.countDistinct("stockcode")
    return tx.groupBy("transaction_id").agg(F.sum("quantity").alias("basket_units"), n.alias("basket_lines"), n.alias("basket_distinct_skus"), F.sum(revenue()).alias("basket_revenue"))


def basket_summary(tx: DataFrame) -> DataFrame:
    """Mean, median, deviation, least and most of each basket metric, in long form."""
    names = ["basket_units", "basket_lines", "basket_distinct_skus", "basket_revenue"]
    long = basket_metrics(tx).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
