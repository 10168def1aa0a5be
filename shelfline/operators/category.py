"""Category management: indicators, trends, efficiency, growth matrix, scenarios."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue




def category_kpis(tx: DataFrame, n_periods: int = 8) -> DataFrame:
    """Indicators per category; growth is all revenue against the n weeks before the last."""
    week = period_start("date", "W")
    n = F.broadcast(tx.agg(F.countDistinct("transaction_id").alias("_n")))
    prior = tx.select(week.alias("w")).distinct().orderBy(F.desc("w")).limit(n_periods + 1)
    last = prior.agg(F.max("w").alias("last"), F.min("w").alias("first"))
    own = tx.crossJoin(F.broadcast(last)).withColumn("w", week)
    before = F.sum(F.when((F.col("w") < F.col("last")) & (F.col("w") >= F.col("first")), revenue()).otherwise(0.0))
    own = own.groupBy("category").agg(F.sum(revenue()).alias("revenue"), F.countDistinct("transaction_id").alias("transactions"), F.countDistinct("customer_id").alias("customers"), before.alias("_prior"))
    growth = F.when(F.col("_prior") != 0, (F.col("revenue") - F.col("_prior")) / F.col("_prior") * 100).otherwise(0.0)
    return own.crossJoin(n).select("category", "revenue", "transactions", "customers", (F.col("transactions") / F.col("_n")).alias("penetration"), (F.col("revenue") / F.col("transactions")).alias("aov"), (F.col("revenue") / F.sum("revenue").over(W.partitionBy())).alias("revenue_share"), growth.alias("growth_pct"))


def category_role(share: Column, growth: Column) -> Column:
    return F.when((share >= 0.2) & (growth > 0), "growth").when(share >= 0.2, "parity").when(growth > 15, "traffic_driver").otherwise("niche")


def rag(growth: Column) -> Column:
    return F.when(growth > 10, "green").when(growth < -10, "red").otherwise("amber")


def category_scorecard(tx: DataFrame, n_periods: int = 8) -> DataFrame:
    k = category_kpis(tx, n_periods)
    return k.select("category", "revenue", "revenue_share", "transactions", "customers", "aov", "growth_pct", category_role(F.col("revenue_share"), F.col("growth_pct")).alias("role"), rag(F.col("growth_pct")).alias("rag"))


def category_trend(tx: DataFrame, period: str = "W") -> DataFrame:
    """Revenue and share of the period's baskets per category and period."""
    p = tx.withColumn("period", period_start("date", period))
    total = p.groupBy("period").agg(F.countDistinct("transaction_id").alias("_n"))
    own = p.groupBy("category", "period").agg(F.sum(revenue()).alias("revenue"), F.countDistinct("transaction_id").alias("_k"))
    return own.join(total, "period").select("category", "period", "revenue", (F.col("_k") / F.col("_n")).alias("basket_penetration"))


def assortment_efficiency(tx: DataFrame) -> DataFrame:
    """Share of revenue over share of products per category."""
    total = F.broadcast(tx.agg(F.countDistinct("stockcode").alias("_s")))
    own = tx.groupBy("category").agg(F.countDistinct("stockcode").alias("_k"), F.sum(revenue()).alias("total_revenue")).crossJoin(total)
    own = own.select("category", (F.col("_k") / F.col("_s")).alias("sku_share"), (F.col("total_revenue") / F.sum("total_revenue").over(W.partitionBy())).alias("revenue_share"), "total_revenue")
    own = own.withColumn("efficiency_index", F.when(F.col("sku_share") > 0, F.col("revenue_share") / F.col("sku_share")).otherwise(0.0))
    return own.withColumn("efficiency_label", F.when(F.col("efficiency_index") > 1.1, "efficient").when(F.col("efficiency_index") < 0.9, "under_efficient").otherwise("balanced"))


def manager_scorecard(tx: DataFrame) -> DataFrame:
    """One row per category: growth of the last year over the one before, reach, repeat customers and shares."""
    total = F.broadcast(tx.agg(F.countDistinct("transaction_id").alias("_b"), F.countDistinct("stockcode").alias("_s")))
    own = tx.groupBy("category").agg(F.sum(revenue()).alias("total_revenue"), F.countDistinct("stockcode").alias("_k"), F.countDistinct("transaction_id").alias("_t")).crossJoin(total)
    again = tx.groupBy("category", "customer_id").agg(F.countDistinct("transaction_id").alias("n")).groupBy("category").agg((F.count_if(F.col("n") > 1) / F.count("*")).alias("repeat_purchase_rate"))
    # weeks belong to the year in which they end
    years = tx.groupBy("category", F.year(F.date_add(period_start("date", "W"), 6)).alias("y")).agg(F.sum(revenue()).alias("r"))
    w = W.partitionBy("category").orderBy(F.desc("y"))
    yoy = years.withColumns({"k": F.row_number().over(w), "before": F.lead("r").over(w)}).where("k = 1").select("category", F.when(F.col("before") > 0, (F.col("r") - F.col("before")) / F.col("before") * 100).alias("revenue_yoy_growth"))
    t = own.join(again, "category").join(yoy, "category")
    return t.select("category", "total_revenue", "revenue_yoy_growth", (F.col("_t") / F.col("_b")).alias("basket_penetration"), "repeat_purchase_rate", (F.col("_k") / F.col("_s")).alias("sku_share"), (F.col("total_revenue") / F.sum("total_revenue").over(W.partitionBy())).alias("revenue_share"))


def growth_matrix(tx: DataFrame) -> DataFrame:
    """Star, cash cow, question mark or dog by the medians of share and growth."""
    s = manager_scorecard(tx).where(F.col("revenue_yoy_growth").isNotNull())
    m = F.broadcast(s.agg(F.percentile("revenue_share", 0.5).alias("_s"), F.percentile("revenue_yoy_growth", 0.5).alias("_g")))
    hi, up = F.col("revenue_share") >= F.col("_s"), F.col("revenue_yoy_growth") >= F.col("_g")
    return s.crossJoin(m).select("category", "revenue_share", F.col("revenue_yoy_growth").alias("growth_pct"), "total_revenue", F.when(hi & up, "star").when(hi, "cash_cow").when(up, "question_mark").otherwise("dog").alias("quadrant"))


def category_baselines(tx: DataFrame, n_weeks: int = 12) -> DataFrame:
    """Mean weekly revenue, units and orders of each category over its last n observed weeks."""
    weeks = tx.groupBy("category", period_start("date", "W").alias("w")).agg(F.sum(revenue()).alias("r"), F.sum("quantity").alias("u"), F.countDistinct("transaction_id").alias("t"))
    last = weeks.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy(F.desc("w")))).where(F.col("k") <= n_weeks)
    return last.groupBy("category").agg(F.avg("r").alias("baseline_revenue"), F.avg("u").alias("baseline_units"), F.avg("t").alias("baseline_orders"), F.count("*").alias("n_weeks"))


def scenario_grid(tx: DataFrame, n_weeks: int = 12, uplift: float = 0.1, weeks: int = 13, band: float = 15.0) -> DataFrame:
    """Three growth cases per category: the mean weekly growth of the last n weeks, and a deviation either side, clamped to the band and compounded."""
    g = tx.groupBy("category", period_start("date", "W").alias("w")).agg(F.sum(revenue()).alias("r"))
    w = W.partitionBy("category").orderBy("w")
    g = g.withColumns({"growth": (F.col("r") / F.lag("r").over(w) - 1) * 100, "k": F.row_number().over(W.partitionBy("category").orderBy(F.desc("w")))}).where(F.col("k") <= n_weeks)
    b = g.groupBy("category").agg(F.avg("r").alias("baseline_revenue"), F.avg("growth").alias("m"), F.stddev_samp("growth").alias("s"), F.count("*").alias("n")).where(F.col("n") >= n_weeks)
    cases = F.array(*[F.struct(F.lit(name).alias("scenario"), x.alias("g")) for name, x in (("base", F.col("m")), ("optimistic", F.col("m") + F.col("s") * uplift), ("pessimistic", F.col("m") - F.col("s") * uplift))])
    b = b.select("category", "baseline_revenue", F.explode(cases).alias("c")).select("category", "baseline_revenue", "c.scenario", F.greatest(F.lit(-band), F.least(F.lit(band), F.col("c.g"))).alias("weekly_growth_pct"))
    return b.withColumn("projected_revenue", F.col("baseline_revenue") * F.pow(1 + F.col("weekly_growth_pct") / 100, F.lit(weeks)))
