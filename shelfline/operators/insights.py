"""Insight and opportunity rows from the results of analyses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue
from . import basket as B
from . import performance as P


def insight(df: DataFrame, area: str, kind: str, subject: Column, text: Column, value: Column, severity: str) -> DataFrame:
    """Rows in the common form: area, kind, subject, text, value, severity."""
    return df.select(F.lit(area).alias("area"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), text.alias("text"), value.cast("double").alias("value"), F.lit(severity).alias("severity"))


def revenue_components(tx: DataFrame) -> DataFrame:
    """Weekly customers, orders per customer, units per order and price per unit; their product is revenue."""
    g = tx.groupBy(period_start("date", "W").alias("week")).agg(F.sum(revenue()).alias("revenue"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("transaction_id").alias("orders"), F.sum("quantity").alias("units"))
    return g.select("week", "revenue", "customers", (F.col("orders") / F.col("customers")).alias("frequency"), (F.col("units") / F.col("orders")).alias("basket_size"), (F.col("revenue") / F.col("units")).alias("unit_price"))


def growth_attribution(tx: DataFrame) -> DataFrame:
    """Share of each component in the change of log revenue between the last two weeks."""
    w = W.orderBy("week")
    names = ["customers", "frequency", "basket_size", "unit_price"]
    c = revenue_components(tx)
    d = c.select("week", *[(F.log(n) - F.log(F.lag(n).over(w))).alias(n) for n in ["revenue", *names]]).orderBy(F.desc("week")).limit(1)
    return d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("log_change"), F.when(F.col("revenue") != 0, F.col(n) / F.col("revenue")).otherwise(0.0).alias("share")) for n in names])).alias("x")).select("x.*")


def concentration(tx: DataFrame, top: int = 10) -> DataFrame:
    """One row: share of the top products in revenue, and the Herfindahl index."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("r"))
    s = own.withColumn("s", F.col("r") / F.sum("r").over(W.partitionBy())).withColumn("k", F.row_number().over(W.orderBy(F.desc("r"), "stockcode")))
    return s.agg(F.sum(F.when(F.col("k") <= top, F.col("s"))).alias("top_share"), F.sum(F.col("s") * F.col("s")).alias("hhi"))


def overview_insights(tx: DataFrame) -> DataFrame:
    c = concentration(tx)
    a = growth_attribution(tx).orderBy(F.desc(F.abs("log_change")), "component").limit(1)
    odd = B.revenue_control_chart(tx).where("anomaly")
    return (
        insight(c, "overview", "concentration", F.lit("top products"), F.format_string("Top 10 products bring %.1f%% of revenue", F.col("top_share") * 100), F.col("top_share"), "info")
        .unionByName(insight(a, "overview", "growth", F.col("component"), F.concat(F.lit("The last week moved most by "), "component"), F.col("log_change"), "info"))
        .unionByName(insight(odd, "overview", "anomaly", F.col("period"), F.concat(F.lit("Revenue is off its limits: "), "rule"), F.col("revenue"), "warning"))
    )


def basket_insights(tx: DataFrame, low: float = 0.05, high: float = 0.5, top: int = 5) -> DataFrame:
    p = B.basket_penetration(tx)
    few = p.where(F.col("penetration") < low).orderBy("penetration", "stockcode").limit(top)
    many = p.where(F.col("penetration") >= high).orderBy(F.desc("penetration"), "stockcode").limit(top)
    return insight(few, "basket", "low_penetration", F.col("stockcode"), F.lit("Few baskets hold this product"), F.col("penetration"), "info").unionByName(insight(many, "basket", "high_penetration", F.col("stockcode"), F.lit("Most baskets hold this product"), F.col("penetration"), "info"))


def product_insights(tx: DataFrame) -> DataFrame:
    r, life = P.sku_rationalization(tx), P.lifecycle_stage(tx)
    out = insight(r.where("action = 'delist_candidate'"), "product", "delist", F.col("stockcode"), F.lit("Little revenue and erratic demand"), F.col("revenue"), "warning")
    out = out.unionByName(insight(r.where("xyz_class = 'Z' AND abc_class = 'A'"), "product", "volatile", F.col("stockcode"), F.lit("A seller with erratic demand"), F.col("revenue"), "warning"))
    return out.unionByName(insight(life.where("stage = 'decline'"), "product", "decline", F.col("stockcode"), F.lit("Revenue fell by more than a quarter in a week"), F.col("growth_pct"), "warning"))


def retention_opportunities(clv: DataFrame, risk: float = 0.5, top: int = 10) -> DataFrame:
    """Customers worth winning back: value times the chance they are gone, halved."""
    t = clv.where(F.col("p_alive") < risk).withColumn("impact", F.col("predicted_clv") * (1 - F.col("p_alive")) * 0.5)
    return t.orderBy(F.desc("impact"), "customer_id").limit(top).select("customer_id", "p_alive", "predicted_clv", "impact")


def cross_sell_opportunities(lift: DataFrame, tx: DataFrame, min_lift: float = 1.5, min_baskets: int = 10, top: int = 10) -> DataFrame:
    """Add-ons with enough lift and baskets, valued at 1 % of the add-on's revenue times the extra lift."""
    own = tx.groupBy(F.col("stockcode").alias("addon")).agg(F.sum(revenue()).alias("r"))
    t = lift.where((F.col("lift") >= min_lift) & (F.col("cooccurrence") >= min_baskets)).join(own, "addon")
    return t.withColumn("impact", 0.01 * (F.col("lift") - 1) * F.col("r")).orderBy(F.desc("impact"), "anchor", "addon").limit(top).select("anchor", "addon", "lift", "cooccurrence", "impact")


def decision_center(tx: DataFrame) -> DataFrame:
    """All insights in one table."""
    return overview_insights(tx).unionByName(basket_insights(tx)).unionByName(product_insights(tx))
