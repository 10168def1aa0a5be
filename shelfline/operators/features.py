"""Fact and dimension tables that other analyses start from."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import iso_week, revenue



def _facts() -> list:
    return [F.sum("quantity").alias("units"), F.sum(revenue()).alias("revenue"), F.countDistinct("transaction_id").alias("n_transactions"), F.countDistinct("customer_id").alias("n_customers")]


def first_seen(c: str):
    """Value of the earliest line that has one; ties to the least value."""
    return F.min(F.when(F.col(c).isNotNull(), F.struct("date", c)))[c]


def dim_product(tx: DataFrame) -> DataFrame:
    """One row per product: first name, category and brand, revenue, orders, lines, customers, units, mean price, first and last date."""
    own = lambda c: F.coalesce(first_seen(c), F.lit("Unknown")) if c in tx.columns else F.lit("Unknown")
    return tx.groupBy("stockcode").agg(
        F.coalesce(first_seen("product"), F.first("stockcode")).alias("product"), own("category").alias("category"), own("brand").alias("brand"),
        F.sum(revenue()).alias("total_revenue"), F.countDistinct("transaction_id").alias("n_orders"), F.count("*").alias("n_line_items"), F.countDistinct("customer_id").alias("n_customers"),
        F.sum("quantity").alias("units"), F.avg("price").alias("avg_price"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def product_lookup(tx: DataFrame) -> DataFrame:
    """First-seen attributes per product, missing ones as Unknown."""
    names = [c for c in ("product", "category", "brand", "size", "flavor") if c in tx.columns]
    return tx.groupBy("stockcode").agg(*[F.coalesce(first_seen(c), F.lit("Unknown")).alias(c) for c in names])


def category_map(tx: DataFrame) -> DataFrame:
    return tx.groupBy("stockcode").agg(F.coalesce(first_seen("category"), F.lit("Unknown")).alias("category"))


def fact_product_day(tx: DataFrame) -> DataFrame:
    return tx.groupBy("stockcode", F.to_date("date").alias("date")).agg(*_facts())


def fact_product_week(tx: DataFrame) -> DataFrame:
    return tx.groupBy("stockcode", iso_week("date").alias("iso_week")).agg(*_facts())


def weekly_product_panel(tx: DataFrame) -> DataFrame:
    """Product and ISO week facts with mean price and active days."""
    return tx.groupBy("stockcode", iso_week("date").alias("iso_week")).agg(*_facts(), F.avg("price").alias("avg_price"), F.countDistinct("date").alias("active_days"))


def weekly_agg(tx: DataFrame, by: list[str], value: str, how: str = "sum") -> DataFrame:
    """One aggregate (sum, mean, count or nunique) of a column by some keys and ISO week."""
    kinds = {"sum": F.sum, "mean": F.avg, "count": F.count, "nunique": F.countDistinct}
    return tx.groupBy(*by, iso_week("date").alias("iso_week")).agg(kinds[how](value).alias(value))


def fact_basket(tx: DataFrame) -> DataFrame:
    """One row per basket; customer and date are those of its earliest line."""
    first = F.min(F.struct("date", "customer_id"))
    return tx.groupBy("transaction_id").agg(first["customer_id"].alias("customer_id"), F.min("date").alias("date"), F.sum("quantity").alias("basket_size"), F.countDistinct("stockcode").alias("n_products"), F.sum(revenue()).alias("basket_revenue"), iso_week(F.min("date")).alias("iso_week"))


def fact_customer(tx: DataFrame) -> DataFrame:
    n = F.countDistinct("transaction_id")
    return tx.groupBy("customer_id").agg(
        n.alias("n_orders"), F.count("*").alias("n_line_items"), F.countDistinct("stockcode").alias("n_products"), F.sum(revenue()).alias("total_revenue"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("active_days"), (F.sum(revenue()) / n).alias("avg_order_value"),
    )


def fact_customer_product(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id", "stockcode").agg(F.sum("quantity").alias("units"), F.sum(revenue()).alias("revenue"), F.countDistinct("transaction_id").alias("n_transactions"))


def customer_sequence(tx: DataFrame, gap_days: int = 7) -> DataFrame:
    """Runs of a customer's purchases without a gap of more than gap_days days."""
    # days first: a window over one row per customer and day instead of every line
    days = tx.groupBy("customer_id", F.to_date("date").alias("day")).agg(F.collect_set("transaction_id").alias("t"), F.collect_set("stockcode").alias("p"), F.sum(revenue()).alias("r"))
    w = W.partitionBy("customer_id").orderBy("day")
    opens = F.when(F.datediff("day", F.lag("day").over(w)) <= gap_days, 0).otherwise(1)
    runs = days.withColumn("new", opens).withColumn("sequence_id", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("customer_id", "sequence_id").agg(
        F.min("day").alias("start_date"), F.max("day").alias("end_date"),
        F.size(F.array_distinct(F.flatten(F.collect_list("t")))).cast("long").alias("n_transactions"), F.size(F.array_distinct(F.flatten(F.collect_list("p")))).cast("long").alias("n_products"),
        F.sum("r").alias("revenue"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("sequence_length_days"),
    )
