"""General table operations: as-of join, cube, pivot, unpivot, filling gaps, set operations."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str]) -> DataFrame:
    """Each row of left with the values of the last row of right that is not later, within equal `by`; null where there is none.

    Both sides go through one sort by `by` and `on`. Of right rows at the same time the one with the largest values counts.
    """
    one = right.groupBy(*by, on).agg(F.max(F.struct(*values)).alias("_v"))
    kept = F.struct(*left.columns)
    both = left.select(*by, on, F.lit(1).alias("_side"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v"), kept.alias("_row"))
    both = both.unionByName(one.select(*by, on, F.lit(0).alias("_side"), "_v", F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    w = W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def revenue_cube(tx: DataFrame, *keys: str) -> DataFrame:
    """Revenue and orders for every combination of keys, of some of them, and in total; a key left out is null."""
    out = tx.cube(*keys).agg(F.sum(revenue()).alias("revenue"), F.countDistinct("transaction_id").alias("orders"), F.grouping_id().cast("long").alias("grouping"))
    return out.select(*keys, "grouping", "revenue", "orders")


def weekday_pivot(tx: DataFrame, key: str) -> DataFrame:
    """Revenue of each key by weekday, a column a day from Monday."""
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    t = tx.select(key, F.get(F.array(*[F.lit(n) for n in names]), F.weekday("date")).alias("day"), revenue().alias("r"))
    return t.groupBy(key).pivot("day", names).agg(F.sum("r")).fillna(0.0, names)


def unpivoted(t: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each key and value column: metric, value."""
    return t.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(keys), list(values), "metric", "value")


def filled_prices(tx: DataFrame) -> DataFrame:
    """Mean price of each product and week from its first to its last, weeks without a sale with the price before."""
    t = tx.groupBy("stockcode", period_start("date", "W").alias("week")).agg(F.avg("price").alias("price"))
    span = t.groupBy("stockcode").agg(F.sequence(F.min("week"), F.max("week"), F.expr("INTERVAL 7 DAYS")).alias("weeks"))
    grid = span.select("stockcode", F.explode("weeks").alias("week"))
    w = W.partitionBy("stockcode").orderBy("week").rowsBetween(W.unboundedPreceding, 0)
    out = grid.join(t, ["stockcode", "week"], "left")
    return out.select("stockcode", "week", F.last("price", ignorenulls=True).over(w).alias("price"), F.col("price").isNotNull().alias("observed"))


def customers_of_both(tx: DataFrame, first: str, second: str, key: str = "category") -> DataFrame:
    """Customers who bought in both."""
    own = lambda v: tx.where(F.col(key) == v).select("customer_id")
    return own(first).intersect(own(second))


def customers_of_first_only(tx: DataFrame, first: str, second: str, key: str = "category") -> DataFrame:
    """Customers who bought in the first and not in the second."""
    own = lambda v: tx.where(F.col(key) == v).select("customer_id")
    return own(first).subtract(own(second))


def rank_sum_test(values: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Mann-Whitney test of two groups (group is true or false) for each key: U of the true group, z with the correction for ties, and the two-sided p.

    Ranks are mean ranks; keys with a group of fewer than three have a null p.
    """
    ties = values.groupBy(key, value).agg(F.count("*").alias("n"), F.count_if(group).alias("m"))
    w = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ties = ties.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    cube = F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")
    t = ties.groupBy(key).agg(F.sum(F.col("m") * F.col("rank")).alias("ranks"), F.sum("m").alias("n1"), (F.sum("n") - F.sum("m")).alias("n2"), F.sum(cube).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    t = t.withColumn("u", F.col("ranks") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    gap = F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0))
    z = F.when(sd > 0, gap / sd).otherwise(0.0)
    t = t.withColumn("z", z)
    return t.select(key, "n1", "n2", "u", "z", F.when((F.col("n1") >= 3) & (F.col("n2") >= 3), two_sided_p(F.col("z"))).alias("p_value"))


#: Coefficients of the rational form of the complementary error function (Numerical Recipes, erfcc; error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z):
    """Chance of a standard normal value at least as far from 0 as z (z from 0 on)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)
