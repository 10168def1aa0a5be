"""Category roles: which categories make trips, which follow the season, which are bought along."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_index, period_start, revenue

#: Decimals of detrended demand when it is ranked.
DIGITS = 6
#: Thresholds of trips, variation, amplitude, strength and attachment, and the error level of the season test.
TRIPS, VARIATION, AMPLITUDE, STRENGTH, ATTACHED, LEVEL = 0.15, 0.25, 0.30, 0.35, 0.20, 0.05


def chi_square_tail(x: Column, df: Column, most: int = 11) -> Column:
    """Upper tail of the chi-square distribution with 1 to `most` degrees of freedom, by the series of the incomplete gamma function."""
    a, h = df / 2.0, x / 2.0
    gammas = F.array(*[F.lit(math.lgamma(k / 2 + 1)) for k in range(1, most + 1)])
    terms = F.aggregate(
        F.sequence(F.lit(1), (4 * x).cast("int") + 200),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda s, k: F.struct((s["t"] * h / (a + k)).alias("t"), (s["s"] + s["t"] * h / (a + k)).alias("s")),
        lambda s: s["s"],
    )
    lower = F.exp(a * F.log(h) - h - F.element_at(gammas, df.cast("int"))) * terms
    return F.when(x > 0, F.greatest(F.lit(0.0), 1 - lower)).otherwise(1.0)


def seasonality(tx: DataFrame, min_cycles: int = 2, min_months: int = 8) -> DataFrame:
    """Per category: amplitude, strength, p_value, significant, n_cycles of its monthly units.

    Months from the first to the last with lines count, those without a sale as 0; a line through them is taken off. Strength is the share
    of what is left that the month of the year explains; amplitude the range of the months' means over the mean demand; p_value that of a
    Kruskal-Wallis test of months of the year, on average ranks with its correction for ties. With two years at most a strength of 0.75
    counts as significant too. Fewer cycles or months with lines give 0. A category's series is as long as the calendar.
    """
    month = period_start("date", "M")
    span = tx.agg(F.min(month).alias("a"), F.max(month).alias("b"), F.countDistinct(month).alias("_seen"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"), "_seen", (F.year("b") - F.year("a") + 1).alias("n_cycles"))
    units = tx.groupBy("category", month.alias("month")).agg(F.sum("quantity").alias("u"))
    t = tx.select("category").distinct().crossJoin(F.broadcast(grid)).join(units, ["category", "month"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
    own = W.partitionBy("category")
    t = t.withColumn("i", F.row_number().over(own.orderBy("month")).cast("double"))
    t = t.withColumns({"_s": F.regr_slope("u", "i").over(own), "_c": F.regr_intercept("u", "i").over(own), "n": F.count("*").over(own)})
    t = t.withColumn("r", F.round(F.col("u") - F.coalesce(F.col("_s") * F.col("i") + F.col("_c"), F.col("u")), DIGITS)).withColumn("m", F.month("month"))
    same = F.count("*").over(W.partitionBy("category", "r"))
    t = t.withColumns({"rank": F.rank().over(own.orderBy("r")) + (same - 1) / 2, "tie": same * same - 1.0})
    g = t.groupBy("category", "m").agg(F.count("*").alias("k"), F.avg("r").alias("mean"), F.sum("rank").alias("ranks"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"), F.sum("u").alias("u"), F.sum("tie").alias("ties"), F.first("n").alias("n"), F.first("n_cycles").alias("n_cycles"), F.first("_seen").alias("_seen"))
    every = F.sum("s") / F.first("n")
    c = g.groupBy("category").agg(
        F.first("n").alias("n"), F.first("n_cycles").alias("_cycles"), F.first("_seen").alias("_seen"), F.count("*").alias("months"), (F.sum("ss") - F.first("n") * every * every).alias("total"),
        (F.sum(F.col("k") * F.col("mean") * F.col("mean")) - F.first("n") * every * every).alias("between"), (F.max("mean") - F.min("mean")).alias("range"), F.greatest(F.abs(F.sum("u") / F.first("n")), F.lit(1e-9)).alias("base"),
        F.sum(F.col("ranks") * F.col("ranks") / F.col("k")).alias("rr"), F.sum("ties").alias("ties"),
    )
    n = F.col("n")
    ties = 1 - F.col("ties") / (n * n * n - n)
    h = F.when((ties > 0) & (F.col("months") >= 3), (12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)) / ties)
    c = c.withColumns({"h": h, "strength": F.when(F.col("total") > 1e-9, F.col("between") / F.col("total")).otherwise(0.0), "amplitude": F.col("range") / F.col("base")})
    enough = (F.col("_cycles") >= min_cycles) & (F.col("_seen") >= min_months)
    p = F.coalesce(chi_square_tail(F.col("h"), F.col("months") - 1), F.lit(1.0))
    c = c.withColumn("p_value", F.when(enough & F.col("h").isNotNull(), p).otherwise(1.0))
    real = (F.col("p_value") < LEVEL) | ((F.col("_cycles") <= 2) & (F.round("strength", 9) >= 0.75))
    zero = lambda c_: F.when(enough, F.col(c_)).otherwise(0.0).alias(c_)
    return c.select("category", zero("amplitude"), zero("strength"), "p_value", (enough & real & (F.col("months") >= 3)).alias("significant"), F.when(enough | (F.col("_cycles") >= 2), F.col("_cycles")).otherwise(0).cast("int").alias("n_cycles"))


def dominant_category(tx: DataFrame) -> DataFrame:
    """transaction_id, category: that with most revenue in each basket, ties to the name that sorts first."""
    own = tx.groupBy("transaction_id", "category").agg(F.round(F.sum(revenue()), 2).alias("r"))
    return own.groupBy("transaction_id").agg(F.min(F.struct((-F.col("r")).alias("r"), "category"))["category"].alias("category"))


def category_roles(tx: DataFrame, trips: float = TRIPS, variation: float = VARIATION, amplitude: float = AMPLITUDE, strength: float = STRENGTH, attached: float = ATTACHED) -> DataFrame:
    """Destination, Seasonal, Convenience or Routine per category, with what tells it.

    Destination: dominant in a share `trips` of all baskets, with weekly units (over weeks with a sale) that vary by `variation` at most.
    Seasonal: seasonality with amplitude and strength that is significant over two cycles. Convenience: a share
    `attached` of its baskets hold a Destination category. The others are Routine.
    """
    n = F.broadcast(tx.agg(F.countDistinct("transaction_id").alias("_n")))
    trip = dominant_category(tx).groupBy("category").agg(F.count("*").alias("_k"))
    weekly = tx.groupBy("category", period_start("date", "W").alias("w")).agg(F.sum("quantity").alias("u"))
    cv = weekly.groupBy("category").agg(F.coalesce(F.stddev_pop("u") / F.avg("u"), F.lit(0.0)).alias("demand_cv"))
    t = cv.join(trip, "category", "left").crossJoin(n).select("category", (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("trip_generation_rate"), "demand_cv")
    t = t.withColumn("destination", (F.round("trip_generation_rate", 9) >= trips) & (F.round("demand_cv", 9) <= variation))
    baskets = tx.select("transaction_id", "category").distinct().join(t.select("category", "destination"), "category")
    with_one = baskets.where("destination").select("transaction_id").distinct().withColumn("_d", F.lit(1))
    along = baskets.where("NOT destination").join(with_one, "transaction_id", "left").groupBy("category").agg((F.count("_d") / F.count("*")).alias("attachment_rate"))
    t = t.join(along, "category", "left").fillna(0.0, ["attachment_rate"]).join(seasonality(tx), "category")
    yearly = (F.col("amplitude") >= amplitude) & (F.round("strength", 9) >= strength) & F.col("significant") & (F.col("n_cycles") >= 2)
    role = F.when(F.col("destination"), "Destination").when(yearly, "Seasonal").when((F.round("trip_generation_rate", 9) < trips) & (F.round("attachment_rate", 9) >= attached), "Convenience").otherwise("Routine")
    return t.withColumn("role", role)


def role_retention(tx: DataFrame, roles: DataFrame, min_customers: int = 5) -> DataFrame:
    """Monthly retention of customers by the role of the dominant category of their first basket (the earliest, then the smallest id).

    role, cohort, period_index, retained, cohort_size, retention_rate; cohorts of a role with fewer customers are left out.
    """
    named = dominant_category(tx).join(roles.select("category", "role"), "category", "left").select("transaction_id", F.coalesce("role", F.lit("Unknown")).alias("role"))
    first = tx.groupBy("customer_id").agg(F.min(F.struct("date", "transaction_id")).alias("f")).select("customer_id", F.col("f.transaction_id").alias("transaction_id"), period_start("f.date", "M").alias("cohort"))
    who = first.join(named, "transaction_id").select("customer_id", "cohort", "role")
    months = tx.select("customer_id", period_start("date", "M").alias("period")).distinct()
    t = months.join(who, "customer_id").withColumn("period_index", period_index(F.col("period"), F.col("cohort"), "M"))
    g = t.groupBy("role", "cohort", "period_index").agg(F.count("*").alias("retained"))
    size = F.max(F.when(F.col("period_index") == 0, F.col("retained"))).over(W.partitionBy("role", "cohort"))
    return g.withColumn("cohort_size", size).where(F.col("cohort_size") >= min_customers).withColumn("retention_rate", F.col("retained") / F.col("cohort_size"))


def role_matrix(roles: DataFrame, tx: DataFrame) -> DataFrame:
    """Categories by trips and attachment against the medians, with revenue and the share of customers reached."""
    n = F.broadcast(tx.agg(F.countDistinct("customer_id").alias("_n")))
    own = tx.groupBy("category").agg(F.sum(revenue()).alias("revenue"), F.countDistinct("customer_id").alias("_c")).crossJoin(n)
    t = roles.select("category", "role", "trip_generation_rate", "attachment_rate").join(own, "category").withColumn("reach", F.col("_c") / F.col("_n")).drop("_c", "_n")
    # a row per category
    high = lambda c: F.round(c, 9) >= F.round(F.percentile(c, F.lit(0.5)).over(W.partitionBy()), 9)
    kind = F.when(high("trip_generation_rate") & high("attachment_rate"), "core").when(high("trip_generation_rate"), "trip_driver").when(high("attachment_rate"), "add_on").otherwise("peripheral")
    return t.withColumn("quadrant", kind)
