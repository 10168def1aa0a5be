"""Product attributes from lines, and how well attributes explain groups of products."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import period_start


def thirds(t: DataFrame, value: str, name: str, labels: tuple[str, str, str]) -> DataFrame:
    """Third of each row by a column, edges by linear quantiles."""
    cuts = F.broadcast(t.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q")))
    kind = F.when(F.col(value) <= F.col("_q")[0], labels[0]).when(F.col(value) <= F.col("_q")[1], labels[1]).otherwise(labels[2])
    return t.crossJoin(cuts).withColumn(name, kind).drop("_q")


def velocity_tier(tx: DataFrame) -> DataFrame:
    """Units per observed month."""
    m = tx.groupBy("stockcode").agg((F.sum("quantity") / F.countDistinct(period_start("date", "M"))).alias("units_per_month"))
    return thirds(m, "units_per_month", "velocity_tier", ("Slow-Moving", "Medium", "Fast-Moving"))


def basket_tier(tx: DataFrame) -> DataFrame:
    """Mean number of products in the baskets of each product."""
    pairs = tx.select("transaction_id", "stockcode").distinct()
    size = pairs.groupBy("transaction_id").agg(F.count("*").alias("k"))
    m = pairs.join(size, "transaction_id").groupBy("stockcode").agg(F.avg("k").alias("basket_depth"))
    return thirds(m, "basket_depth", "mission_tier", ("Top-Up", "Regular", "Stock-Up"))


def basket_missions(tx: DataFrame) -> DataFrame:
    """Mission of each basket: the commonest tier of its products, ties to the name that sorts first."""
    t = tx.select("transaction_id", "stockcode").distinct().join(basket_tier(tx).select("stockcode", "mission_tier"), "stockcode")
    n = t.groupBy("transaction_id", "mission_tier").agg(F.count("*").alias("n"))
    return n.groupBy("transaction_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "mission_tier"))["mission_tier"].alias("mission"))


def seasonality_class(tx: DataFrame, cv: float = 0.35, support: float = 0.3) -> DataFrame:
    """Seasonal, Steady or Sporadic by variation over months, months without a sale as 0, and the share of months with one."""
    months = F.broadcast(tx.agg(F.countDistinct(period_start("date", "M")).alias("n")))
    m = tx.groupBy("stockcode", period_start("date", "M").alias("m")).agg(F.sum("quantity").alias("u"))
    g = m.groupBy("stockcode").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("ss"), F.count("*").alias("k")).crossJoin(months)
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1)))
    g = g.select("stockcode", F.when((F.col("n") > 1) & (mean > 0), sd / mean).otherwise(0.0).alias("monthly_cv"), (F.col("k") / F.col("n")).alias("activity"))
    return g.withColumn("seasonality", F.when(F.col("activity") < support, "Sporadic").when(F.col("monthly_cv") >= cv, "Seasonal").otherwise("Steady"))


def split_quality(groups: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """For each attribute of products: mutual information with the group (bits), entropy gain and Gini gain."""
    long = attributes.join(groups, "stockcode").select("group", F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")).select("group", "x.*")
    c = long.groupBy("attribute", "value", "group").agg(F.count("*").alias("n"))
    v = long.groupBy("attribute", "value").agg(F.count("*").alias("nv"))
    g = long.groupBy("attribute", "group").agg(F.count("*").alias("ng"))
    t = long.groupBy("attribute").agg(F.count("*").alias("t"))
    j = c.join(v, ["attribute", "value"]).join(g, ["attribute", "group"]).join(t, "attribute")
    mi = F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nv") * F.col("ng"))))
    own = F.sum(F.col("n") * F.col("n") / (F.col("nv") * F.col("t")))
    before = g.join(t, "attribute").groupBy("attribute").agg(F.sum(F.pow(F.col("ng") / F.col("t"), 2)).alias("b"))
    return j.groupBy("attribute").agg(mi.alias("mutual_information"), own.alias("own")).join(before, "attribute").select("attribute", "mutual_information", (F.col("own") - F.col("b")).alias("gini_gain"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information of two groupings (stockcode, group)."""
    j = a.select("stockcode", F.col("group").alias("x")).join(b.select("stockcode", F.col("group").alias("y")), "stockcode")
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cell = j.groupBy("x", "y").agg(F.count("*").alias("n"))
    xs, ys = (j.groupBy(k).agg(F.count("*").alias("n")) for k in ("x", "y"))
    n = j.agg(F.count("*").alias("t"))
    h = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    s = cell.agg(two("n").alias("ij")).crossJoin(xs.crossJoin(n).agg(two("n").alias("i"), h("n").alias("hx"))).crossJoin(ys.crossJoin(n).agg(two("n").alias("j"), h("n").alias("hy"))).crossJoin(n).crossJoin(cell.crossJoin(n).agg(h("n").alias("hxy")))
    chance = F.col("i") * F.col("j") / (F.col("t") * (F.col("t") - 1) / 2)
    best = (F.col("i") + F.col("j")) / 2
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    return s.select(F.when(best != chance, (F.col("ij") - chance) / (best - chance)).otherwise(1.0).alias("ari"), F.when(F.col("hx") + F.col("hy") > 0, 2 * mi / (F.col("hx") + F.col("hy"))).otherwise(1.0).alias("nmi"))
