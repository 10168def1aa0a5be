"""Uplift of promotions: propensity, two-model learners, Qini curves and customers' scores."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.scalar import period_start, revenue
from ..functions.store import cut, stored
from .tree import poisson_weight

FEATURES = ["avg_price", "n_txns", "week_of_year", "qty_lag", "price_lag", "cust_qty", "cust_revenue", "cust_products", "cust_txns", "prod_qty", "prod_revenue", "prod_price_cv"]

#: Lines that one task takes; larger tables have more tasks.
LINES_OF_TASK = 500_000


def uplift_rows(lines: DataFrame, horizon: int = 1) -> DataFrame:
    """A row per customer, product and week: id, customer_id, treatment (whether a line of the week was promoted), y (units of the `horizon` weeks after) and FEATURES, missing ones 0.

    lines have is_promo. Customers' and products' features come from the weeks before alone, so that nothing after the treatment tells on it.
    """
    key = ["customer_id", "stockcode"]
    # tasks in number as lines, so that none holds more of them as the table grows
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_OF_TASK))
    w = lines.select(*key, "date", "quantity", "price", "transaction_id", "is_promo").repartition(parts, *key).groupBy(*key, period_start("date", "W").alias("week")).agg(F.sum("quantity").alias("q"), F.avg("price").alias("avg_price"), F.countDistinct("transaction_id").alias("n_txns"), F.sum(revenue()).alias("r"), F.max(F.col("is_promo").cast("int")).alias("treatment"))
    day = F.datediff("week", F.lit("1970-01-01").cast("date"))
    pair = W.partitionBy(*key).orderBy(day)
    ahead = pair.rangeBetween(1, 7 * horizon)
    w = w.withColumns({"y": F.coalesce(F.sum("q").over(ahead), F.lit(0.0)), "qty_lag": F.lag("q").over(pair), "price_lag": F.lag("avg_price").over(pair), "week_of_year": F.weekofyear("week")})
    # read by both sides' sums and by the rows
    w = stored(w)

    def before(side: str, sums: dict) -> DataFrame:
        """Running sums of a side's weeks, those before each."""
        g = (w if side == "stockcode" else dealt).groupBy(side, "week").agg(*[c.alias(n) for n, c in sums.items()])
        past = W.partitionBy(side).orderBy("week").rowsBetween(W.unboundedPreceding, -1)
        # a product has no more weeks than the calendar; customers grow with the lines
        g = g if side == "stockcode" else g.repartition(parts, side)
        return g.select(side, "week", *[F.sum(n).over(past).alias(n) for n in sums])

    dealt = w.repartition(parts, "customer_id", "week")
    cust = before("customer_id", {"cust_qty": F.sum("q"), "cust_revenue": F.sum("r"), "cust_products": F.count("*"), "cust_txns": F.sum("n_txns")})
    prod = before("stockcode", {"prod_qty": F.sum("q"), "prod_revenue": F.sum("r"), "_p": F.sum("avg_price"), "_pp": F.sum(F.col("avg_price") * F.col("avg_price")), "_n": F.count("*")})
    mean = F.col("_p") / F.col("_n")
    prod = prod.withColumn("prod_price_cv", F.when((F.col("_n") > 1) & (mean > 0), F.sqrt(F.greatest(F.lit(0.0), (F.col("_pp") - F.col("_n") * mean * mean) / (F.col("_n") - 1))) / mean)).drop("_p", "_pp", "_n")
    out = dealt.join(cust.repartition(parts, "customer_id", "week"), ["customer_id", "week"]).join(prod, ["stockcode", "week"])
    row_id = F.concat_ws("|", "customer_id", "stockcode", F.col("week").cast("string"))
    return out.select(row_id.alias("id"), "customer_id", "treatment", "y", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def propensity(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows with propensity, the chance of treatment by logistic regression on standardised features."""
    stages = [VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="treatment", predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q", maxIter=100, regParam=1e-4)]
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return out.withColumn("propensity", vector_to_array("_q")[1]).drop("_v", "_x", "_p", "_r", "_q")


def overlap(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """One row: the range of propensities both sides share, the smaller share of a side within it, and whether that is enough."""
    side = lambda t, f: f(F.when(F.col("treatment") == t, F.col("propensity")))
    ends = rows.agg(F.greatest(side(1, F.min), side(0, F.min)).alias("low"), F.least(side(1, F.max), side(0, F.max)).alias("high"), F.countDistinct("treatment").alias("_k"))
    # without both sides greatest and least would name the side that is there
    ends = ends.select(*[F.when(F.col("_k") == 2, F.col(c)).alias(c) for c in ("low", "high")])
    inside = F.col("propensity").between(F.col("low"), F.col("high")).cast("double")
    share = rows.crossJoin(F.broadcast(ends)).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.least(F.coalesce(side(1, lambda c: F.avg(F.when(c.isNotNull(), inside))), F.lit(0.0)), F.coalesce(side(0, lambda c: F.avg(F.when(c.isNotNull(), inside))), F.lit(0.0))).alias("overlap_proportion"))
    return share.withColumn("enough", F.coalesce(F.col("overlap_proportion") >= least, F.lit(False)))


def trimmed(rows: DataFrame) -> DataFrame:
    """Rows in the range of propensities that both sides share."""
    ends = overlap(rows).select("low", "high")
    return rows.crossJoin(F.broadcast(ends)).where(F.col("propensity").between(F.col("low"), F.col("high"))).drop("low", "high")


def two_models(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 4, seed: int = 42, strict: bool = True) -> DataFrame:
    """Rows with uplift: what a model of the treated tells more than one of the others. Each side needs ten rows in each half.

    A row's models are those fitted without its half of the ids, so that none scores what it has learnt. With fewer rows
    there are no models: that raises, or without `strict` leaves every row with a null uplift.
    """
    half = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2))
    rows = cut(VectorAssembler(inputCols=features, outputCol="_v").transform(rows).withColumn("_half", half))
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("treatment", "_half").agg(F.count("*")).collect()}
    if any(counts.get((t, h), 0) < 10 for t in (0, 1) for h in (0, 1)):
        if strict:
            raise ValueError("too few treated or other rows for two models")
        return rows.drop("_v", "_half").withColumn("uplift", F.lit(None).cast("double"))
    parts = []
    for h in (0, 1):
        own = rows.where(F.col("_half") == h)
        for t in (1, 0):
            learner = GBTRegressor(featuresCol="_v", labelCol="y", predictionCol=f"_y{t}", maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
            own = learner.fit(rows.where((F.col("_half") != h) & (F.col("treatment") == t))).transform(own)
        parts.append(own)
    both = parts[0].unionByName(parts[1])
    return both.withColumn("uplift", F.col("_y1") - F.col("_y0")).drop("_y1", "_y0", "_v", "_half")


def qini(rows: DataFrame, bins: int = 10, resamples: int = 50, seed: int = 42) -> DataFrame:
    """The Qini curve of `uplift`: bin, x (share of rows), qini_y, random_y, ci_lower, ci_upper, from bin 0.

    Rows are ranked by uplift, largest first, ties by id. A bin adds its treated rows times the difference of mean y between its sides, over all rows;
    a bin with one side adds nothing. Rows without an uplift take no part; without any other, bin 0 is all there is. The band holds 95 % of curves drawn again with Poisson weights of rows.
    """
    r = ranked(rows.where(F.col("uplift").isNotNull()).select((-F.col("uplift")).alias("_u"), "id", "treatment", "y"), "_u", "id")
    r = r.withColumn("bin", F.least(F.lit(bins), F.floor((F.col("rank") - 1) * bins / F.col("n")).cast("int") + 1))
    r = r.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples)))).withColumn("w", F.when(F.col("draw") == 0, 1).otherwise(poisson_weight(seed, "id", "draw"))).where("w > 0")
    part = lambda t, v: F.sum(F.when(F.col("treatment") == t, v).otherwise(0))
    w, wy = F.col("w"), F.col("w") * F.col("y")
    g = r.groupBy("draw", "bin").agg(part(1, w).alias("nt"), part(0, w).alias("nc"), part(1, wy).alias("yt"), part(0, wy).alias("yc"))
    gain = F.when((F.col("nt") > 0) & (F.col("nc") > 0), (F.col("yt") / F.col("nt") - F.col("yc") / F.col("nc")) * F.col("nt")).otherwise(0.0)
    upto, all_ = W.partitionBy("draw").orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("draw")
    # from here on a row per bin and draw
    g = g.withColumn("q", F.sum(gain).over(upto) / F.sum(F.col("nt") + F.col("nc")).over(all_)).withColumn("x", F.sum(F.col("nt") + F.col("nc")).over(upto) / F.sum(F.col("nt") + F.col("nc")).over(all_))
    own = g.where("draw = 0").select("bin", "x", F.col("q").alias("qini_y"))
    band = g.where("draw > 0").groupBy("bin").agg(F.percentile("q", 0.025).alias("ci_lower"), F.percentile("q", 0.975).alias("ci_upper"))
    out = own.join(band, "bin", "left").withColumn("random_y", F.col("x") * F.max_by("qini_y", "bin").over(W.partitionBy()))
    zero = rows.sparkSession.range(1).select(F.lit(0).alias("bin"), *[F.lit(0.0).alias(c) for c in ("x", "qini_y", "ci_lower", "ci_upper", "random_y")])
    return out.unionByName(zero)


def qini_metrics(curve: DataFrame, top: int = 3) -> DataFrame:
    """metric, value: area under the Qini curve, what it is over the random line, that against the whole, and the gain per row of the first bins. Nulls for a curve of bin 0 alone."""
    w = W.orderBy("bin")  # a row per bin
    t = curve.withColumns({"_x": F.lag("x").over(w), "_y": F.lag("qini_y").over(w), "_r": F.lag("random_y").over(w)})
    area = lambda y, before: F.sum((F.col("x") - F.col("_x")) * (F.col(y) + F.col(before)) / 2)
    t = t.agg(area("qini_y", "_y").alias("qini_coefficient"), (area("qini_y", "_y") - area("random_y", "_r")).alias("auuc"), F.max_by("qini_y", "bin").alias("_last"), F.max(F.when(F.col("bin") == top, F.col("qini_y") / F.col("x"))).alias("gain_at_top"))
    t = t.withColumn("auuc_normalized", F.when(F.col("auuc").isNull(), None).when(F.col("_last") != 0, F.greatest(F.lit(0.0), F.col("auuc") / F.abs("_last"))).otherwise(0.0))
    names = ("qini_coefficient", "auuc", "auuc_normalized", "gain_at_top")
    return t.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def customer_uplift(rows: DataFrame) -> DataFrame:
    """Mean uplift of each customer's rows with a 95 % interval of the mean (null for one row), mean propensity and share of treated rows."""
    g = rows.groupBy("customer_id").agg(F.avg("uplift").alias("uplift"), F.stddev_samp("uplift").alias("_s"), F.count("*").alias("n_rows"), F.avg("propensity").alias("propensity_score"), F.avg("treatment").alias("treatment_share"))
    half = 1.96 * F.col("_s") / F.sqrt("n_rows")
    return g.select("customer_id", "uplift", (F.col("uplift") - half).alias("ci_lower"), (F.col("uplift") + half).alias("ci_upper"), "propensity_score", "treatment_share", "n_rows")
