"""Prices: elasticity, key value items, decisions and price curves."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue
from .basket import basket_penetration
from .features import category_map
from .performance import product_metrics




def weekly_prices(tx: DataFrame) -> DataFrame:
    """Mean price and total quantity per product and week."""
    return tx.groupBy("stockcode", period_start("date", "W").alias("week")).agg(F.avg("price").alias("p"), F.sum("quantity").alias("q"))


def own_price_elasticity(tx: DataFrame, min_periods: int = 10, min_price_variation: float = 0.05) -> DataFrame:
    """Slope of log quantity on log price over weeks, for products with enough weeks and price variation."""
    w = weekly_prices(tx).where("p > 0 AND q > 0").withColumns({"x": F.log("p"), "y": F.log("q")})
    g = w.groupBy("stockcode").agg(
        F.count("*").alias("n_obs"), (F.stddev_samp("p") / F.avg("p")).alias("price_cv"), F.countDistinct("p").alias("_k"), F.regr_slope("y", "x").alias("elasticity"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy")
    ).where((F.col("n_obs") >= min_periods) & (F.col("price_cv") >= min_price_variation) & (F.col("_k") >= 3))
    se = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r_squared")) * F.col("_syy") / ((F.col("n_obs") - 2) * F.col("_sxx")))
    return g.withColumn("std_error", se).select("stockcode", "elasticity", "intercept", "r_squared", "std_error", "n_obs", "price_cv", (F.col("elasticity") - 1.96 * F.col("std_error")).alias("ci_lower"), (F.col("elasticity") + 1.96 * F.col("std_error")).alias("ci_upper"))


def elasticity_confidence(e: DataFrame, wide: float = 2.0, low: float = 4.0) -> DataFrame:
    """Confidence by the width of the interval relative to the estimate, and the kind of demand."""
    width = (F.col("ci_upper") - F.col("ci_lower")) / F.greatest(F.abs("elasticity"), F.lit(1e-9))
    a = F.abs("elasticity")
    return e.withColumn("confidence", F.when(width <= wide, "high").when(width <= low, "medium").otherwise("low")).withColumn("demand", F.when(a > 1.0, "elastic").when(a < 1.0, "inelastic").otherwise("unit"))


def shrunk_elasticity(tx: DataFrame, **how) -> DataFrame:
    """Estimates drawn towards their category's mean: an estimate's own weight is between / (between + within).

    A noisy estimate moves most. (The usual form; weights the other way round pull the sure ones.)
    """
    e = own_price_elasticity(tx, **how).join(category_map(tx), "stockcode")
    by = W.partitionBy("category")
    e = e.withColumns({"category_mean": F.avg("elasticity").over(by), "between": F.coalesce(F.var_samp("elasticity").over(by), F.lit(0.0)), "within": F.col("std_error") * F.col("std_error")})
    weight = F.when(F.col("between") + F.col("within") > 0, F.col("between") / (F.col("between") + F.col("within"))).otherwise(0.0)
    return e.select("stockcode", "category", "elasticity", "category_mean", (1 - weight).alias("category_weight"), ((1 - weight) * F.col("category_mean") + weight * F.col("elasticity")).alias("shrunk"))


#: Weights of the standardised features.
KVI_WEIGHTS = {"basket_penetration": 0.30, "total_revenue": 0.25, "abs_elasticity": 0.15, "customers": 0.10, "revenue_per_customer": 0.20}


def kvi_scores(tx: DataFrame, elasticity: DataFrame | None = None) -> DataFrame:
    """Key value items: weighted standard scores of reach, revenue, elasticity, customers and revenue per customer, from 0 to 1.

    A missing elasticity counts as the median of the known ones (0.5 without any) in the score and stays null in the table.
    """
    m = product_metrics(tx).drop("penetration").withColumnRenamed("revenue", "total_revenue")
    p = basket_penetration(tx).select("stockcode", F.col("penetration").alias("basket_penetration"))
    t = m.join(p, "stockcode").join(category_map(tx), "stockcode")
    if elasticity is not None:
        t = t.join(elasticity.select("stockcode", F.abs("elasticity").alias("abs_elasticity")), "stockcode", "left")
    else:
        t = t.withColumn("abs_elasticity", F.lit(None).cast("double"))
    t = t.withColumns({"revenue_per_customer": F.col("total_revenue") / F.col("customers"), "trip_incidence": F.col("basket_penetration"), "elasticity_status": F.when(F.col("abs_elasticity").isNotNull(), "estimated").otherwise("unavailable")})
    middle = F.broadcast(t.agg(F.coalesce(F.percentile("abs_elasticity", 0.5), F.lit(0.5)).alias("_m")))
    t = t.crossJoin(middle)
    z = F.lit(0.0)
    for c, w in KVI_WEIGHTS.items():
        x = F.coalesce(F.col(c), F.col("_m")) if c == "abs_elasticity" else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        sd = F.stddev_pop(x).over(W.partitionBy())
        z = z + w * (x - F.avg(x).over(W.partitionBy())) / F.when(sd > 0, sd).otherwise(1.0)
    t = t.withColumn("_z", z)
    lo, hi = F.min("_z").over(W.partitionBy()), F.max("_z").over(W.partitionBy())
    return t.select("stockcode", "category", F.when(hi > lo, (F.col("_z") - lo) / (hi - lo)).otherwise(0.5).alias("kvi_score"), "total_revenue", "basket_penetration", "trip_incidence", "abs_elasticity", "elasticity_status")


def _split(kvi: DataFrame, labels: tuple[str, str, str, str], unknown: str, name: str, extra: Column, threshold: float = 1.0) -> DataFrame:
    mid = F.broadcast(kvi.agg(F.percentile("kvi_score", 0.5).alias("_mid")))
    high, elastic = F.col("kvi_score") >= F.col("_mid"), F.col("abs_elasticity") >= threshold
    known = extra & F.col("abs_elasticity").isNotNull()
    kind = F.when(~known, unknown).when(high & elastic, labels[0]).when(high, labels[1]).when(elastic, labels[2]).otherwise(labels[3])
    return kvi.crossJoin(mid).withColumn(name, kind).drop("_mid")


def elasticity_quadrant(kvi: DataFrame) -> DataFrame:
    return _split(kvi, ("advocate", "protect", "promote", "defer"), "unknown", "quadrant", F.col("elasticity_status").isin("estimated", "weak"))


def decision_matrix(kvi: DataFrame) -> DataFrame:
    return _split(kvi, ("invest", "protect", "price_lever", "review"), "insufficient_evidence", "decision", F.col("elasticity_status") == "estimated")


def parse_size(c: str | Column) -> Column:
    """Pack size text in litres, kilograms or pieces; 1 where there is none."""
    text = F.upper(F.col(c) if isinstance(c, str) else c)
    number, unit = (F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(ML|L|G|KG|PK|PCS)", i) for i in (1, 2))
    value = F.nullif(number, F.lit("")).cast("double")
    return F.coalesce(F.when(unit.isin("ML", "G"), value / 1000).otherwise(value), F.lit(1.0))


def price_curve_violations(items: DataFrame, tolerance: float = 1.05) -> DataFrame:
    """Neighbouring sizes of a category (stockcode, category, pack_size, price_per_unit) where the smaller costs more a unit."""
    w = W.partitionBy("category").orderBy("pack_size", "stockcode")
    nxt = lambda c: F.lead(c).over(w)
    t = items.withColumns({"larger_pack": nxt("stockcode"), "larger_size": nxt("pack_size"), "larger_price_per_unit": nxt("price_per_unit")})
    return t.where(F.col("price_per_unit") > F.col("larger_price_per_unit") * tolerance).select("category", "larger_pack", "larger_size", "larger_price_per_unit", F.col("stockcode").alias("smaller_pack"), F.col("pack_size").alias("smaller_size"), F.col("price_per_unit").alias("smaller_price_per_unit"), ((F.col("price_per_unit") / F.col("larger_price_per_unit") - 1) * 100).alias("violation_pct"))


def unit_prices(tx: DataFrame) -> DataFrame:
    """Mean price over pack size per product."""
    size = parse_size(F.concat("size", F.lit(" PK")))
    return tx.groupBy("stockcode", "category").agg(F.avg(size).alias("pack_size"), (F.sum(revenue()) / F.sum("quantity") / F.avg(size)).alias("price_per_unit"))


def price_tiers(tx: DataFrame, labels: tuple[str, ...] = ("Budget", "Mainstream", "Premium")) -> DataFrame:
    """Third of each product by its median price."""
    m = tx.groupBy("stockcode").agg(F.percentile("price", 0.5).alias("median_price"))
    cuts = F.broadcast(m.agg(F.percentile("median_price", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q")))
    return m.crossJoin(cuts).select("stockcode", "median_price", F.when(F.col("median_price") <= F.col("_q")[0], labels[0]).when(F.col("median_price") <= F.col("_q")[1], labels[1]).otherwise(labels[2]).alias("price_tier"))


def elasticity_status(tx: DataFrame, estimates: DataFrame, min_periods: int = 10, min_price_variation: float = 0.05) -> DataFrame:
    """For every product whether its elasticity can be told, and if not why. estimates comes from elasticity_confidence."""
    s = weekly_prices(tx).groupBy("stockcode").agg(F.count("*").alias("n_obs"), (F.stddev_samp("p") / F.avg("p")).alias("price_cv"), F.countDistinct("p").alias("_k"), F.count_if((F.col("p") == 0) | (F.col("q") == 0)).alias("_zero"))
    why = (
        F.when(F.col("n_obs") < min_periods, "insufficient_observations")
        .when(F.col("_zero") > 0, "unavailable")
        .when(F.col("_k") < 3, "insufficient_price_points")
        .when(F.col("price_cv") < min_price_variation, "insufficient_variation")
    )
    t = s.join(estimates.select("stockcode", "elasticity", "r_squared", "confidence"), "stockcode", "left")
    told = F.when(F.col("elasticity").isNull(), "unavailable").when(F.col("confidence") == "low", "weak").otherwise("estimated")
    return t.select("stockcode", F.coalesce(why, told).alias("elasticity_status"), "n_obs", "price_cv", "elasticity", "r_squared", "confidence")


def robust_elasticity(tx: DataFrame, **how) -> DataFrame:
    """own_price_elasticity with errors that allow for unequal variance (HC3): residuals over 1 - leverage."""
    e = own_price_elasticity(tx, **how).select("stockcode", "elasticity", "intercept", "n_obs")
    w = weekly_prices(tx).where("p > 0 AND q > 0").select("stockcode", F.log("p").alias("x"), F.log("q").alias("y")).join(e, "stockcode")
    m = w.groupBy("stockcode").agg(F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx"))
    w = w.join(m, "stockcode").withColumn("dx", F.col("x") - F.col("mx"))
    leverage = 1 / F.col("n_obs") + F.col("dx") * F.col("dx") / F.col("sxx")
    r = (F.col("y") - F.col("intercept") - F.col("elasticity") * F.col("x")) / (1 - leverage)
    g = w.groupBy("stockcode").agg(F.first("elasticity").alias("elasticity"), F.first("n_obs").alias("n_obs"), (F.sqrt(F.sum(F.pow(F.col("dx") * r, 2))) / F.first("sxx")).alias("robust_error"))
    half = 1.96 * F.col("robust_error")
    return g.withColumns({"ci_lower": F.col("elasticity") - half, "ci_upper": F.col("elasticity") + half})


def cross_price_elasticity(tx: DataFrame, pairs: DataFrame, min_periods: int = 10, min_price_variation: float = 0.05) -> DataFrame:
    """For pairs (a, b): effect of the log price of b on the log quantity of a, its own log price taken out."""
    w = weekly_prices(tx).where("p > 0 AND q > 0")
    side = lambda s: w.select(F.col("stockcode").alias(s), "week", F.col("p").alias(f"p_{s}"), F.log("p").alias(f"x_{s}"), F.log("q").alias(f"y_{s}"))
    t = pairs.select("a", "b").join(side("a"), "a").join(side("b").drop("y_b"), ["b", "week"])
    cov = lambda u, v, name: (F.covar_pop(u, v) * F.count("*")).alias(name)
    vary = lambda c: F.stddev_samp(c) / F.avg(c)
    g = t.groupBy("a", "b").agg(
        F.count("*").alias("n_obs"), vary("p_a").alias("cv_a"), vary("p_b").alias("cv_b"), F.countDistinct("p_a").alias("k_a"), F.countDistinct("p_b").alias("k_b"),
        cov("x_a", "x_a", "aa"), cov("x_b", "x_b", "bb"), cov("x_a", "x_b", "ab"), cov("y_a", "x_a", "ya"), cov("y_a", "x_b", "yb"), cov("y_a", "y_a", "yy"),
    )
    g = g.where((F.col("n_obs") >= min_periods) & (F.col("cv_a") >= min_price_variation) & (F.col("cv_b") >= min_price_variation) & (F.col("k_a") >= 3) & (F.col("k_b") >= 3))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    g = g.withColumns({"own_elasticity": (F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab")) / det, "cross_elasticity": (F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab")) / det})
    rest = F.col("yy") - F.col("own_elasticity") * F.col("ya") - F.col("cross_elasticity") * F.col("yb")
    se = F.sqrt(F.greatest(F.lit(0.0), rest) / (F.col("n_obs") - 3) * F.col("aa") / det)
    kind = F.when(F.col("cross_elasticity") > 0, "substitutes").otherwise("complements")
    return g.where(det > 0).select("a", "b", "n_obs", "own_elasticity", "cross_elasticity", se.alias("std_error"), kind.alias("relation"))


def pricing_scorecard(status: DataFrame, kvi: DataFrame) -> DataFrame:
    """One row: products by status, estimates with high confidence, and the revenue that usable estimates cover."""
    t = status.select("stockcode", F.col("elasticity_status").alias("s"), F.col("confidence").alias("c")).join(kvi.select("stockcode", F.col("total_revenue").alias("r")), "stockcode", "left")
    usable = F.col("s").isin("estimated", "weak")
    covered = F.coalesce(F.sum(F.when(usable, F.col("r"))), F.lit(0.0))
    return t.agg(F.count("*").alias("n_products"), F.count_if(F.col("s") == "estimated").alias("n_estimated"), F.count_if(F.col("s") == "weak").alias("n_weak"), F.count_if(F.col("c") == "high").alias("n_high"), covered.alias("covered_revenue"), (covered / F.sum("r")).alias("covered_share"))


def usable_estimates(tx: DataFrame, status: DataFrame) -> DataFrame:
    """Products whose estimate can be acted on, with mean weekly price and quantity."""
    base = weekly_prices(tx).groupBy("stockcode").agg(F.avg("p").alias("base_price"), F.avg("q").alias("base_qty"))
    good = status.where(F.col("confidence").isin("high", "medium") & F.col("elasticity_status").isin("estimated", "weak"))
    return good.select("stockcode", "elasticity").join(base, "stockcode")


def _priced(t: DataFrame) -> DataFrame:
    """Quantity and revenue at the price base_price x (1 + change), elasticity constant."""
    t = t.withColumn("price", F.col("base_price") * (1 + F.col("change")))
    t = t.withColumn("quantity", F.col("base_qty") * F.pow(1 + F.col("change"), F.col("elasticity")))
    return t.withColumn("revenue", F.col("price") * F.col("quantity"))


def price_simulation(usable: DataFrame, changes: tuple[float, ...] = (-0.05, -0.02, 0.02, 0.05)) -> DataFrame:
    """Price, quantity and revenue of every usable product after a few changes of price."""
    t = _priced(usable.withColumn("change", F.explode(F.array(*[F.lit(float(c)) for c in changes]))))
    return t.select("stockcode", "change", "price", "quantity", "revenue", (F.col("revenue") / (F.col("base_price") * F.col("base_qty")) - 1).alias("revenue_change"))


def price_response_curve(usable: DataFrame, estimates: DataFrame, points: int = 100, width: float = 0.2) -> DataFrame:
    """Demand curve of every usable product over a range of prices, with a band from the interval of the estimate."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    t = usable.join(estimates.select("stockcode", "ci_lower", "ci_upper"), "stockcode").select("*", step)
    t = _priced(t.withColumn("change", -width + F.col("point") * (2 * width / (points - 1))))
    at = lambda c: F.col("base_qty") * F.pow(1 + F.col("change"), F.col(c))
    return t.select("stockcode", "point", "price", "quantity", F.least(at("ci_lower"), at("ci_upper")).alias("quantity_low"), F.greatest(at("ci_lower"), at("ci_upper")).alias("quantity_high"))


def price_ladder(kvi: DataFrame) -> DataFrame:
    """Premium, Mid, Value or Entry by the quartile of the key value score; elastic products of the third quarter count as Entry."""
    q = lambda s: F.percentile("kvi_score", F.lit(s)).over(W.partitionBy())
    k = F.col("kvi_score")
    tier = F.when(k >= q(0.75), "Premium").when(k >= q(0.5), "Mid").when((k >= q(0.25)) & ~F.coalesce(F.col("abs_elasticity") >= 1, F.lit(False)), "Value").otherwise("Entry")
    return kvi.select("stockcode", "category", "kvi_score", "abs_elasticity", "total_revenue", tier.alias("tier"))


def price_promo_matrix(kvi: DataFrame) -> DataFrame:
    """Strategy of products with an elasticity, by the medians of score and elasticity, and the band of the score."""
    t = kvi.where("abs_elasticity IS NOT NULL")
    high = lambda c: F.col(c) >= F.percentile(c, F.lit(0.5)).over(W.partitionBy())
    k, e = high("kvi_score"), high("abs_elasticity")
    strategy = F.when(k & e, "Strategic promo").when(k, "Base-price focus").when(e, "Selective promo").otherwise("Margin opportunity")
    band = F.when(F.col("kvi_score") >= 0.67, "High").when(F.col("kvi_score") >= 0.33, "Medium").otherwise("Low")
    return t.select("stockcode", "kvi_score", "abs_elasticity", "total_revenue", band.alias("kvi_status"), strategy.alias("strategy"))


def pricing_manager(decisions: DataFrame, status: DataFrame) -> DataFrame:
    """One row per product: decision, status, elasticity, confidence and what a price cut of 5 % would bring."""
    t = decisions.select("stockcode", "kvi_score", "total_revenue", "decision").join(status.select("stockcode", F.col("elasticity_status").alias("status"), "elasticity", "confidence", "n_obs"), "stockcode", "full")
    gain = F.col("total_revenue") * (0.95 * F.pow(F.lit(0.95), F.col("elasticity")) - 1)
    return t.withColumn("cut_effect", gain)
