"""Promotions: finding them in prices, comparing windows, timing, halo and cannibalisation."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue
from ..functions.store import near
from .features import category_map


def _drop(base: str, price: str):
    return (F.col(base) - F.col(price)) / F.col(base)


def _bases(tx: DataFrame) -> DataFrame:
    return tx.groupBy("stockcode").agg(F.percentile("price", 0.9).alias("_base"))


def _flagged(tx: DataFrame, drop: float) -> DataFrame:
    t = tx.join(_bases(tx), "stockcode").withColumn("price_drop_pct", _drop("_base", "price"))
    return t.withColumn("is_promo", F.coalesce(F.col("price_drop_pct") >= drop, F.lit(False)))


def _promo_days(tx: DataFrame, drop: float, gap_days: int) -> DataFrame:
    """Days of each product with lines under promotion, and the run each belongs to: a day has one if its least or its largest price is one."""
    days = tx.groupBy("stockcode", F.to_date("date").alias("day")).agg(F.min("price").alias("_low"), F.max("price").alias("_high"))
    days = days.join(_bases(tx), "stockcode").where((_drop("_base", "_low") >= drop) | (_drop("_base", "_high") >= drop)).select("stockcode", "day")
    w = W.partitionBy("stockcode").orderBy("day")
    opens = F.when(F.datediff("day", F.lag("day").over(w)) <= gap_days, 0).otherwise(1)
    return days.withColumn("_o", opens).withColumn("run", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0)))


def _runs(days: DataFrame, min_days: int, max_days: int) -> DataFrame:
    runs = days.groupBy("stockcode", "run").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date")).withColumn("duration_days", F.datediff("end_date", "start_date") + 1)
    return runs.where(F.col("duration_days").between(min_days, max_days))


def promo_periods(tx: DataFrame, drop: float = 0.15, min_days: int = 3, max_days: int = 60, gap_days: int = 1) -> DataFrame:
    """The promotions of detect_promotions without their sales: stockcode, start_date, end_date, duration_days. Lines are summed up by product and day at once."""
    return _runs(_promo_days(tx, drop, gap_days), min_days, max_days).drop("run")


def detect_promotions(tx: DataFrame, drop: float = 0.15, min_days: int = 3, max_days: int = 60, gap_days: int = 1) -> DataFrame:
    """Runs of days with lines at least `drop` below the product's 90th percentile price, with sales against the rest."""
    t = _flagged(tx, drop).withColumn("day", F.to_date("date"))
    # one row per product and day holds the islands; the lines join their island again
    days = _promo_days(tx, drop, gap_days)
    runs = _runs(days, min_days, max_days)
    own = t.where("is_promo").join(days.select("stockcode", "day", "run"), ["stockcode", "day"]).groupBy("stockcode", "run").agg(
        (F.avg("price_drop_pct") * 100).alias("avg_discount_pct"), F.sum(revenue()).alias("promo_revenue"), F.sum("quantity").alias("promo_qty"), F.countDistinct("transaction_id").alias("promo_orders"), F.countDistinct("customer_id").alias("promo_customers"), F.avg("price").alias("avg_promo_price")
    )
    rest = t.where("NOT is_promo")
    base = rest.groupBy("stockcode").agg(F.sum(revenue()).alias("baseline_revenue"), F.sum("quantity").alias("baseline_qty"), F.countDistinct("transaction_id").alias("baseline_orders"), F.countDistinct("customer_id").alias("baseline_customers"), F.avg("price").alias("avg_baseline_price"))
    n = F.broadcast(rest.agg(F.countDistinct("date").alias("_days")))
    out = runs.join(own, ["stockcode", "run"]).join(base, "stockcode", "left").fillna(0).crossJoin(n)
    lift = lambda a, b: F.when((F.col(b) > 0) & (F.col("_days") > 0), F.col(a) / F.col("duration_days") / (F.col(b) / F.col("_days")) - 1).otherwise(0.0)
    return out.withColumns({"qty_lift": lift("promo_qty", "baseline_qty"), "revenue_lift": lift("promo_revenue", "baseline_revenue")}).drop("run", "_days")


def mark_promo_lines(tx: DataFrame, promos: DataFrame) -> DataFrame:
    """Lines with is_promo: whether their day lies in a promotion of their product.

    Periods that overlap are merged first, so a line meets one period at most and none is repeated.
    """
    w = W.partitionBy("stockcode").orderBy("start_date", "end_date")
    p = promos.select("stockcode", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    p = p.withColumn("_m", F.max("end_date").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_g", F.sum(F.when(F.col("start_date") <= F.col("_m"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    p = p.groupBy(F.col("stockcode").alias("_s"), "_g").agg(F.min("start_date").alias("_a"), F.max("end_date").alias("_b"))
    on = (F.col("stockcode") == F.col("_s")) & F.to_date("date").between(F.col("_a"), F.col("_b"))
    return tx.join(p, on, "left").withColumn("is_promo", F.col("_s").isNotNull()).drop("_s", "_g", "_a", "_b")


def promo_timeline(tx: DataFrame, promos: DataFrame, period: str = "W") -> DataFrame:
    """Revenue with and without promotion per category and period."""
    t = mark_promo_lines(tx, promos)
    part = lambda c: F.sum(F.when(c, revenue()).otherwise(0.0))
    return t.groupBy("category", period_start("date", period).alias("period")).agg(part(F.col("is_promo")).alias("promo_revenue"), part(~F.col("is_promo")).alias("base_revenue"), F.countDistinct(F.when(F.col("is_promo"), F.col("stockcode"))).alias("promo_skus"))


def pre_post_comparison(tx: DataFrame, promos: DataFrame, orders: bool = True) -> DataFrame:
    """Each promotion against the window of the same length before it. Without orders, their columns are left out, and lines are summed up by product and day first."""
    p = promos.select("stockcode", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date")).withColumn("_n", F.datediff("end_date", "start_date") + 1)
    # windows become days, so that a line meets only the promotions around its day
    p = p.select("stockcode", "start_date", "end_date", F.explode(F.sequence(F.expr("date_sub(start_date, _n)"), "end_date")).alias("_d"))
    lines = tx.select(F.col("stockcode").alias("_s"), F.to_date("date").alias("_day"), "transaction_id", revenue().alias("_r"), "quantity")
    if not orders:
        lines = lines.groupBy("_s", "_day").agg(F.sum("_r").alias("_r"), F.sum("quantity").alias("quantity"))
    t = p.join(lines, (F.col("stockcode") == F.col("_s")) & (F.col("_d") == F.col("_day")), "left").withColumn("_in", F.col("_d") >= F.col("start_date"))
    on, off = F.col("_s").isNotNull() & F.col("_in"), F.col("_s").isNotNull() & ~F.col("_in")
    sums = lambda c, e: F.sum(F.when(c, F.col(e)).otherwise(0.0))
    part = {"treated": on, "control": off}
    by = ["stockcode", "start_date", "end_date"]
    lift = lambda a, b: F.when(F.col(b) > 0, (F.col(a) / F.col(b) - 1) * 100).otherwise(0.0)
    lifts = {"lift_revenue_pct": lift("treated_revenue", "control_revenue"), "lift_qty_pct": lift("treated_qty", "control_qty")}
    if not orders:
        return t.groupBy(*by).agg(*[sums(c, e).alias(f"{k}_{name}") for e, name in (("_r", "revenue"), ("quantity", "qty")) for k, c in part.items()]).withColumns(lifts)
    one = t.groupBy(*by, "transaction_id").agg(*[e for k, c in part.items() for e in (sums(c, "_r").alias(f"{k}_revenue"), sums(c, "quantity").alias(f"{k}_qty"), F.max(c & F.col("transaction_id").isNotNull()).alias(f"{k}_orders"))])
    g = one.groupBy(*by).agg(*[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in ("revenue", "qty") for k in part], *[F.count_if(f"{k}_orders").alias(f"{k}_orders") for k in part])
    return g.withColumns(lifts | {"lift_orders_pct": lift("treated_orders", "control_orders")})


def promo_timing(tx: DataFrame, promos: DataFrame, by: str = "weekday") -> DataFrame:
    """Revenue with and without promotion by weekday (0 is Monday) or month."""
    key = F.weekday("date") if by == "weekday" else F.month("date")
    t = mark_promo_lines(tx, promos)
    part = lambda c: F.sum(F.when(c, revenue()).otherwise(0.0))
    return t.groupBy(key.alias(by)).agg(part(F.col("is_promo")).alias("promo_revenue"), part(~F.col("is_promo")).alias("base_revenue")).withColumn("uplift_ratio", F.when(F.col("base_revenue") > 0, F.col("promo_revenue") / F.col("base_revenue")).otherwise(0.0))


def cannibalization(tx: DataFrame, promos: DataFrame, floor: float = 1.0, orders: bool = True) -> DataFrame:
    """Revenue that each promotion's peers (same category) lost against the window of the same length before.

    Without orders, their columns are left out, and a line counts on its own day.
    """
    cats = category_map(tx)
    p = promos.select(F.col("stockcode").alias("promo_product"), F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date")).join(cats.select(F.col("stockcode").alias("promo_product"), F.col("category").alias("_c")), "promo_product")
    p = p.withColumn("_from", F.expr("date_sub(start_date, datediff(end_date, start_date) + 1)"))
    # lines become product days (an order counts on its first day), windows become days, and both meet on category and day
    if orders:
        baskets = tx.groupBy("stockcode", "category", "transaction_id").agg(F.min(F.to_date("date")).alias("d"), F.sum(revenue()).alias("r"))
        days = baskets.groupBy("stockcode", "category", "d").agg(F.sum("r").alias("r"), F.count("*").alias("t"))
    else:
        days = tx.groupBy("stockcode", "category", F.to_date("date").alias("d")).agg(F.sum(revenue()).alias("r"))
    p = p.select("promo_product", "start_date", F.col("_c").alias("category"), F.explode(F.sequence("_from", "end_date")).alias("d"))
    j = p.join(days, ["category", "d"]).where("stockcode <> promo_product")
    now = F.col("d") >= F.col("start_date")
    part = lambda c, v, name: F.sum(F.when(c, F.col(v)).otherwise(0)).alias(name)
    g = j.groupBy("promo_product", "start_date", F.col("stockcode").alias("peer_product"), "category").agg(part(now, "r", "promo_revenue"), part(~now, "r", "base_revenue"), *([part(now, "t", "promo_orders"), part(~now, "t", "base_orders")] if orders else []))
    g = g.where(F.col("base_revenue") >= floor)
    lost = F.greatest(F.lit(0.0), F.col("base_revenue") - F.col("promo_revenue"))
    return g.withColumn("cannibalized_revenue", lost).withColumn("cannibalization_index", F.least(F.lit(1.0), F.col("cannibalized_revenue") / F.col("base_revenue")))


def weekly_sales(tx: DataFrame, promos: DataFrame) -> DataFrame:
    """Units, revenue and mean price per product and week, and whether a promotion touches the week."""
    own = tx.groupBy("stockcode", period_start("date", "W").alias("week")).agg(F.sum("quantity").alias("actual_units"), F.sum(revenue()).alias("actual_revenue"), F.avg("price").alias("avg_price"))
    weeks = F.sequence(period_start("start_date", "W"), period_start("end_date", "W"), F.expr("INTERVAL 7 DAYS"))
    touched = promos.select("stockcode", F.explode(weeks).alias("week")).distinct().withColumn("_p", F.lit(True))
    return own.join(touched, ["stockcode", "week"], "left").withColumn("is_promo", F.coalesce("_p", F.lit(False))).drop("_p")


def promo_baseline(tx: DataFrame, promos: DataFrame, season: int = 52) -> DataFrame:
    """Sales per product and week that would have been without promotion, and what is beyond.

    Products with two seasons of weeks, one of them without promotion: linear trend plus the mean difference of
    the week of the year, both from weeks without promotion, which promotion weeks take over from the week before.
    Others: the mean of the last four weeks with sales.
    """
    by = W.partitionBy("stockcode")
    order = by.orderBy("week")
    t = weekly_sales(tx, promos)
    many = (F.count("*").over(by) >= 2 * season) & (F.count_if(~F.col("is_promo")).over(by) >= season)
    t = t.withColumns({"_many": many, "_i": F.row_number().over(order).cast("double"), "_season": F.weekofyear("week")})
    plain = t.where("_many AND NOT is_promo")
    for c in ("units", "revenue"):
        y = f"actual_{c}"
        line = plain.groupBy("stockcode").agg(F.regr_intercept(y, "_i").alias("_a"), F.regr_slope(y, "_i").alias("_b"))
        extra = plain.join(line, "stockcode").groupBy("stockcode", "_season").agg(F.avg(F.col(y) - F.col("_a") - F.col("_b") * F.col("_i")).alias("_s"))
        t = t.join(line, "stockcode", "left").join(extra, ["stockcode", "_season"], "left")
        fit = F.greatest(F.lit(0.0), F.col("_a") + F.col("_b") * F.col("_i") + F.col("_s"))
        t = t.withColumn("_fit", F.when(F.col("_many") & ~F.col("is_promo"), fit))
        carried = F.coalesce(F.last("_fit", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.first("_fit", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        recent = F.coalesce(F.avg(y).over(order.rowsBetween(-4, -1)), F.col(y))
        t = t.withColumn(f"baseline_{c}", F.when(F.col("_many"), carried).otherwise(recent)).drop("_a", "_b", "_s", "_fit")
    t = t.withColumn("baseline_price", F.when(F.col("baseline_units") > 0, F.col("baseline_revenue") / F.col("baseline_units")))
    t = t.withColumns({"incremental_units": F.col("actual_units") - F.col("baseline_units"), "incremental_revenue": F.col("actual_revenue") - F.col("baseline_revenue")})
    t = t.withColumn("incremental_revenue_qty", F.col("incremental_units") * F.col("baseline_price"))
    t = t.withColumn("incremental_revenue_price", F.col("incremental_revenue") - F.col("incremental_revenue_qty"))
    return t.withColumn("incrementality_pct", F.when(F.col("actual_revenue") > 0, F.col("incremental_revenue") / F.col("actual_revenue") * 100).otherwise(0.0)).drop("_many", "_i", "_season")


def promo_waterfall(baseline: DataFrame, halo: DataFrame | None = None, cannibalized: DataFrame | None = None) -> DataFrame:
    """Per product: baseline, what quantity and price add, halo, cannibalisation, and the net over the baseline."""
    names = ["baseline_revenue", "actual_revenue", "incremental_revenue_qty", "incremental_revenue_price"]
    t = baseline.groupBy("stockcode").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    for side, source, name in ((halo, "halo_revenue", "halo_revenue"), (cannibalized, "cannibalized_revenue", "cannibalization_revenue")):
        if side is None:
            t = t.withColumn(name, F.lit(0.0))
        else:
            t = t.join(side.groupBy(F.col("promo_product").alias("stockcode")).agg(F.sum(source).alias(name)), "stockcode", "left").fillna(0.0, [name])
    t = t.withColumn("incremental_revenue", F.col("incremental_revenue_qty") + F.col("incremental_revenue_price"))
    t = t.withColumn("net_incremental_revenue", F.col("incremental_revenue") + F.col("halo_revenue") - F.col("cannibalization_revenue"))
    return t.withColumn("roi", F.when(F.col("baseline_revenue") > 0, F.col("net_incremental_revenue") / F.col("baseline_revenue")).otherwise(0.0))


def promo_scores(waterfall: DataFrame) -> DataFrame:
    """WIN, MIXED, INEFFECTIVE or DESTROYS_VALUE per product."""
    # rounded, so that what is zero but for the order of a sum counts as zero
    qty, price, net, roi = (F.round(c, 6) for c in ("incremental_revenue_qty", "incremental_revenue_price", "net_incremental_revenue", "roi"))
    volume = F.when(qty != 0, F.abs(qty)).otherwise(F.greatest(F.abs(price), F.lit(1.0)))
    idle = F.abs(qty) <= 0.01 * F.greatest(F.abs(qty), F.abs(price), F.lit(1.0))
    score = F.when(idle, "INEFFECTIVE").when((qty < 0) | (net < -0.5 * volume), "DESTROYS_VALUE").when(roi < 0, "MIXED").otherwise("WIN")
    return waterfall.select("stockcode", net.alias("net_incremental_revenue"), roi.alias("roi"), score.alias("score"))


def promo_roi(comparison: DataFrame, margin: float = 0.3, cost: float = 0.15) -> DataFrame:
    """Profit and return of each promotion of pre_post_comparison."""
    gain = F.col("treated_revenue") - F.col("control_revenue")
    t = comparison.withColumns({"incremental_revenue": gain, "promo_cost": F.col("treated_revenue") * cost})
    t = t.withColumn("incremental_profit", F.col("incremental_revenue") * margin - F.col("promo_cost"))
    roi = F.when(F.col("promo_cost") > 0, F.col("incremental_profit") / F.col("promo_cost") * 100).otherwise(0.0)
    return t.select("stockcode", "start_date", "end_date", "incremental_revenue", "incremental_profit", "promo_cost", roi.alias("roi_pct"))


def promo_baskets(tx: DataFrame, promos: DataFrame) -> DataFrame:
    """Revenue of the promoted product in each basket of a promotion (during) and of the window of the same length before."""
    p = promos.select(F.col("stockcode").alias("_s"), F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    p = p.withColumn("_from", F.expr("date_sub(start_date, datediff(end_date, start_date) + 1)"))
    d = F.to_date("date")
    t = tx.join(p, (F.col("stockcode") == F.col("_s")) & d.between(F.col("_from"), F.col("end_date")))
    return t.groupBy("stockcode", "start_date", "transaction_id", (d >= F.col("start_date")).alias("during")).agg(F.sum(revenue()).alias("basket_revenue"))


def halo_effect(tx: DataFrame, promos: DataFrame, window_days: int = 7) -> DataFrame:
    """Other products in the baskets of each promotion, and in the product's baskets of four windows before."""
    p = promos.select(F.col("stockcode").alias("promo_product"), F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    # windows become days, so that a line meets only the promotions around its day
    p = p.select("promo_product", "start_date", F.explode(F.sequence(F.date_sub("start_date", 4 * window_days), "end_date")).alias("_d"))
    own = tx.select("stockcode", "transaction_id", F.to_date("date").alias("_day")).join(p, (F.col("stockcode") == F.col("promo_product")) & (F.col("_day") == F.col("_d")))
    own = own.select("promo_product", "start_date", "transaction_id", (F.col("_d") >= F.col("start_date")).alias("now")).distinct()
    # a basket meets its promotions with one row per product, so that rows are baskets
    sums = tx.groupBy("transaction_id", "stockcode").agg(F.sum(revenue()).alias("r"))
    t = own.join(sums, "transaction_id").where("stockcode <> promo_product")
    part = lambda c, name: [F.sum(F.when(c, F.col("r")).otherwise(0.0)).alias(f"{name}_revenue"), F.count_if(c).alias(f"{name}_orders")]
    g = t.groupBy("promo_product", "start_date", F.col("stockcode").alias("halo_product")).agg(*part(F.col("now"), "halo"), *part(~F.col("now"), "base"))
    return g.withColumn("revenue_lift", F.when(F.col("base_revenue") != 0, (F.col("halo_revenue") / F.col("base_revenue") - 1) * 100))


def halo_revenue(tx: DataFrame, promos: DataFrame) -> DataFrame:
    """promo_product, halo_revenue: what halo_effect gives for all of a product's promotions and other products together.

    A basket of n promotions of a product counts n times what it holds beside that product, so no pair of products is built and lines are shuffled once, by basket.
    """
    p = promos.select(F.col("stockcode").alias("_s"), F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    p = p.select("_s", "start_date", F.explode(F.sequence("start_date", "end_date")).alias("_d")).groupBy("_s", "_d").agg(F.collect_set("start_date").alias("_p"))
    lines = tx.select("transaction_id", "stockcode", F.to_date("date").alias("_day"), revenue().alias("r")).where("transaction_id IS NOT NULL AND stockcode IS NOT NULL")
    t = lines.join(near(p), (F.col("stockcode") == F.col("_s")) & (F.col("_day") == F.col("_d")), "left").select("transaction_id", "stockcode", "r", "_p")
    own = t.repartition("transaction_id").groupBy("transaction_id", "stockcode").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("r"), F.size(F.array_distinct(F.flatten(F.collect_set("_p")))).alias("n"))
    rest = F.sum("r").over(W.partitionBy("transaction_id")) - F.col("r")
    return own.withColumn("rest", rest).where("n > 0").groupBy(F.col("stockcode").alias("promo_product")).agg(F.sum(F.col("n") * F.col("rest")).alias("halo_revenue"))


def category_cannibalization(tx: DataFrame, promos: DataFrame, window_days: int = 30, floor: float = 1.0) -> DataFrame:
    """What other categories lost during promotions against the window of the same length before, per pair of categories."""
    cats = category_map(tx).select("stockcode", F.col("category").alias("promo_category"))
    p = promos.select("stockcode", F.to_date("start_date").alias("a"), F.to_date("end_date").alias("b")).join(cats, "stockcode")
    p = p.withColumn("n", F.least(F.datediff("b", "a") + 1, F.lit(window_days))).withColumn("promo", F.xxhash64("stockcode", "a", "b"))
    p = p.select("promo", "promo_category", "b", "n", F.explode(F.sequence(F.expr("date_sub(b, 2 * n - 1)"), "b")).alias("d"))
    days = tx.groupBy("category", F.to_date("date").alias("d")).agg(F.sum(revenue()).alias("r"))
    j = p.join(days, "d").where("category <> promo_category")
    now = F.col("d") > F.expr("date_sub(b, n)")
    one = j.groupBy("promo", "promo_category", F.col("category").alias("peer_category")).agg(F.sum(F.when(now, F.col("r")).otherwise(0.0)).alias("promo_revenue"), F.sum(F.when(now, 0.0).otherwise(F.col("r"))).alias("base_revenue"))
    one = one.where(F.col("base_revenue") >= floor).withColumn("lost", F.greatest(F.lit(0.0), F.col("base_revenue") - F.col("promo_revenue")))
    g = one.groupBy("promo_category", "peer_category").agg(F.count("*").alias("n_promos"), F.sum("promo_revenue").alias("promo_revenue"), F.sum("base_revenue").alias("base_revenue"), F.sum("lost").alias("cannibalized_revenue"))
    return g.withColumn("cannibalization_index", F.least(F.lit(1.0), F.col("cannibalized_revenue") / F.col("base_revenue")))


def promo_effectivity(waterfall: DataFrame, promos: DataFrame) -> DataFrame:
    """Products by the revenue that quantity adds and by return, with what their promotions sold."""
    sold = promos.groupBy("stockcode").agg(F.sum("promo_revenue").alias("promo_revenue"))
    t = waterfall.select("stockcode", F.round("incremental_revenue_qty", 6).alias("volume"), F.round(F.col("roi") * 100, 6).alias("roi_pct"))
    t = t.join(sold, "stockcode", "left").fillna(0.0, ["promo_revenue"])
    high = lambda c: F.col(c) >= F.percentile(c, F.lit(0.5)).over(W.partitionBy())
    kind = F.when(high("volume") & high("roi_pct"), "scale").when(high("volume"), "optimize").when(high("roi_pct"), "rethink").otherwise("stop")
    return t.withColumn("quadrant", kind)


def promo_observed(comparison: DataFrame, waterfall: DataFrame) -> DataFrame:
    """Mean lift seen around a product's promotions beside the one that its baseline gives."""
    seen = comparison.groupBy("stockcode").agg(F.avg("lift_revenue_pct").alias("observed_lift_pct"), F.count("*").alias("n_promos"))
    told = waterfall.select("stockcode", F.when(F.col("baseline_revenue") > 0, F.col("incremental_revenue") / F.col("baseline_revenue") * 100).otherwise(0.0).alias("estimated_lift_pct"))
    return seen.join(told, "stockcode", "full").withColumn("gap_pct", F.col("observed_lift_pct") - F.col("estimated_lift_pct"))


def discount_response(promos: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean extra units of promotions with a discount around 5, 10, 15, 20 and 25 %."""
    weeks = F.sequence(period_start("start_date", "W"), period_start("end_date", "W"), F.expr("INTERVAL 7 DAYS"))
    point = (F.floor((F.col("avg_discount_pct") + 2.5) / 5) * 5).cast("int")
    p = promos.select("stockcode", "start_date", point.alias("discount_pct"), F.explode(weeks).alias("week"))
    one = p.join(baseline.select("stockcode", "week", "incremental_units"), ["stockcode", "week"], "left").groupBy("stockcode", "start_date", "discount_pct").agg(F.sum("incremental_units").alias("u"))
    g = one.groupBy("discount_pct").agg(F.avg("u").alias("mean_incremental_units"), F.count("*").alias("promo_count"))
    points = promos.sparkSession.range(1, 6).select((F.col("id") * 5).cast("int").alias("discount_pct"))
    return points.join(g, "discount_pct", "left").fillna(0.0, ["mean_incremental_units"]).fillna(0, ["promo_count"])


def promo_manager(waterfall: DataFrame, promos: DataFrame) -> DataFrame:
    """Per promotion of a product: discount, sales, what it added, return and advice."""
    t = waterfall.select("stockcode", "incremental_revenue_qty", "cannibalization_revenue", (F.col("roi") * 100).alias("roi_pct"))
    t = t.join(promos.select("stockcode", "start_date", "end_date", "avg_discount_pct", "promo_revenue", "promo_qty", "baseline_revenue"), "stockcode")
    more, r = F.col("incremental_revenue_qty"), F.col("roi_pct")
    advice = F.when((more > 0) & (r >= 50), "scale").when((more > 0) & (r > 0), "optimize").when((more == 0) & (r > 0), "rethink").otherwise("stop")
    return t.withColumn("recommendation", advice)


def promo_panel(tx: DataFrame, promos: DataFrame) -> DataFrame:
    """Product weeks with logs of units and price, the log of units the week of sales before, and the promotion flag."""
    t = weekly_sales(tx, promos).where("actual_units > 0 AND avg_price > 0")
    t = t.withColumns({"log_units": F.log("actual_units"), "log_price": F.log("avg_price")})
    return t.select("stockcode", "week", "is_promo", "log_units", "log_price", F.lag("log_units").over(W.partitionBy("stockcode").orderBy("week")).alias("lag_log_units"))


def baseline_revenue(tx: DataFrame, promos: DataFrame) -> DataFrame:
    """Mean weekly revenue of each product in weeks without promotion."""
    return weekly_sales(tx, promos).where("NOT is_promo").groupBy("stockcode").agg(F.avg("actual_revenue").alias("baseline_weekly_revenue"), F.count("*").alias("n_weeks"))
