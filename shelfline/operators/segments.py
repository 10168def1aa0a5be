"""Customer features, segments and survival."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import quantiles, ranked
from ..functions.scalar import revenue, safe_divide
from ..functions.store import cut

#: Segment of each recency, frequency and monetary score.
RFM_NAMES = {
    "444": "Champions",
    "443": "Champions",
    "434": "Champions",
    "344": "Champions",
    "442": "Loyal",
    "433": "Loyal",
    "432": "Loyal",
    "343": "Loyal",
    "334": "Loyal",
    "424": "Potential Loyalists",
    "423": "Potential Loyalists",
    "333": "Potential Loyalists",
    "324": "Potential Loyalists",
    "441": "New Customers",
    "431": "New Customers",
    "422": "New Customers",
    "342": "New Customers",
    "421": "Promising",
    "332": "Promising",
    "323": "Promising",
    "322": "Need Attention",
    "233": "Need Attention",
    "232": "Need Attention",
    "223": "About to Sleep",
    "222": "About to Sleep",
    "133": "About to Sleep",
    "221": "At Risk",
    "212": "At Risk",
    "123": "At Risk",
    "122": "At Risk",
    "211": "Cannot Lose Them",
    "113": "Cannot Lose Them",
    "112": "Cannot Lose Them",
    "111": "Lost",
}


def with_quartile(t: DataFrame, c: str, name: str, *ties: str) -> DataFrame:
    """Quartile 1 to 4 of a column by rank, ties in the order of other columns.

    Edges are linear quantiles of the ranks 1..n; a rank on an edge belongs below it.
    """
    r = F.col("rank")
    edge = lambda q: 1 + (F.col("n") - 1) * q
    kind = F.when(r <= edge(0.25), 1).when(r <= edge(0.5), 2).when(r <= edge(0.75), 3).otherwise(4)
    return ranked(t, c, *ties).withColumn(name, kind).drop("rank", "n", "range")


def rfm_features(tx: DataFrame) -> DataFrame:
    """Recency, frequency, value and derived features per customer, as of the day after the last line."""
    last = F.broadcast(tx.agg(F.max("date").alias("_last")))
    own = tx.groupBy("customer_id").agg(
        F.max("date").alias("last_purchase"), F.min("date").alias("first_purchase"), F.countDistinct("transaction_id").alias("frequency"), F.sum(revenue()).alias("monetary"),
        F.avg(revenue()).alias("avg_order_value"), F.max(revenue()).alias("max_order_value"), F.sum("quantity").alias("n_items"), F.countDistinct("stockcode").alias("n_unique_products"),
        F.countDistinct("category").alias("n_unique_categories"), F.avg("price").alias("avg_price_paid"), F.stddev_samp(revenue()).alias("std_order_value"),
    ).crossJoin(last)
    own = own.withColumns({"recency_days": F.datediff("_last", "last_purchase") + 1, "customer_lifetime_days": F.datediff("last_purchase", "first_purchase")})
    return own.withColumns({
        "purchase_interval": F.when(F.col("frequency") > 1, F.col("customer_lifetime_days") / (F.col("frequency") - 1)).otherwise(F.col("customer_lifetime_days").cast("double")),
        "items_per_order": F.col("n_items") / F.col("frequency"),
        "revenue_per_item": safe_divide(F.col("monetary"), F.col("n_items")),
        "order_value_cv": F.when(F.abs("avg_order_value") > 1e-10, F.coalesce("std_order_value", F.lit(0.0)) / F.abs("avg_order_value")).otherwise(0.0),
    }).drop("_last")


def rfm_segments(rfm: DataFrame) -> DataFrame:
    """Scores 1 to 4 for each of recency, frequency and value, and the segment's name. Ties by customer id."""
    scored = rfm.select("customer_id", "recency_days", "frequency", "monetary")
    for c, name in (("recency_days", "recency_score"), ("frequency", "frequency_score"), ("monetary", "monetary_score")):
        scored = with_quartile(scored, c, name, "customer_id")
    scored = scored.withColumn("recency_score", 5 - F.col("recency_score"))
    code = F.concat(F.col("recency_score").cast("string"), F.col("frequency_score").cast("string"), F.col("monetary_score").cast("string"))
    names = F.create_map(*[F.lit(x) for pair in RFM_NAMES.items() for x in pair])
    return scored.withColumn("rfm_score", code).withColumn("segment", F.coalesce(F.try_element_at(names, F.col("rfm_score")), F.lit("Other")))


def behavioral_features(tx: DataFrame) -> DataFrame:
    """Thirteen behaviour features per customer, missing ones 0."""
    days = F.datediff(F.max("date"), F.min("date"))
    out = tx.groupBy("customer_id").agg(
        (days + 1).alias("days_active"), F.countDistinct("transaction_id").alias("purchase_frequency"), (days / F.greatest(F.countDistinct("date") - 1, F.lit(1))).alias("avg_days_between"),
        F.sum(revenue()).alias("total_revenue"), F.avg(revenue()).alias("avg_order_value"), F.stddev_samp(revenue()).alias("revenue_std"), F.countDistinct("stockcode").alias("n_products"), F.countDistinct("category").alias("n_categories"),
        F.avg("quantity").alias("avg_basket_size"), F.max("quantity").alias("max_basket_size"), F.avg("price").alias("avg_price"), (F.stddev_samp("price") / F.avg("price")).alias("price_cv"),
        F.avg((F.weekday("date") >= 5).cast("double")).alias("weekend_ratio"),
    )
    return out.fillna(0)


def value_segments(tx: DataFrame, horizon_days: int = 90) -> DataFrame:
    """Two-year value from history before the horizon, with what came after it, and a named segment."""
    end = F.broadcast(tx.agg((F.max("date") - F.expr(f"INTERVAL {int(horizon_days)} DAYS")).alias("_cut")))
    t = tx.crossJoin(end)
    old = F.col("date") < F.col("_cut")
    h = F.when(old, revenue())
    f = t.groupBy("customer_id").agg(
        F.datediff(F.first("_cut"), F.max(F.when(old, F.col("date")))).alias("recency"), F.countDistinct(F.when(old, F.col("transaction_id"))).alias("frequency"), F.sum(h).alias("monetary"), F.avg(h).alias("avg_order"),
        F.countDistinct(F.when(old, F.col("stockcode"))).alias("n_products"), (F.datediff(F.max(F.when(old, F.col("date"))), F.min(F.when(old, F.col("date")))) + 1).alias("lifetime_days"), F.sum(F.when(old, 0.0).otherwise(revenue())).alias("future_revenue"),
    ).where("frequency > 0")
    life = F.greatest(F.col("lifetime_days"), F.lit(1))
    alive = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("recency") / (life + F.col("recency"))))
    f = f.withColumn("predicted_clv", F.col("monetary") / (life / 365) * alive * 2)
    f = cut(f)
    q = F.broadcast(quantiles(f, "predicted_clv", {"_top": 0.8, "_mid": 0.6}))
    more = F.col("frequency") > 1
    name = (
        F.when((F.col("predicted_clv") > F.col("_top")) & (F.col("recency") < 30) & more, "VIP")
        .when((F.col("predicted_clv") > F.col("_mid")) & (F.col("recency") < 60) & more, "High Potential")
        .when((F.col("frequency") > 5) & (F.col("recency") < 90), "Loyal")
        .when((F.col("frequency") == 1) & (F.col("recency") < 30), "New")
        .when(F.col("recency") > 180, "Churned")
        .otherwise("Regular")
    )
    return f.crossJoin(q).withColumn("value_segment", name).drop("_top", "_mid")


def kaplan_meier(tx: DataFrame, window_days: int = 365) -> DataFrame:
    """Share of customers still without a purchase in the window, by days between their first and last before it.

    The curve has a row per different duration, so its running product is over the calendar, not the customers.
    """
    end = F.broadcast(tx.agg((F.max("date") - F.expr(f"INTERVAL {int(window_days)} DAYS")).alias("_cut")))
    old = F.col("date") < F.col("_cut")
    one = tx.crossJoin(end).groupBy("customer_id").agg(F.datediff(F.max(F.when(old, F.col("date"))), F.min(F.when(old, F.col("date")))).alias("duration"), F.max((~old).cast("int")).alias("event")).where("duration IS NOT NULL")
    t = one.groupBy("duration").agg(F.sum("event").alias("d"), F.count("*").alias("c"))
    at_risk = F.sum("c").over(W.orderBy(F.desc("duration")).rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("n", at_risk).withColumn("step", F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))))
    w = W.orderBy("duration").rowsBetween(W.unboundedPreceding, 0)
    gone = F.max((F.col("d") >= F.col("n")).cast("int")).over(w)
    return t.select(F.col("duration").alias("timeline"), F.when(gone == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum("step").over(w), F.lit(0.0)))).alias("survival_prob"))


def segment_value_metrics(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Customers, revenue, shares and value per customer of each segment (customer_id, segment)."""
    own = tx.groupBy("customer_id").agg(F.sum(revenue()).alias("r"), F.countDistinct("transaction_id").alias("t"))
    g = segments.join(own, "customer_id", "left").fillna(0.0, ["r"]).fillna(0, ["t"]).groupBy("segment").agg(F.count("*").alias("n_customers"), F.sum("r").alias("revenue"), F.sum("t").alias("transactions"))
    share = lambda c: F.col(c) / F.sum(c).over(W.partitionBy())
    g = g.withColumns({"customer_share": share("n_customers"), "revenue_share": share("revenue")})
    return g.withColumns({"revenue_per_customer": F.col("revenue") / F.col("n_customers"), "transactions_per_customer": F.col("transactions") / F.col("n_customers"), "concentration_index": safe_divide(F.col("revenue_share"), F.col("customer_share"))})


def segment_concentration(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Gini coefficient and moments of customer revenue within each segment."""
    own = segments.join(tx.groupBy("customer_id").agg(F.sum(revenue()).alias("r")), "customer_id")
    rows = ranked(own.select("segment", "customer_id", "r"), "segment", "r", "customer_id")
    size = rows.groupBy("segment").agg(F.min("rank").alias("_first"), F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(size), "segment").withColumn("i", F.col("rank") - F.col("_first") + 1)  # a row per segment
    middle = F.abs(2 * F.col("i") - F.col("_n") - 1) <= 1
    gini = 2 * F.sum(F.col("i") * F.col("r")) / (F.count("*") * F.sum("r")) - (F.count("*") + 1) / F.count("*")
    return rows.groupBy("segment").agg(F.count("*").alias("n_customers"), gini.alias("gini"), F.avg("r").alias("mean_revenue"), F.avg(F.when(middle, F.col("r"))).alias("median_revenue"), F.stddev_samp("r").alias("std_revenue"))


def purchase_streak(tx: DataFrame) -> DataFrame:
    """Longest run of lines of a customer with at most a day between neighbours."""
    days = tx.groupBy("customer_id", F.to_date("date").alias("d")).agg(F.count("*").alias("n"))
    w = W.partitionBy("customer_id").orderBy("d")
    runs = days.withColumn("new", F.when(F.datediff("d", F.lag("d").over(w)) <= 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("customer_id", "run").agg(F.sum("n").alias("n")).groupBy("customer_id").agg(F.max("n").alias("streak"))


def _of_segment(segments: DataFrame, tx: DataFrame) -> DataFrame:
    return tx.join(segments.select("customer_id", "segment"), "customer_id")


def segment_sizes(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Customers and revenue of each segment."""
    return _of_segment(segments, tx).groupBy("segment").agg(F.countDistinct("customer_id").alias("customers"), F.sum(revenue()).alias("monetary"))


def segment_economics(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Revenue of each segment as customers x orders per customer x revenue per order."""
    g = _of_segment(segments, tx).groupBy("segment").agg(F.countDistinct("customer_id").alias("customers"), F.countDistinct("transaction_id").alias("transactions"), F.sum(revenue()).alias("revenue"), F.sum("quantity").alias("units"))
    return g.withColumns({"orders_per_customer": F.col("transactions") / F.col("customers"), "avg_basket_value": F.col("revenue") / F.col("transactions"), "revenue_per_customer": F.col("revenue") / F.col("customers")})


def segment_categories(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Segment by category: revenue, its share of the segment's, that against the share of all (index), and reach in the segment."""
    t = _of_segment(segments, tx)
    g = t.groupBy("segment", "category").agg(F.sum(revenue()).alias("revenue"), F.countDistinct("customer_id").alias("customers"))
    size = t.groupBy("segment").agg(F.countDistinct("customer_id").alias("_n"))
    own, whole, every = W.partitionBy("segment"), W.partitionBy("category"), W.partitionBy()
    share = F.col("revenue") / F.sum("revenue").over(own)
    usual = F.sum("revenue").over(whole) / F.sum("revenue").over(every)
    return g.join(size, "segment").select("segment", "category", "revenue", "customers", (share * 100).alias("revenue_pct"), (share / usual).alias("affinity_index"), (F.col("customers") / F.col("_n") * 100).alias("penetration_pct"))


def middle_second(tx: DataFrame) -> DataFrame:
    """One row, _m: the median time of the lines, from how many there are at each second."""
    n = cut(tx.groupBy(F.unix_timestamp("date").cast("double").alias("s")).agg(F.count("*").alias("k")))
    # a place among all lines is that of the first line of a second plus what the second holds
    r = ranked(n, "s")
    sums = r.groupBy("range").agg(F.sum("k").alias("b"))
    before = sums.select("range", (F.sum("b").over(W.orderBy("range")) - F.col("b")).alias("b"), F.sum("b").over(W.partitionBy()).alias("total"))
    upto = F.sum("k").over(W.partitionBy("range").orderBy("s").rowsBetween(W.unboundedPreceding, 0)) + F.col("b")
    placed = r.join(F.broadcast(before), "range").select("s", "total", (upto - F.col("k")).alias("from"), upto.alias("to"))
    at = lambda bound: F.max(F.when((F.col("from") <= bound) & (bound < F.col("to")), F.col("s")))
    half = (F.col("total") - 1) / 2
    return placed.agg(((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("_m"))


def segment_growth(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Second half of the lines' time against the first, split at the median date; segments with lines in both."""
    seconds = F.unix_timestamp("date").cast("double")
    middle = F.broadcast(middle_second(tx))
    t = _of_segment(segments, tx).crossJoin(middle).withColumn("_late", seconds > F.col("_m"))
    names = {"revenue": F.sum(revenue()), "customers": F.countDistinct("customer_id"), "transactions": F.countDistinct("transaction_id"), "aov": F.avg(revenue())}
    g = t.groupBy("segment", "_late").agg(*[c.alias(n) for n, c in names.items()])
    first, second = (g.where(F.col("_late") == late).select("segment", *[F.col(n).alias(f"{n}_{k}") for n in names]) for late, k in ((False, 1), (True, 2)))
    j = first.join(second, "segment")
    pct = lambda n: F.when(F.col(f"{n}_1") != 0, (F.col(f"{n}_2") - F.col(f"{n}_1")) / F.col(f"{n}_1") * 100).otherwise(0.0)
    share = lambda k: F.col(f"revenue_{k}") / F.sum(f"revenue_{k}").over(W.partitionBy()) * 100
    return j.select("segment", pct("revenue").alias("revenue_growth_pct"), pct("customers").alias("customer_growth_pct"), pct("transactions").alias("frequency_growth_pct"), pct("aov").alias("avg_order_value_growth_pct"), (share(2) - share(1)).alias("segment_share_change_pct"))


def segment_manager(economics: DataFrame, growth: DataFrame) -> DataFrame:
    """Revenue and growth of each segment, its quadrant by growth and revenue per customer, and what to do."""
    t = economics.select("segment", "revenue", "customers", "transactions", "revenue_per_customer").join(growth.select("segment", "revenue_growth_pct", "customer_growth_pct"), "segment", "left").fillna(0.0)
    mid = lambda c: F.percentile(c, F.lit(0.5)).over(W.partitionBy())
    up, rich = F.col("revenue_growth_pct") >= 0, F.col("revenue") > mid("revenue")
    action = F.when(up & rich, "Invest").when(rich, "Harvest").when(up, "Build").otherwise("Hold")
    fast, dear = F.col("revenue_growth_pct") >= mid("revenue_growth_pct"), F.col("revenue_per_customer") >= mid("revenue_per_customer")
    kind = F.when(fast & dear, "Invest").when(dear, "Retain").when(fast, "Develop").otherwise("Depreciate")
    return t.withColumns({"quadrant": kind, "action": action})


def segment_engagement(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Means over each segment's customers: orders, days since the last, days between, weeks and months with orders; shares active in 30 days and without an order in 90."""
    last = F.broadcast(tx.agg(F.to_date(F.max("date")).alias("_end")))
    d = F.to_date("date")
    days = F.datediff(F.max(d), F.min(d))
    c = _of_segment(segments, tx).groupBy("segment", "customer_id").agg(
        F.countDistinct("transaction_id").alias("purchase_frequency"), F.max(d).alias("_last"), (days / F.greatest(F.countDistinct(d) - 1, F.lit(1))).alias("avg_days_between"),
        F.countDistinct(F.date_trunc("week", "date")).alias("active_weeks"), F.countDistinct(F.date_trunc("month", "date")).alias("active_months"),
    ).crossJoin(last).withColumn("recency_days", F.datediff("_end", "_last"))
    means = [F.avg(n).alias(n) for n in ("purchase_frequency", "recency_days", "avg_days_between", "active_weeks", "active_months")]
    share = lambda e: F.count_if(e) / F.count("*") * 100
    return c.groupBy("segment").agg(F.count("*").alias("total_customers"), *means, share(F.col("recency_days") <= 30).alias("active_customer_rate_pct"), share(F.col("recency_days") > 90).alias("dormancy_rate_pct"))


def segment_baskets(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Means over each segment's baskets, and shares above the median value and below half of it."""
    b = _of_segment(segments, tx).groupBy("segment", "customer_id", "transaction_id").agg(F.round(F.sum(revenue()), 2).alias("v"), F.sum("quantity").alias("u"), F.countDistinct("stockcode").alias("s"), F.countDistinct("category").alias("c"))
    b = cut(b)
    mid = F.broadcast(quantiles(b, "v", {"_m": 0.5}, "segment"))  # a row per segment
    share = lambda e: F.count_if(e) / F.count("*") * 100
    return b.join(mid, "segment").groupBy("segment").agg(
        F.count("*").alias("n_baskets"), F.avg("v").alias("avg_basket_value"), F.avg("u").alias("avg_units_per_basket"), F.avg("s").alias("avg_skus_per_basket"), F.avg("c").alias("avg_categories_per_basket"),
        share(F.col("v") > F.col("_m")).alias("large_basket_rate_pct"), share(F.col("v") < F.col("_m") * 0.5).alias("small_basket_rate_pct"),
    )


def segment_retention(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Customers of each segment in the first and second half of the time, and how many of the first came back."""
    seconds = F.unix_timestamp("date").cast("double")
    middle = F.broadcast(middle_second(tx))
    late = seconds > F.col("_m")
    c = _of_segment(segments, tx).crossJoin(middle).groupBy("segment", "customer_id").agg(F.max(late).alias("second"), F.max(~late).alias("first"), F.countDistinct("transaction_id").alias("n"))
    g = c.groupBy("segment").agg(F.count_if("first").alias("n_first"), F.count_if(F.col("first") & F.col("second")).alias("n_kept"), (F.count_if(F.col("n") > 1) / F.count("*") * 100).alias("repeat_customer_pct"))
    return g.withColumn("retention_pct", F.when(F.col("n_first") > 0, F.col("n_kept") / F.col("n_first") * 100).otherwise(0.0))


def segment_prices(segments: DataFrame, tx: DataFrame) -> DataFrame:
    """Mean price paid in each segment, its spread, and against the mean price of each product."""
    usual = tx.groupBy("stockcode").agg(F.avg("price").alias("_p"))
    t = _of_segment(segments, tx).join(usual, "stockcode")
    return t.groupBy("segment").agg(F.avg("price").alias("avg_price"), (F.stddev_samp("price") / F.avg("price")).alias("price_cv"), F.avg(F.col("price") / F.col("_p")).alias("price_index"), (F.count_if(F.col("price") < F.col("_p")) / F.count("*") * 100).alias("below_usual_pct"))


def halves(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines up to the median time of all lines, and those after it."""
    t = tx.crossJoin(F.broadcast(middle_second(tx)))
    late = F.unix_timestamp("date").cast("double") > F.col("_m")
    return t.where(~late).drop("_m"), t.where(late).drop("_m")


def segment_migration(before: DataFrame, after: DataFrame, min_customers: int = 5) -> DataFrame:
    """Customers by their segment in two tables (customer_id, segment), with the share of each first segment and whether they stayed.

    First segments with fewer customers in both are left out.
    """
    j = before.select("customer_id", F.col("segment").alias("segment_from")).join(after.select("customer_id", F.col("segment").alias("segment_to")), "customer_id")
    n = j.groupBy("segment_from", "segment_to").agg(F.count("*").alias("customers"))
    n = n.withColumn("_n", F.sum("customers").over(W.partitionBy("segment_from"))).where(F.col("_n") >= min_customers)
    stay = F.when(F.col("segment_from") == F.col("segment_to"), F.col("customers") / F.col("_n")).otherwise(0.0)
    return n.select("segment_from", "segment_to", "customers", (F.col("customers") / F.col("_n")).alias("share"), stay.alias("retention_rate"))


def segment_radar(segments: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """segment, metric, mean, and where the mean lies between the least and largest of all segments (0 to 1, 0.5 where they are equal)."""
    means = segments.join(features, "customer_id").groupBy("segment").agg(*[F.avg(c).alias(c) for c in names])
    long = means.select("segment", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("mean")) for c in names])))
    w = W.partitionBy("metric")  # a row per segment
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    return long.withColumn("scaled", F.when(high - low > 1e-12, (F.col("mean") - low) / (high - low)).otherwise(0.5))


def segment_distinctiveness(segments: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """segment, n_customers, distinctiveness: mean distance of a segment's means from those of all customers, in their deviations."""
    t = segments.join(features, "customer_id")
    whole = t.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    own = t.groupBy("segment").agg(F.count("*").alias("n_customers"), *[F.avg(c).alias(c) for c in names]).crossJoin(F.broadcast(whole))
    far = [F.when(F.col(f"s_{c}") > 1e-12, F.abs(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in names]
    return own.select("segment", "n_customers", (sum(far[1:], far[0]) / len(names)).alias("distinctiveness"))
