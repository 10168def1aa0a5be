"""Decision tables: indicators, quadrants, priorities and manager tables per category, product, pair and cohort.

Medians and ranges are windows over rows that are already one per category, product or pair.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..functions.scalar import period_start, revenue, safe_divide
from ..functions.store import cut


def middle(c: str | Column, share: float = 0.5) -> Column:
    """Quantile of a column over all rows, by linear interpolation."""
    return F.percentile(c, F.lit(share)).over(W.partitionBy())


def scaled(c: str) -> Column:
    """From 0 to 1 between the smallest and the largest value, 0.5 if all are equal."""
    low, high = F.min(c).over(W.partitionBy()), F.max(c).over(W.partitionBy())
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.5)


def quadrant(x: Column, y: Column, both: str, only_x: str, only_y: str, neither: str) -> Column:
    return F.when(x & y, both).when(x, only_x).when(y, only_y).otherwise(neither)


def _high(c: str) -> Column:
    return F.col(c) >= middle(c)


def _own(tx: DataFrame, key: str) -> DataFrame:
    return tx.groupBy(key).agg(F.sum(revenue()).alias("revenue"), F.countDistinct("customer_id").alias("customers"))


# overview


def overview_kpis(tx: DataFrame, top: int = 5) -> DataFrame:
    """One row: revenue, growth of the last week, customers, revenue at risk by concentration, and value of the growth."""
    weeks = tx.groupBy(period_start("date", "W").alias("w")).agg(F.sum(revenue()).alias("r"))
    last = weeks.orderBy(F.desc("w")).limit(2)
    last = last.agg(F.max_by("r", "w").alias("now"), F.min_by("r", "w").alias("before"), F.count("*").alias("n"))
    total = tx.agg(F.sum(revenue()).alias("category_revenue"), F.countDistinct("customer_id").alias("customer_reach"))
    best = tx.groupBy("category").agg(F.sum(revenue()).alias("r")).orderBy(F.desc("r")).limit(top)
    t = total.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(best.agg(F.sum("r").alias("top"))))
    growth = F.when((F.col("n") == 2) & (F.col("before") > 0), F.col("now") / F.col("before") - 1).otherwise(0.0)
    all_of = F.col("category_revenue")
    risk = all_of * F.least(F.col("top") / all_of * 0.3, F.lit(0.2))
    value = all_of * F.abs(growth) * 0.4
    return t.select("category_revenue", growth.alias("revenue_growth"), "customer_reach", risk.alias("revenue_at_risk"), value.alias("opportunity_value"))


def category_importance(tx: DataFrame) -> DataFrame:
    """Revenue per customer and reach of each category, and its quadrant by their medians."""
    t = _own(tx, "category")
    t = t.withColumn("revenue_per_customer", F.col("revenue") / F.col("customers"))
    t = t.withColumn("reach_pct", F.col("customers") / F.sum("customers").over(W.partitionBy()) * 100)
    t = t.withColumns({"revenue_score": scaled("revenue_per_customer"), "reach_score": scaled("reach_pct")})
    return t.withColumn("quadrant", quadrant(_high("revenue_per_customer"), _high("reach_pct"), "Grow", "Defend", "Build", "Review"))


def revenue_drivers(components: DataFrame) -> DataFrame:
    """One row from weekly components: change of revenue in the last week, and each driver's share of it in logs.

    Price counts once. lost_customers is how many customers fewer there were.
    """
    names = ["customers", "frequency", "basket_size", "unit_price"]
    w = W.orderBy("week")
    t = components.select("week", *names, "revenue", *[F.lag(n).over(w).alias(f"_{n}") for n in [*names, "revenue"]])
    t = t.orderBy(F.desc("week")).limit(1).where("_revenue IS NOT NULL")
    logs = {n: F.log(F.col(n) / F.col(f"_{n}")) for n in names}
    total = sum(logs.values(), F.lit(0.0))
    shares = [F.when(total != 0, c / total).otherwise(0.0).alias(f"{n}_share") for n, c in logs.items()]
    lost = F.greatest(F.lit(0), F.col("_customers") - F.col("customers")).cast("long")
    return t.select("week", (F.col("revenue") / F.col("_revenue") - 1).alias("revenue_change"), *shares, lost.alias("lost_customers"))


def growth_reach(kpis: DataFrame) -> DataFrame:
    """Quadrant of each category by growth and reach."""
    t = kpis.select("category", "revenue", "growth_pct", (F.col("customers") / F.sum("customers").over(W.partitionBy()) * 100).alias("reach_pct"))
    kind = quadrant(_high("growth_pct"), _high("reach_pct"), "Growth Engines", "Emerging Opportunities", "Critical Risks", "Draggers")
    return t.withColumn("quadrant", kind)


def decision_priorities(tx: DataFrame) -> DataFrame:
    """Priority score of each category from revenue, customers and products, and what to do with it."""
    t = tx.groupBy("category").agg(F.sum(revenue()).alias("revenue"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("stockcode").alias("n_products"))
    score = F.col("revenue") * 0.5 + F.col("customers") * 10 + F.col("n_products") * 50
    r, c = F.col("revenue"), F.col("customers")
    mid, mid_c = middle("revenue"), middle("customers")
    kind = F.when((r > mid * 2) & (c > mid_c), "Invest").when((r > mid) & (c <= mid_c), "Protect").when(r <= mid * 0.5, "Review").otherwise("Monitor")
    t = t.withColumns({"decision_priority": score, "decision": kind})
    return t.withColumn("rank", F.row_number().over(W.orderBy(F.desc("decision_priority"), "category")))


# categories


def category_reach(kpis: DataFrame) -> DataFrame:
    """Share of each category in the sum of the categories' customers."""
    return kpis.select("category", "customers", (F.col("customers") / F.sum("customers").over(W.partitionBy())).alias("reach"))


#: Parts of growth that the bridge starts from.
BRIDGE = {"trend": 0.40, "seasonality": 0.25, "promo": 0.20}


def growth_bridge(scorecard: DataFrame, kpis: DataFrame) -> DataFrame:
    """Growth of each category over a year, split by fixed shares and rescaled to add up to it."""
    t = scorecard.join(category_reach(kpis), "category")
    g = F.col("revenue_yoy_growth")
    parts = {n: g * s for n, s in BRIDGE.items()}
    parts["cannibalization"] = F.when(F.col("revenue_share") > 0.1, g * -0.15).otherwise(0.0)
    parts["new_customers"] = g * F.col("reach") * 0.30
    total = sum(parts.values(), F.lit(0.0))
    return t.select("category", g.alias("total_growth"), *[F.when(total != 0, c * g / total).otherwise(0.0).alias(n) for n, c in parts.items()])


def opportunity_map(scorecard: DataFrame) -> DataFrame:
    """Share of revenue times the size of growth."""
    return scorecard.select("category", "revenue_share", "revenue_yoy_growth", (F.col("revenue_share") * F.abs("revenue_yoy_growth") / 100).alias("opportunity_score"))


def category_kpi_row(scorecard: DataFrame) -> DataFrame:
    """One row: revenue, mean growth, revenue of shrinking categories, and value of small growing ones."""
    growing = (F.col("revenue_yoy_growth") > 0) & (F.col("revenue_share") < 0.2)
    value = F.sum(F.when(growing, F.col("total_revenue"))) * F.avg(F.when(growing, F.col("revenue_yoy_growth"))) / 100
    return scorecard.agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("revenue_yoy_growth").alias("mean_growth"),
        F.coalesce(F.sum(F.when(F.col("revenue_yoy_growth") < 0, F.col("total_revenue"))), F.lit(0.0)).alias("revenue_at_risk"),
        F.coalesce(value, F.lit(0.0)).alias("opportunity_value"),
    )


def category_trajectory(tx: DataFrame) -> DataFrame:
    """Weekly revenue of each category with its linear trend and the mean of the calendar month."""
    t = tx.groupBy("category", period_start("date", "W").alias("week")).agg(F.sum(revenue()).alias("revenue"))
    t = t.withColumn("i", F.row_number().over(W.partitionBy("category").orderBy("week")).cast("double"))
    line = t.groupBy("category").agg(F.regr_slope("revenue", "i").alias("slope"), F.regr_intercept("revenue", "i").alias("base"))
    season = F.avg("revenue").over(W.partitionBy("category", F.month("week")))
    return t.withColumn("month_mean", season).join(line, "category").select("category", "week", "revenue", (F.col("base") + F.col("slope") * F.col("i")).alias("trend"), "month_mean")


def strategic_table(scorecard: DataFrame) -> DataFrame:
    """Priority and action of each category by its growth and share."""
    g, s = F.col("growth_pct"), F.col("revenue_share")
    priority = F.when((g < 0) & (s >= middle("revenue_share")), "High").when((g > 0) & (s < middle("revenue_share")), "Medium").otherwise("Low")
    action = F.when((g < 0) & (s >= middle("revenue_share")), "Defend").when(g < 0, "Review").when(s >= middle("revenue_share"), "Invest").otherwise("Build")
    return scorecard.select("category", "role", "revenue_share", "growth_pct", priority.alias("priority"), action.alias("action"))


def action_plan(strategic: DataFrame, top: int = 5) -> DataFrame:
    """The categories with the largest share times decline, one row for each of three months."""
    t = strategic.withColumn("risk_score", F.col("revenue_share") * F.greatest(F.lit(0.0), -F.col("growth_pct")) / 100)
    t = t.orderBy(F.desc("risk_score"), "category").limit(top)
    steps = F.array(*[F.struct(F.lit(d).alias("day"), F.lit(s).alias("step")) for d, s in ((30, "diagnose"), (60, "test"), (90, "roll out"))])
    return t.select("category", "priority", "action", "risk_score", F.explode(steps).alias("x")).select("category", "priority", "action", "risk_score", "x.day", "x.step")


# rules and pairs


def rule_values(rules: DataFrame, tx: DataFrame) -> DataFrame:
    """Rules with the value of their extra lift: (lift - 1) x mean revenue of the antecedents x support, and a quadrant."""
    own = tx.groupBy(F.col("stockcode").alias("_i")).agg(F.sum(revenue()).alias("_r"))
    side = rules.select("antecedents", F.explode("antecedents").alias("_i")).distinct().join(own, "_i", "left")
    mean = side.groupBy("antecedents").agg(F.avg(F.coalesce("_r", F.lit(0.0))).alias("antecedent_revenue"))
    t = rules.join(mean, "antecedents")
    t = t.withColumn("incremental_value", F.greatest(F.col("lift") - 1, F.lit(0.0)) * F.col("antecedent_revenue") * F.col("support"))
    kind = quadrant(_high("lift"), _high("incremental_value"), "scale", "optimize", "rethink", "stop")
    return t.withColumn("quadrant", kind).select("antecedents", "consequents", "support", "lift", "antecedent_revenue", "incremental_value", "quadrant")


def cross_sell_matrix(values: DataFrame) -> DataFrame:
    """Each anchor and add-on of the rules: largest lift, support in total and value."""
    t = values.select(F.array_join("antecedents", "+").alias("anchor"), F.explode("consequents").alias("addon"), "lift", "support", "antecedent_revenue")
    t = t.groupBy("anchor", "addon").agg(F.max("lift").alias("max_lift"), F.sum("support").alias("total_support"), F.max("antecedent_revenue").alias("r"))
    return t.select("anchor", "addon", "max_lift", "total_support", (F.col("r") * F.col("total_support") * (F.col("max_lift") - 1)).alias("expected_value"))


def _strongest(pairs: DataFrame) -> DataFrame:
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("stockcode"), F.abs("affinity").alias("v")) for c in ("a", "b")])).alias("x")
    return pairs.select(ends).select("x.*").groupBy("stockcode").agg(F.max("v").alias("affinity_intensity"))


def affinity_quadrants(pairs: DataFrame, tx: DataFrame) -> DataFrame:
    """Products by their strongest affinity, against the median of all pairs, and by revenue."""
    pairs = cut(pairs)
    edge = F.broadcast(quantiles(pairs, "affinity", {"_cut": 0.5}))
    t = _strongest(pairs).join(_own(tx, "stockcode").drop("customers"), "stockcode").crossJoin(edge)
    near, rich = F.col("affinity_intensity") > F.col("_cut"), F.col("revenue") > middle("revenue")
    return t.withColumn("quadrant", quadrant(near, rich, "basket_anchors", "niche", "growth_attachments", "low_priority")).drop("_cut")


def co_purchase_manager(pairs: DataFrame, tx: DataFrame, growth: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Per product: strongest affinity, revenue over the median, share of baskets and advice.

    growth has stockcode and growth_pct, elasticity stockcode and elasticity; without a row both count as 0.
    """
    n = F.broadcast(tx.agg(F.countDistinct("transaction_id").alias("_n")))
    t = _own(tx, "stockcode").crossJoin(n).join(_strongest(pairs), "stockcode", "left")
    t = t.join(growth.select("stockcode", "growth_pct"), "stockcode", "left").join(elasticity.select("stockcode", "elasticity"), "stockcode", "left")
    t = t.fillna(0.0, ["affinity_intensity", "growth_pct", "elasticity"])
    near, rich = F.col("affinity_intensity") > 0.3, F.col("revenue") > middle("revenue")
    advice = (
        F.when(near & rich, "Anchor - Maintain & Expand")
        .when(rich & (F.col("growth_pct") > 0), "Growth - Invest")
        .when(near & (F.col("elasticity") < -1), "Protect - Retain")
        .when(F.col("growth_pct") < 0, "Prune - Phase Out")
        .otherwise("Review - Test")
    )
    extra = F.greatest(F.lit(0.0), F.col("revenue") - middle("revenue"))
    reach = F.least(F.col("customers") / F.col("_n"), F.lit(1.0))
    return t.select("stockcode", "affinity_intensity", "revenue", extra.alias("incremental_revenue"), reach.alias("basket_penetration"), advice.alias("recommendation"))


def basket_network(pairs: DataFrame, tx: DataFrame) -> DataFrame:
    """Edges of affinity with the revenue of both ends."""
    own = lambda c: _own(tx, "stockcode").select(F.col("stockcode").alias(c), F.col("revenue").alias(f"revenue_{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_ab", "affinity", "revenue_a", "revenue_b")


def mission_shares(missions: DataFrame, tx: DataFrame) -> DataFrame:
    """Share of lines and revenue in baskets of each mission."""
    t = tx.join(missions, "transaction_id").groupBy("mission").agg(F.count("*").alias("lines"), F.sum(revenue()).alias("revenue"))
    return t.withColumns({"line_share": F.col("lines") / F.sum("lines").over(W.partitionBy()), "revenue_share": F.col("revenue") / F.sum("revenue").over(W.partitionBy())})


# switching


def switching_status(matrix: DataFrame, tx: DataFrame, min_transactions: int = 3, min_customers: int = 10, min_transitions: int = 5) -> DataFrame:
    """For every product whether switching can be told, and if not why."""
    own = tx.groupBy("stockcode").agg(F.count("*").alias("n_observations"), F.countDistinct("customer_id").alias("n_customers"))
    both = matrix.select(F.col("from_product").alias("stockcode"), F.col("to_product").alias("o"), "count")
    both = both.unionByName(matrix.select(F.col("to_product").alias("stockcode"), F.col("from_product").alias("o"), "count"))
    moves = both.groupBy("stockcode").agg(F.countDistinct("o").alias("n_switchers"), F.sum("count").alias("n_transitions"))
    t = own.join(moves, "stockcode", "left").fillna(0, ["n_switchers", "n_transitions"])
    status = (
        F.when(F.col("n_observations") < min_transactions, "insufficient_observations")
        .when(F.col("n_customers") < min_customers, "insufficient_customers")
        .when(F.col("n_transitions") == 0, "no_switching_observed")
        .when(F.col("n_transitions") < min_transitions, "insufficient_transitions")
        .otherwise("estimated")
    )
    return t.withColumn("switching_status", status)


def net_switching(transference: DataFrame) -> DataFrame:
    """Revenue that flows to and from each product."""
    total = lambda c, name: transference.groupBy(F.col(c).alias("stockcode")).agg(F.sum("observed_switching_transfer_revenue").alias(name))
    t = total("from_product", "outflow").join(total("to_product", "inflow"), "stockcode", "full").fillna(0.0)
    return t.withColumn("net", F.col("inflow") - F.col("outflow"))


def switching_summary(matrix: DataFrame) -> DataFrame:
    """One row: switches, pairs, products and the largest pair's share."""
    ends = F.size(F.array_union(F.collect_set("from_product"), F.collect_set("to_product"))).cast("long")
    n = F.sum("count")
    return matrix.agg(n.alias("n_switches"), F.count("*").alias("n_pairs"), ends.alias("n_products"), (F.max("count") / n).alias("largest_share"))


def revenue_risk(sdp: DataFrame, tx: DataFrame) -> DataFrame:
    """Products by revenue and by how much of their demand has substitutes (0.5 where unknown)."""
    t = _own(tx, "stockcode").drop("customers").join(sdp, "stockcode", "left")
    t = t.withColumn("sdp", F.round(F.coalesce("sdp", F.lit(0.5)), 9))
    return t.withColumn("quadrant", quadrant(_high("revenue"), _high("sdp"), "safe", "protect", "investigate", "unique"))


def high_value_lines(tx: DataFrame, share: float = 0.8) -> DataFrame:
    """Lines of the customers whose revenue reaches a quantile of all customers' revenue."""
    own = cut(tx.groupBy("customer_id").agg(F.round(F.sum(revenue()), 2).alias("_r")))
    edge = F.broadcast(quantiles(own, "_r", {"_edge": share}))
    return tx.join(own.crossJoin(edge).where("_r >= _edge"), "customer_id", "left_semi")


def switching_flows(transference: DataFrame, impact: DataFrame, top: int = 15) -> DataFrame:
    """Where the revenue of the products that would cost most goes: to substitutes, or lost."""
    worst = impact.orderBy(F.round("net_revenue_impact", 2), "stockcode").limit(top)
    flows = transference.join(worst.select(F.col("stockcode").alias("from_product")), "from_product", "left_semi")
    flows = flows.select("from_product", "to_product", F.col("observed_switching_transfer_revenue").alias("revenue"))
    lost = F.greatest(F.lit(0.0), F.col("product_revenue") - F.col("estimated_revenue_recovered"))
    return flows.unionByName(worst.select(F.col("stockcode").alias("from_product"), F.lit("lost").alias("to_product"), lost.alias("revenue")))


def switching_manager(rates: DataFrame, recovery: DataFrame, sdp: DataFrame) -> DataFrame:
    """Per product: switch-out rate, main substitute, recovery, uniqueness and advice."""
    t = sdp.join(rates.select("stockcode", "switch_out_rate"), "stockcode", "left").join(recovery.select(F.col("from_product").alias("stockcode"), "top_substitute", "top_share"), "stockcode", "left")
    t = t.withColumn("recovery", F.round("sdp", 9)).withColumn("uniqueness", 1 - F.col("recovery"))
    advice = F.when(F.col("uniqueness") >= 0.5, "keep").when(F.col("top_share") >= 0.5, "delist_candidate").otherwise("review")
    return t.select("stockcode", F.coalesce("switch_out_rate", F.lit(0.0)).alias("switch_out_rate"), "top_substitute", "recovery", "uniqueness", advice.alias("advice"))


# cohorts and products


def cohort_value(ltv: DataFrame, retention: DataFrame) -> DataFrame:
    """Cumulative revenue of each cohort per customer who came back in the period."""
    t = ltv.join(retention.select("cohort", "period_index", "retained"), ["cohort", "period_index"], "left")
    return t.select("cohort", "period_index", "cumulative_revenue", "retained", safe_divide(F.col("cumulative_revenue"), F.col("retained")).alias("revenue_per_retained"))


#: What to do in each cell of ABC and XYZ classes.
CELLS = {
    "AX": "Protect & grow", "AY": "Manage demand", "AZ": "Hedge volatility", "BX": "Grow", "BY": "Manage",
    "BZ": "Review", "CX": "Selective grow", "CY": "Review", "CZ": "Delist candidate",
}


def class_grid(abc: DataFrame, xyz: DataFrame) -> DataFrame:
    """Products and revenue in each of the nine cells of ABC and XYZ classes, with an action."""
    spark = abc.sparkSession
    cells = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c[0]).alias("abc_class"), F.lit(c[1]).alias("xyz_class"), F.lit(a).alias("action")) for c, a in CELLS.items()])).alias("x")).select("x.*")
    own = abc.select("stockcode", "abc_class", "revenue").join(xyz.select("stockcode", "xyz_class"), "stockcode")
    own = own.groupBy("abc_class", "xyz_class").agg(F.count("*").alias("n_products"), F.sum("revenue").alias("revenue"))
    return cells.join(own, ["abc_class", "xyz_class"], "left").fillna(0, ["n_products"]).fillna(0.0, ["revenue"])


def class_counts(grid: DataFrame) -> DataFrame:
    """The grid's numbers of products with a column for each XYZ class."""
    return grid.groupBy("abc_class").pivot("xyz_class", ["X", "Y", "Z"]).agg(F.sum("n_products"))


def velocity_repeat(velocity: DataFrame, repeat: DataFrame, tx: DataFrame) -> DataFrame:
    """Velocity and repeat rate of each product, and whether its revenue is above the median."""
    t = velocity.select("stockcode", "velocity").join(repeat.select("stockcode", "repeat_rate"), "stockcode").join(_own(tx, "stockcode").drop("customers"), "stockcode")
    return t.withColumn("revenue_level", F.when(F.col("revenue") > middle("revenue"), "High").otherwise("Low"))


# assortments


def coverage_curve(tx: DataFrame, min_coverage: float = 0.8) -> DataFrame:
    """Share of revenue that the best 1, 2, ... products cover, and whether that is enough."""
    own = _own(tx, "stockcode").drop("customers")
    w = W.orderBy(F.desc("revenue"), "stockcode")
    t = own.withColumns({"n_products": F.row_number().over(w), "coverage": F.sum("revenue").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("revenue").over(W.partitionBy())})
    return t.withColumn("enough", F.col("coverage") >= min_coverage)


def coverage_risk(tx: DataFrame, transference: DataFrame, kept: DataFrame) -> DataFrame:
    """Per product: revenue, what leaves it for others, what of this kept products (stockcode) would take, and its share."""
    out = transference.join(kept.select(F.col("stockcode").alias("to_product"), F.lit(True).alias("_k")), "to_product", "left")
    flow = F.col("observed_switching_transfer_revenue")
    out = out.groupBy(F.col("from_product").alias("stockcode")).agg(F.sum(flow).alias("revenue_at_risk"), F.sum(F.when(F.col("_k"), flow).otherwise(0.0)).alias("recovery"))
    t = _own(tx, "stockcode").drop("customers").join(out, "stockcode", "left").fillna(0.0, ["revenue_at_risk", "recovery"])
    return t.withColumn("coverage", F.when(F.col("revenue_at_risk") > 0, F.col("recovery") / F.col("revenue_at_risk")).otherwise(1.0))


def portfolio_matrix(tx: DataFrame, sdp: DataFrame, risk: DataFrame) -> DataFrame:
    """Per product: share of revenue, uniqueness, reach, cover by kept substitutes and quadrant."""
    n = F.broadcast(tx.agg(F.countDistinct("customer_id").alias("_n")))
    t = _own(tx, "stockcode").crossJoin(n).join(sdp, "stockcode").join(risk.select("stockcode", "coverage"), "stockcode")
    t = t.select("stockcode", (F.col("revenue") / F.sum("revenue").over(W.partitionBy())).alias("revenue_share"), F.round(1 - F.col("sdp"), 9).alias("uniqueness"), (F.col("customers") / F.col("_n")).alias("reach"), F.col("coverage").alias("substitute_coverage"))
    return t.withColumn("quadrant", quadrant(_high("revenue_share"), _high("uniqueness"), "core", "replaceable_seller", "niche", "tail"))


def assortment_decisions(portfolio: DataFrame, kvi: DataFrame, kept: DataFrame) -> DataFrame:
    """Keep, Add, Review or Delist per product, from key value score, revenue, uniqueness and reach."""
    t = portfolio.join(kvi.select("stockcode", "kvi_score", "total_revenue"), "stockcode", "left").join(kept.select("stockcode", F.lit(True).alias("_k")), "stockcode", "left")
    r = F.col("total_revenue")
    label = (
        F.when((F.col("kvi_score") >= 0.6) | ((r > middle("total_revenue", 0.8)) & (F.col("uniqueness") >= 0.7)), "Keep")
        .when((F.col("reach") >= 0.15) & F.col("_k").isNull() & (F.col("uniqueness") < 0.4), "Add")
        .when((r >= 0.3) & (r <= middle("total_revenue", 0.7)), "Review")
        .otherwise("Delist")
    )
    return t.select("stockcode", "total_revenue", "reach", "uniqueness", "kvi_score", label.alias("decision"))


def delist_waterfall(tx: DataFrame, kvi: DataFrame, kept: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Steps from all revenue: duplicates by name (the best stays), the weak quarter without key items and kept ones, white space."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("r"), F.min(F.lower(F.trim("product"))).alias("name"))
    t = own.join(kvi.select("stockcode", "kvi_score"), "stockcode", "left").join(kept.select("stockcode", F.lit(True).alias("_k")), "stockcode", "left").join(portfolio.select("stockcode", "reach", "uniqueness"), "stockcode", "left")
    again = F.row_number().over(W.partitionBy("name").orderBy(F.desc("r"), "stockcode")) > 1
    weak = (F.col("r") <= middle("r", 0.25)) & F.col("_k").isNull()
    space = (F.col("reach") >= 0.15) & F.col("_k").isNull() & (F.col("uniqueness") < 0.6)
    key = F.coalesce(F.col("kvi_score") >= 0.6, F.lit(False))
    t = t.withColumns({"again": again, "tail": weak & ~key, "key": weak & key, "space": F.coalesce(space, F.lit(False))})
    steps = [("total", F.lit(True)), ("duplicates", F.col("again")), ("tail", F.col("tail")), ("protected", F.col("key")), ("white_space", F.col("space"))]
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.count_if(c).alias("n_products"), F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0)).alias("revenue")) for i, (n, c) in enumerate(steps)]
    return t.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
