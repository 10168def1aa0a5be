"""Boards of decisions: risk of opportunities, the funnel, the action queue and priorities; strategy of categories; rules between categories; what data is good for.

Tables of opportunities and insights have a bounded number of rows, as their analyses make reports of a fixed length.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.scalar import revenue
from .insights import insight
from .opportunities import opportunity

#: Risk by confidence, and what a value counts for by confidence.
RISK = {"high": 0.2, "medium": 0.6}
TRUST = {"high": 1.0, "medium": 0.7, "low": 0.4, "insufficient": 0.2}
#: Next step by price decision.
NEXT_STEP = {"invest": "Implement recommended price change", "protect": "Maintain current strategy", "price_lever": "Test price decrease", "review": "Collect more evidence", "monitor": "Monitor ongoing"}
#: What each analysis wants beyond the least of all (baskets, customers, products).
NEEDS = {
    "clv": (1000, 500, 0), "assortment": (500, 0, 20), "promo": (500, 0, 0), "segmentation": (500, 200, 0), "cdt": (1000, 0, 50), "rules": (200, 0, 20), "switching": (500, 100, 0), "elasticity": (500, 0, 0),
}
LEVELS = ["insufficient", "low", "medium", "high"]


def _case(c: str, names: dict, other):
    out = None
    for k, v in names.items():
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    return out.otherwise(other)


def opportunity_risk(listed: DataFrame) -> DataFrame:
    """Each opportunity with risk_level (by confidence), opp_value (share of the largest value) and quadrant."""
    t = listed.withColumns({"risk_level": _case("confidence", RISK, 1.0), "opp_value": F.least(F.lit(1.0), F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(W.partitionBy())))})
    worth, risky = F.col("opp_value") >= 0.5, F.col("risk_level") >= 0.5
    quadrant = F.when(worth & ~risky, "do_now").when(worth, "test_first").when(risky, "watch").otherwise("quick_win")
    return t.select("area", "source", "subject", "value", "confidence", "risk_level", "opp_value", quadrant.alias("quadrant"))


def portfolio_funnel(listed: DataFrame, insights: DataFrame) -> DataFrame:
    """stage, n, share of all signals: signals, subjects that an analysis looked at, opportunities with high confidence, opportunities, the quarter of largest value."""
    subjects = listed.select("subject").union(insights.select("subject")).distinct().agg(F.count("*").alias("analysed"))
    n = listed.agg(F.count("*").alias("found"), F.count_if(F.col("confidence") == "high").alias("sure"))
    t = n.crossJoin(insights.agg(F.count("*").alias("seen"))).crossJoin(subjects)
    total = F.col("found") + F.col("seen")
    top = F.when(F.col("found") > 0, F.greatest(F.lit(1), F.floor(F.col("found") / 4))).otherwise(0)
    stages = [("signals", total), ("analysed", F.col("analysed")), ("evidence_sufficient", F.col("sure")), ("opportunities", F.col("found")), ("high_priority", top)]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(s).alias("stage"), c.cast("long").alias("n"), F.when(total > 0, F.least(F.lit(1.0), c / total)).otherwise(0.0).alias("share")) for i, (s, c) in enumerate(stages)])
    return t.select(F.explode(rows).alias("x")).select("x.*")


def action_queue(listed: DataFrame, categories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Opportunities in the order of work: place, priority (by value and confidence), subject, category, area, value, confidence, next_action.

    The next action is that of the subject's price decision, or else the opportunity's source. Subjects that are no product have no category.
    """
    t = listed.join(categories.select(F.col("stockcode").alias("subject"), "category"), "subject", "left").join(decisions.select(F.col("stockcode").alias("subject"), "decision"), "subject", "left")
    priority = F.when((F.col("value") > 0) & (F.col("confidence") == "high"), "High").when((F.col("value") > 0) & (F.col("confidence") == "medium"), "Medium").otherwise("Low")
    t = t.withColumns({"priority": priority, "next_action": _case("decision", NEXT_STEP, F.col("source"))})
    order = W.orderBy(_case("priority", {"High": 0, "Medium": 1}, 2), F.desc("value"), "area", "subject", "source")
    return t.select(F.row_number().over(order).alias("place"), "priority", "subject", "category", "area", "value", "confidence", "next_action")


def priorities(listed: DataFrame, insights: DataFrame, top: int = 5) -> DataFrame:
    """The first opportunities and insights by score: value times confidence, a fifth more at most for opportunities of a rare area, half for insights (of medium confidence)."""
    rare = 1 + (1 - F.count("*").over(W.partitionBy("area")) / F.count("*").over(W.partitionBy())) * 0.2
    o = listed.select(F.lit("opportunity").alias("type"), "area", "subject", "source", "value", (F.col("value") * _case("confidence", TRUST, 0.7) * rare).alias("score"))
    i = insights.select(F.lit("insight").alias("type"), "area", "subject", F.col("kind").alias("source"), "value", (F.coalesce("value", F.lit(0.0)) * 0.5 * TRUST["medium"]).alias("score"))
    t = o.unionByName(i).withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("score", 4)), "type", "area", "subject", "source")))
    return t.where(F.col("place") <= top)


def strategy_scorecard(scorecard: DataFrame, roles: DataFrame, efficiency: DataFrame, reach: DataFrame, decisions: DataFrame, returns: DataFrame, switching: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per category: role, revenue, growth, customer_reach (%), price_position, promo_roi, assortment_health, switching_risk, customer_value.

    Price position and switching risk are those of the category's products with most revenue behind them (ties to the name that sorts first); the return of
    promotions is the mean over its products with promotions, 0 without any.
    """
    position = _case("decision", {"invest": "premium", "protect": "stable", "price_lever": "competitive"}, "review")
    by = lambda t, name, value: t.groupBy("category", value.alias("v")).agg(F.round(F.sum("total_revenue"), 2).alias("r")).groupBy("category").agg(F.min(F.struct(-F.col("r"), "v"))["v"].alias(name))
    priced = by(decisions.select("category", "decision", "total_revenue"), "price_position", position)
    risk = _case("switching_status", {"no_switching_observed": "low", "estimated": "medium", "insufficient_observations": "medium"}, "high")
    own = decisions.select("stockcode", "category", "total_revenue")
    moved = by(own.join(switching.select("stockcode", "switching_status"), "stockcode"), "switching_risk", risk)
    promo = returns.join(categories, "stockcode").groupBy("category").agg(F.avg("roi_pct").alias("promo_roi"))
    t = scorecard.join(roles.select("category", "role"), "category", "left").join(efficiency.select("category", F.col("efficiency_label").alias("assortment_health")), "category", "left").join(reach.select("category", "reach"), "category", "left")
    t = t.join(priced, "category", "left").join(moved, "category", "left").join(promo, "category", "left")
    worth = F.col("repeat_purchase_rate") * F.least(F.col("total_revenue") / 1000, F.lit(100.0))
    return t.select(
        "category", F.coalesce("role", F.lit("Routine")).alias("role"), F.col("total_revenue").alias("revenue"), F.coalesce("revenue_yoy_growth", F.lit(0.0)).alias("growth"), (F.coalesce("reach", "basket_penetration") * 100).alias("customer_reach"),
        F.coalesce("price_position", F.lit("review")).alias("price_position"), F.coalesce("promo_roi", F.lit(0.0)).alias("promo_roi"), F.coalesce("assortment_health", F.lit("balanced")).alias("assortment_health"), F.coalesce("switching_risk", F.lit("unknown")).alias("switching_risk"), worth.alias("customer_value"),
    )


def category_rules(rules: DataFrame, tx: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules by the categories of their sides: rule_count, mean support, confidence and lift, max_lift, and avg_lift of the categories' own baskets.

    A side's name joins the categories of its products, sorted, as often as they occur. The lift of categories is that of baskets
    that hold all of a side's categories; 1 where a side is in no basket.
    """
    side = lambda t, c: t.select("_r", F.explode(c).alias("stockcode")).join(categories, "stockcode", "left").groupBy("_r").agg(F.array_sort(F.collect_list(F.coalesce("category", F.lit("Unknown")))).alias(f"{c}_s"))
    r = rules.withColumn("_r", F.concat(F.array_join("antecedents", "|"), F.lit(">"), F.array_join("consequents", "|")))
    r = r.join(side(r, "antecedents"), "_r").join(side(r, "consequents"), "_r")
    names = {"antecedent_category": F.array_join("antecedents_s", " + "), "consequent_category": F.array_join("consequents_s", " + ")}
    g = r.withColumns(names).groupBy("antecedents_s", "consequents_s", *names).agg(F.count("*").alias("rule_count"), F.avg("support").alias("support"), F.avg("confidence").alias("confidence"), F.avg("lift").alias("lift"), F.max("lift").alias("max_lift"))
    # a basket is its set of categories, so baskets meet the sides as counted sets
    baskets = tx.select("transaction_id", "stockcode").distinct().join(categories, "stockcode").groupBy("transaction_id").agg(F.array_sort(F.collect_set("category")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    total = baskets.agg(F.sum("n").alias("total"))
    one = g.select("antecedents_s", "consequents_s", F.col("antecedents_s")[0].alias("first")).unionByName(g.select("antecedents_s", "consequents_s", F.col("consequents_s")[0].alias("first"))).distinct()
    holds = lambda c: F.size(F.array_except(c, "s")) == 0
    met = one.join(baskets.withColumn("first", F.explode("s")), "first").select("antecedents_s", "consequents_s", "s", "n").distinct()
    met = met.groupBy("antecedents_s", "consequents_s").agg(F.sum(F.when(holds("antecedents_s"), F.col("n"))).alias("a"), F.sum(F.when(holds("consequents_s"), F.col("n"))).alias("c"), F.coalesce(F.sum(F.when(holds("antecedents_s") & holds("consequents_s"), F.col("n"))), F.lit(0)).alias("ac"))
    t = g.join(met, ["antecedents_s", "consequents_s"], "left").crossJoin(F.broadcast(total))
    lift = F.when((F.col("a") > 0) & (F.col("c") > 0), F.col("ac") * F.col("total") / (F.col("a") * F.col("c"))).otherwise(1.0)
    return t.select("antecedent_category", "consequent_category", "rule_count", "support", "confidence", "lift", lift.alias("avg_lift"), "max_lift")


def eligibility(tx: DataFrame, min_baskets: int = 100, min_customers: int = 50, min_products: int = 10) -> DataFrame:
    """For each analysis: is_eligible (the least of all analyses is there), what blocks it, what it has too little of, and the least it wants."""
    n = tx.agg(F.countDistinct("transaction_id").alias("baskets"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("stockcode").alias("products"))
    least = {"baskets": min_baskets, "customers": min_customers, "products": min_products}
    rows = F.array(*[F.struct(F.lit(a).alias("analysis"), *[F.lit(v).alias(f"want_{c}") for c, v in zip(least, want, strict=True)]) for a, want in NEEDS.items()])
    t = n.withColumn("x", F.explode(rows)).select("baskets", "customers", "products", "x.*")
    short = lambda bound: F.array_join(F.filter(F.array(*[F.when(F.col(c) < bound(c), c) for c in least]), lambda x: x.isNotNull()), ",")
    return t.select(
        "analysis", (short(lambda c: F.lit(least[c])) == "").alias("is_eligible"), short(lambda c: F.lit(least[c])).alias("blocked_by"), short(lambda c: F.col(f"want_{c}")).alias("low_on"),
        *[F.greatest(F.lit(v), F.col(f"want_{c}")).alias(f"min_{c}") for c, v in least.items()],
    )


def by_reliability(df: DataFrame, level: str = "medium", column: str = "reliability") -> DataFrame:
    """Rows whose reliability is at least the level; null and unknown levels count as insufficient."""
    if level not in LEVELS:
        raise ValueError(f"level has to be one of {', '.join(LEVELS)}")
    return df.where(_case(column, {name: i for i, name in enumerate(LEVELS)}, 0) >= LEVELS.index(level))


def pricing_insights(status: DataFrame, kvi: DataFrame, decisions: DataFrame) -> DataFrame:
    """How many products' elasticity can be told and the revenue they cover, weak estimates, large sellers without one, prices that vary too little, and each price decision's revenue."""
    s = status.join(kvi.select("stockcode", "total_revenue"), "stockcode", "left").withColumn("r", F.coalesce("total_revenue", F.lit(0.0)))
    edge = F.broadcast(kvi.agg(F.percentile("total_revenue", 0.75).alias("edge")))
    usable, flat = F.col("elasticity_status").isin("estimated", "weak"), F.col("elasticity_status").isin("insufficient_variation", "insufficient_price_points")
    weak, large = F.col("elasticity_status") == "weak", ~usable & (F.col("r") >= F.col("edge"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0))
    t = s.crossJoin(edge).agg(F.count("*").alias("n"), F.count_if(usable).alias("k"), of(usable).alias("covered"), of(~usable).alias("open"), F.count_if(weak).alias("weak"), of(weak).alias("weak_r"), F.count_if(large).alias("large"), of(large).alias("large_r"), F.count_if(flat).alias("flat"), of(flat).alias("flat_r")).where("n > 0")
    low = F.col("k") / F.col("n") < 0.5
    text = F.lit
    out = insight(t.where(low), "pricing", "coverage", text("products"), text("Few products have an elasticity that can be used"), F.col("open"), "warning")
    out = out.unionByName(insight(t.where(~low), "pricing", "coverage", text("products"), text("Most products have an elasticity that can be used"), F.col("covered"), "info"))
    out = out.unionByName(insight(t.where("weak > 0"), "pricing", "weak_estimates", F.col("weak"), text("Revenue under estimates that are not sure"), F.col("weak_r"), "info"))
    out = out.unionByName(insight(t.where("large > 0 AND large_r > 0"), "pricing", "large_without_estimate", F.col("large"), text("Revenue of large sellers without an estimate"), F.col("large_r"), "warning"))
    out = out.unionByName(insight(t.where("flat > 0"), "pricing", "flat_prices", F.col("flat"), text("Prices vary too little to learn from"), F.col("flat_r"), "info"))
    d = decisions.where(F.col("decision").isin("invest", "protect", "price_lever", "review")).groupBy("decision").agg(F.sum("total_revenue").alias("r"))
    return out.unionByName(insight(d, "pricing", "decision", F.col("decision"), text("Revenue under this decision"), F.col("r"), "info"))


def customer_insights(clv: DataFrame, risk: float = 0.5, top: int = 5, concentrated: float = 0.5) -> DataFrame:
    """Value of the first customers who are likely gone, and whether the tenth with most value holds most of it."""
    gone = clv.where(F.col("p_alive") < risk).orderBy(F.desc("predicted_clv"), "customer_id").limit(top).agg(F.sum("predicted_clv").alias("v")).where("v IS NOT NULL")
    r = ranked(clv.select("customer_id", (-F.coalesce("predicted_clv", F.lit(0.0))).alias("minus")), "minus", "customer_id")
    share = r.agg((F.sum(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.col("minus"))) / F.sum("minus")).alias("v")).where("v IS NOT NULL")
    out = insight(gone, "customer", "at_risk", F.lit("customers"), F.lit("Value of the first customers who are likely gone"), F.col("v"), "warning")
    out = out.unionByName(insight(share.where(F.col("v") >= concentrated), "customer", "concentrated", F.lit("first tenth"), F.lit("Few customers hold most of the expected value"), F.col("v"), "warning"))
    return out.unionByName(insight(share.where(F.col("v") < concentrated), "customer", "spread", F.lit("first tenth"), F.lit("The expected value is spread over customers"), F.col("v"), "info"))


def best_scenario(scenarios: DataFrame) -> DataFrame:
    """The scenario with most revenue kept and recovered (ties to the smaller id)."""
    return scenarios.withColumn("expected_revenue", F.col("kept_revenue") + F.col("recovered_revenue")).orderBy(F.desc(F.round("expected_revenue", 4)), "scenario_id").limit(1)


def assortment_insights(scenarios: DataFrame, solution: DataFrame, deep: float = 0.3) -> DataFrame:
    """What the best scenario brings, how deep its cut is and what it leaves unmet, and the revenue of the chosen solution."""
    b = best_scenario(scenarios)
    total = F.col("kept_revenue") + F.col("recovered_revenue") + F.col("unmet_revenue")
    b = b.withColumn("cut", F.when(total > 0, 1 - F.col("kept_revenue") / total).otherwise(0.0))
    out = insight(b, "assortment", "best_scenario", F.col("n_skus"), F.lit("Expected revenue of the best scenario"), F.col("expected_revenue"), "info")
    out = out.unionByName(insight(b.where(F.col("cut") > deep), "assortment", "deep_cut", F.col("n_skus"), F.lit("A deep cut leaves demand unmet"), F.col("unmet_revenue"), "warning"))
    out = out.unionByName(insight(b.where(F.col("cut") <= deep), "assortment", "shallow_cut", F.col("n_skus"), F.lit("Most revenue is in what is kept"), F.col("unmet_revenue"), "info"))
    s = solution.agg(F.count("*").alias("n"), F.sum("revenue").alias("r")).where("n > 0")
    return out.unionByName(insight(s, "assortment", "solution", F.col("n"), F.lit("Revenue of the chosen solution"), F.col("r"), "info"))


def assortment_opportunities(scenarios: DataFrame, solution: DataFrame, top: int = 10) -> DataFrame:
    """What the best scenario recovers by switching, then the products of the solution with most revenue."""
    b = best_scenario(scenarios).withColumn("scenario", F.lit("best scenario"))
    out = opportunity(b, "assortment", "scenario", F.col("recovered_revenue"), "medium", "scenario")
    return out.unionByName(opportunity(solution.orderBy(F.desc(F.round("revenue", 2)), "stockcode").limit(top), "assortment", "solution", F.col("revenue"), "medium"))


def category_reach(tx: DataFrame) -> DataFrame:
    """Share of customers who bought from each category."""
    total = F.broadcast(tx.agg(F.countDistinct("customer_id").alias("_n")))
    return tx.groupBy("category").agg(F.countDistinct("customer_id").alias("_k"), F.sum(revenue()).alias("total_revenue")).crossJoin(total).select("category", (F.col("_k") / F.col("_n")).alias("reach"), "total_revenue")
