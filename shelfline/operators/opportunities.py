"""Insights and opportunities of cohorts, baskets, products, switching, promotions and prices, from the results of their analyses.

Windows without a partition run over rows that are already one per cohort, product or promotion.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boards import middle
from .insights import insight


def opportunity(df: DataFrame, area: str, source: str | Column, value: Column, confidence: Column | str, subject: str = "stockcode") -> DataFrame:
    """Rows in the common form: area, source, subject, value, confidence."""
    name = F.lit(source) if isinstance(source, str) else source
    trust = F.lit(confidence) if isinstance(confidence, str) else confidence
    subject = F.col(subject).cast("string").alias("subject")
    return df.select(F.lit(area).alias("area"), name.alias("source"), subject, value.cast("double").alias("value"), trust.alias("confidence"))


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def ranked_list(tables: list[DataFrame]) -> DataFrame:
    """All opportunities with their rank by value; each table has a bounded number of rows, as long as it comes from the functions here."""
    return together(tables).withColumn("rank", F.row_number().over(W.orderBy(F.desc("value"), "area", "subject", "source")))


def best(df: DataFrame, top: int) -> DataFrame:
    return df.orderBy(F.desc("value"), "subject", "source").limit(top)


def cohort_insights(sizes: DataFrame, retention: DataFrame, change: float = 0.1, low: float = 0.2) -> DataFrame:
    """Whether the last cohort is smaller or larger than the one before, and whether few of it came back in the next period."""
    w = W.orderBy("cohort")
    last = sizes.select("cohort", (F.col("n_customers") / F.lag("n_customers").over(w) - 1).alias("change")).orderBy(F.desc("cohort")).limit(1)
    fewer, more = last.where(F.col("change") < -change), last.where(F.col("change") > change)
    newest = F.max("cohort").over(W.partitionBy())
    seldom = retention.withColumn("newest", newest).where(F.col("cohort") == F.col("newest")).where((F.col("period_index") == 1) & (F.col("retention_rate") < low))
    out = insight(fewer, "cohort", "smaller_cohort", F.col("cohort"), F.lit("Fewer new customers than in the period before"), F.col("change"), "warning")
    out = out.unionByName(insight(more, "cohort", "larger_cohort", F.col("cohort"), F.lit("More new customers than in the period before"), F.col("change"), "info"))
    return out.unionByName(insight(seldom, "cohort", "low_retention", F.col("cohort"), F.lit("Few new customers came back in the next period"), F.col("retention_rate"), "warning"))


def cohort_opportunities(sizes: DataFrame, retention: DataFrame, strong: float = 0.6, top: int = 10) -> DataFrame:
    """The newest cohort, if many came back or it is among the largest fifth, then periods of other cohorts with high retention.

    The newest cohort counts only once its next period is known. A cohort's own first period has all its customers.
    """
    s = sizes.withColumns({"large": F.percentile("n_customers", F.lit(0.8)).over(W.partitionBy()), "newest": F.max("cohort").over(W.partitionBy())})
    j = retention.join(F.broadcast(s.select("cohort", "n_customers", "large", "newest")), "cohort")
    mine = (F.col("cohort") == F.col("newest")) & (F.col("period_index") == 1)
    kept, big = mine & (F.col("retention_rate") >= strong), mine & (F.col("n_customers") >= F.col("large"))
    j = j.withColumns({"kept": kept, "big": big})
    used = F.max(F.when(F.col("kept") | F.col("big"), F.col("cohort"))).over(W.partitionBy())
    j = j.withColumns({"n": F.sum(F.col("kept").cast("int") + F.col("big").cast("int")).over(W.partitionBy()), "used": used})
    other = (F.col("retention_rate") >= strong) & ~F.col("cohort").eqNullSafe(F.col("used"))
    place = F.row_number().over(W.partitionBy("other").orderBy(F.desc("retention_rate"), "cohort", "period_index"))
    j = j.withColumn("other", other).withColumn("place", place)
    back = F.col("n_customers") * F.col("retention_rate")
    out = opportunity(j.where("kept"), "cohort", "retention", back, "medium", "cohort")
    out = out.unionByName(opportunity(j.where("big"), "cohort", "size", F.col("n_customers"), "medium", "cohort"))
    return best(out.unionByName(opportunity(j.where(F.col("other") & (F.col("place") <= top - F.col("n"))), "cohort", "retention", back, "low", "cohort")), top)


def basket_opportunities(penetration: DataFrame, high: float = 0.5, low: float = 0.05, least: float = 0.01, top: int = 10) -> DataFrame:
    """Products in many baskets (drivers of traffic) and in few, first those with revenue over the median.

    Half of the rows go to each side; what is left over goes to the others, half to the high side, then to the low one.
    """
    side = F.when(F.col("penetration") >= high, "high").when(F.col("penetration") < low, "low")
    t = penetration.where(F.col("revenue_share") >= least).withColumn("mid", middle("revenue_share")).withColumn("side", side).where("side IS NOT NULL")
    t = t.withColumns({"strong": F.col("revenue_share") >= F.col("mid"), "far": F.when(F.col("side") == "high", -F.col("penetration")).otherwise(F.col("penetration"))})
    order = W.partitionBy("side", "strong").orderBy("far", F.desc("revenue_share"), "stockcode")
    t = t.withColumn("chosen", F.col("strong") & (F.row_number().over(order) <= top // 2))
    rest = (F.col("side") == "high") & ~F.col("chosen")
    t = t.withColumns({"left": top - F.count_if("chosen").over(W.partitionBy()), "n_high": F.count_if(rest).over(W.partitionBy())})
    t = t.withColumn("place", F.row_number().over(W.partitionBy("side", "chosen").orderBy("far", "stockcode")))
    half = F.floor(F.col("left") / 2)
    room = F.when(F.col("side") == "high", half).otherwise(F.col("left") - F.least(half, F.col("n_high")))
    t = t.where(F.col("chosen") | (F.col("place") <= room))
    source = F.when(F.col("side") == "high", F.when(F.col("chosen"), "traffic_driver").otherwise("high_penetration"))
    source = source.otherwise(F.when(F.col("chosen"), "raise_penetration").otherwise("low_penetration"))
    return opportunity(t, "basket", source, F.col("revenue_share") * 100, F.when(F.col("chosen"), "medium").otherwise("low"))


#: The part of a product's revenue that each kind of opportunity is worth.
WORTH = {"delist": 1.0, "sticky": 0.1, "slow": 0.05, "action": 0.01}


def product_opportunities(rationalization: DataFrame, top: int = 10) -> DataFrame:
    """Products to delist, fast ones that are bought again, and slow ones; then others by revenue if rows are left."""
    fast, again = F.col("velocity") > middle("velocity"), F.col("repeat_rate") > middle("repeat_rate")
    t = rationalization.withColumns({"delist": F.col("action") == "delist_candidate", "sticky": fast & again, "slow": ~fast & ~again})
    orders = {"delist": [F.desc("revenue")], "sticky": [F.desc("velocity"), F.desc("repeat_rate")], "slow": ["velocity", "repeat_rate"]}
    t = t.withColumns({k: F.col(k) & (F.row_number().over(W.partitionBy(k).orderBy(*o, "stockcode")) <= top // 2) for k, o in orders.items()})
    n = sum((F.col(k).cast("int") for k in orders), F.lit(0))
    t = t.withColumns({"used": n > 0, "left": top - F.sum(n).over(W.partitionBy())})
    t = t.withColumn("action", ~F.col("used") & (F.row_number().over(W.partitionBy("used").orderBy(F.desc("revenue"), "stockcode")) <= F.col("left")))
    kinds = F.array(*[F.when(F.col(k), F.struct(F.lit(k).alias("kind"), (F.col("revenue") * part).alias("v"))) for k, part in WORTH.items()])
    t = t.select("stockcode", F.explode(F.array_compact(kinds)).alias("k"))
    return best(opportunity(t, "product", F.col("k.kind"), F.col("k.v"), F.when(F.col("k.kind") == "action", "low").otherwise("medium")), top)


def switching_insights(transference: DataFrame, sdp: DataFrame, impact: DataFrame, unique: float = 0.2, substitutable: float = 0.8) -> DataFrame:
    """Largest net loser and winner, products with unique and with substitutable demand, and the extremes of delisting; each with the level of evidence (1 to 5)."""
    flow = "observed_switching_transfer_revenue"
    sides = F.array(F.struct(F.col("from_product").alias("p"), (-F.col(flow)).alias("v")), F.struct(F.col("to_product").alias("p"), F.col(flow).alias("v")))
    net = transference.select(F.explode(sides).alias("x")).groupBy("x.p").agg(F.round(F.sum("x.v"), 2).alias("net"), F.count("*").alias("n"))
    # each pair is counted at both of its ends
    facts = net.agg((F.sum("n") / 2).alias("pairs"), F.count("*").alias("products"))
    level = lambda pairs, products: (F.col("pairs") >= pairs) & (F.col("products") >= products)
    level = F.when(level(50, 20), 5).when(level(30, 15), 4).when(level(20, 10), 3).when(level(10, 5), 2).otherwise(1)
    loser, winner = net.where("net < 0").orderBy("net", "p").limit(1), net.where("net > 0").orderBy(F.desc("net"), "p").limit(1)
    rare = sdp.where(F.col("sdp") < unique).agg(F.count("*").alias("n")).where("n > 0")
    easy = sdp.where(F.col("sdp") >= substitutable).agg(F.count("*").alias("n")).where("n > 0")
    i = impact.withColumn("net", F.round("net_revenue_impact", 2))
    worst, gain = i.where("net < 0").orderBy("net", "stockcode").limit(1), i.where("net > 0").orderBy(F.desc("net"), "stockcode").limit(1)
    rows = [
        insight(loser, "switching", "leakage", F.col("p"), F.lit("Loses most revenue by switching"), -F.col("net"), "warning"),
        insight(winner, "switching", "growth", F.col("p"), F.lit("Gains most revenue by switching"), F.col("net"), "info"),
        insight(rare, "switching", "unique_demand", F.lit("products"), F.lit("Demand that no other product would take"), F.col("n"), "warning"),
        insight(easy, "switching", "substitutable_demand", F.lit("products"), F.lit("Demand that other products would take"), F.col("n"), "info"),
        insight(worst, "switching", "delist_loss", F.col("stockcode"), F.lit("Delisting would lose most"), -F.col("net"), "warning"),
        insight(gain, "switching", "delist_gain", F.col("stockcode"), F.lit("Delisting would lose nothing"), F.col("net"), "info"),
    ]
    return together(rows).crossJoin(F.broadcast(facts.select(level.alias("evidence_level"))))


def product_roi(roi: DataFrame) -> DataFrame:
    """Return of all of a product's promotions, from that of each."""
    t = roi.groupBy("stockcode").agg(F.sum("incremental_profit").alias("p"), F.sum("promo_cost").alias("c"))
    return t.select("stockcode", F.when(F.col("c") > 0, F.round(F.col("p") / F.col("c") * 100, 6)).otherwise(0.0).alias("roi_pct"))


#: Kind of insight for each score of a promotion.
SCORES = {"WIN": "opportunity", "MIXED": "efficiency", "INEFFECTIVE": "leakage", "DESTROYS_VALUE": "risk"}


def promotion_insights(scores: DataFrame, roi: DataFrame, cannibalized: DataFrame, min_roi: float = 50.0, index: float = 0.5) -> DataFrame:
    """Net revenue by score, the product with the best return over min_roi, and the pair that loses most to a promotion."""
    g = scores.groupBy("score").agg(F.sum("net_incremental_revenue").alias("net"))
    kind = F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair])[F.col("score")]
    top = roi.join(scores, "stockcode").where(F.col("roi_pct") >= min_roi).orderBy(F.desc("roi_pct"), "stockcode").limit(1)
    t = cannibalized.where(F.col("cannibalization_index") >= index).withColumn("lost", F.round("cannibalized_revenue", 2))
    t = t.orderBy(F.desc("lost"), "promo_product", "peer_product").limit(1)
    out = insight(g.withColumn("kind", kind), "promotion", "score", F.col("score"), F.col("kind"), F.abs("net"), "info")
    out = out.unionByName(insight(top, "promotion", "best_return", F.col("stockcode"), F.lit("Best return of all promotions"), F.col("net_incremental_revenue"), "info"))
    return out.unionByName(insight(t, "promotion", "cannibalization", F.col("promo_product"), F.concat(F.lit("Takes most from "), "peer_product"), F.col("lost"), "warning"))


def promotion_opportunities(scores: DataFrame, roi: DataFrame, top: int = 10, min_roi: float = 50.0) -> DataFrame:
    """Promotions to repeat: the wins with the best returns, if over min_roi. Then promotions to stop: those that destroy most value."""
    t = scores.join(roi, "stockcode", "left").fillna(0.0, ["roi_pct"]).where(F.col("score").isin("WIN", "DESTROYS_VALUE"))
    order = F.when(F.col("score") == "WIN", -F.col("roi_pct")).otherwise(F.col("net_incremental_revenue"))
    t = t.withColumn("place", F.row_number().over(W.partitionBy("score").orderBy(order, "stockcode")))
    scale = (F.col("score") == "WIN") & (F.col("place") <= top) & (F.col("roi_pct") >= min_roi)
    t = t.withColumn("scale", scale).withColumn("n", F.count_if("scale").over(W.partitionBy()))
    t = t.where(F.col("scale") | ((F.col("score") != "WIN") & (F.col("place") <= top - F.col("n"))))
    trust = F.when(F.col("scale") & (F.col("roi_pct") >= 2 * min_roi), "high").otherwise("medium")
    return opportunity(t, "promotion", F.when(F.col("scale"), "repeat").otherwise("stop"), F.abs("net_incremental_revenue"), trust)


def pricing_opportunities(decisions: DataFrame, cut: float = 0.05, top: int = 5) -> DataFrame:
    """The products with most revenue of each decision; a price lever is worth what a small price cut would add."""
    t = decisions.where(F.col("decision").isin("invest", "protect", "price_lever")).withColumn("r", F.round("total_revenue", 2))
    place = F.row_number().over(W.partitionBy("decision").orderBy(F.desc("r"), "stockcode"))
    t = t.withColumn("place", place).where(F.col("place") <= top)
    gain = F.greatest(F.lit(0.0), F.col("r") * ((1 + F.col("abs_elasticity") * cut) * (1 - cut) - 1))
    value = F.when(F.col("decision") != "price_lever", F.col("r")).when(F.col("abs_elasticity") > 1, gain).otherwise(0.0)
    return opportunity(t, "pricing", F.col("decision"), value, "medium")
