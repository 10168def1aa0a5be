"""Switching between products in consecutive baskets, and the demand that moves with it."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import revenue, safe_divide


def customer_sequences(tx: DataFrame, window_days: int = 90, min_transactions: int = 3) -> DataFrame:
    """Baskets in order with the one before, where the gap fits the window; customers with enough of them.

    Order is by date, then basket id. A basket's date is its earliest line's.
    """
    baskets = tx.groupBy("customer_id", "transaction_id").agg(F.min("date").alias("date"), F.array_sort(F.collect_set("stockcode")).alias("products"))
    w = W.partitionBy("customer_id").orderBy("date", "transaction_id")
    step = baskets.withColumns({"prev_products": F.lag("products").over(w), "prev_date": F.lag("date").over(w)})
    gap = F.floor((F.unix_timestamp("date") - F.unix_timestamp("prev_date")) / 86400).cast("int")
    step = step.where(F.col("prev_products").isNotNull()).withColumn("gap_days", gap).where(F.col("gap_days") <= window_days)
    return step.withColumn("_n", F.count("*").over(W.partitionBy("customer_id"))).where(F.col("_n") >= min_transactions - 1).drop("_n")


def switching_matrix(tx: DataFrame, window_days: int = 90, min_transactions: int = 3) -> DataFrame:
    """Counts of product to another product between consecutive baskets, and their share of the first's."""
    seq = customer_sequences(tx, window_days, min_transactions)
    moves = seq.select(F.explode("prev_products").alias("from_product"), "products").select("from_product", F.explode("products").alias("to_product")).where("from_product <> to_product")
    n = moves.groupBy("from_product", "to_product").agg(F.count("*").alias("count"))
    return n.withColumn("pct", F.col("count") / F.sum("count").over(W.partitionBy("from_product")))


def category_switching(tx: DataFrame, lookup: DataFrame, **how) -> DataFrame:
    """Switching by category of both sides, with the number of product pairs and the share of all switches."""
    m = switching_matrix(tx, **how)
    side = lambda s: lookup.select(F.col("stockcode").alias(f"{s}_product"), F.col("category").alias(f"{s}_category"))
    m = m.join(side("from"), "from_product", "left").join(side("to"), "to_product", "left").fillna("Unknown", ["from_category", "to_category"])
    own = m.groupBy("from_category", "to_category").agg(F.sum("count").alias("count"), F.count("*").alias("product_pairs"))
    return own.withColumn("pct", F.col("count") / F.sum("count").over(W.partitionBy()))


def top_switching_paths(tx: DataFrame, n: int = 20, **how) -> DataFrame:
    return switching_matrix(tx, **how).orderBy(F.desc("count"), "from_product", "to_product").limit(n)


def loyalty_metrics(tx: DataFrame) -> DataFrame:
    """Per customer: baskets, mean number of products in one, share of products bought again, and changed baskets."""
    baskets = tx.groupBy("customer_id", "transaction_id").agg(F.countDistinct("stockcode").alias("k"))
    one = baskets.groupBy("customer_id").agg(F.count("*").alias("n_transactions"), F.avg("k").alias("avg_basket_size"))
    lines = tx.groupBy("customer_id", "stockcode").agg(F.count("*").alias("n"))
    two = lines.groupBy("customer_id").agg((F.count_if(F.col("n") > 1) / F.count("*")).alias("repeat_purchase_rate"), F.count("*").alias("n_distinct_products"))
    changed = customer_sequences(tx, 90, 2).where(F.col("products") != F.col("prev_products")).groupBy("customer_id").agg(F.count("*").alias("switching_count"))
    t = one.join(two, "customer_id").join(changed, "customer_id", "left").fillna(0, ["switching_count"])
    return t.withColumn("switching_rate", F.least(F.lit(1.0), safe_divide(F.col("switching_count"), F.col("n_transactions") - 1)))


def in_out_rates(matrix: DataFrame, tx: DataFrame) -> DataFrame:
    """Products switched to and from, over the customers of each product."""
    customers = tx.groupBy("stockcode").agg(F.countDistinct("customer_id").alias("c"))
    out = matrix.groupBy(F.col("from_product").alias("stockcode")).agg(F.count("*").alias("n_switchers_out"))
    into = matrix.groupBy(F.col("to_product").alias("stockcode")).agg(F.count("*").alias("n_switchers_in"))
    t = customers.join(out, "stockcode", "full").join(into, "stockcode", "full").fillna(0, ["c", "n_switchers_out", "n_switchers_in"])
    rate = lambda c: safe_divide(F.col(c), F.col("c"))
    t = t.withColumns({"switch_out_rate": rate("n_switchers_out"), "switch_in_rate": rate("n_switchers_in")})
    return t.select("stockcode", "switch_out_rate", "switch_in_rate", (F.col("switch_in_rate") - F.col("switch_out_rate")).alias("net_rate"), "n_switchers_out", "n_switchers_in")


def demand_transference(tx: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """Switch share times the revenue, and revenue share, of the product left."""
    own = tx.groupBy(F.col("stockcode").alias("from_product")).agg(F.sum(revenue()).alias("r")).withColumn("s", F.col("r") / F.sum("r").over(W.partitionBy()))
    m = (matrix if matrix is not None else switching_matrix(tx)).join(own, "from_product", "left").fillna(0.0, ["r", "s"])
    return m.select("from_product", "to_product", F.col("pct").alias("switch_rate"), F.col("s").alias("revenue_share_from"), (F.col("pct") * F.col("s")).alias("observed_switching_transference"), (F.col("pct") * F.col("r")).alias("observed_switching_transfer_revenue"))


def substitutable_demand(transference: DataFrame, tx: DataFrame) -> DataFrame:
    """Share of a product's revenue that its substitutes would take, at most 1."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("r"))
    got = transference.groupBy(F.col("from_product").alias("stockcode")).agg(F.sum("observed_switching_transfer_revenue").alias("t"))
    return own.join(got, "stockcode", "left").select("stockcode", F.least(F.lit(1.0), F.coalesce(safe_divide(F.col("t"), F.col("r")), F.lit(0.0))).alias("sdp"))


def recovery_hhi(transference: DataFrame) -> DataFrame:
    """Concentration of what each product's substitutes would take, and the largest of them."""
    share = F.col("observed_switching_transfer_revenue") / F.sum("observed_switching_transfer_revenue").over(W.partitionBy("from_product"))
    t = transference.withColumn("s", share)
    return t.groupBy("from_product").agg(F.sum(F.col("s") * F.col("s")).alias("recovery_hhi"), F.count("*").alias("n_substitutes"), F.min(F.struct((-F.col("s")).alias("m"), "to_product"))["to_product"].alias("top_substitute"), F.max("s").alias("top_share"))


def delist_impact(tx: DataFrame, transference: DataFrame, delisted: DataFrame) -> DataFrame:
    """Own revenue, what would be recovered, and the net, of each product in delisted (stockcode)."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("product_revenue"))
    got = transference.groupBy(F.col("from_product").alias("stockcode")).agg(F.sum("observed_switching_transfer_revenue").alias("estimated_revenue_recovered"))
    t = delisted.join(own, "stockcode", "left").join(got, "stockcode", "left").fillna(0.0)
    net = F.col("estimated_revenue_recovered") - F.col("product_revenue")
    return t.select("stockcode", "product_revenue", "estimated_revenue_recovered", net.alias("net_revenue_impact"), F.when(F.col("product_revenue") > 0, F.col("estimated_revenue_recovered") / F.col("product_revenue")).alias("recovery_rate"))


def node_delist_impact(tx: DataFrame, transference: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster (stockcode, node_id): revenue, what stays inside and what leaves if its products go."""
    own = tx.groupBy("stockcode").agg(F.sum(revenue()).alias("r"))
    nodes = clusters.join(own, "stockcode", "left").groupBy("node_id").agg(F.count("*").alias("n_products"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("total_node_revenue"))
    side = lambda s: clusters.select(F.col("stockcode").alias(f"{s}_product"), F.col("node_id").alias(f"{s}_node"))
    t = transference.join(side("from"), "from_product").join(side("to"), "to_product", "left")
    inside = F.col("from_node").eqNullSafe(F.col("to_node"))
    take = lambda c: F.sum(F.when(c, F.col("observed_switching_transfer_revenue")).otherwise(0.0))
    flow = t.groupBy(F.col("from_node").alias("node_id")).agg(take(inside).alias("internal_recovery"), take(~inside).alias("external_leakage"))
    out = nodes.join(flow, "node_id", "left").fillna(0.0)
    return out.withColumn("node_sdp", F.when(F.col("total_node_revenue") > 0, F.col("internal_recovery") / F.col("total_node_revenue")))


def event_slices(tx: DataFrame, events: DataFrame, pre_days: int = 30, post_days: int = 30) -> DataFrame:
    """Lines in the days before, during and after each event (start_date, end_date), with `phase`; a line once per phase."""
    day = lambda c, n: F.date_add(F.to_date(c), n)
    spans = events.select(F.explode(F.array(
        F.struct(F.lit("pre").alias("phase"), day("start_date", -pre_days).alias("_a"), day("start_date", -1).alias("_b")),
        F.struct(F.lit("event").alias("phase"), day("start_date", 0).alias("_a"), day("end_date", 0).alias("_b")),
        F.struct(F.lit("post").alias("phase"), day("end_date", 1).alias("_a"), day("end_date", post_days).alias("_b")),
    )).alias("s")).select("s.*")
    # spans become days, so that the join is on equal days and a day meets each phase once
    days = spans.select("phase", F.explode(F.sequence("_a", "_b")).alias("_d")).distinct()
    return tx.withColumn("_d", F.to_date("date")).join(days, "_d").drop("_d")


def switching_by_phase(tx: DataFrame, events: DataFrame, lookup: DataFrame, **how) -> DataFrame:
    """Category switching within each phase of the events."""
    out = None
    for phase in ("pre", "event", "post"):
        own = category_switching(event_slices(tx, events).where(F.col("phase") == phase).drop("phase"), lookup, **how).withColumn("phase", F.lit(phase))
        out = own if out is None else out.unionByName(own)
    return out


#: Switch rate and revenue share of strong and moderate substitution.
STRONG, MODERATE = (0.3, 0.1), (0.15, 0.05)


def substitution_strength(transference: DataFrame, sdp: DataFrame, tx: DataFrame) -> DataFrame:
    """Each pair's switching as substitution, movement (most demand is substitutable) or loyalty (hardly any is), with strength and confidence."""
    own = tx.groupBy(F.col("stockcode").alias("from_product")).agg(F.sum(revenue()).alias("_r"))
    t = transference.join(own, "from_product", "left").join(sdp.select(F.col("stockcode").alias("from_product"), "sdp"), "from_product", "left").fillna(0.5, ["sdp"])
    risk = F.col("observed_switching_transfer_revenue")
    # rounded, so that shares on a threshold stay there
    share, rate, sdp_ = F.round(safe_divide(risk, F.col("_r")), 9), F.round("switch_rate", 9), F.round("sdp", 9)
    strength = F.when((rate >= STRONG[0]) & (share >= STRONG[1]), "strong").when((rate >= MODERATE[0]) & (share >= MODERATE[1]), "moderate").otherwise("weak")
    t = t.withColumn("substitution_strength", strength)
    firm = F.col("substitution_strength") != "weak"
    kind = F.when(firm & (share >= 0.1), "substitution").when(~firm & (sdp_ >= 0.8), "movement").when((share < 0.05) & (sdp_ < 0.2), "loyalty").otherwise("insufficient_evidence")
    sure = F.when((F.col("substitution_strength") == "strong") & (share >= 0.15), "high").when((F.col("substitution_strength") == "moderate") & (share >= 0.05), "medium").otherwise("low")
    return t.select("from_product", "to_product", "switch_rate", risk.alias("revenue_at_risk"), "substitution_strength", kind.alias("classification"), sure.alias("confidence"))


def switching_opportunities(substitution: DataFrame, high_value: DataFrame, impact: DataFrame, top: int = 10) -> DataFrame:
    """The first opportunities of switching: protect, steal_share, consolidate or delist_candidate, in that order, then by revenue at risk.

    high_value is a switching matrix of customers of high value; impact has net_revenue_impact per product.
    """
    t = substitution.join(high_value.select("from_product", "to_product", F.col("count").alias("_hv")), ["from_product", "to_product"], "left")
    t = t.join(impact.select(F.col("stockcode").alias("from_product"), F.col("net_revenue_impact").alias("_net")), "from_product", "left").fillna(0, ["_hv"])
    firm = (F.col("classification") == "substitution") & (F.col("substitution_strength") != "weak")
    kind = F.when(firm & (F.col("_hv") > 0), "protect").when(firm, "consolidate").when(F.col("classification") == "movement", "steal_share").when((F.col("classification") != "loyalty") & (F.round("_net", 6) > 0), "delist_candidate").otherwise("protect")
    t = t.withColumn("opportunity_type", kind).withColumn("_o", F.expr("CASE opportunity_type WHEN 'protect' THEN 0 WHEN 'steal_share' THEN 2 WHEN 'consolidate' THEN 3 ELSE 4 END"))
    first = t.orderBy("_o", F.desc(F.round("revenue_at_risk", 4)), "from_product", "to_product").limit(top)
    return first.select("from_product", "to_product", "opportunity_type", "revenue_at_risk", F.col("_hv").alias("high_value_switches"), "confidence")
