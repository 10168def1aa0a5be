"""Insights and opportunities on small tables, with the cases that the star tables don't hold."""

from shelfline.operators import opportunities as O


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_cohort_insights(spark):
    sizes = spark.createDataFrame([("2024-01", 100), ("2024-02", 80)], "cohort string, n_customers long")
    kept = spark.createDataFrame([("2024-01", 1, 0.5), ("2024-02", 0, 1.0), ("2024-02", 1, 0.1)], "cohort string, period_index int, retention_rate double")
    assert rows(O.cohort_insights(sizes, kept), "kind", "subject") == [("low_retention", "2024-02"), ("smaller_cohort", "2024-02")]
    assert O.cohort_insights(sizes.limit(0), kept.limit(0)).count() == 0


def test_cohort_opportunities_fill_up_with_other_cohorts(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100)], "cohort string, n_customers long")
    kept = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.7), ("b", 0, 1.0), ("b", 1, 0.6)], "cohort string, period_index int, retention_rate double")
    got = rows(O.cohort_opportunities(sizes, kept, top=3), "subject", "source", "value", "confidence")
    assert got == [("a", "retention", 10.0, "low"), ("b", "retention", 60.0, "medium"), ("b", "size", 100.0, "medium")]
    assert O.cohort_opportunities(sizes.limit(0), kept.limit(0)).count() == 0


def test_basket_opportunities_fill_both_sides(spark):
    p = spark.createDataFrame([("a", 0.9, 0.4), ("b", 0.8, 0.02), ("c", 0.01, 0.3), ("d", 0.02, 0.02), ("e", 0.2, 0.2), ("f", 0.9, 0.001)], "stockcode string, penetration double, revenue_share double")
    got = rows(O.basket_opportunities(p, top=4), "subject", "source")
    assert got == [("a", "traffic_driver"), ("b", "high_penetration"), ("c", "raise_penetration"), ("d", "low_penetration")]
    assert O.basket_opportunities(p.limit(0)).count() == 0


def test_product_opportunities_fill_up_by_revenue(spark):
    r = spark.createDataFrame([("a", 100.0, 9.0, 0.9, "keep"), ("b", 50.0, 1.0, 0.1, "delist_candidate"), ("c", 70.0, 5.0, 0.05, "review")], "stockcode string, revenue double, velocity double, repeat_rate double, action string")
    got = rows(O.product_opportunities(r), "subject", "source", "value")
    assert got == [("a", "sticky", 10.0), ("b", "delist", 50.0), ("b", "slow", 2.5), ("c", "slow", 3.5)]
    assert rows(O.product_opportunities(r.withColumn("velocity", r.velocity * 0 + 1).where("stockcode <> 'b'")), "subject", "source") == [("a", "action"), ("c", "slow")]


def test_switching_insights(spark):
    t = spark.createDataFrame([("a", "b", 10.0), ("b", "a", 4.0), ("a", "c", 1.0)], "from_product string, to_product string, observed_switching_transfer_revenue double")
    sdp = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.0)], "stockcode string, sdp double")
    impact = spark.createDataFrame([("a", -5.0), ("b", 2.0), ("c", 0.0)], "stockcode string, net_revenue_impact double")
    got = rows(O.switching_insights(t, sdp, impact), "kind", "subject", "value", "evidence_level")
    assert got == [("delist_gain", "b", 2.0, 1), ("delist_loss", "a", 5.0, 1), ("growth", "b", 6.0, 1), ("leakage", "a", 7.0, 1), ("substitutable_demand", "products", 1.0, 1), ("unique_demand", "products", 2.0, 1)]


def test_promotions_to_repeat_and_to_stop(spark):
    s = spark.createDataFrame([("a", 10.0, 0.1, "WIN"), ("b", 20.0, 0.2, "WIN"), ("c", -30.0, -1.0, "DESTROYS_VALUE"), ("d", -5.0, -1.0, "DESTROYS_VALUE"), ("e", 1.0, -0.1, "MIXED")], "stockcode string, net_incremental_revenue double, roi double, score string")
    r = spark.createDataFrame([("a", 120.0), ("b", 10.0)], "stockcode string, roi_pct double")
    got = rows(O.promotion_opportunities(s, r, top=2), "subject", "source", "value", "confidence")
    assert got == [("a", "repeat", 10.0, "high"), ("c", "stop", 30.0, "medium")]
    lost = spark.createDataFrame([("a", "x", 7.0, 0.6), ("a", "y", 9.0, 0.4)], "promo_product string, peer_product string, cannibalized_revenue double, cannibalization_index double")
    got = rows(O.promotion_insights(s, r, lost), "kind", "subject", "value")
    assert got == [("best_return", "a", 10.0), ("cannibalization", "a", 7.0), ("score", "DESTROYS_VALUE", 35.0), ("score", "MIXED", 1.0), ("score", "WIN", 30.0)]
