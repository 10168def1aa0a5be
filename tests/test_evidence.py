import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.operators import intervals as I
from shelfline.operators import models as N
from shelfline.operators.tree import poisson_weight
from shelfline.sources.lines import star_lines


def test_intervals_hold_their_estimates_and_repeat(spark):
    tx = star_lines(spark, "/root/testdata/sf0.001")
    for build in (lambda: I.switching_intervals(tx, 40), lambda: I.transference_intervals(tx, 10, 40)):
        one, two = ({(r.from_product, r.to_product): r for r in build().collect()} for _ in range(2))
        assert one == two and len(one) >= 10
        # the middle of the draws is near the estimate, so nearly all intervals hold it
        assert np.mean([r.ci_lower <= r.estimate <= r.ci_upper for r in one.values()]) > 0.95
        assert all(r.std_error >= 0 and r.ci_lower >= 0 for r in one.values())


def test_interval_of_a_share_by_hand(spark):
    rows = [(f"c{c}", f"2024-01-{d:02d}", f"{c}-{d}", p) for c in range(60) for d, p in ((1, "a"), (2, "b" if c % 3 else "c"), (3, "a"))]
    tx = spark.createDataFrame(rows, "customer_id string, date string, transaction_id string, stockcode string").withColumns({"date": F.to_timestamp("date"), "price": F.lit(1.0), "quantity": F.lit(1.0)})
    got = {(r.from_product, r.to_product): r for r in I.switching_intervals(tx, 400).collect()}
    r = got["a", "b"]
    assert r.estimate == pytest.approx(2 / 3) and r.std_error == pytest.approx(np.sqrt(2 / 9 / 60), rel=0.2)
    assert r.ci_lower < 2 / 3 < r.ci_upper and got["b", "a"].estimate == 1.0 and got["b", "a"].std_error == pytest.approx(0.0)
    assert I.switching_intervals(tx.limit(0), 5).count() == 0


def test_separated_clusters_are_stable(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (9, 0), (0, 9))]))]
    df = spark.createDataFrame(rows, "customer_id string, x double, y double")
    assert [r.ari for r in N.cluster_stability(df, ["x", "y"], 3, resamples=3).collect()] == pytest.approx([1.0] * 3)


def test_draws_weigh_sums_and_not_rows(spark):
    """The sums of each draw by brute force; moves are neither counted for each customer nor repeated for each draw."""
    tx = star_lines(spark, "/root/testdata/sf0.001")
    seen = {}
    for r in tx.groupBy("customer_id", F.col("stockcode").alias("from_product")).agg(F.sum("quantity").alias("q")).crossJoin(spark.range(0, 6).select(F.col("id").cast("int").alias("draw"))).withColumn("w", F.when(F.col("draw") == 0, 1).otherwise(poisson_weight(42, "customer_id", "draw"))).collect():
        if r.w:
            seen[r.from_product, r.draw] = seen.get((r.from_product, r.draw), 0.0) + r.q * r.w
    sold = tx.select("customer_id", "stockcode", "quantity")
    got = I._drawn_sums(sold, ["from_product"], F.col("quantity"), 5, 42, lambda t: t.select("_w", F.col("stockcode").alias("from_product"), "quantity"))
    assert {(r.from_product, r.draw): r.total for r in got.collect()} == pytest.approx(seen)
    plan = I.switching_intervals(tx, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan and "explode([0,1,2,3,4,5])" not in plan
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert not [k for k in keys if "customer_id" in k and "from_product" in k]
