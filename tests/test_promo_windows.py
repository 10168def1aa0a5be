"""Promotions meet the lines of their days, and the results are those of all pairs of a promotion and a line."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfline.operators import promo as M


def made(spark):
    rng = random.Random(5)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    # a basket may hold lines of two days, and lines without a basket
    lines = [(day(rng.randrange(90)), rng.choice([None, *(f"t{i}" for i in range(60))]), rng.choice("abc"), rng.choice("uv"), float(rng.randrange(1, 9)), float(rng.randrange(1, 4))) for _ in range(600)]
    promos = [(p, day(a), day(a + n)) for p, a, n in (("a", 20, 4), ("a", 30, 2), ("b", 40, 10), ("c", 0, 3), ("z", 9, 3))]
    tx = spark.createDataFrame(lines, "date date, transaction_id string, stockcode string, customer_id string, price double, quantity double").withColumn("date", F.to_timestamp("date"))
    return lines, promos, tx, spark.createDataFrame(promos, "stockcode string, start_date date, end_date date")


def joins_on_days(df):
    return re.search(r"_day#\d+ = _d#\d+|_d#\d+ = _day#\d+", df._jdf.queryExecution().optimizedPlan().toString())


def test_pre_post_comparison(spark):
    lines, promos, tx, p = made(spark)
    df = M.pre_post_comparison(tx, p)
    got = {(r.stockcode, r.start_date): r for r in df.collect()}
    assert len(got) == len(promos)
    for s, a, b in promos:
        for name, lo, hi in (("treated", a, b), ("control", a - (b - a) - datetime.timedelta(1), a - datetime.timedelta(1))):
            own = [x for x in lines if x[2] == s and lo <= x[0] <= hi]
            r = got[s, a]
            assert r[f"{name}_revenue"] == pytest.approx(sum(x[4] * x[5] for x in own)) and r[f"{name}_qty"] == pytest.approx(sum(x[5] for x in own))
            assert r[f"{name}_orders"] == len({x[1] for x in own} - {None})
    assert joins_on_days(df)


def test_halo_effect(spark):
    lines, promos, tx, p = made(spark)
    df = M.halo_effect(tx, p)
    want = {}
    for s, a, b in promos:
        for name, lo, hi in (("halo", a, b), ("base", a - datetime.timedelta(28), a - datetime.timedelta(1))):
            baskets = {x[1] for x in lines if x[2] == s and lo <= x[0] <= hi} - {None}
            for t in baskets:
                for other in {x[2] for x in lines if x[1] == t} - {s}:
                    cell = want.setdefault((s, a, other), {"halo_revenue": 0.0, "halo_orders": 0, "base_revenue": 0.0, "base_orders": 0})
                    cell[f"{name}_revenue"] += sum(x[4] * x[5] for x in lines if x[1] == t and x[2] == other)
                    cell[f"{name}_orders"] += 1
    got = {(r.promo_product, r.start_date, r.halo_product): {k: r[k] for k in ("halo_revenue", "halo_orders", "base_revenue", "base_orders")} for r in df.collect()}
    assert got == want and joins_on_days(df)


def test_lean_forms_give_what_the_full_ones_do(spark):
    lines, promos, tx, p = made(spark)
    # promotions of one product that overlap; a line without a price; baskets of one product
    p = p.union(spark.createDataFrame([("a", datetime.date(2024, 1, 22), datetime.date(2024, 2, 3))], p.schema))
    tx = tx.union(spark.createDataFrame([(datetime.datetime(2024, 1, 22), "t0", "a", "u", None, 1.0), (datetime.datetime(2024, 1, 22), "solo", "a", "u", 2.0, 1.0), (datetime.datetime(2024, 1, 22), "t1", None, "u", 2.0, 1.0)], tx.schema))
    full = {r.promo_product: r.s for r in M.halo_effect(tx, p).groupBy("promo_product").agg(F.sum("halo_revenue").alias("s")).collect()}
    lean = {r.promo_product: r.halo_revenue for r in M.halo_revenue(tx, p).collect()}
    assert {k: v for k, v in lean.items() if v} == pytest.approx({k: v for k, v in full.items() if v}) and len(full) == 3
    key = ["stockcode", "start_date", "end_date"]
    both = M.pre_post_comparison(tx, p).join(M.pre_post_comparison(tx, p, orders=False).withColumnsRenamed({c: f"l_{c}" for c in ("treated_revenue", "control_revenue", "treated_qty", "control_qty", "lift_revenue_pct", "lift_qty_pct")}), key).collect()
    assert len(both) == 6 and all(r[c] == pytest.approx(r[f"l_{c}"]) for r in both for c in ("treated_revenue", "control_revenue", "treated_qty", "control_qty", "lift_revenue_pct", "lift_qty_pct"))


def test_periods_are_those_of_the_promotions(spark):
    rng = random.Random(3)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    lines = [(day(rng.randrange(120)), f"t{i}", rng.choice("abcd"), f"c{i % 9}", rng.choice([100.0, 100.0, 100.0, 90.0, 80.0]), 1.0) for i in range(500)] + [(None, "x", "a", "c", 50.0, 1.0), (day(3), "y", "a", "c", None, 1.0)]
    tx = spark.createDataFrame(lines, "date timestamp, transaction_id string, stockcode string, customer_id string, price double, quantity double")
    for gap in (1, 4):
        columns = ["stockcode", "start_date", "end_date", "duration_days"]
        want = sorted(map(tuple, M.detect_promotions(tx, gap_days=gap).select(columns).collect()))
        assert sorted(map(tuple, M.promo_periods(tx, gap_days=gap).select(columns).collect())) == want and (len(want) > 5 or gap == 1)


def test_decision_steps_shuffle_no_line_by_promotion(spark):
    """Revenue meets promotions as sums by product and day; the halo shuffles lines once, by basket."""
    _, _, tx, p = made(spark)
    tx = tx.withColumn("category", F.lit("k"))
    for df in (M.promo_periods(tx), M.pre_post_comparison(tx, p, orders=False), M.cannibalization(tx, p, orders=False)):
        assert "transaction_id" not in re.sub(r"(?s)\(?Scan ExistingRDD.*?\]|LogicalRDD.*?\]", "", df._jdf.queryExecution().executedPlan().toString())
    assert len(re.findall(r"Exchange hashpartitioning\(transaction_id", M.halo_revenue(tx, p)._jdf.queryExecution().executedPlan().toString())) == 1
