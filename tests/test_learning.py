import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.operators import embedding as E
from shelfline.operators import survival as S
from shelfline.operators import uplift as U


def test_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(70, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[3] = v[5]
    names = [f"p{i:02d}" for i in range(70)]
    df = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v, strict=True)] + [("none", None)], "stockcode string, embedding array<double>")
    got = {}
    for r in E.nearest_products(df, k=5, block=9).orderBy("product", "rank").collect():
        got.setdefault(r["product"], []).append(r.neighbor)
    for i, n in enumerate(names):
        want = sorted((round(1 - float(v[i] @ v[j]), 9), names[j]) for j in range(70) if j != i)[:5]
        assert got[n] == [w[1] for w in want]
    assert len(got) == 70 and E.nearest_products(df.limit(0)).count() == 0


def test_embeddings_find_planted_groups_and_repeat(spark):
    rng = random.Random(7)
    rows = [(f"c{c}", f"t{c}-{k}", f"g{c % 4}-{rng.randrange(8)}") for c in range(160) for k in range(12)]
    tx = spark.createDataFrame(rows, "customer_id string, transaction_id string, stockcode string")
    e = E.product_embeddings(tx, dimension=8, rounds=8)
    near = E.nearest_products(e, k=7).collect()
    assert sum(r["product"][:2] == r.neighbor[:2] for r in near) >= 0.95 * len(near) and len(near) == 32 * 7
    one, two = ({r.stockcode: r.embedding for r in x.collect()} for x in (e, E.product_embeddings(tx, dimension=8, rounds=8)))
    assert all(np.allclose(one[p], two[p], atol=1e-4) for p in one)
    assert all(abs(np.linalg.norm(x) - 1) < 1e-6 for x in one.values())


def test_embeddings_of_few_products_send_sums_by_product(spark, monkeypatch):
    """The factors are those of ALS, whose fit has no rounds; customers go to many tasks."""
    rng = random.Random(11)
    rows = [(f"c{c}", f"t{c}-{k % 9}", f"p{rng.randrange(3 + c % 20):02d}") for c in range(90) for k in range(1 + c % 25)]
    rows += [(None, "t", "p01"), ("c1", "t", None), ("c2", None, "p07"), ("lonely", "t", "only")]
    tx = spark.createDataFrame(rows, "customer_id string, transaction_id string, stockcode string")
    fits, tasks, fit, keep = [], [], E.ALS.fit, E.cut
    monkeypatch.setattr(E.ALS, "fit", lambda self, rows: fits.append(self.getMaxIter()) or fit(self, rows))
    monkeypatch.setattr(E, "cut", lambda t: tasks.append(t.rdd.getNumPartitions() if "features" in t.columns else 0) or keep(t))
    monkeypatch.setattr(E, "CUSTOMERS", 10)
    monkeypatch.setattr(E, "STEP", 4)
    few = {r.stockcode: r.embedding for r in E.product_embeddings(tx, dimension=6, rounds=5).collect()}
    assert fits == [0] and max(tasks) == 10
    monkeypatch.setattr(E, "FEW", 22)
    many = {r.stockcode: r.embedding for r in E.product_embeddings(tx, dimension=6, rounds=5).collect()}
    assert fits == [0, 5] and len(few) == 23 and few.keys() == many.keys()
    assert all(np.allclose(few[p], many[p], atol=1e-5) for p in few)


def test_survival_recovers_coefficients(spark):
    rng = np.random.default_rng(8)
    n = 6000
    x, z = rng.normal(size=n), rng.normal(size=n)
    t = np.exp(3.0 + 0.8 * x - 0.5 * z + 0.6 * np.log(rng.exponential(size=n)))
    c = rng.exponential(60.0, size=n)
    rows = [(f"c{i}", float(max(min(t[i], c[i]), 1e-3)), float(t[i] <= c[i]), float(x[i]), float(z[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_id string, duration double, event double, x double, z double")
    model = S.fit_survival(df, ["x", "z"])
    assert model.coefficients.toArray() == pytest.approx([0.8, -0.5], abs=0.05)
    assert (model.intercept, model.scale) == (pytest.approx(3.0, abs=0.06), pytest.approx(0.6, abs=0.04))
    got = S.survival_predictions(df, model, ["x", "z"], 20)
    assert got.count() == n and got.where("survival_prob < 0 OR survival_prob > 1 OR median_lifetime > expected_lifetime * 3").count() == 0
    r = got.join(df.select("customer_id", "x", "z"), "customer_id").first()
    lam = np.exp(model.intercept + model.coefficients[0] * r.x + model.coefficients[1] * r.z)
    s = lambda t: np.exp(-((t / lam) ** (1 / model.scale)))
    assert r.survival_prob == pytest.approx(s(r.duration + 20) / s(r.duration), rel=1e-9)
    terms = {d.term: d.value for d in S.survival_diagnostics(model, df, ["x", "z"]).collect()}
    assert terms["n_customers"] == n and terms["x"] == model.coefficients[0]


def made_up(spark, n=3000, seed=9):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-0.8 * a))).astype(int)
    effect = np.where(b > 0, 3.0, 0.0)
    y = 1 + a + effect * t + 0.3 * rng.normal(size=n)
    rows = [(f"r{i}", f"c{i % 200}", int(t[i]), float(y[i]), float(a[i]), float(b[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, customer_id string, treatment int, y double, a double, b double"), effect


def test_uplift_of_a_known_effect(spark):
    df, effect = made_up(spark)
    rows = U.propensity(df, ["a", "b"])
    assert abs(rows.stat.corr("propensity", "a")) > 0.9
    shared = U.overlap(rows).first()
    assert shared.enough and 0.9 < shared.overlap_proportion <= 1
    kept = U.trimmed(rows)
    assert 0.9 * len(effect) < kept.count() <= len(effect)
    scored = U.two_models(kept, ["a", "b"]).cache()
    by = {r[0]: r[1] for r in scored.groupBy((F.col("b") > 0).alias("k")).agg(F.avg("uplift")).collect()}
    assert by[True] == pytest.approx(3.0, abs=0.3) and by[False] == pytest.approx(0.0, abs=0.3)
    c = U.customer_uplift(scored)
    assert c.count() == 200
    truth = df.groupBy("customer_id").agg(F.avg(F.when(F.col("b") > 0, 3.0).otherwise(0.0)).alias("t"))
    inside = c.join(truth, "customer_id").where("t BETWEEN ci_lower - 0.3 AND ci_upper + 0.3").count()
    assert inside >= 190
    curve = sorted(U.qini(scored).collect(), key=lambda r: r.bin)
    own = sorted(scored.select("uplift", "id", "treatment", "y").collect(), key=lambda r: (-r.uplift, r.id))
    n, total = len(own), 0.0
    for k in range(1, 11):
        part = [r for i, r in enumerate(own) if min(10, i * 10 // n + 1) == k]
        y1, y0 = [r.y for r in part if r.treatment], [r.y for r in part if not r.treatment]
        total += (np.mean(y1) - np.mean(y0)) * len(y1) if y1 and y0 else 0.0
        assert curve[k].qini_y == pytest.approx(total / n, abs=1e-9) and curve[k].ci_lower <= curve[k].ci_upper
    assert curve[10].ci_lower <= curve[10].qini_y <= curve[10].ci_upper
    m = {r.metric: r.value for r in U.qini_metrics(U.qini(scored)).collect()}
    assert m["auuc"] > 0.1 and m["gain_at_top"] > m["qini_coefficient"] > 0
    with pytest.raises(ValueError):
        U.two_models(rows.where("treatment = 1"), ["a", "b"])
    assert not U.overlap(rows.where("treatment = 1")).first().enough


def test_uplift_without_enough_treated_rows(spark):
    df, _ = made_up(spark, 60)
    rows = df.withColumn("treatment", F.lit(0)).withColumn("propensity", F.lit(0.2))
    scored = U.two_models(rows, ["a", "b"], strict=False)
    assert scored.count() == 60 and scored.where("uplift IS NOT NULL").count() == 0
    assert [(r.bin, r.qini_y) for r in U.qini(scored).collect()] == [(0, 0.0)]
    assert {r.metric: r.value for r in U.qini_metrics(U.qini(scored)).collect()} == dict.fromkeys(("qini_coefficient", "auuc", "auuc_normalized", "gain_at_top"))
    customers = U.customer_uplift(scored).collect()
    assert len(customers) == 60 and all(r.uplift is None and r.treatment_share == 0 for r in customers)


def test_uplift_rows_go_to_more_tasks_as_lines_grow(spark, monkeypatch):
    rng = random.Random(13)
    lines = [(f"c{rng.randrange(9)}", f"p{rng.randrange(4)}", f"t{i}", f"2024-0{rng.randrange(1, 7)}-1{rng.randrange(10)}", float(rng.randrange(1, 5)), 2.0 + rng.randrange(3), rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(lines, "customer_id string, stockcode string, transaction_id string, day string, quantity double, price double, is_promo boolean").withColumn("date", F.to_timestamp("day"))
    want = {r.id: r for r in U.uplift_rows(df, 4).collect()}
    tasks, keep = [], U.stored
    monkeypatch.setattr(U, "LINES_OF_TASK", 10)
    monkeypatch.setattr(U, "stored", lambda w: tasks.append(w.rdd.getNumPartitions()) or keep(w))
    got = {r.id: r for r in U.uplift_rows(df, 4).collect()}
    assert tasks == [20] and got.keys() == want.keys()
    week = lambda d: d - datetime.timedelta(d.weekday())
    own = [(c, p, week(datetime.date.fromisoformat(d)), q, q * x) for c, p, _, d, q, x, _ in lines]
    for k, r in got.items():
        c, p, w = k.split("|")
        before = [o for o in own if o[0] == c and str(o[2]) < w]
        assert (r.cust_qty, r.cust_txns) == (sum(o[3] for o in before), len(before)) and r.cust_revenue == pytest.approx(sum(o[4] for o in before))
        assert r.cust_products == len({o[1:3] for o in before})
        ahead = [o[3] for o in own if o[:2] == (c, p) and w < str(o[2]) <= str(datetime.date.fromisoformat(w) + datetime.timedelta(28))]
        assert r.y == sum(ahead) and r.prod_qty == sum(o[3] for o in own if o[1] == p and str(o[2]) < w)
        assert all(r[f] == pytest.approx(want[k][f]) for f in U.FEATURES)
