"""Odd inputs and parts that the registered queries don't reach."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfline.operators import attributes as X
from shelfline.operators import basket as B
from shelfline.operators import clv as V
from shelfline.operators import loops as L
from shelfline.operators import performance as P
from shelfline.operators import pricing as R
from shelfline.operators import quality as Q
from shelfline.operators import rules as U
from shelfline.operators import switching as S
from shelfline.sources.lines import clean_id, detect_column_mapping, load_transactions, normalise
from shelfline.streaming import events as E

LINES = "date timestamp, transaction_id string, stockcode string, product string, customer_id string, price double, quantity double, category string, brand string, size string, discount double"


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], LINES)


def test_headers_and_cleaning(spark, tmp_path):
    assert detect_column_mapping(["SKU", "Order_ID", "dt", "QTY", "Amount", "client_id", "other"]) == {"SKU": "stockcode", "Order_ID": "transaction_id", "dt": "date", "QTY": "quantity", "Amount": "price", "client_id": "customer_id"}
    (tmp_path / "a.csv").write_text("Date,Order_ID,SKU,Client_ID,Unit_Price,Qty,Cat\n2024-01-02,1.0,A,7.0,2.5,2,x\nbad,2,B,8,1,1,x\n2024-01-03,3,C,nan,1,1,y\n2024-01-04,4,D,9,-1,1,y\n2024-01-05,5,E,9,oops,1,y\n")
    path = f"file://{tmp_path}/a.csv"
    rows = load_transactions(spark, path).collect()
    assert [(r.transaction_id, r.customer_id, r.product, r.category) for r in rows] == [("1", "7", "A", "x")]
    assert load_transactions(spark, path, require_customer_id=False).count() == 2
    assert normalise(spark.read.csv(path, header=True))[1].count() == 1
    with pytest.raises(ValueError):
        normalise(spark.createDataFrame([(1,)], "sku int"))
    got = spark.createDataFrame([(" 85123.0 ",), ("",), ("NaN",), (None,), ("a.0b",)], "x string").select(clean_id("x").alias("y")).collect()
    assert [r.y for r in got] == ["85123", None, None, None, "a.0b"]


def test_empty_lines(empty):
    for f in (B.basket_penetration, B.customer_entropy, B.basket_summary, B.revenue_control_chart, P.abc_analysis, P.xyz_analysis, P.lifecycle_stage, P.time_to_second_purchase, S.switching_matrix, S.loyalty_metrics, R.own_price_elasticity, X.seasonality_class):
        assert f(empty).count() == 0


def test_pack_sizes_and_contract(spark):
    df = spark.createDataFrame([("500ML",), ("6 pk",), ("1.5 KG",), (None,), ("big",)], "s string")
    assert [r.v for r in df.select(R.parse_size("s").alias("v")).collect()] == [0.5, 6.0, 1.5, 1.0, 1.0]
    assert Q.check_contract(df, ["s"], {"known": F.col("s").isNotNull()}).first().violations == 1
    assert Q.referential_violations(df, df.limit(1), "s").count() == 4


def test_pagerank_and_communities(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 2.0), ("c", "x", 0.1)], "src string, dst string, weight double")
    r = {x.node: x.pagerank for x in L.pagerank(e, damping=0.4, tolerance=1e-6).collect()}
    w = {}
    for a, b, v in [tuple(x) for x in e.collect()]:
        w.setdefault(a, {})[b] = v
        w.setdefault(b, {})[a] = v
    p = dict.fromkeys(w, 1 / len(w))
    for _ in range(200):
        p = {n: 0.6 / len(w) + 0.4 * sum(p[m] * w[m][n] / sum(w[m].values()) for m in w if n in w[m]) for n in w}
    assert all(abs(p[n] - r[n]) < 1e-5 for n in p)
    c = {x.node: x.community for x in L.label_propagation(e).collect()}
    assert c["a"] == c["b"] == c["c"] and c["x"] == c["y"] != c["a"]
    assert L.pagerank(e.limit(0)).count() == 0


def test_chains(spark):
    c = spark.createDataFrame([("a", "b", 0.1), ("a", "end", 0.9), ("b", "a", 1.0), ("end", "end", 1.0)], "src string, dst string, p double")
    into, steps = L.absorption(c, tolerance=1e-5)
    assert {(x.src, x.dst): round(x.probability, 4) for x in into.collect()} == {("a", "end"): 1.0, ("b", "end"): 1.0}
    assert {x.src: round(x.steps, 3) for x in steps.collect()} == {"a": 1.222, "b": 2.222}
    two = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "b", 0.5)], "src string, dst string, p double")
    pi = {x.state: x.share for x in L.steady_state(two, tolerance=1e-5).collect()}
    assert abs(pi["a"] - 1 / 3) < 1e-3 and abs(pi["b"] - 2 / 3) < 1e-3


def test_redundant_rules(spark):
    rows = [(["a"], ["z"], 0.6, 2.0), (["a", "b"], ["z"], 0.5, 1.5), (["a", "c"], ["z"], 0.9, 3.0), (["b"], ["y"], 0.9, 9.0)]
    df = spark.createDataFrame(rows, "antecedents array<string>, consequents array<string>, confidence double, lift double")
    assert {tuple(x.antecedents): x.is_redundant for x in U.flag_redundant(df).collect()} == {("a",): False, ("a", "b"): True, ("a", "c"): False, ("b",): False}


def test_clv(spark):
    tx = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("cast(o_orderdate as timestamp) date", "cast(o_orderkey as string) transaction_id", "cast(o_custkey as string) customer_id", "o_totalprice price", "1.0 quantity")
    rows = V.predict_clv(tx).collect()
    assert rows and all(0 <= r.p_alive <= 1 and r.predicted_purchases >= 0 and math.isfinite(r.predicted_clv) for r in rows)
    assert {r.clv_segment for r in rows} <= {"Low", "Medium", "High", "Very High"}


def test_gamma_gamma_uses_all_customers(spark):
    r = np.random.default_rng(11)
    x = r.integers(1, 6, 12000)
    m = r.gamma(4.0 * x, 1 / (x * r.gamma(5.0, 1 / 60.0, len(x))))
    rows = spark.createDataFrame(pd.DataFrame({"customer_id": np.arange(len(x)).astype(str), "frequency": x, "monetary_value": m}))

    def loss(z):
        p, q, v = np.exp(z)
        like = V.lgamma(p * x + q) - V.lgamma(p * x) - math.lgamma(q) + q * np.log(v) + (p * x - 1) * np.log(m / m.mean()) + p * x * np.log(x) - (p * x + q) * np.log(x * m / m.mean() + v)
        return float(-like.mean() + 0.001 * (np.exp(z) ** 2).sum() / 100)

    p, q, v = np.exp(V.minimise(loss, np.zeros(3)))
    assert np.allclose(V.fit_gamma_gamma(rows), [p, q, v * m.mean()], rtol=2e-3)


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    E.run_to_parquet(E.windowed_events(stream, late="3650 days").drop("n_users"), f"file://{tmp_path}/never", f"file://{tmp_path}/c0")
    E.run_to_parquet(E.drop_repeats(stream, "3650 days").select("event_id"), f"file://{tmp_path}/ids", f"file://{tmp_path}/c1")
    assert spark.read.schema("event_id long").parquet(f"file://{tmp_path}/ids").count() == batch.select("event_id").distinct().count()


def test_import_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import shelfline.registry"], check=True, timeout=120)


def test_lift_interval_is_brute_force(spark):
    """Names that hold the old separator, rules of three products, and each set's weighted count."""
    rng = random.Random(12)
    names = ["a|b", "a", "b", "c|", "d"]
    rows = [(f"c{c}", f"t{c}-{k}", s) for c in range(40) for k in range(3) for s in rng.sample(names, rng.randint(1, 4))]
    tx = spark.createDataFrame(rows, "customer_id string, transaction_id string, stockcode string")
    rules = spark.createDataFrame([(["a|b"], ["a"]), (["a", "b"], ["d"]), (["b"], ["a|b", "c|"])], "antecedents array<string>, consequents array<string>")
    got = {(tuple(r.antecedents), tuple(r.consequents)): (r.lift_ci_lower, r.lift_ci_upper) for r in U.lift_interval(tx, rules, 20, 7).collect()}
    u = {(r.c, r.b): r.u for r in spark.range(40).selectExpr("concat('c', id) AS c", "explode(sequence(1, 20)) AS b").selectExpr("c", "b", "pmod(xxhash64(c, b, 7), 1073741824L) / 1073741824.0D AS u").collect()}
    cdf = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(7)])
    baskets = {}
    for c, t, s in rows:
        baskets.setdefault((c, t), set()).add(s)
    for a, b in [(("a|b",), ("a",)), (("a", "b"), ("d",)), (("b",), ("a|b", "c|"))]:
        lifts = []
        for draw in range(1, 21):
            w = {k: int((u[k[0], draw] >= cdf).sum()) for k in baskets}
            n, na, nc, nac = (sum(w[k] for k, i in baskets.items() if set(x) <= i) for x in ((), a, b, a + b))
            if na and nc:
                lifts.append(nac * n / (na * nc))
        assert got[a, b] == pytest.approx(np.percentile(lifts, [5, 95]), abs=1e-9)
    assert len(got) == 3
