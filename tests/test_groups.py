"""Clusters, cohesion, tiers, boosted scores and lifetime intervals against brute force or planted facts."""

import datetime
import random

import numpy as np
import pytest

from shelfline.operators import boosted as K
from shelfline.operators import clusters as C
from shelfline.operators import lifetime as L


def planted(seed=3, groups=3, each=12, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = np.eye(6)[:groups]
    return {f"g{g}-{i}": (centres[g] + noise * rng.normal(size=6)).tolist() for g in range(groups) for i in range(each)}


def frame(spark, vectors):
    return spark.createDataFrame([*vectors.items(), ("none", None), ("zero", [0.0] * 6)], "stockcode string, embedding array<double>")


def test_clusters_find_planted_groups_and_their_number(spark):
    df = frame(spark, planted())
    found = {r.stockcode: r.cluster for r in C.product_clusters(df, 3).collect()}
    assert len(found) == 36 and len({(p[:2], c) for p, c in found.items()}) == 3
    scores = {r.n_clusters: r.silhouette for r in C.cluster_counts(df, 5).collect()}
    assert max(scores, key=scores.get) == 3
    assert C.cluster_counts(df.limit(0), 5).count() == 0


def test_cohesion_equals_all_pairs(spark):
    v = planted(5, 3, 5, 0.6)
    groups = {p: p[1] for p in v} | {"lonely": "9"}
    v["lonely"] = [0.5, 0.0, 0.0, 0.0, 0.0, 2.0]
    u = {p: np.array(x) / np.linalg.norm(x) for p, x in v.items()}
    df = frame(spark, v)
    g = spark.createDataFrame([*groups.items(), ("none", "1"), ("g0-0-other", None)], "stockcode string, group string")
    got = {r["group"]: r for r in C.group_cohesion(C.embedding_cells(df), g).collect()}
    for name in sorted(set(groups.values())):
        own = [p for p in v if groups[p] == name]
        inside = [u[a] @ u[b] for a in own for b in own if a < b]
        outside = [u[a] @ u[b] for a in own for b in v if groups[b] != name]
        assert got[name]["size"] == len(own)
        assert got[name].within_similarity == pytest.approx(np.mean(inside) if inside else 1.0)
        assert got[name].across_similarity == pytest.approx(np.mean(outside))


def lloyd(x, order, names, k):
    """k-means of one category by the rules of tiers_by_category."""
    sd = x.std(axis=0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)
    n = len(x)
    group = np.empty(n, int)
    for place, i in enumerate(sorted(range(n), key=lambda i: (order[i], names[i]))):
        group[i] = place * min(k, n) // n
    while True:
        labels = sorted(set(group.tolist()))
        d = np.stack([((z - z[group == g].mean(axis=0)) ** 2).sum(axis=1) for g in labels], axis=1)
        new = np.array([labels[j] for j in d.argmin(axis=1)])
        if (new == group).all():
            break
        group = new
    means = sorted(set(group.tolist()), key=lambda g: (order[group == g].mean(), g))
    return [means.index(g) for g in group]


def test_tiers_equal_k_means_in_each_category(spark):
    rng = np.random.default_rng(11)
    rows = [("big", f"p{i:03d}", float(np.exp(rng.normal())), float(rng.random())) for i in range(60)]
    rows += [("small", "q1", 2.0, 0.1), ("small", "q2", 1.0, None), ("one", "r", 5.0, 0.5), (None, "s1", 1.0, 0.0), (None, "s2", 9.0, 0.0)]
    rows += [("same", f"t{i}", 3.0, 0.2) for i in range(4)]
    df = spark.createDataFrame(rows, "category string, stockcode string, price double, reach double")
    got = {r.stockcode: r for r in C.tiers_by_category(df, ["price", "reach"], "price").collect()}
    assert len(got) == len(rows)
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        want = lloyd(np.array([[r[2], r[3] or 0.0] for r in own]), np.array([r[2] for r in own]), [r[1] for r in own], 3)
        assert [got[r[1]].tier for r in own] == want, c
    assert got["r"].tier_label == "Value" and got["q1"].tier_label == "Mainstream"
    assert C.tiers_by_category(df.limit(0), ["price"], "price").count() == 0


def test_boosted_scores_beat_the_heuristic_on_products_held_out(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        a, b, c = rng.random(3)
        # revenue depends on a step and a product of two measures; the heuristic knows one of them
        rows.append((f"p{i}", "c", float(100 * (a > 0.5) + 80 * a * b), float(a), float(a), float(b), float(c)))
    df = spark.createDataFrame(rows, "stockcode string, category string, total_revenue double, kvi_score double, x double, y double, noise double")
    columns = ["x", "y", "noise"]
    scored = K.out_of_fold(df, columns, folds=3, trees=20)
    errors = {r.model: r.rmse for r in K.boosted_errors(scored).collect()}
    assert errors["boosted"] < 0.6 * errors["linear"] < errors["constant"]
    one = K.boosted_scores(scored).collect()
    assert len(one) == 240 and min(r.kvi_score for r in one) == 0 and max(r.kvi_score for r in one) == 1
    weight = {r.feature: r for r in K.boosted_importances(df, columns, trees=10).collect()}
    assert weight["x"].permuted > weight["y"].permuted > weight["noise"].permuted
    assert sum(r.importance for r in weight.values()) == pytest.approx(1)


def buyers(spark, n=160):
    rng = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for c in range(n):
        rate, value = rng.gammavariate(1.2, 0.03), rng.gammavariate(6, 5)
        t, k = rng.uniform(0, 60), 0
        while t < 365:
            rows.append((f"c{c}", f"t{c}-{k}", f"p{rng.randrange(9)}", day + datetime.timedelta(days=t), value * rng.uniform(0.6, 1.4), 1.0))
            k, t = k + 1, t + rng.expovariate(rate + 1e-3)
            if rng.random() < 0.08:
                break
    return spark.createDataFrame(rows, "customer_id string, transaction_id string, stockcode string, date timestamp, price double, quantity double")


def test_intervals_of_lifetime_values(spark):
    tx = buyers(spark)
    got = L.clv_intervals(tx, draws=40).collect()
    assert len(got) == 160
    sure = [r for r in got if r.ci_status == "valid"]
    assert len(sure) > 140 and all(r.n_draws >= L.LEAST_DRAWS and r.ci_lower <= r.ci_upper for r in sure)
    assert np.mean([r.ci_lower <= r.predicted_clv <= r.ci_upper for r in sure]) > 0.8
    few = L.clv_intervals(tx, draws=3).collect()
    assert all(r.ci_status == "insufficient_resamples" and r.ci_lower is None for r in few)


def test_customer_view_and_diagnostics(spark):
    from shelfline.operators.clv import predict_clv

    tx = buyers(spark)
    one = {r.customer_id: r for r in L.clv_customers(tx, predict_clv(tx), annual_rate=0.1).collect()}
    assert len(one) == 160 and all(0 < r.clv_12m_discounted < r.clv_12m for r in one.values() if r.clv_12m > 0)
    assert all(r.clv_12m == pytest.approx(r.predicted_clv * 365 / 90) for r in one.values())
    metrics = {r.metric: r.value for r in L.clv_diagnostics(tx).collect()}
    assert metrics["n_customers_total"] == 160 and metrics["bgf_r"] > 0 and metrics["ggf_p"] > 0
    assert 0 <= metrics["gg_value_stationarity_pct"] <= 1 and metrics["gg_independence_status"] in (0, 1, 2)
    assert L.value_independence(tx.limit(0)).count() == 0


def test_fits_take_gamma_functions_of_few_numbers(monkeypatch):
    """Rows of counts grow with the calendar, numbers of purchases hardly; the loss is the same."""
    from shelfline.operators import clv as V

    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, 3000).astype(float)
    t = rng.uniform(20, 90, 3000)
    last, w = np.where(x > 0, t * rng.random(3000), 0.0), rng.integers(1, 5, 3000).astype(float)
    most, plain = [], V.lgamma
    monkeypatch.setattr(V, "lgamma", lambda v: most.append(len(v)) or plain(v))
    p = np.array([0.1, 0.7, -0.3, 0.4])
    r, alpha, a, b = np.exp(p)
    like = plain(r + x) - plain(np.array([r])) + r * np.log(alpha) + plain(np.array([a + b])) + plain(b + x) - plain(np.array([b])) - plain(a + b + x)
    gone = np.where(x > 0, np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + last), -np.inf)
    like = like + np.logaddexp(-(r + x) * np.log(alpha + t), gone)
    assert V.bg_nbd_loss(p, x, last, t, w) == pytest.approx(-(w * like).sum() / w.sum() + 0.001 * (np.exp(p) ** 2).sum() / 100, rel=1e-12)
    V.bg_nbd_of_counts(x, last, t, w)
    V.gamma_gamma_of_counts(x[x > 0], t[x > 0], np.log(t[x > 0]), w[x > 0])
    assert max(most) == 9
