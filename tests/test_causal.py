import datetime as dt

import numpy as np
import pytest

from shelfline.operators import causal as C

WEEK0 = dt.date(2020, 1, 6)


def panel(spark, seed=1, units=25, weeks=40, effect=0.7, price=-1.5, share=0.8):
    rng = np.random.default_rng(seed)
    a, g = rng.normal(size=units), rng.normal(size=weeks)
    rows = []
    for i in range(units):
        for t in range(weeks):
            if rng.random() > share:
                continue
            promo, p = bool(rng.random() < 0.2), float(rng.normal())
            rows.append((f"s{i:02d}", WEEK0 + dt.timedelta(weeks=t), promo, float(effect * promo + price * p + a[i] + g[t] + 0.1 * rng.normal()), p))
    return rows, spark.createDataFrame(rows, "stockcode string, week date, is_promo boolean, log_units double, log_price double")


def dense(rows, regressors):
    """Least squares with all dummies, clustered by unit."""
    us, ts = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    d = np.zeros((len(rows), len(us) + len(ts) - 1))
    for k, r in enumerate(rows):
        d[k, us.index(r[0])] = 1
        if ts.index(r[1]):
            d[k, len(us) + ts.index(r[1]) - 1] = 1
    x = np.column_stack([[f(r) for r in rows] for f in regressors])
    y = np.array([r[3] for r in rows])
    q, _ = np.linalg.qr(d)
    x, y = x - q @ (q.T @ x), y - q @ (q.T @ y)
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    own = np.array([us.index(r[0]) for r in rows])
    meat = sum(np.outer(s, s) for s in (x[own == u].T @ e[own == u] for u in range(len(us))))
    return beta, bread @ meat @ bread * len(us) / (len(us) - 1)


def test_two_way_effect_equals_dense_least_squares(spark):
    rows, df = panel(spark)
    beta, cov = dense(rows, [lambda r: float(r[2]), lambda r: r[4]])
    got = C.two_way_effect(df).first()
    assert (got.effect, got.price_effect) == pytest.approx(tuple(beta), abs=1e-8)
    assert got.std_error == pytest.approx(np.sqrt(cov[0, 0]), rel=1e-6)
    assert abs(got.effect - 0.7) < 4 * got.std_error and got.n_obs == len(rows) and got.n_products == 25
    none = C.two_way_effect(df.limit(0)).first()
    assert none.effect == 0.0 and none.n_obs == 0


def test_event_study_equals_dense_least_squares(spark):
    rows, df = panel(spark, 2)
    starts = {f"s{i:02d}": WEEK0 + dt.timedelta(weeks=8 + i) for i in range(20)}
    promos = spark.createDataFrame([(s, d, d) for s, d in starts.items()], "stockcode string, start_date date, end_date date")
    periods = [k for k in range(-4, 5) if k != -1]
    since = lambda r: (r[1] - starts[r[0]]).days // 7 if r[0] in starts else None
    beta, cov = dense(rows, [*[lambda r, k=k: float(since(r) == k) for k in periods], lambda r: r[4]])
    got = {r.period: r for r in C.event_study(df, promos).collect()}
    assert set(got) == set(periods)
    for i, k in enumerate(periods):
        assert got[k].coefficient == pytest.approx(beta[i], abs=1e-8) and got[k].std_error == pytest.approx(np.sqrt(cov[i, i]), rel=1e-6)
    pre = [i for i, k in enumerate(periods) if k < 0]
    wald = beta[pre] @ np.linalg.inv(cov[np.ix_(pre, pre)]) @ beta[pre]
    assert got[0].pretrend_p_value == pytest.approx(C.chi_square_tail(wald, len(pre)), abs=1e-9)


def test_tails():
    # from tables of the distributions
    assert C.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert C.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert C.chi_square_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert C.chi_square_tail(19.67513757268249, 11) == pytest.approx(0.05, abs=1e-9)
    assert C.chi_square_tail(0.0, 5) == 1.0
    assert C.normal_tail(np.array([1.959963984540054])) == pytest.approx([0.05], abs=1e-9)


def test_cross_effects_equal_least_squares(spark):
    rows, df = panel(spark, 3, units=6)
    cats = spark.createDataFrame([(f"s{i:02d}", "x" if i < 4 else "y") for i in range(6)], "stockcode string, category string")
    got = {(r.promo_product, r.peer_product): r for r in C.cross_effects(df, cats).collect()}
    assert len(got) == 4 * 3 + 2
    for (a, b), r in got.items():
        on = {x[1] for x in rows if x[0] == a and x[2]}
        own = [x for x in rows if x[0] == b]
        x = np.array([[1.0, float(o[1] in on), o[4]] for o in own])
        y = np.array([o[3] for o in own])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        se = np.sqrt(e @ e / (len(y) - 3) * np.linalg.inv(x.T @ x)[1, 1])
        assert (r.effect, r.std_error) == (pytest.approx(beta[1], abs=1e-8), pytest.approx(se, rel=1e-6))


def lines(spark, series, z=None):
    rows = [(dt.datetime.combine(WEEK0 + dt.timedelta(weeks=t), dt.time()), u, 10.0 if z is None else float(z[u][t][0]), float(q), 1.0 if z is None else float(z[u][t][1])) for u, qs in series.items() for t, q in enumerate(qs)]
    return spark.createDataFrame(rows, "date timestamp, stockcode string, price double, quantity double, cost double")


def test_instrument_recovers_the_elasticity(spark):
    rng = np.random.default_rng(4)
    z, q = {}, {}
    for u in ("a", "b"):
        cost, shock = rng.normal(0, 0.4, 300), rng.normal(0, 0.5, 300)
        p = 0.8 * cost + 0.5 * shock  # price follows demand too, so least squares is off
        z[u] = list(zip(np.exp(p), np.exp(cost), strict=True))
        q[u] = np.exp(-2.0 * p + shock)
    from pyspark.sql import functions as F

    got = {r.stockcode: r for r in C.instrument_elasticity(lines(spark, q, z), F.col("cost")).collect()}
    for r in got.values():
        assert abs(r.elasticity + 2.0) < 4 * r.std_error < 0.5 and r.first_stage_f > 10 and not r.weak_instrument
    assert C.instrument_elasticity(lines(spark, {"c": [1.0] * 5}), F.col("cost")).count() == 0


def test_synthetic_control_finds_a_planted_mixture(spark):
    rng = np.random.default_rng(5)
    d = {f"d{i}": np.exp(np.cumsum(rng.normal(0, 0.2, 40)) + 3) for i in range(6)}
    mix = 0.6 * np.log(d["d1"]) + 0.4 * np.log(d["d4"])
    mix[30:] += 0.5
    tx = lines(spark, d | {"t": np.exp(mix)})
    one = lambda names: spark.createDataFrame([(n,) for n in names], "stockcode string")
    effects, weights = C.synthetic_control(tx, one(["t"]), one(d))
    w = {r.donor: r.weight for r in weights.where("unit = 't'").collect()}
    assert w["d1"] == pytest.approx(0.6, abs=1e-5) and w["d4"] == pytest.approx(0.4, abs=1e-5) and sum(w.values()) == pytest.approx(1)
    rows = {r.unit: r for r in effects.collect()}
    assert rows["t"].effect_log == pytest.approx(0.5, abs=1e-4) and rows["t"]["rank"] == 1 and not rows["t"].is_placebo and len(rows) == 7
    with pytest.raises(ValueError):
        C.synthetic_control(tx, one(["t"]), one(d), pre=35)
