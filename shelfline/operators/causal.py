"""Effects in panels of units and weeks: two-way effects, event studies, cross-product effects, instruments, synthetic controls."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import period_start, revenue
from ..functions.store import cut

#: Weeks of a panel at most: the driver solves a system with a row for each.
MOST_WEEKS = 1_500


def normal_tail(z: np.ndarray) -> np.ndarray:
    """Two-sided p-values of standard normal values."""
    from math import erfc, sqrt

    return np.array([erfc(abs(x) / sqrt(2)) for x in np.atleast_1d(z)])


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution with whole degrees of freedom, by its finite recursion."""
    from math import erfc, exp, lgamma, log, sqrt

    if not x > 0:
        return 1.0
    total, k = (erfc(sqrt(x / 2)), 1) if df % 2 else (exp(-x / 2), 2)
    while k < df:
        total += exp(k / 2 * log(x / 2) - x / 2 - lgamma(k / 2 + 1))
        k += 2
    return min(1.0, total)


def two_way_fit(panel: DataFrame, outcome: str, regressors: list[str], unit: str = "stockcode", time: str = "week") -> tuple[np.ndarray, np.ndarray, int, int]:
    """Coefficients, their covariance clustered by unit, rows and units of a least squares fit with unit and time effects.

    Exact: unit effects are taken off within each unit's rows, and time effects are solved for together with the
    coefficients from sums over units, which one pass makes. A second pass sums the scores of units. The driver
    holds systems of one row per week and regressor, bounded by the calendar (MOST_WEEKS). Rows with nulls are left
    out; a regressor that the effects explain gets 0.
    """
    names = [outcome, *regressors]
    rows = panel.select(F.col(unit).alias("u"), F.col(time).alias("t"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    cols = [f"v{i}" for i in range(len(names))]
    n_weeks = rows.select("t").distinct().count()
    if n_weeks > MOST_WEEKS:
        raise ValueError(f"{n_weeks} weeks; the fit is for {MOST_WEEKS} at most")
    weeks = rows.select("t").distinct().orderBy("t").collect()
    at = {r[0]: i for i, r in enumerate(weeks)}
    index = F.create_map(*[F.lit(x) for t, i in at.items() for x in (t, i)]) if at else F.create_map()
    # a unit's rows are as many as there are weeks, so they fit in one row
    own = cut(rows.groupBy("u").agg(F.collect_list(F.struct(*([index[F.col("t")].alias("w")] if at else [F.lit(0).alias("w")]), *cols)).alias("x")))
    k, size = len(names), len(at)

    def within(x: list) -> tuple[np.ndarray, np.ndarray]:
        w = np.array([r["w"] for r in x], dtype=np.int64)
        v = np.array([[r[c] for c in cols] for r in x])
        return w, v - v.mean(axis=0)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((size + k, size + k)), [0, 0]
        for batch in batches:
            for x in batch["x"]:
                w, v = within(x)
                np.add.at(total, (w, w), 1.0)
                present = np.bincount(w, minlength=size)
                some = np.flatnonzero(present)
                total[np.ix_(some, some)] -= np.outer(present[some], present[some]) / len(w)
                np.add.at(total[:, size:], w, v)
                total[size:, size:] += v.T @ v
                count[0] += len(w)
                count[1] += 1
        yield pd.DataFrame({"i": np.arange(size + k + 1), "row": [*total.tolist(), [float(c) for c in count] + [0.0] * (size + k - 2)]})

    # one matrix a task; its rows are added up by place
    entry = F.posexplode("row").alias("j", "x")
    found = own.mapInPandas(moments, "i int, row array<double>").select("i", entry).groupBy("i", "j").agg(F.sum("x").alias("x")).where("x <> 0").collect()
    m = np.zeros((size + k + 1, size + k + 1))
    for i, j, x in found:
        m[i, j] = x
    n_obs, n_units = int(m[size + k, 0]), int(m[size + k, 1])
    m = m[: size + k, : size + k]
    m[size:, :size] = m[:size, size:].T
    ww = np.linalg.pinv(m[:size, :size], rcond=1e-10, hermitian=True) if size else np.zeros((0, 0))
    # what weeks explain of each variable, then of the outcome by regressors
    by_week = ww @ m[:size, size:]
    rest = m[size:, size:] - m[size:, :size] @ by_week
    bread = np.linalg.pinv(rest[1:, 1:], rcond=1e-10, hermitian=True)
    beta = bread @ rest[1:, 0]

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k - 1, k - 1))
        for batch in batches:
            for x in batch["x"]:
                w, v = within(x)
                d = by_week[w]
                v = v - (d - d.mean(axis=0))
                s = v[:, 1:].T @ (v[:, 0] - v[:, 1:] @ beta)
                total += np.outer(s, s)
        yield pd.DataFrame({"i": np.arange(k - 1), "row": total.tolist()})

    meat = np.zeros((k - 1, k - 1))
    for i, j, x in own.mapInPandas(scores, "i int, row array<double>").select("i", entry).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        meat[i, j] = x
    scale = n_units / (n_units - 1) if n_units > 1 else 0.0
    return beta, bread @ meat @ bread * scale, n_obs, n_units


def two_way_effect(panel: DataFrame) -> DataFrame:
    """One row: effect of promotion on log units with product and week effects and log price taken out, and its error by product clusters."""
    t = panel.withColumn("promo", F.col("is_promo").cast("double"))
    beta, cov, n, g = two_way_fit(t, "log_units", ["promo", "log_price"])
    row = (float(beta[0]), float(np.sqrt(max(cov[0, 0], 0.0))), float(beta[1]), n, g)
    return panel.sparkSession.createDataFrame([row], "effect double, std_error double, price_effect double, n_obs long, n_products long")


def event_study(panel: DataFrame, promos: DataFrame, leads: int = 4, lags: int = 4) -> DataFrame:
    """Effect on log units by weeks since a product's first promotion, against the week before it.

    period, coefficient, std_error (by product clusters), p_value, is_pre, and the p-value of all leads being 0 together. Product
    and week effects and log price are taken out; weeks outside the window and products without promotion are the rest.
    """
    first = promos.groupBy("stockcode").agg(F.min(F.to_date("start_date")).alias("_start"))
    t = panel.join(first, "stockcode", "left")
    since = F.floor(F.datediff(F.to_date("week"), period_start("_start", "W")) / 7)
    periods = [k for k in range(-leads, lags + 1) if k != -1]
    t = t.withColumns({f"_d{i}": F.coalesce((since == k).cast("double"), F.lit(0.0)) for i, k in enumerate(periods)})
    beta, cov, _, _ = two_way_fit(t, "log_units", [*[f"_d{i}" for i in range(len(periods))], "log_price"])
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    p = normal_tail(np.divide(beta, se, out=np.zeros_like(beta), where=se > 0))
    pre = [i for i, k in enumerate(periods) if k < 0]
    known = [i for i in pre if se[i] > 0]
    joint = chi_square_tail(float(beta[known] @ np.linalg.pinv(cov[np.ix_(known, known)]) @ beta[known]), len(known)) if known else None
    rows = [(k, float(beta[i]), float(se[i]), float(p[i]), k < 0, joint) for i, k in enumerate(periods)]
    return panel.sparkSession.createDataFrame(rows, "period int, coefficient double, std_error double, p_value double, is_pre boolean, pretrend_p_value double")


def cross_effects(panel: DataFrame, cats: DataFrame, min_weeks: int = 4) -> DataFrame:
    """What a product's promotions do to the log units of products of its category, the peer's own log price taken out.

    promo_product, peer_product, effect, std_error, t_value, n_obs, effect_type (halo or cannibalization). Each pair is a least squares
    fit over the peer's weeks from sums of products of one pass: a promotion meets the peers' weeks on category and week,
    the other weeks come from the peer's totals.
    """
    t = panel.join(cats, "stockcode").where("log_units IS NOT NULL AND log_price IS NOT NULL")
    y, p = F.col("log_units"), F.col("log_price")
    all_ = t.groupBy(F.col("stockcode").alias("peer_product")).agg(F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(p).alias("p"), F.sum(y * y).alias("yy"), F.sum(p * p).alias("pp"), F.sum(y * p).alias("yp"))
    on = t.where("is_promo").select(F.col("stockcode").alias("promo_product"), "category", "week").distinct()
    peer = t.select(F.col("stockcode").alias("peer_product"), "category", "week", "log_units", "log_price")
    met = on.join(peer, ["category", "week"]).where("promo_product <> peer_product").groupBy("promo_product", "peer_product").agg(F.count("*").alias("m"), F.sum("log_units").alias("ym"), F.sum("log_price").alias("pm"))
    j = met.join(all_, "peer_product").where((F.col("n") >= min_weeks) & (F.col("m") < F.col("n")))
    n, m = F.col("n"), F.col("m")
    # the treated weeks are an indicator, so its sums of squares and products are counts and sums over them
    j = j.withColumns({"dd": m - m * m / n, "sp": F.col("pp") - F.col("p") * F.col("p") / n, "dp": F.col("pm") - m * F.col("p") / n, "dy": F.col("ym") - m * F.col("y") / n, "py": F.col("yp") - F.col("p") * F.col("y") / n, "sy": F.col("yy") - F.col("y") * F.col("y") / n})
    det = F.col("dd") * F.col("sp") - F.col("dp") * F.col("dp")
    j = j.where(det > 1e-9).withColumn("det", det)
    j = j.withColumns({"effect": (F.col("dy") * F.col("sp") - F.col("py") * F.col("dp")) / F.col("det"), "price": (F.col("py") * F.col("dd") - F.col("dy") * F.col("dp")) / F.col("det")})
    rss = F.greatest(F.lit(0.0), F.col("sy") - F.col("effect") * F.col("dy") - F.col("price") * F.col("py"))
    j = j.where("n > 3").withColumn("std_error", F.sqrt(rss / (n - 3) * F.col("sp") / F.col("det")))
    kind = F.when(F.col("effect") > 0, "halo").otherwise("cannibalization")
    return j.select("promo_product", "peer_product", "effect", "std_error", F.when(F.col("std_error") > 0, F.col("effect") / F.col("std_error")).alias("t_value"), n.alias("n_obs"), kind.alias("effect_type"))


def instrument_elasticity(tx: DataFrame, instrument: Column, min_periods: int = 10, min_variation: float = 0.05) -> DataFrame:
    """Price elasticity per product by two-stage least squares on weekly logs, with the first stage's F.

    Both stages come from sums of products of one pass. The error is that of two-stage least squares, from the residuals of the
    prices as they were. Products with few weeks, little variation of price or instrument or a first stage without slope are left out.
    """
    w = tx.groupBy("stockcode", period_start("date", "W").alias("week")).agg(F.avg("price").alias("p"), F.sum("quantity").alias("q"), F.avg(instrument).alias("z")).where("p > 0 AND q > 0 AND z > 0")
    x, y, z = F.log("p"), F.log("q"), F.log("z")
    names = {"xx": F.regr_sxx(x, x), "yy": F.regr_sxx(y, y), "zz": F.regr_sxx(z, z), "zx": F.regr_sxy(x, z), "zy": F.regr_sxy(y, z), "xy": F.regr_sxy(y, x)}
    g = w.groupBy("stockcode").agg(F.count("*").alias("n_obs"), (F.stddev_samp("p") / F.avg("p")).alias("pv"), (F.stddev_samp("z") / F.avg("z")).alias("zv"), *[c.alias(k) for k, c in names.items()])
    g = g.where((F.col("n_obs") >= min_periods) & (F.col("pv") >= min_variation) & (F.col("zv") >= min_variation) & (F.abs("zx") > 1e-9))
    g = g.withColumns({"elasticity": F.col("zy") / F.col("zx"), "r2": F.col("zx") * F.col("zx") / (F.col("zz") * F.col("xx"))})
    rss = F.greatest(F.lit(0.0), F.col("yy") - 2 * F.col("elasticity") * F.col("xy") + F.col("elasticity") * F.col("elasticity") * F.col("xx"))
    df = F.col("n_obs") - 2
    f = F.col("r2") * df / (1 - F.col("r2"))
    return g.select("stockcode", "elasticity", F.sqrt(rss / df * F.col("zz") / (F.col("zx") * F.col("zx"))).alias("std_error"), f.alias("first_stage_f"), (f < 10).alias("weak_instrument"), "n_obs")


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with entries of at least 0 that add up to 1."""
    u = np.sort(v)[::-1]
    over = u - (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    k = np.flatnonzero(over > 0)[-1]
    return np.maximum(v - (np.cumsum(u)[k] - 1) / (k + 1), 0.0)


def mixture_weights(target: np.ndarray, donors: np.ndarray, tolerance: float = 1e-12, most: int = 200_000) -> np.ndarray:
    """Weights on a simplex whose mix of donor series (a row each) is nearest to a series, by accelerated projected gradient. Raises where it doesn't settle."""
    gram, cross = donors @ donors.T, donors @ target
    step = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-300)
    w = ahead = np.full(len(donors), 1.0 / len(donors))
    speed = 1.0
    for _ in range(most):
        new = simplex(ahead - step * (gram @ ahead - cross))
        if (ahead - new) @ (new - w) > 0:  # against the way it came: start anew
            speed, ahead = 1.0, w
            new = simplex(w - step * (gram @ w - cross))
        nxt = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead, moved = new + (speed - 1) / nxt * (new - w), float(np.abs(new - w).max())
        w, speed = new, nxt
        if moved < tolerance:
            return w
    raise ArithmeticError("mixture weights do not settle")


def synthetic_control(tx: DataFrame, treated: DataFrame, donors: DataFrame, unit: str = "stockcode", pre: int = 20, post: int = 10) -> tuple[DataFrame, DataFrame]:
    """Effects and weights of treated units against mixtures of donor units, each donor taking its turn as a placebo.

    Series are logs of weekly units; the last `post` weeks of all are after the treatment, and a week without sale takes the week before (at
    the start the week after). Weights fit the weeks before. Effects: unit, is_placebo, effect_log, effect_pct, pre_rmse, ratio (of
    the errors after and before) and rank of the ratio among all. A unit's fit is one task over its donors' weeks, so donors are a chosen few.
    Units without `pre` weeks before give no row; without a donor neither.
    """
    u = F.col(unit)
    names = treated.select(u.cast("string").alias("unit")).distinct().withColumn("placebo", F.lit(False)).unionByName(donors.join(treated, unit, "left_anti").select(u.cast("string").alias("unit")).distinct().withColumn("placebo", F.lit(True)))
    names = cut(names)
    weekly = tx.groupBy(u.cast("string").alias("unit"), period_start("date", "W").alias("week")).agg(F.sum("quantity").alias("q")).where("q > 0")
    weeks = tx.select(period_start("date", "W").alias("week")).distinct()
    n = weeks.count()
    if n < pre + post:
        raise ValueError(f"{n} weeks; a synthetic control takes {pre + post} at least")
    weeks = weeks.withColumn("i", F.row_number().over(W.orderBy("week")) - 1)  # a row per week
    series = weekly.join(F.broadcast(weeks), "week").join(names, "unit").groupBy("unit", "placebo").agg(F.collect_list(F.struct("i", F.log("q").alias("y"))).alias("s"))
    # a unit's group holds its own series and those of the donors
    others = series.where("placebo").select(F.col("unit").alias("donor"), F.col("s").alias("d"))
    groups = series.join(others, F.col("unit") != F.col("donor")).select("unit", "placebo", "s", "donor", "d")

    def dense(pairs: list) -> np.ndarray:
        y = pd.Series(np.nan, index=range(n))
        for r in pairs:
            y[r["i"]] = r["y"]
        return y.ffill().bfill().to_numpy()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("donor")
        y, d = dense(rows["s"].iloc[0]), np.stack([dense(x) for x in rows["d"]])
        w = mixture_weights(y[: n - post], d[:, : n - post])
        gap = y - d.T @ w
        before, after = np.sqrt((gap[: n - post] ** 2).mean()), np.sqrt((gap[n - post :] ** 2).mean())
        made = (d.T @ w)[n - post :]
        pct = ((np.exp(y[n - post :]) - np.exp(made)) / np.exp(made)).mean()
        return pd.DataFrame({"unit": rows["unit"].iloc[0], "is_placebo": bool(rows["placebo"].iloc[0]), "effect_log": gap[n - post :].mean(), "effect_pct": pct, "pre_rmse": before, "ratio": after / max(before, 1e-12), "donor": rows["donor"], "weight": w})

    out = cut(groups.groupBy("unit").applyInPandas(fit, "unit string, is_placebo boolean, effect_log double, effect_pct double, pre_rmse double, ratio double, donor string, weight double"))
    effects = out.drop("donor", "weight").distinct()
    ranked = effects.withColumn("rank", F.row_number().over(W.orderBy(F.desc("ratio"), "unit")))  # a row per unit
    return ranked, out.select("unit", "donor", "weight")


def waterfall_with_effect(lines: DataFrame, effect: DataFrame, margin: float = 0.3, cost: float = 0.15) -> DataFrame:
    """One row: promoted revenue split by the two-way effect into what would have been sold anyway and what promotion added, its cost and profit.

    lines have is_promo; effect is a row of two_way_effect.
    """
    t = lines.where("is_promo").agg(F.coalesce(F.sum(revenue()), F.lit(0.0)).alias("promo_revenue")).crossJoin(F.broadcast(effect.select("effect")))
    t = t.withColumn("baseline_revenue", F.col("promo_revenue") / F.exp("effect")).withColumn("incremental_revenue", F.col("promo_revenue") - F.col("baseline_revenue"))
    t = t.withColumns({"promo_cost": F.col("promo_revenue") * cost, "incremental_profit": F.col("incremental_revenue") * margin - F.col("promo_revenue") * cost})
    return t.withColumn("roi", F.when(F.col("promo_cost") > 0, F.col("incremental_profit") / F.col("promo_cost")).otherwise(0.0)).drop("effect")
