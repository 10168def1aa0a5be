"""Around lifetime value: a customer view, checks of the value model's assumptions, and intervals by drawing customers anew."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.scalar import revenue
from ..functions.store import cut
from . import clv as V
from .basket import customer_entropy
from .tree import poisson_weight

#: Draws that have to hold a customer for an interval.
LEAST_DRAWS = 15


def clv_customers(tx: DataFrame, clv: DataFrame, horizon_days: int = 90, annual_rate: float = 0.0) -> DataFrame:
    """One row per customer: what they bought, and what the models of `predict_clv` expect, over the horizon and a year."""
    end = F.broadcast(tx.agg(F.max("date").alias("_end")))
    own = tx.where(revenue() > 0).groupBy("customer_id").agg(F.countDistinct("transaction_id").alias("frequency"), F.sum(revenue()).alias("total_revenue"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    own = own.crossJoin(end).select("customer_id", "frequency", F.datediff("_end", "_b").alias("recency_days"), F.datediff("_b", "_a").alias("customer_lifetime_days"), "total_revenue", (F.col("total_revenue") / F.col("frequency")).alias("avg_order_value"))
    t = clv.select(F.col("customer_id").alias("_id"), "p_alive", "predicted_purchases", F.col("predicted_aov").alias("expected_avg_value"), "predicted_clv", "clv_segment")
    out = own.join(t, F.col("customer_id").cast("string") == F.col("_id")).drop("_id")
    year = F.col("expected_avg_value") * F.col("predicted_purchases") * (365 / horizon_days)
    out = out.withColumns({"clv_12m": year, "clv_12m_discounted": year * V.discount_factor(365, annual_rate)})
    return out.join(customer_entropy(tx).select("customer_id", "entropy", "normalized_entropy"), "customer_id")


def _mean_ranks(t: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Key and the rank of its value, ties at their mean rank."""
    rows = ranked(t.select(key, F.col(value).alias("_v")), "_v", key).select(key, "_v", "rank")
    ties = rows.groupBy("_v").agg(F.avg("rank").alias(name))
    return rows.join(ties, "_v").select(key, name)


def value_independence(tx: DataFrame) -> DataFrame:
    """metric, value: whether a customer's number of purchases says anything about their value, which the value model rules out.

    Correlations over customers with at least two purchases (none under five such customers, 0 where one side doesn't vary); status 0 is
    largely met, 1 partially, 2 violated, by the stronger one (0.2 and 0.4). Stationarity is the share of customers with at
    least three purchases whose mean value of the later half is within half and twice that of the earlier.
    """
    p = cut(tx.where(revenue() > 0).groupBy("customer_id", "transaction_id").agg(F.min("date").alias("date"), F.sum(revenue()).alias("r")))
    c = cut(p.groupBy("customer_id").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("m")).where("n >= 2"))
    r = c.join(_mean_ranks(c, "customer_id", "n", "rn"), "customer_id").join(_mean_ranks(c, "customer_id", "m", "rm"), "customer_id")
    flat = (F.stddev_pop("n") == 0) | (F.stddev_pop("m") == 0)
    both = r.agg(F.count("*").alias("k"), F.when(flat, 0.0).otherwise(F.corr("n", "m")).alias("pearson"), F.when(flat, 0.0).otherwise(F.corr("rn", "rm")).alias("spearman")).where("k >= 5")
    far = F.greatest(F.abs("pearson"), F.abs("spearman"))
    metrics = {"gg_freq_value_pearson": F.col("pearson"), "gg_freq_value_spearman": F.col("spearman"), "gg_independence_status": F.when(far < 0.2, 0.0).when(far < 0.4, 1.0).otherwise(2.0)}
    out = both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])).alias("x")).select("x.*")
    # a customer's purchases in order: one row of dates and values, which their number bounds
    seq = p.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("date", "transaction_id", "r"))).alias("v")).where(F.size("v") >= 3)
    half = F.floor(F.size("v") / 2).cast("int")
    mean = lambda part, n: F.aggregate(part, F.lit(0.0), lambda s, x: s + x["r"]) / n
    seq = seq.select((mean(F.slice("v", half + 1, F.size("v")), F.size("v") - half) / mean(F.slice("v", F.lit(1), half), half)).alias("q"))
    steady = seq.agg(F.avg(F.when(F.col("q").between(0.5, 2.0), 1.0).otherwise(0.0)).alias("value")).where("value IS NOT NULL")
    return out.unionByName(steady.select(F.lit("gg_value_stationarity_pct").alias("metric"), "value"))


def clv_diagnostics(tx: DataFrame) -> DataFrame:
    """metric, value: parameters of both models, customers fitted and in all, and the checks of `value_independence`."""
    s = cut(V.purchase_summary(tx))
    names = ["bgf_r", "bgf_alpha", "bgf_a", "bgf_b", "ggf_p", "ggf_q", "ggf_v"]
    size = s.agg(F.count("*"), F.count_if(F.expr("frequency > 0 AND monetary_value > 0"))).first()
    rows = [*zip(names, (float(v) for v in (*V.fit_bg_nbd(s), *V.fit_gamma_gamma(s))), strict=True), ("n_customers_total", float(size[0])), ("n_customers_fit", float(size[1]))]
    return tx.sparkSession.createDataFrame(rows, "metric string, value double").unionByName(value_independence(tx))


def _draw_weights(draws: int, seed: int) -> list:
    return [poisson_weight(seed, "customer_id", F.lit(d)) for d in range(draws)]


def _spread(counts: DataFrame, draws: int) -> DataFrame:
    """Counted customers with a column of weights a draw as rows of one draw each."""
    return counts.withColumn("n", F.explode(F.array(*[F.struct(F.lit(d).alias("draw"), F.col(f"w{d}").cast("double").alias("w")) for d in range(draws)]))).select("*", "n.draw", "n.w").where("w > 0")


def clv_fits(summary: DataFrame, draws: int, seed: int = 42) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Parameters of both models for each draw that holds repeat customers; in a draw customers count by Poisson weights.

    The draws are weighed in one pass over the customers, each draw is fitted in a task of its own on counts that the
    calendar bounds, and seven numbers a draw reach the driver.
    """
    start = V.fit_bg_nbd(summary)
    sums = [F.sum(w).alias(f"w{d}") for d, w in enumerate(_draw_weights(draws, seed))]
    long = _spread(V.purchase_counts(summary, *sums), draws).select("draw", F.lit(0).alias("side"), F.col("frequency").cast("double").alias("x"), F.col("recency").cast("double").alias("y"), F.col("T").cast("double").alias("z"), "w")
    values = _spread(V.value_counts(summary, *sums), draws).select("draw", F.lit(1).alias("side"), F.col("frequency").cast("double").alias("x"), F.col("m").alias("y"), F.col("log_m").alias("z"), "w")

    def fit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["x", "y", "z"])
        x, y, z, w = (t[c].to_numpy(float) for c in ("x", "y", "z", "w"))
        found = V.bg_nbd_of_counts(x, y, z, w, start) if key[1] == 0 else V.gamma_gamma_of_counts(x, y, z, w)
        return pd.DataFrame({"draw": [key[0]], "side": [key[1]], "p": [found.tolist()]})

    # as many tasks as fits: small rows would else be packed into one
    got = long.unionByName(values).repartition(2 * draws, "draw", "side").groupBy("draw", "side").applyInPandas(fit, "draw int, side int, p array<double>").collect()
    by = {(r["draw"], r["side"]): np.array(r["p"]) for r in got}
    return {d: (by[d, 0], by[d, 1]) for d in range(draws) if (d, 0) in by and (d, 1) in by}


def clv_intervals(tx: DataFrame, horizon_days: int = 90, draws: int = 60, level: float = 0.95, seed: int = 42) -> DataFrame:
    """customer_id, predicted_clv, ci_lower, ci_upper, n_draws, ci_status: the value under the models of all customers, and its spread over those of draws.

    Draws that hold a customer count for them; under 15 of them the bounds are null and the status is insufficient_resamples.
    """
    s = cut(V.purchase_summary(tx))
    full, fits, base = (V.fit_bg_nbd(s), V.fit_gamma_gamma(s)), clv_fits(s, draws, seed), V.mean_value(s)
    held = F.array(*[w > 0 for w in _draw_weights(draws, seed)])
    schema = "customer_id string, predicted_clv double, ci_lower double, ci_upper double, n_draws int, ci_status string"
    tail = (1 - level) / 2 * 100

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, last, t, m = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=float) for i in range(1, 5))
            value = lambda f: np.prod(V.expected(*f, x, last / 7, t / 7, m, horizon_days / 7, base)[1:], axis=0)
            one = value(full)
            drawn = np.stack([value(f) for f in fits.values()]) if fits else np.empty((0, len(x)))
            mask = np.array(batch.column(5).to_pylist(), dtype=bool).reshape(len(x), draws).T[list(fits)]
            n = mask.sum(axis=0)
            ok = n >= LEAST_DRAWS
            low, high = np.full(len(x), np.nan), np.full(len(x), np.nan)
            if ok.any():
                low[ok], high[ok] = np.nanpercentile(np.where(mask, drawn, np.nan)[:, ok], [tail, 100 - tail], axis=0)
            status = np.where(ok, "valid", "insufficient_resamples")
            cols = [batch.column(0), pa.array(one), pa.array(low, from_pandas=True), pa.array(high, from_pandas=True), pa.array(n, pa.int32()), pa.array(status.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    rows = s.select(F.col("customer_id").cast("string").alias("customer_id"), "frequency", "recency", "T", "monetary_value", held.alias("held"))
    return rows.mapInArrow(score, schema)
