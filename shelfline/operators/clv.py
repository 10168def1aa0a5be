"""Customer lifetime value: BG/NBD for purchases, Gamma-Gamma for their value.

Both likelihoods are fitted over all customers, on tables whose size does not follow their number:
repeat purchases, week of the last one and age in weeks for the first; repeat purchases and fine bins
of the value's logarithm, with each bin's means, for the second. Scoring runs over all customers.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..functions.scalar import revenue
from ..functions.store import cut

#: Bins of ln(value) a unit: values of a bin differ by 0.2 % at most.
VALUE_BINS = 500
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(x).astype(float)


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder-Mead on a handful of parameters."""
    n = len(start)
    points = [start] + [start + 0.5 * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-9 * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        tried = middle + (middle - points[-1])
        v = f(tried)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            near = middle + 0.5 * (points[-1] - middle)
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def purchase_summary(tx: DataFrame) -> DataFrame:
    """customer_id, frequency (days with a purchase after the first), recency and T in days, monetary_value (mean revenue of those days)."""
    last = F.broadcast(tx.agg(F.to_date(F.max("date")).alias("_end")))
    days = tx.groupBy("customer_id", F.to_date("date").alias("d")).agg(F.sum(revenue()).alias("r"))
    one = days.groupBy("customer_id").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n"), F.sum("r").alias("s"), F.min(F.struct("d", "r"))["r"].alias("first"))
    one = one.crossJoin(last)
    value = F.when(F.col("n") > 1, (F.col("s") - F.col("first")) / (F.col("n") - 1)).otherwise(0.0)
    return one.select("customer_id", (F.col("n") - 1).alias("frequency"), F.datediff("b", "a").alias("recency"), F.datediff("_end", "a").alias("T"), value.alias("monetary_value"))


def _levels(x: np.ndarray) -> Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]:
    """Applies a function of the numbers of purchases, which are few, once to each and not once to each row."""
    u, at = np.unique(x, return_inverse=True)
    return lambda f: f(u)[at]


def bg_nbd_loss(p: np.ndarray, x, tx, t, w, of=None) -> float:
    """of: _levels(x), where it is known."""
    r, alpha, a, b = np.exp(p)
    of = of or _levels(x)
    one = of(lambda x: lgamma(r + x)) - math.lgamma(r) + r * np.log(alpha)
    two = math.lgamma(a + b) + of(lambda x: lgamma(b + x)) - math.lgamma(b) - of(lambda x: lgamma(a + b + x))
    alive = -(r + x) * np.log(alpha + t)
    gone = np.where(x > 0, np.log(a) - np.log(np.maximum(b + np.maximum(x, 1) - 1, 1e-300)) - (r + x) * np.log(alpha + tx), -np.inf)
    like = one + two + np.logaddexp(alive, gone)
    return float(-(w * like).sum() / w.sum() + 0.001 * (np.exp(p) ** 2).sum() / 100)


def purchase_counts(summary: DataFrame, *sums) -> DataFrame:
    """Customers by repeat purchases, week of the last one and age in weeks; n counts them, or else the given sums."""
    week = lambda c: F.round(F.col(c) / 7).cast("int")
    return summary.groupBy("frequency", week("recency").alias("recency"), week("T").alias("T")).agg(*(sums or (F.count("*").alias("n"),)))


def value_counts(summary: DataFrame, *sums) -> DataFrame:
    """Customers with repeat purchases by their number and bin of ln(value), with each bin's means."""
    log = F.ln("monetary_value")
    bins = summary.where("frequency > 0 AND monetary_value > 0").groupBy("frequency", F.floor(log * VALUE_BINS).alias("bin"))
    return bins.agg(F.avg("monetary_value").alias("m"), F.avg(log).alias("log_m"), *(sums or (F.count("*").alias("n"),)))


def bg_nbd_of_counts(x, tx, t, w, start: np.ndarray | None = None) -> np.ndarray:
    """r, alpha, a, b from counted customers; start is a known fit nearby."""
    if not len(x) or not w.sum():
        return np.ones(4)
    of = _levels(x)
    return np.exp(minimise(lambda p: bg_nbd_loss(p, x, tx, np.maximum(t, tx), w, of), np.zeros(4) if start is None else np.log(start)))


def gamma_gamma_of_counts(x, m, log_m, w) -> np.ndarray:
    """p, q, v from counted customers."""
    if w.sum() < 2:
        return np.array([1.0, 2.0, 1.0])
    scale = (w * m).sum() / w.sum()
    m, log_m = m / scale, log_m - math.log(scale)
    of = _levels(x)

    def loss(z):
        p, q, v = np.exp(z)
        like = of(lambda x: lgamma(p * x + q)) - of(lambda x: lgamma(p * x)) - math.lgamma(q) + q * np.log(v) + (p * x - 1) * log_m + p * x * np.log(x) - (p * x + q) * np.log(x * m + v)
        return float(-(w * like).sum() / w.sum() + 0.001 * (np.exp(z) ** 2).sum() / 100)

    p, q, v = np.exp(minimise(loss, np.zeros(3)))
    return np.array([p, q, v * scale])


def fit_bg_nbd(summary: DataFrame) -> np.ndarray:
    """r, alpha, a, b with time in weeks."""
    g = purchase_counts(summary).toPandas()
    return bg_nbd_of_counts(*(g[c].to_numpy(float) for c in ("frequency", "recency", "T", "n")))


def fit_gamma_gamma(summary: DataFrame) -> np.ndarray:
    """p, q, v over all customers with repeat purchases, counted by purchases and bin of value."""
    g = value_counts(summary).orderBy("frequency", "bin").toPandas()
    return gamma_gamma_of_counts(*(g[c].to_numpy(float) for c in ("frequency", "m", "log_m", "n")))


def _hyp2f1(a, b, c, z, terms: int = 1_000_000):
    """The hypergeometric series for 0 <= z < 1. Raises where it doesn't settle."""
    total, term, open_ = np.ones_like(z), np.ones_like(z), np.arange(len(z))
    for k in range(terms):
        term[open_] *= (a[open_] + k) * (b[open_] + k) / ((c[open_] + k) * (k + 1)) * z[open_]
        total[open_] += term[open_]
        # terms grow before they fall: a small one counts once their ratio stays under 1
        ratio = (a[open_] + k) * (b[open_] + k) / ((c[open_] + k) * (k + 1)) * z[open_]
        open_ = open_[(np.abs(term[open_]) >= 1e-12 * np.abs(total[open_])) | (ratio >= 1)]
        if not len(open_):
            return total
    raise ArithmeticError("the hypergeometric series does not settle")


def expected(bg: np.ndarray, gg: np.ndarray, x, tx, t, m, horizon: float, mean_value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance to be alive, purchases over the horizon and value of one, for arrays of customers with times in weeks.

    mean_value is the base where the fit of values has no mean (q <= 1).
    """
    r, alpha, a, b = (float(p) for p in bg)
    p, q, v = (float(y) for y in gg)
    odds = np.where(x > 0, a / np.maximum(b + np.maximum(x, 1) - 1, 1e-300) * ((alpha + t) / (alpha + tx)) ** (r + x), 0.0)
    alive = 1 / (1 + odds)
    # the mean count for a near 1 goes through a - 1 = 0; step off it
    a1 = a if abs(a - 1) > 1e-6 else a + 1e-6
    z = horizon / (alpha + t + horizon)
    f = _hyp2f1(r + x, b + x, a1 + b + x - 1, z)
    n = (a1 + b + x - 1) / (a1 - 1) * (1 - ((alpha + t) / (alpha + t + horizon)) ** (r + x) * f) * alive
    weight = p * x / np.maximum(p * x + q - 1, 1e-9) if q > 1 else np.ones_like(x)
    base = v * p / (q - 1) if q > 1 else mean_value
    return alive, np.maximum(n, 0), np.where(x > 0, (1 - weight) * base + weight * m, base)


def discount_factor(days: int, annual_rate: float) -> float:
    """What a purchase within the days is worth now, with purchases spread evenly over them."""
    rate = annual_rate / 365
    return 1.0 if rate == 0 else (1 - (1 + rate) ** -days) / (rate * days)


def mean_value(summary: DataFrame) -> float:
    """Mean value over customers with repeat purchases; 0 without any."""
    return summary.where("frequency > 0").agg(F.avg("monetary_value")).first()[0] or 0.0


def predict_clv(tx: DataFrame, horizon_days: int = 90, annual_rate: float = 0.0) -> DataFrame:
    """Per customer: chance to be alive, expected purchases and value over the horizon, and the quartile of the value."""
    s = cut(purchase_summary(tx))
    bg, gg = fit_bg_nbd(s), fit_gamma_gamma(s)
    base, discount = mean_value(s), discount_factor(horizon_days, annual_rate)
    schema = "customer_id string, frequency long, recency int, T int, monetary_value double, p_alive double, predicted_purchases double, predicted_aov double, predicted_clv double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, last, t, m = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=float) for i in range(1, 5))
            alive, n, aov = expected(bg, gg, x, last / 7, t / 7, m, horizon_days / 7, base)
            cols = [batch.column(i) for i in range(5)] + [pa.array(y) for y in (alive, n, aov, n * aov * discount)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    out = s.select(F.col("customer_id").cast("string"), "frequency", "recency", "T", "monetary_value").mapInArrow(score, schema)
    out = cut(out)
    edges = F.broadcast(quantiles(out, "predicted_clv", {"_a": 0.25, "_b": 0.5, "_c": 0.75}))
    value = F.col("predicted_clv")
    label = F.when(value <= F.col("_a"), "Low").when(value <= F.col("_b"), "Medium").when(value <= F.col("_c"), "High").otherwise("Very High")
    return out.crossJoin(edges).withColumn("clv_segment", label).drop("_a", "_b", "_c")
