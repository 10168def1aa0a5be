"""Intervals by resampling customers: each draw weighs customers by a Poisson weight, the same in every part of a statistic."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import revenue
from ..functions.store import cut
from .switching import customer_sequences
from .tree import poisson_of, unit_hash


def _drawn_sums(t: DataFrame, keys: list[str], value: Column, resamples: int, seed: int, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys, draw, total: the sum of value times the weight of the customer in the draw. Draw 0 has all, once.

    A row's weights are taken once, before `spread` makes rows of keys and value of it. These don't meet draws: a sum is kept for each.
    """
    draws = range(1, resamples + 1)
    u = t.withColumns({f"_u{d}": unit_hash(seed, "customer_id", F.lit(d)) for d in draws})
    u = spread(u.withColumn("_w", F.array(F.lit(1), *[poisson_of(F.col(f"_u{d}")) for d in draws])).drop(*[f"_u{d}" for d in draws]))
    w = lambda d: F.get("_w", F.lit(d))
    sums = u.groupBy(*keys).agg(*[F.sum(F.when(w(d) > 0, value * w(d))).alias(f"_s{d}") for d in (0, *draws)])
    cells = F.array(*[F.struct(F.lit(d).alias("draw"), F.col(f"_s{d}").alias("total")) for d in (0, *draws)])
    return sums.select(*keys, F.inline(cells)).where("total IS NOT NULL")


def _drawn_rates(tx: DataFrame, resamples: int, seed: int, window_days: int = 90, min_transactions: int = 3) -> DataFrame:
    """from_product, to_product, draw, n, pct: moves between consecutive baskets of each customer, weighed by draw."""

    def moves(seq: DataFrame) -> DataFrame:
        one = seq.select("_w", F.explode("prev_products").alias("from_product"), "products")
        return one.select("_w", "from_product", F.explode("products").alias("to_product")).where("from_product <> to_product")

    seq = customer_sequences(tx, window_days, min_transactions)
    n = _drawn_sums(seq, ["from_product", "to_product"], F.lit(1), resamples, seed, moves).withColumnRenamed("total", "n")
    return n.withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy("from_product", "draw")))


def _band(t: DataFrame, value: str, keys: list[str], resamples: int, level: float) -> DataFrame:
    """Per key: the value of draw 0 as estimate, and quantiles and deviation of the other draws, in which an absent key counts 0."""
    tail = (1 - level) / 2
    seen = F.array_agg(F.when(F.col("draw") > 0, F.col(value)))
    g = t.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col(value))).alias("estimate"), seen.alias("_v"))
    # as many entries as draws
    g = g.where("estimate IS NOT NULL").withColumn("_v", F.array_sort(F.concat("_v", F.array_repeat(F.lit(0.0), F.lit(resamples) - F.size("_v")))))

    def at(q: float):
        place = (resamples - 1) * q
        low, part = int(place), place - int(place)
        return F.get("_v", F.lit(low)) * (1 - part) + F.get("_v", F.lit(min(low + 1, resamples - 1))) * part

    mean = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / resamples
    spread = F.aggregate(F.transform("_v", lambda x: F.pow(x - F.col("_m"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    g = g.withColumn("_m", mean)
    return g.select(*keys, "estimate", at(tail).alias("ci_lower"), at(1 - tail).alias("ci_upper"), F.sqrt(spread / max(resamples - 1, 1)).alias("std_error"), F.lit(resamples).alias("n_resamples"))


def switching_intervals(tx: DataFrame, resamples: int = 200, level: float = 0.95, window_days: int = 90, min_transactions: int = 3, seed: int = 42) -> DataFrame:
    """Each pair's share of the moves from its first product, with an interval and error over draws of customers."""
    return _band(_drawn_rates(tx, resamples, seed, window_days, min_transactions), "pct", ["from_product", "to_product"], resamples, level)


def transference_intervals(tx: DataFrame, max_pairs: int = 10, resamples: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The largest demand transferences (share of moves x revenue share of the first product) with intervals over draws of customers.

    max_pairs is the length of the report, by estimate, ties by names. Rates and revenue of a draw come from the same customers.
    """
    # one row a customer, of at most as many entries as there are products
    sold = tx.select("customer_id", F.col("stockcode").alias("from_product"), revenue().alias("r")).repartition("customer_id").groupBy("customer_id", "from_product").agg(F.sum("r").alias("r"))
    sold = sold.groupBy("customer_id").agg(F.collect_list(F.struct("from_product", "r")).alias("sold"))
    own = _drawn_sums(sold, ["from_product"], F.col("r"), resamples, seed, lambda t: t.select("_w", F.inline("sold"))).withColumnRenamed("total", "r")
    own = cut(own.withColumn("s", F.col("r") / F.sum("r").over(W.partitionBy("draw"))))
    rates = cut(_drawn_rates(tx, resamples, seed))
    now = rates.where("draw = 0").join(own.where("draw = 0"), ["from_product", "draw"]).withColumn("v", F.round(F.col("pct") * F.col("s"), 12))
    top = F.broadcast(now.orderBy(F.desc("v"), "from_product", "to_product").limit(max_pairs).select("from_product", "to_product"))
    # the share is of all moves from the product, so only its pairs are cut to the report
    t = rates.join(top, ["from_product", "to_product"], "left_semi").join(own, ["from_product", "draw"]).withColumn("v", F.col("pct") * F.col("s"))
    return _band(t, "v", ["from_product", "to_product"], resamples, level)
