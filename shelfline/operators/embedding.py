"""Product embeddings by matrix factorisation of customers and products, and nearest products by blocks."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.store import cut, stored

#: Products of a block; two blocks meet in one task.
BLOCK = 1024
#: Products up to which a round is a pass over customers that sends sums by product; a task holds such a sum for each.
FEW = 512
#: Customers of a task in such a pass, and of one step within it.
CUSTOMERS, STEP = 20_000, 1024


def product_embeddings(tx: DataFrame, dimension: int = 32, rounds: int = 10, regularisation: float = 0.05, confidence: float = 10.0, seed: int = 42) -> DataFrame:
    """stockcode, embedding: unit vectors from the factors of who bought what, weighed by the number of baskets.

    Alternating least squares with implicit preferences. Ids are places in the order of names, so that one seed gives the same
    factors over the same lines. Null customers and products are left out. Up to FEW products, the rounds are those of rounds_by_customer.
    """
    lines = tx.where("customer_id IS NOT NULL AND stockcode IS NOT NULL").select("customer_id", "stockcode", "transaction_id").repartition("customer_id", "stockcode")
    n = stored(lines.groupBy("customer_id", "stockcode").agg(F.countDistinct("transaction_id").cast("float").alias("n")))
    code = lambda c: ranked(n.select(c).distinct(), c).select(c, F.col("rank").cast("int").alias(f"{c}_i"))
    products = cut(code("stockcode"))
    als = ALS(rank=dimension, maxIter=rounds, regParam=regularisation, alpha=confidence, implicitPrefs=True, nonnegative=False, seed=seed, userCol="customer_id_i", itemCol="stockcode_i", ratingCol="n", coldStartStrategy="nan")
    if products.count() <= FEW:
        factors = rounds_by_customer(n, cut(code("customer_id")), products, als)
    else:
        cells = n.join(code("customer_id"), "customer_id").join(products, "stockcode")
        cells = cells.repartition("customer_id_i").sortWithinPartitions("customer_id_i", "stockcode_i")
        factors = als.fit(cells).itemFactors
    size = F.sqrt(F.aggregate("features", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    unit = F.transform("features", lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("double"))
    return factors.join(products, F.col("id") == F.col("stockcode_i")).select("stockcode", unit.alias("embedding"))


def _sums(d: int, k: int, alpha: float, weight: float, y: np.ndarray | None):
    """Of a task's customers: i, v, for each product the matrix, right side and number of customers that its next factors need.

    y: the products' factors, from which a customer's are found; without them they are read.
    """
    flat = None if y is None else (y[:, :, None] * y[:, None, :]).reshape(k, d * d)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, every = np.zeros((k, d * d + d + 1)), np.zeros((d, d))
        for batch in batches:
            for part in (batch.slice(at, STEP) for at in range(0, len(batch), STEP)):
                many = part["i"].value_lengths().to_numpy()
                m = len(many)
                over = np.zeros((m, k))
                over[np.repeat(np.arange(m), many), part["i"].flatten().to_numpy()] = alpha * part["n"].flatten().to_numpy()
                has = over > 0
                if y is None:
                    x = part["features"].flatten().to_numpy().reshape(m, d).astype(float)
                else:
                    a = (over @ flat).reshape(m, d, d) + y.T @ y + weight * np.maximum(has.sum(axis=1), 1)[:, None, None] * np.eye(d)
                    x = np.linalg.solve(a, ((over + has) @ y)[:, :, None])[:, :, 0].astype(np.float32).astype(float)
                total[:, : d * d] += over.T @ (x[:, :, None] * x[:, None, :]).reshape(m, d * d)
                total[:, d * d : -1] += (over + has).T @ x
                total[:, -1] += has.sum(axis=0)
                every += x.T @ x
        total[:, : d * d] += every.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(total.ravel(), d * d + d + 1).cast(pa.list_(pa.float64()))], ["i", "v"])

    return go


def rounds_by_customer(n: DataFrame, customers: DataFrame, products: DataFrame, als: ALS) -> DataFrame:
    """id, features: the item factors of als.fit, but for the last digits of a float; for few products, of any number of customers.

    n: customer_id, stockcode, n; customers and products: their ids as customer_id_i and stockcode_i, from 1. A round is a pass over the customers: each one's
    factors come from those of the products and go into sums by product, so that no customer's factors are sent or kept. A product's next factors
    are solved where its sums meet; `rank` numbers for each product pass through the driver. A customer's first factors are those of als, which follow from the ids and the seed.
    Cells of 0 baskets (of null ones) weigh nothing and don't count for the regularisation, as in als.
    """
    d, alpha, weight, k = als.getRank(), als.getAlpha(), als.getRegParam(), products.count()
    start = als.copy({als.maxIter: 0}).fit(customers.select("customer_id_i", (F.col("customer_id_i") % 100).alias("stockcode_i"), F.lit(1.0).cast("float").alias("n"))).userFactors
    cell = F.struct((F.col("stockcode_i") - 1).alias("i"), "n")
    bought = n.join(F.broadcast(products), "stockcode").select("customer_id", cell.alias("c")).repartition("customer_id").groupBy("customer_id").agg(F.collect_list("c").alias("c"))
    rows = bought.join(customers, "customer_id").join(start, F.col("customer_id_i") == F.col("id")).select("c.i", "c.n", "features")
    rows = cut(rows.repartition(-(-customers.count() // CUSTOMERS)))

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        v = np.sum(np.stack(t["v"].to_numpy()), axis=0)
        x = np.linalg.solve(v[: d * d].reshape(d, d) + weight * max(v[-1], 1) * np.eye(d), v[d * d : -1])
        return pd.DataFrame({"id": [int(t["i"].iloc[0]) + 1], "features": [x.astype(np.float32)]})

    y = None
    for _ in range(als.getMaxIter()):
        sums = (rows if y is None else rows.drop("features")).mapInArrow(_sums(d, k, alpha, weight, y), "i int, v array<double>")
        found = sorted(sums.groupBy("i").applyInPandas(solve, "id int, features array<float>").collect())
        y = np.array([r.features for r in found])
    return n.sparkSession.createDataFrame(found, "id int, features array<float>")


def nearest_products(embeddings: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """product, neighbor, distance (cosine), rank: each product's k nearest others, ties to the name that sorts first.

    Products are dealt into blocks; a task compares one block with another and passes on the k best of each product.
    Null embeddings are left out, products count once.
    """
    rows = cut(embeddings.where("stockcode IS NOT NULL AND embedding IS NOT NULL").groupBy("stockcode").agg(F.min("embedding").alias("v")))
    blocks = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("stockcode"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = rows.select(own.alias("l"), every.alias("r"), "stockcode", "v")
    right = rows.select(every.alias("l"), own.alias("r"), "stockcode", "v")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"product": [], "neighbor": [], "distance": []})
        b = b.sort_values("stockcode")
        x, y = (np.stack(t["v"].to_numpy()) for t in (a, b))
        names = b["stockcode"].to_numpy()
        d = np.round(1 - x @ y.T, 9)
        d[a["stockcode"].to_numpy()[:, None] == names[None, :]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(a)), order.shape[1])
        j = order.ravel()
        ok = np.isfinite(d[i, j])
        return pd.DataFrame({"product": a["stockcode"].to_numpy()[i[ok]], "neighbor": names[j[ok]], "distance": d[i[ok], j[ok]]})

    met = left.groupBy("l", "r").cogroup(right.groupBy("l", "r")).applyInPandas(best, "product string, neighbor string, distance double")
    return met.withColumn("rank", F.row_number().over(W.partitionBy("product").orderBy("distance", "neighbor"))).where(F.col("rank") <= k)
