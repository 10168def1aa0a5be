import random

import numpy as np
from pyspark.sql import functions as F

from shelfline.functions.ranks import quantiles, ranked
from shelfline.functions.store import once, stored


def test_ranks_with_equal_values(spark):
    rng = random.Random(1)
    rows = [(i, 1.0 if i % 10 else rng.random() * 3, f"c{rng.randrange(10**6):06d}-{i}") for i in range(8000)] + [(-1, None, "x")]
    df = spark.createDataFrame(rows, "i int, v double, name string").repartition(7)
    got = ranked(df, "v", "name").collect()
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    assert {r.i: r["rank"] for r in got} == want and {r.n for r in got} == {8001}
    # nine in ten share one value and are spread all the same
    sizes = {}
    for r in got:
        sizes[r.range] = sizes.get(r.range, 0) + 1
    assert len(sizes) >= 3 and max(sizes.values()) <= 2 * len(got) / len(sizes)
    assert ranked(df.limit(0), "v", "name").count() == 0


def test_quantiles(spark):
    rng = random.Random(2)
    rows = [("a", rng.choice([1.0, 2.0, 2.0, 5.5])) for _ in range(501)] + [("b", rng.random()) for _ in range(40)] + [("c", 3.0), ("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.lo, r.mid) for r in quantiles(df, "v", {"lo": 0.2, "mid": 0.5}, "k").collect()}
    for k in "abc":
        v = [x for g, x in rows if g == k and x is not None]
        assert np.allclose(got[k], np.quantile(v, [0.2, 0.5]))
    assert set(got) == {"a", "b", "c"}
    every = [x for _, x in rows if x is not None]
    assert np.allclose(quantiles(df, "v", {"q": 0.8}).first().q, np.quantile(every, 0.8))
    assert quantiles(df.limit(0), "v", {"q": 0.8}).first().q is None and quantiles(df.limit(0), "v", {"q": 0.8}, "k").count() == 0


def test_shared_parts_are_built_once(spark):
    tx, calls = spark.range(5), []

    def build():
        calls.append(1)
        return tx.select((F.col("id") * 2).alias("b"))

    assert once(tx, "b", build, stored).count() == once(tx, "b", build, stored).count() == 5 and len(calls) == 1
    assert once(spark.range(3), "b", build).count() == 5 and len(calls) == 2
