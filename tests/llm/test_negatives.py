import math
import random

import duckdb
import numpy as np

from shelfline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, score string, g int"


def expected(rows, every=50):
    """By plain Python integers; rows of unique ids."""
    ok = {i: (y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, v) in ok.items():
        if a % every:
            continue
        by = sorted((-dot(v, w), b, y == label) for b, (y, w) in ok.items() if b != a)
        for minus, p, _ in [x for x in by if x[2]][:5]:
            fit = [x for x in by if not x[2] and 50 * -minus <= 100 * -x[0] <= 95 * -minus][:3]
            out |= {(a, p, k + 1, x[1], -minus, -x[0]) for k, x in enumerate(fit)}
    return out


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    return {tuple(r) for r in N.hard_negatives(df, "vec_id % 50 = 0").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    for name, value in (("ANCHORS", 3), ("ROWS", 40), ("SLICE", 150)):
        monkeypatch.setattr(N, name, value)
    # clusters, so that bounds decide, and one vector that a third of the rows have
    centres = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(12)]
    rows = [(i - 100, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)] if i % 3 else centres[0], rng.randrange(4)) for i in range(600)]
    want = expected(rows)
    assert len(want) > 40
    for dense in (0.05, 2.0):
        monkeypatch.setattr(N, "DENSE", dense)
        assert mined(spark, rows) == want


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.randint(0, 9))], rng.randrange(3)) for i in range(0, 500, 5)]
    rows += [(None, [1.0], 1), (1001, None, 1), (1050, [1.0], None), (1002, [None, 1.0], 0), (1003, [float("nan")], 0), (1100, [float("inf")], 0), (1150, [0.5] * 3000, 1), (1004, [0.5] * 2900, 1), (1006, [0.4] * 2900, 2), (1200, [9.0], 77)]
    want = expected(rows)
    assert any(x[0] == 1150 for x in want)
    assert mined(spark, rows) == want
    assert mined(spark, rows + rows[:50]) == want
    assert mined(spark, []) == set() and mined(spark, [(50, [1.0], 1)]) == set()
    # huge components: exact integers, not doubles
    big = [(i, [float(2**28) + rng.randrange(2**20), 3.0 * i], i % 2) for i in range(40, 70)]
    assert mined(spark, big) == expected(big)
    assert mined(spark, [(50, [3e38], 1), (51, [3e38], 1), (52, [1e-3], 2)]) == set()


def test_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (50, 32))
    a = N.Side(np.arange(50), np.zeros(50), x)
    exact = x @ x.T
    for m, d in a.sums:
        assert (m @ m.T + d @ d.T + 1e-6 >= exact).all() and (m @ m.T - d @ d.T - 1e-6 <= exact).all()


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    rel = con.execute(N.OP12_SQL)
    names = [x[0] for x in rel.description]
    want = sorted(rel.fetchall())
    assert len(want) > 50
    assert sorted(tuple(r[n] for n in names) for r in N.op12_hard_negatives(spark, "/root/testdata/sf0.01").collect()) == want
