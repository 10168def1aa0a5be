import collections
import math

import numpy as np

from shelfline.llm import neighbours as N


def brute(rows, every=20, k=20):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = (x * q).sum(axis=1)
            out[i] = sorted((-a, b) for a, b in zip(s.tolist(), ids.tolist()) if b != i)[:k]
    return out


def recall(got, want):
    found = collections.defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
    return np.mean([len(found[q] & {v for _, v in w}) / max(1, len(w)) for q, w in want.items()])


def test_recall_and_ranks(spark):
    r = np.random.default_rng(4)
    for scale in (False, True):
        rows = []
        for i in range(3000):
            v = r.normal(size=16)
            v *= (r.random() + 0.2 if scale else 1) / np.linalg.norm(v)
            rows.append((i, [float(np.float32(a)) for a in v]))
        rows += [(10000 + i, rows[40][1]) for i in range(300)]
        odd = [(20000, None), (20020, [0.0] * 16), (20040, [None] + [1.0] * 15), (20060, [math.nan] * 16), (None, rows[1][1]), (20080, []), (20100, [math.inf] * 16)]
        df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, rank string")
        got = N.nearest(df, df.where("vec_id % 20 = 0")).collect()
        want = brute(rows)
        assert recall(got, want) >= 0.9
        by = collections.defaultdict(list)
        for x in sorted(got, key=lambda x: x.rank):
            by[x.query_id].append(x)
        assert set(by) == set(want)
        vectors = dict(rows)
        for q, own in by.items():
            assert [x.rank for x in own] == list(range(1, len(own) + 1)) and len({x.vec_id for x in own}) == len(own) and q not in {x.vec_id for x in own}
            assert [(-x.score, x.vec_id) for x in own] == sorted((-x.score, x.vec_id) for x in own)
            assert all(abs(x.score - np.dot(vectors[q], vectors[x.vec_id])) < 1e-12 for x in own)
        assert [x.vec_id for x in by[40]] == list(range(10000, 10020))


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in N.nearest(df, df.where("vec_id % 20 = 0")).collect()} == {(0, 1), (0, 20), (20, 0), (20, 1)}
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0
    assert N.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_recall_on_the_given_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert recall(N.op3_neighbours(spark, d).collect(), brute(rows)) >= 0.9


def test_clusters_are_found_with_few_comparisons(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(150, 24))
    x = np.repeat(centres, 40, axis=0) + 0.15 * r.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = N.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert recall(got, brute(rows)) >= 0.9
    compared = {g.query_id: g.compared for g in got}
    assert len(compared) == 300 and np.mean(list(compared.values())) < 0.35 * len(rows)


def test_slices_and_ids_with_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE_ROWS", 50)
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(400, 6)), 5 + 0.01 * r.normal(size=(400, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (3, [9.0] * 6)], "vec_id long, embedding array<double>")
    got = N.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert recall(got, brute(rows)) >= 0.9
    assert all(len({g.vec_id for g in got if g.query_id == q}) == 20 for q in {g.query_id for g in got})
    assert all(abs(g.score - np.dot(x[400], [9.0] * 6)) < 1e-9 for g in got if g.query_id == 400 and g.vec_id == 3)
