import numpy as np
import pyarrow as pa

from shelfline.llm import quality as Q


def test_linear_time_identity():
    column = pa.chunked_array([pa.array(["the cat sat on the mat", "", "One two!\nTHREE 4", None])])
    bucket, words, weight, stats = Q.features(column)
    r = np.random.default_rng(0)
    size = Q.BUCKETS + Q.STATISTICS
    m = Q.FactorMachine(0.3, r.normal(size=size), r.normal(size=(size, Q.FACTORS)), stats.mean(0), np.maximum(stats.std(0), 1e-3))
    got, _, x = Q.margin(m, bucket, words, weight, stats)
    for d in range(4):
        own = [(int(b), weight[d]) for b in bucket[words[d] : words[d + 1]]] + [(Q.BUCKETS + i, x[d, i]) for i in range(Q.STATISTICS)]
        want = m.bias + sum(m.weight[i] * v for i, v in own)
        want += sum(m.factor[i] @ m.factor[j] * v * u for k, (i, v) in enumerate(own) for j, u in own[k + 1 :])
        assert np.isclose(got[d], want)


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op10_quality(spark, d)
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    rows = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (2, None, 2), (3, "", 3), (4, "word " * 50000, 4), (4, "x", 4)], "doc_id long, text string, y int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (1, None), (2, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    for labels in (none, some):
        m = Q.fit_quality(docs, labels)
        assert docs.withColumn("s", Q.score(spark, m, "text")).where("s IS NULL").count() == 0
    assert docs.limit(0).withColumn("s", Q.score(spark, m, "text")).count() == 0


def test_columns_named_like_the_result(spark, tmp_path):
    d = f"file://{tmp_path}"
    texts = ["good words here", None, "", "buy now buy now", "good words here"]
    docs = spark.createDataFrame([(i, t, "s", 9, "p") for i, t in enumerate(texts)] + [(0, texts[0], "s", 9, "p")], "doc_id long, text string, score string, held_out int, predicted string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 5), (3, 0, 5), (4, 1, 5)], "doc_id long, quality int, score int").write.parquet(f"{d}/labels.parquet")
    out = Q.op10_quality(spark, d)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and sorted(r.doc_id for r in rows) == [0, 0, 1, 2, 3, 4]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    # repeated rows, and equal texts of other ids, have one score
    assert len({r.score for r in rows if r.doc_id in (0, 4)}) == 1


def test_fit_does_not_depend_on_the_order_of_equal_rows(spark):
    rows = [(i, f"word{i % 3} and more", i % 2) for i in range(40)]
    fits = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, quality int").repartition(3)
        m = Q.fit_quality(df.select("doc_id", "text"), df.select("doc_id", "quality"))
        fits.append(m.weight)
    assert np.allclose(fits[0], fits[1])
