import corpus_pipeline as P
from shelfline.llm.pieces import decode, load_model, model_path

EN = "the cat sat on the mat and then it went out into the garden with the other cats while rain fell softly over all the old houses near the river bank"
DE = "der hund ging durch den garten und dann wieder zu dem haus in der kleinen strasse wo viele kinder mit einem roten ball vor der alten schule spielten"


def test_stages_take_effect(spark, tmp_path):
    words = EN.split()
    bench = "which of these numbers is the largest prime below one hundred and how would you show it"
    rows = [
        (1, EN, "en"), (2, EN.upper() + "!", "en"), (3, EN.replace("softly", "gently") + " " + " ".join(f"tail{i} the cat" for i in range(120)), "en"),
        (4, DE, "de"), (5, "123 456", "en"), (6, None, "en"), (7, "people say " + bench.replace("largest", "biggest") + " in the other room and the garden", "en"),
        (8, " ".join(reversed(words)) + " and it rained on the mat", None), (9, "", "de"), (None, "another text about the garden and the river that has no number at all", "en"),
    ]
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{d}/{name.replace(' ', '-')}")
        seen[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda k: sorted((r.doc_id for r in seen[P.STAGES[k][0]]), key=str)
    assert ids(0) == sorted([1, 2, 3, 4, 7, 8, None], key=str)
    assert ids(1) == sorted([1, 3, 4, 7, 8, None], key=str)
    third = {r.doc_id: r for r in seen["suffix-array dedup"]}
    assert "mat and then it went" in third[1].text and "mat and then it went" not in third[3].text and "gently" in third[3].text
    assert ids(3) == sorted([1, 3, 4, 8, None], key=str)
    last = docs.withColumn("text", decode(spark, load_model(model_path()), "ids")).collect()
    assert {r.doc_id: r.text for r in last} == {r.doc_id: r.text for r in seen["benchmark decontamination"]} and all(r.round_trip for r in last)
    assert P.run(spark, d).count() == len(last)


def test_empty(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0


def test_extra_columns_and_repeated_rows(spark, tmp_path):
    d = f"file://{tmp_path}"
    odd = ["group_id", "kept", "found", "score", "ids", "key", "hash", "n_removed", "_found", "block"]
    rows = [(1, EN, "en"), (1, EN, "en"), (2, DE, "de"), (3, EN + " ", "en"), (4, "some other words in the garden of the school", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in odd)
    spark.createDataFrame([(i, t, lang, "s", len(t), *[f"{c}{i}" for c in odd]) for i, t, lang in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
            got = docs.collect()
            assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in odd), name
            seen[k] = sorted(r.doc_id for r in got)
    assert seen[0] == [1, 1, 2, 3, 4]
    # rows of one id are one document; the copy with a larger id goes
    assert all(seen[k] == [1, 1, 2, 4] for k in (1, 2, 3))
    assert docs.count() == 4
