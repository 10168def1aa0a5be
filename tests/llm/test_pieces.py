import os
import random

import pytest

from shelfline.llm import pieces as P

MODEL = P.model_path()
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


def every(model, s):
    if not s:
        yield 0.0, []
        return
    for k in range(1, min(len(s), model.longest) + 1):
        hit = model.scores.get(s[:k])
        edges = [([hit[0]], hit[1])] if hit else []
        if k == 1 and not hit:
            edges.append(([model.byte_ids[b] for b in s[0].encode()], model.unknown_score))
        for ids, score in edges:
            for rest, more in every(model, s[k:]):
                yield score + rest, ids + more


def test_n_best_against_all_segmentations():
    model, r = P.load_model(MODEL), random.Random(1)
    for _ in range(60):
        s = "".join(r.choice("▁thenigößé") for _ in range(r.randint(1, 9)))
        want = sorted((-x for x, _ in every(model, s)))[:4]
        got = P.n_best(model, s, 4)
        assert [-x for x, _ in got] == want
        assert len({tuple(i) for _, i in got}) == len(got)
        assert all((x, i) in list(every(model, s)) for x, i in got)


def test_text_level_n_best():
    model = P.load_model(MODEL)
    e = P.Encoder(model, 4)
    for t in ("the theing", "on on on", "a b\n  c", "thhe"):
        ids, score, others = next(iter(e.encode([t])))
        ids = list(ids)
        want = P.n_best(model, P.SPACE + t.replace(" ", P.SPACE), 4)
        whole = [(score, ids)]
        for s, edits in others:
            new, shift = list(ids), 0
            for at, n, i in edits:
                new[at + shift : at + shift + n] = i
                shift += len(i) - n
            whole.append((s, new))
        assert [s for s, _ in whole] == pytest.approx([s for s, _ in want])
        assert len({tuple(i) for _, i in whole}) == len(whole)


def test_round_trip(spark):
    model = P.load_model(MODEL)
    texts = ["", None, "Hello  world\n\n x ", " lead", "▁ odd ▁▁", "日本語 😀 ñß", "a" * 5000, "x\ty\r\n\0z", "Hello  world\n\n x "]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = df.withColumn("e", P.encode(spark, model, "text")).withColumn("back", P.decode(spark, model, "e.ids")).orderBy("doc_id").collect()
    assert [x.back for x in got] == [t or "" for t in texts]
    assert got[0].e.ids == [] and got[1].e.others == []
    assert df.limit(0).withColumn("e", P.encode(spark, model, "text")).count() == 0
    assert spark.createDataFrame([(None,), ([1, 99999, model.scores["▁Hello"][0]],)], "i array<int>").select(P.decode(spark, model, "i").alias("t")).collect()[1].t == "Hello"
