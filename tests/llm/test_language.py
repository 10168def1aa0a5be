import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import language as L

EN = "the cat sat on the mat and then it went out into the garden with the other cats "
DE = "der hund ging durch den garten und dann wieder zu dem haus in der kleinen strasse "
FR = "le chat est dans la maison avec les enfants qui jouent dans le jardin du voisin "


def test_mixture(spark):
    train = [(i, t * (1 + i % 3), lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 20)] + [(900, None, "en"), (901, EN, None)]
    model = L.fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    texts = [EN, DE, FR, EN * 3 + DE, None, "", "123 -- !", "…", "cat " * 20000, EN]
    df = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    got = [r.x for r in df.withColumn("x", L.identify(spark, model, "text")).orderBy("doc_id").collect()]
    assert [x.lang for x in got] == ["en", "de", "fr", "en", "und", "und", "und", "und", "en", "en"]
    assert [len(x.languages) for x in got[:4]] == [1, 1, 1, 2]
    assert abs(got[3].score - 0.75) < 0.1 and abs(sum(y.share for y in got[3].languages) - 1) < 1e-4
    assert df.limit(0).withColumn("x", L.identify(spark, model, "text")).count() == 0


def test_no_languages(spark):
    empty = L.fit_languages(spark.createDataFrame([], "text string, lang string"))
    df = spark.createDataFrame([(EN,)], "text string")
    assert df.select(L.identify(spark, empty, "text").alias("x")).first().x.lang == "und"


def test_held_out_accuracy(spark):
    got = L.op5_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9


def word_trigrams(text):
    """Buckets of the trigrams of each word, byte by byte."""
    inside = lambda b: b >= 128 or b == 39 or chr(b).isalpha()
    data, words, open_ = text.encode(), [], False
    for i, b in enumerate(data):
        if not inside(b):
            open_ = False
            continue
        if not open_:
            words.append([])
            open_ = True
        before, after = (data[j] if 0 <= j < len(data) and inside(data[j]) else 32 for j in (i - 1, i + 1))
        words[-1].append((((before << 16 | b << 8 | after) * 2654435761) % 2**32) >> 16)
    return words


def brute_mixture(rows, text):
    """The operator's estimate, word by word in plain Python."""
    names = sorted({lang for _, lang in rows})
    seen = {lang: Counter(g for t, x in rows if x == lang for w in word_trigrams(t) for g in w) for lang in names}
    total = {lang: sum(c.values()) for lang, c in seen.items()}
    log_p = lambda g, lang: math.log((seen[lang][g] + L.SMOOTHING) / (total[lang] + L.SMOOTHING * L.BUCKETS))
    like = []
    for w in word_trigrams(text):
        one = [sum(log_p(g, lang) for g in w) for lang in names]
        like.append([math.exp(x - max(one)) for x in one])

    def em(share, rounds):
        for _ in range(rounds):
            sums = [sum(p * s for p, s in zip(w, share, strict=True)) for w in like]
            value = sum(math.log(t) for t in sums)
            share = [sum(w[k] * share[k] / t for w, t in zip(like, sums, strict=True)) / len(like) for k in range(len(names))]
        return share, value

    cost = L.PENALTY * math.log(max(len(like), 2))
    share, value = em([1 / len(names)] * len(names), L.ROUNDS)
    best, best_value = share, value - cost * (len(names) - 1)
    for size in range(len(names) - 1, 0, -1):
        left = [s if s > 0 else math.inf for s in share]
        if sum(s > 0 for s in share) > size:
            last = max(k for k, s in enumerate(left) if s == min(left))
            share = [0.0 if k == last else s for k, s in enumerate(share)]
        share = [s / sum(share) for s in share]
        share, value = em(share, L.AGAIN if size > 1 else 1)
        if value - cost * (size - 1) > best_value:
            best, best_value = share, value - cost * (size - 1)
    return dict(zip(names, best, strict=True))


def test_mixture_equals_brute_force(spark):
    rows = [(EN, "en"), (DE, "de"), (FR, "fr"), (EN[::-1], "xx"), ("l\u2019\u00e9t\u00e9 d'un na\u00eff", "fr")] * 2
    model = L.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    e, d, f = EN.split(), DE.split(), FR.split()
    texts = [EN, DE + FR, " ".join(e[:6] + d[:6] + f[:6]), "cat", "hund cat", EN * 5 + "der hund", "na\u00efve caf\u00e9 l'eau 42 d'or", "q z q z 9", " ".join(e[i % 9] + d[i % 7] for i in range(40))]
    got, has = L.shares(model, pa.chunked_array([pa.array(texts)]))
    assert has.all()
    for text, share in zip(texts, got, strict=True):
        want = brute_mixture(rows, text)
        assert {lang: float(s) for lang, s in zip(model.languages, share, strict=True)} == pytest.approx(want, abs=2e-3), text


def test_ties_go_to_the_name_that_sorts_first(spark):
    model = L.fit_languages(spark.createDataFrame([(EN, "b"), (EN, "a")], "text string, lang string"))
    assert spark.createDataFrame([(EN,)], "text string").select(L.identify(spark, model, "text").alias("x")).first().x.lang == "a"
