import random
import re
import zlib
from collections import Counter

import duckdb

from shelfline.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n, times=2):
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] and n[best] > n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] is not None else None))
    return out


def grouped(spark, rows):
    df = spark.createDataFrame([(w, n, 7) for w, n in rows], "word string, n long, form int")
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.group_variants(df).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))): rng.randint(1, 60) for _ in range(260)}
    assert grouped(spark, words.items()) == expected(words)


def test_long_words_chains_and_odd_rows(spark):
    rng = random.Random(4)
    long = ["".join(rng.choice("xyz") for _ in range(k)) for k in (31, 32, 33, 34, 40, 2000)]
    words = {"aaaa": 1, "aaab": 2, "aabb": 4, "abbb": 9, "bbbb": 40, "": 3, "q": 7, "aaaaa": 1, "aaa": 1}
    for i, w in enumerate(long):
        for p in {0, 5, 30, 31, 32, 33, len(w) - 1}:
            if p < len(w):
                words |= {w: 50 + i, w[:p] + w[p + 1 :]: 3, w[:p] + "ü" + w[p + 1 :]: 5, w[:p] + "😀" + w[p:]: 200}
    assert grouped(spark, words.items()) == expected(words)
    odd = [(None, 4), ("twice", 2), ("twice", 3), ("twine", None)]
    assert grouped(spark, odd) == {("twice", None, "twice", 5, 1, None), ("twine", "twice", "twice", 0, 1, 5)}
    assert grouped(spark, []) == set() and grouped(spark, [("", 1)]) == {("", None, "", 1, 0, None)}
    assert grouped(spark, [("tie", 1), ("tib", 5), ("tia", 5)]) == {("tie", "tia", "tia", 1, 2, 5), ("tib", None, "tib", 5, 2, None), ("tia", None, "tia", 5, 2, None)}


DOCS = [(1, "Hello hello HELLO hellos hellos, ÉTÉÉÉ étééé"), (2, None), (None, "jello jello jello x×÷×÷ x×÷×÷ x×÷×÷"), (3, ""), (1, "hello " * 30), (4, "9" * 50 + "z" * 40_000), (-5, "hellos cello cello cello")] + [(i, "fable table tables hello wordy") for i in range(10, 400)]


def test_words_of_documents(spark, tmp_path):
    n = Counter()
    for i, t in DOCS:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    assert len(words) > 8
    spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, word int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.op13_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == expected(words)


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rel = con.execute(S.OP13_SQL)
    names = [x[0] for x in rel.description]
    want = sorted(map(str, rel.fetchall()))
    assert len(want) > 100
    assert sorted(str(tuple(r[n] for n in names)) for r in S.op13_spelling_variants(spark, "/root/testdata/sf0.001").collect()) == want
