import hashlib
import random
import re

import duckdb
import pytest

from shelfline.llm import pii as P


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text or "", re.ASCII) if ok(m[0])]


def card(rng, size=16, head="4"):
    d = head + "".join(rng.choice("0123456789") for _ in range(size - 1 - len(head)))
    return next(d + c for c in "0123456789" if luhn(d + c))


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f.g@h", "x@y@z.w a.b+c%d-e@f-g.h-i..j@k.l", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.255.0255 1.2.3", "ü😀 Mail: ö.x@y.zz😀 1.1.1.1",
    "+1 (683) 555-0123. +49 30 123 +1 2 +123456789012345 +1234567890123456 ++12345678 +(1)2345678 +1-----2345678- ",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 4111 1111 1111 1112 12 4111 1111 1111 1111", "IBAN DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819 X DE89 3704 0044 0532 0130 01",
    "BE68 5390 0754 7034 Then DE89 3704 0044 0532 0130 00 THE END", "my ssn 123-45-6789 is written here once, and then again after this part 123-45-6789; 666-12-3456 ssn", "amex card 378282246310005 or 378282246310005", "x" * 8_000 + "@" + "9" * 8_000, "1." * 4_000 + "a@" + "b." * 4_000,
    "a@b.cc " * 3_000, "+" + "5" * 8_000, "(" * 30_000, "-".join(["123"] * 9_000),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    signs = ["@", ".", "+", " ", "-", "1", "23", "255", "a", "b.", "é", "(", ")", "4111 1111 1111 1111", "é@é", "x@y.z", "1.1.1.1", "\n"]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [f"pay {card(rng, n)} now" for n in range(13, 21)]
    path = str(tmp_path_factory.mktemp("pii"))
    rows = [(i if i != 5 else None, t, "z", 1) for i, t in enumerate(texts)] + [(7, TEXTS[7], "z", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, found string, kind int").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_base_spans_equal_brute_force(spark, folder):
    path, rows = folder
    got = sorted(P.op11_pii(spark, path).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, text, *_) in zip(got, rows, strict=True):
        want = base(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text and text[:100]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in want) for k in ("email", "ip", "card", "phone"))
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")] == want
        for s in r.spans.split(","):
            if s.startswith("iban:"):
                b, e = map(int, s.split(":")[1:])
                assert mod97(text[b:e].replace(" ", "")) == 1


def test_checks_and_context(spark, folder):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)], "i int, text string, found string")
    got = {r.i: r for r in P.find_pii(df).collect()}
    cut = lambda i, kind: [TEXTS[i][x.start : x.end] for x in got[i].found if x.kind == kind]
    assert cut(9, "iban") == ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"]
    assert cut(10, "iban") == ["BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]
    assert cut(11, "ssn") == ["123-45-6789"] and got[11].found[0].start == 7
    assert len(cut(12, "card_short")) == 1
    assert not got[0].found and P.find_pii(df.limit(0)).count() == 0
    by = {r.text: r.found[0].score for r in P.find_pii(spark.createDataFrame([("email a@b.cc",), ("a@b.cc",), ("noreply: a@b.cc",)], "text string")).collect()}
    assert by["email a@b.cc"] > by["a@b.cc"] > by["noreply: a@b.cc"]


def test_against_sql(spark, folder):
    for d, glob in ((folder[0], "/*.parquet"), ("/root/testdata/sf0.001", "")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet{glob}'" + (" WHERE length(text) < 5000 OR text IS NULL" if glob else ""))
        rel = con.execute(P.OP11_SQL)
        names = [x[0] for x in rel.description]
        want = sorted(map(str, rel.fetchall()))
        docs = {r[1] for r in folder[1] if r[1] is None or len(r[1]) < 5000}
        query = P.op11_pii(spark, d)
        rows = [tuple(r[n] for n in names) for r in query.collect()]
        if glob:
            small = {r[0] for r in folder[1] if r[1] in docs}
            rows = [r for r in rows if r[0] in small]
        assert sorted(map(str, rows)) == want
