import base64
import gzip
import hashlib

from shelfline.llm import warc as W

PAGES = [
    (5, "http://a.b/c?d#e", "<html>x</html>"), (3, None, "<html>x</html>"), (9, "http://h\r\nX: y/", None), (2, "no scheme", ""), (7, "http://a", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\né😀"),
    (8, "http://a", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\né😀"), (11, "http://long", "z" * 300000), (12, "http://dup", "dup"), (12, "http://dup", "dup"),
]


def expected(pages):
    first = {}
    for p, _, h in sorted(pages, key=lambda x: x[0]):
        first.setdefault(h or "", p)
    out, done = [], set()
    for p, _, h in pages:
        raw = (h or "").encode()
        f = first[h or ""]
        new = f == p and f not in done
        done.add(p)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if new else "revisit", None if new else f))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, record_id string, type int")
    df.write.parquet(f"file://{tmp_path}/pages.parquet")
    got = W.op9_warc(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(PAGES) and len(got) == 9
    assert W.assemble(W.read_warc(spark, _written(spark, df.limit(0), tmp_path / "none"))).count() == 0


def _written(spark, df, path):
    W.write_warc(W.captures(df), f"file://{path}")
    return f"file://{path}"


def test_payloads_and_standard_files(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = _written(spark, df, tmp_path / "w")
    rows = W.assemble(W.read_warc(spark, path)).collect()
    assert sorted(bytes(r.response.payload).decode() for r in rows if r.response.type == "response") == sorted({h or "" for _, _, h in PAGES})
    assert all(r.request and r.metadata and r.response.digest_ok is not False for r in rows)
    one = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n"
    records = [one % (b"warcinfo", 0, b"", 2, b"hi"), one % (b"response", 1, b"", 5, b"plain"), one % (b"request", 2, b"WARC-Concurrent-To: <urn:1>\r\n", 3, b"GET"), one % (b"metadata", 3, b"WARC-Concurrent-To: <urn:9>\r\n", 1, b"m"), b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut"]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = {r.record_id: r for r in W.assemble(W.read_warc(spark, f"file://{tmp_path}/other")).collect()}
    assert set(got) == {"<urn:1>", "<urn:9>"} and got["<urn:9>"].response is None
    assert bytes(got["<urn:1>"].response.payload) == b"plain" and got["<urn:1>"].request.block == "GET"


def test_pieces_of_any_size(monkeypatch):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bodies = [b"", b"a" * 70, b"WARC/1.0\r\n\r\n" * 9, bytes(range(256))]
    plain = b"".join(record % (len(b), b) for b in bodies)
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(W, "PIECE", size)
        for file in (plain, gzip.compress(plain), b"".join(gzip.compress(record % (len(b), b)) for b in bodies)):
            assert [r["_block"] for r in W.parse_records(W.pieces(file))] == bodies
