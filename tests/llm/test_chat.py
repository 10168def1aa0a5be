import duckdb

from shelfline.llm import chat as C

ROWS = [
    (1, 0, "system", "be & nice"), (1, 2, "assistant", "<|end|>\nhi"), (1, 1, "user", "&lt; <|user|>\n"),
    (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 5, None, ""), (4, None, "us>er|>\n", "x&amp;"), (4, 1, "user", "é😀<"),
    (5, 0, "user", "a"), (5, 0, "user", "a"), (6, 0, "user", "long " * 30000), (6, 1, "assistant", "ok"), (None, 0, "user", "lost"), (7, 0, "user", "q"), (7, 1, "system", "s"),
]


def test_round_trip_and_states(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in C.format_chats(df).withColumn("back", C.read_back(C.F.col("formatted"))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in ROWS if k == c))
        assert [(x.role, x.text) for x in r.back] == [(role, text) for _, _, role, text in own]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}
    assert (got[2].error_at, got[5].error_at, got[7].error_at) == (0, 1, 1)
    assert [s.loss for s in got[1].segments] == [False] * 7 + [True, False]
    assert C.format_chats(df.limit(0)).count() == 0


def test_against_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for d, glob in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.001", "")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet{glob}'")
        rel = con.execute(C.OP8_SQL)
        names = [x[0] for x in rel.description]
        want = sorted(rel.fetchall())
        assert sorted(tuple(r[n] for n in names) for r in C.op8_chat(spark, d).collect()) == want
