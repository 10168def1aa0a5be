import hashlib
import random
import zlib

import numpy as np

from shelfline.llm import suffix_dedup as S
from shelfline.llm.suffix_dedup import suffix_dedup


def brute(rows, length=50):
    """Marks every byte of every string that a smaller id holds; quadratic."""
    data = [(d if d is not None else 1 << 62, (t or "").encode()) for d, t in rows]
    out = []
    for d, t in data:
        older = {x[i : i + length] for e, x in data if e < d for i in range(len(x) - length + 1)}
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if t[i : i + length] in older:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if d == 1 << 62 else d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passage = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = " ".join(r.choice([word(), word(), r.choice(passage)]) for _ in range(r.randint(0, 30)))
        rows.append((r.randint(0, 80), t))
    base = rows[3][1]
    rows += [(i + 100, base[: i * 3] + "X" + base[i * 3 + 1 :]) for i in range(20)]
    rows += [(None, base), (5, None), (6, ""), (7, "a" * 400), (300, "a" * 130), (301, "ab" * 100), (302, passage[0]), (302, passage[0])]
    return rows


def test_against_brute_force(spark):
    for seed, block in ((1, 1 << 20), (2, 3000), (3, 700)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, n_bytes string")
        got = suffix_dedup(df, block_bytes=block).collect()
        assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got], key=str) == brute(rows)


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_are_suffix_arrays(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 7)
    r = random.Random(8)
    for length in (3, 5):
        family, older, d = S.SuffixFamily(length), {}, 0
        for _ in range(30):
            texts = []
            for _ in range(r.randint(1, 6)):
                d += r.randint(0, 1)
                texts.append((d, bytes(r.choice(b"ab\x00") for _ in range(r.randint(length, 20)))))
            data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
            ends = np.cumsum([len(t) for _, t in texts])
            starts = np.concatenate([np.arange(e - len(t), e - length + 1) for e, (_, t) in zip(ends, texts)])
            ids = np.concatenate([np.full(len(t) - length + 1, i) for i, t in texts])
            strings = [data[a : a + length].tobytes() for a in starts]
            for i, s in zip(ids.tolist(), strings):
                older[s] = min(i, older.get(s, i))
            assert family.take(data, starts, ids).tolist() == [older[s] < i for s, i in zip(strings, ids.tolist())]
            held = []
            for level in family.levels:
                own = [level.text[a : a + length].tobytes() for a in level.starts]
                assert own == sorted(set(own)) and [older[s] for s in own] == level.ids.tolist()
                held += own
            assert sorted(held) == sorted(older)
            sizes = [len(x) for x in family.levels]
            assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_equal_names_of_different_texts_are_compared(spark, monkeypatch):
    monkeypatch.setattr(S.K, "span_hash", lambda s, a, b: np.zeros(len(a), np.uint64) + np.uint64(1 << 40))
    import pyarrow as pa

    texts = [bytes([65 + i]) * 60 for i in range(3)] * 2
    runs = S.Runs(pa.table({"doc_id": pa.array(range(6)), "text": pa.array(texts)}), 50, 16)
    found = S._candidates(runs, pa.table({"shard": pa.array([], pa.int64()), "data": pa.array([], pa.binary())}), 1, 50, 16)
    rows = S._send_strings(0, runs, found, 50).to_pylist()
    spans = np.frombuffer(zlib.decompress(rows[0]["data"]), np.int64).reshape(-1, 2)
    cut = {k for a, b in spans for k in range(a // 60, -(-b // 60))}
    assert rows[0]["shard"] == -1 and cut <= {3, 4, 5}
