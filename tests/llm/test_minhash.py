import collections
import math
import random
import re

import numpy as np

from shelfline.llm import minhash as M


def brute(rows, threshold=0.8):
    """Weighted Jaccard of all pairs of different texts, then groups."""
    first = {}
    for d, t in sorted((d, t or "") for d, t in rows if d is not None):
        first.setdefault(d, t)
    words = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in first.items()}
    same = {}
    for d in sorted(first):
        same.setdefault(tuple(words[d]) or ("raw", first[d]), []).append(d)
    shingles = {c[0]: collections.Counter(tuple(words[c[0]][i : i + 5]) for i in range(max(1, len(words[c[0]]) - 4))) for c in same.values() if words[c[0]]}
    df = collections.Counter(s for c in same.values() if c[0] in shingles for s in shingles[c[0]] for _ in c)
    n = len([1 for d, _ in rows if d is not None])
    weight = {d: {s: c * (1 + M.IDF_GAIN * math.log((n + 1) / (2 ** (round(8 * math.log2(df[s])) / 8) + 1)) / math.log(n + 1)) for s, c in x.items()} for d, x in shingles.items()}
    root = {d: d for d in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for c in same.values():
        for d in c:
            root[d] = c[0]
    links, ids = set(), sorted(weight)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = sum(min(w, weight[b][s]) for s, w in weight[a].items() if s in weight[b])
            j = common / (sum(weight[a].values()) + sum(weight[b].values()) - common)
            if j >= threshold:
                links.add((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in first}, links


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, d = [], 0
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 200))]
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((d, " ".join(t).title() + "."))
            d += r.randint(1, 3)
    rows += [(1000, ""), (1001, None), (1002, "..."), (1003, "one two"), (1004, "One, two!"), (1005, "w " * 3000), (1006, "w " * 3000 + "w"), (rows[0][0], "zzz other text of the same id"), (None, rows[1][1])]
    return rows


def test_against_brute_force(spark):
    for seed, block in ((1, 1 << 20), (2, 4000)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, block int, group_id int")
        groups, links = M.near_duplicates(df, block_bytes=block)
        want, want_links = brute(rows)
        assert {x.doc_id: x.group_id for x in groups.collect()} == want
        assert {(x.a, x.b) for x in links.collect()} <= want_links


def test_samples_agree_as_jaccard():
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    w = r.random(300) + 0.5
    a, b = np.arange(0, 220), np.arange(60, 300)
    hit = [M.samples(np.concatenate([h[a], h[b]]) ^ np.uint64(k << 3), np.log(np.concatenate([w[a], w[b] * 1.1])).astype(np.float32), np.array([0, len(a), len(a) + len(b)])) for k in range(40)]
    agree = np.mean([x[0] == x[1] for x in hit])
    common = np.minimum(w[60:220], w[60:220] * 1.1).sum()
    assert abs(agree - common / (w[a].sum() + 1.1 * w[b].sum() - common)) < 0.04


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def star(n):
    """One base document and n copies with edits of their own, each about 0.84 to the base and 0.71 to another copy."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    rows = [(n // 2, " ".join(base))]
    for d in [k for k in range(n + 1) if k != n // 2]:
        t = list(base)
        for k in r.sample(range(10, 290, 8), 5):
            t[k] = f"own{d}x{k}"
        rows.append((d, " ".join(t)))
    return rows


def test_all_links_of_a_star(spark, monkeypatch):
    rows = star(200)
    want, want_links = brute(rows)
    assert len(set(want.values())) == 1 and len(want_links) < 2000
    for cell in (M.CELL, 20 * 424):
        monkeypatch.setattr(M, "CELL", cell)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        groups, links = M.near_duplicates(df, every_link=True)
        found = {(x.a, x.b) for x in links.collect()}
        assert found <= want_links and len(found) >= 0.995 * len(want_links)
        got = groups.collect()
        assert sum(x.n_links for x in got) == 2 * len(found)
        assert {x.doc_id: x.group_id for x in got} == want
        groups, links = M.near_duplicates(df)
        assert {x.doc_id: x.group_id for x in groups.collect()} == want
        assert {(x.a, x.b) for x in links.collect()} <= want_links


def chains(n):
    """Chains in which only neighbours are near, all of one large text with common stretches: no document is near to most others."""
    r = random.Random(6)
    base = [f"b{k}" for k in range(240)]
    rows = []
    for c in range(4):
        t = list(base)
        for d in range(n):
            rows.append((1000 * c + 7 * d % n, " ".join(t)))
            for k in r.sample(range(10, 230, 8), 3):
                t[k] = f"own{c}x{d}x{k}"
    return rows


def test_groups_of_chains(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 4000)
    rows = chains(30)
    want, _ = brute(rows)
    assert {x.doc_id: x.group_id for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()} == want
