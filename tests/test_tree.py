import math
import random
from collections import Counter

import pytest

from shelfline.operators import tree as T

NAMES = ["a", "b", "c"]


def entropy(values):
    n = len(values)
    return -sum(k / n * math.log2(k / n) for k in Counter(values).values()) if n else 0.0


def gini(values):
    n = len(values)
    return 1 - sum((k / n) ** 2 for k in Counter(values).values()) if n else 0.0


def best(products, attrs, groups, used, least, impurity):
    found = None
    for place, name in enumerate(NAMES):
        if name in used:
            continue
        have = [p for p in products if attrs[p].get(name) is not None]
        sizes = Counter(attrs[p][name] for p in have)
        if sum(n >= least for n in sizes.values()) < 2:
            continue
        known = [p for p in have if groups.get(p) is not None]
        if not known:
            continue
        left = sum(impurity([groups[p] for p in known if attrs[p][name] == v]) * sum(attrs[p][name] == v for p in known) for v in sizes)
        gain = round(impurity([groups[p] for p in known]) - left / len(known), 9)
        if gain > 0.01 and (found is None or gain > found[0]):
            found = (gain, name, {v: [p for p in have if attrs[p][name] == v] for v, n in sizes.items() if n >= least})
    return found


def grow(products, attrs, groups, least, deepest, impurity, node="all", used=(), depth=0):
    split = best(products, attrs, groups, used, least, impurity) if depth < deepest and len(products) >= least else None
    out = {node: (depth, len(products), split and split[1], split and split[0])}
    for v, ps in (split[2] if split else {}).items():
        out |= grow(ps, attrs, groups, least, deepest, impurity, f"{node}/{split[1]}={v}", (*used, split[1]), depth + 1)
    return out


@pytest.mark.parametrize("criterion", ["entropy", "gini"])
def test_tree_equals_brute_force(spark, criterion):
    rng = random.Random(9)
    attrs, groups = {}, {}
    for i in range(140):
        p = f"p{i:03d}"
        attrs[p] = {"a": rng.choice("xyz"), "b": rng.choice("uv") if i % 11 else None, "c": rng.choice("klmnopq")}
        groups[p] = rng.choice([attrs[p]["a"], attrs[p]["a"] + str(attrs[p]["b"]), "rest"]) if i % 13 else None
    df = spark.createDataFrame([(p, v["a"], v["b"], v["c"], 1) for p, v in attrs.items()] + [("p000", *[attrs["p000"][n] for n in NAMES], 1), (None, "x", "u", "k", 1)], "stockcode string, a string, b string, c string, size int")
    nodes, members = T.grow_tree(df, spark.createDataFrame(list(groups.items()), "stockcode string, group string"), NAMES, 3, 3, criterion, resamples=10)
    want = grow(sorted(attrs), attrs, groups, 3, 3, entropy if criterion == "entropy" else gini)
    got = {r.node: r for r in nodes.collect()}
    assert {n: (r.depth, r.size, r.attribute) for n, r in got.items()} == {n: w[:3] for n, w in want.items()}
    assert all(abs((r.split_score or 0) - (want[n][3] or 0)) < 1e-6 for n, r in got.items())
    assert {r["node"] for r in members.select("node").distinct().collect()} == set(want) and len(want) > 6
    # the root's split is clear, so resamples choose it too
    assert got["all"].split_stability >= 0.8
    assert all(r.split_stability is None for r in got.values() if r.size < T.RESAMPLED and not r.is_leaf)


def test_similarity_pruning_scores_and_odd_inputs(spark):
    rows = [(f"p{i}", "x" if i < 6 else "y", "u" if i % 2 else "v") for i in range(12)]
    df = spark.createDataFrame(rows, "stockcode string, a string, b string")
    groups = spark.createDataFrame([(p, a) for p, a, _ in rows], "stockcode string, group string")
    nodes, members = T.grow_tree(df, groups, ["a", "b"], 3, 2, resamples=0)
    pairs = spark.createDataFrame([("p0", "p1", 0.9), ("p1", "p2", 0.6), ("p7", "p9", 3.0)], "a string, b string, similarity double")
    sims = {r.node: r.similarity_within for r in T.within_similarity(members, pairs).collect()}
    assert abs(sims["all/a=x"] - 1.5 / 15) < 1e-9 and abs(sims["all/a=y"] - 3 / 15) < 1e-9
    nodes = nodes.join(T.within_similarity(members, pairs), "node")
    assert {r.node: r.is_leaf for r in T.prune_tree(nodes, 0.12).collect()} == {"all": False, "all/a=x": True, "all/a=y": True}
    cutback = T.prune_tree(nodes, 0.5).collect()
    assert [(r.node, r.is_leaf, r.attribute) for r in cutback] == [("all", True, None)]
    scores = {r.metric: r.value for r in T.tree_scores(nodes).collect()}
    assert scores == {"n_nodes": 3, "n_leaves": 2, "depth": 1, "mean_leaf_similarity": pytest.approx(0.15), "products_covered": 12}
    assert [r.attribute for r in T.attribute_importance(nodes).collect()] == ["a"]
    assert "Shoppers split by a" in {r.rule for r in T.rules_of(nodes).collect()}
    none, nobody = T.grow_tree(df.limit(0), groups, ["a", "b"])
    assert none.count() == nobody.count() == 0
