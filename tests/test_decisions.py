"""Decisions on small tables, and files of settings."""

import random

import pytest

from shelfline.operators import decisions as D
from shelfline.operators import rules as U
from shelfline.sources.settings import read_thresholds, write_csv, write_thresholds


def test_category_rules_equal_brute_force(spark):
    rng = random.Random(8)
    cats = {f"p{i}": f"c{i % 3}" for i in range(7)}
    baskets = {f"t{b}": {f"p{rng.randrange(8)}" for _ in range(rng.randrange(1, 5))} for b in range(60)}  # p7 has no category
    tx = spark.createDataFrame([(b, p) for b, ps in baskets.items() for p in ps], "transaction_id string, stockcode string")
    sets, n = U.frequent_itemsets(tx, 0.02, 3)
    rules = U.generate_rules(sets, n, 0.05)
    categories = spark.createDataFrame(list(cats.items()), "stockcode string, category string")
    got = {(r.antecedent_category, r.consequent_category): r for r in D.category_rules(rules, tx, categories).collect()}
    named = {b: {cats[p] for p in ps if p in cats} for b, ps in baskets.items()}
    known = [s for s in named.values() if s]
    want: dict = {}
    for r in rules.collect():
        side = lambda items: tuple(sorted(cats.get(i, "Unknown") for i in items))
        want.setdefault((side(r.antecedents), side(r.consequents)), []).append(r)
    assert set(got) == {(" + ".join(a), " + ".join(c)) for a, c in want}
    assert any(len(a) > 1 or len(c) > 1 for a, c in want) and any("Unknown" in a for a, _ in want)
    for (a, c), rs in want.items():
        g = got[" + ".join(a), " + ".join(c)]
        na, nc = (sum(set(x) <= s for s in known) for x in (a, c))
        both = sum(set(a) | set(c) <= s for s in known)
        assert g.rule_count == len(rs) and g.max_lift == pytest.approx(max(r.lift for r in rs))
        assert g.avg_lift == pytest.approx(both * len(known) / (na * nc) if na and nc else 1.0)
    assert D.category_rules(rules.limit(0), tx, categories).count() == 0


def listed(spark):
    rows = [("a", "x", "p1", 100.0, "high"), ("a", "x", "p2", 80.0, "medium"), ("b", "y", "p3", 60.0, "low"), ("b", "y", None, 0.0, "high"), ("b", "z", "p1", 5.0, None)]
    return spark.createDataFrame(rows, "area string, source string, subject string, value double, confidence string")


def insights(spark, rows=()):
    return spark.createDataFrame(list(rows), "area string, kind string, subject string, text string, value double, severity string")


def test_boards_of_opportunities(spark):
    risk = {(r.source, r.subject): r for r in D.opportunity_risk(listed(spark)).collect()}
    assert {k: r.quadrant for k, r in risk.items()} == {("x", "p1"): "do_now", ("x", "p2"): "test_first", ("y", "p3"): "test_first", ("y", None): "quick_win", ("z", "p1"): "watch"}
    cats = spark.createDataFrame([("p1", "c")], "stockcode string, category string")
    decisions = spark.createDataFrame([("p1", "invest"), ("p2", "insufficient_evidence")], "stockcode string, decision string")
    queue = D.action_queue(listed(spark), cats, decisions).orderBy("place").collect()
    assert [(r.priority, r.subject) for r in queue] == [("High", "p1"), ("Medium", "p2"), ("Low", "p3"), ("Low", "p1"), ("Low", None)]
    assert queue[0].next_action == "Implement recommended price change" and queue[1].next_action == "x" and queue[0].category == "c" and queue[1].category is None
    seen = insights(spark, [("a", "k", "q", "t", 400.0, "info"), ("c", "k", "p1", "t", None, "info")])
    first = D.priorities(listed(spark), seen, 3).orderBy("place").collect()
    assert [(r.type, r.subject) for r in first] == [("insight", "q"), ("opportunity", "p1"), ("opportunity", "p2")]
    funnel = {r.stage: r.n for r in D.portfolio_funnel(listed(spark), seen).collect()}
    assert funnel == {"signals": 7, "analysed": 5, "evidence_sufficient": 2, "opportunities": 5, "high_priority": 1}
    none = {r.stage: (r.n, r.share) for r in D.portfolio_funnel(listed(spark).limit(0), insights(spark)).collect()}
    assert set(none.values()) == {(0, 0.0)}


def test_eligibility_and_reliability(spark):
    tx = spark.createDataFrame([(f"t{i}", f"c{i % 60}", f"p{i % 12}") for i in range(150)], "transaction_id string, customer_id string, stockcode string")
    e = {r.analysis: r for r in D.eligibility(tx).collect()}
    assert all(r.is_eligible and r.blocked_by == "" for r in e.values()) and e["rules"].low_on == "baskets,products" and e["clv"].low_on == "baskets,customers"
    assert e["cdt"].min_products == 50 and e["promo"].min_products == 10
    assert {r.blocked_by for r in D.eligibility(tx.limit(0)).collect()} == {"baskets,customers,products"}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["high", "medium", "low", "insufficient", None, "odd"])], "i int, reliability string")
    got = {lv: [r.i for r in D.by_reliability(df, lv).orderBy("i").collect()] for lv in D.LEVELS}
    assert got == {"insufficient": [0, 1, 2, 3, 4, 5], "low": [0, 1, 2], "medium": [0, 1], "high": [0]}
    with pytest.raises(ValueError):
        D.by_reliability(df, "sure")


def test_customer_insights(spark):
    rows = [(f"c{i}", 0.9, 1.0) for i in range(18)] + [("gone", 0.1, 50.0), ("new", None, 100.0)]
    got = {r["kind"]: r.value for r in D.customer_insights(spark.createDataFrame(rows, "customer_id string, p_alive double, predicted_clv double")).collect()}
    assert got == {"at_risk": 50.0, "concentrated": pytest.approx(150 / 168)}
    assert D.customer_insights(spark.createDataFrame([], "customer_id string, p_alive double, predicted_clv double")).count() == 0


def test_settings_come_back(spark, tmp_path):
    path = str(tmp_path / "thresholds")
    write_thresholds(spark, {"lift": 1.5, "support": 0.01}, path)
    write_thresholds(spark, {"lift": 2, "support": 0.01}, path)
    assert read_thresholds(spark, path) == {"lift": 2.0, "support": 0.01}
    assert read_thresholds(spark, path, {"lift": 1.0, "confidence": 0.3}) == {"lift": 2.0, "support": 0.01, "confidence": 0.3}
    bad = tmp_path / "bad.json"
    bad.write_text("[1, 2]")
    with pytest.raises(Exception):
        read_thresholds(spark, str(bad))
    pretty = tmp_path / "pretty.json"
    pretty.write_text('{\n  "lift": 3.5,\n  "none": null\n}\n')
    assert read_thresholds(spark, str(pretty), {"none": 1.0}) == {"lift": 3.5, "none": 1.0}


def test_csv_comes_back(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', ["p", "q"]), (None, "line\nbreak", [])], "k string, v string, items array<string>")
    write_csv(df, str(tmp_path / "out"), one_file=True)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    assert {(r.k, r.v, r["items"]) for r in back.collect()} == {("a,b", 'say "x"', '["p","q"]'), (None, "line\nbreak", "[]")}


def test_lists_of_one_query_share_their_lines(spark, monkeypatch):
    """Opportunities and insights are made from the lines that signals has stored, not from files read again."""
    from shelfline.plans import decisions as P
    from shelfline.plans import opportunities as L

    given = []
    parts = ["cohort_insights", "basket_insights"]
    for name in parts:
        monkeypatch.setitem(P.QUERIES, name, lambda spark, sf_dir, tx=None: given.append(tx) or spark.createDataFrame([("a", "k", "s", "t", 1.0, "info")], L.FORM.replace(",", " string,").replace("value string", "value double") + " string"))
    monkeypatch.setattr(L, "INSIGHTS", parts)
    tx, one, two = P.signals(spark, "/root/testdata/sf0.001", "insight_list", "insight_list")
    assert one.count() == two.count() == 2 and len(given) == 4
    assert all(t is tx for t in given)
